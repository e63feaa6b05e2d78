"""Sequences, samples, budgets and logs derived from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.functions import images as im
from seqlattice.operators.budgets import Rule
from seqlattice.sources.scratch import scratch_path

RULE = Rule(0.8, ((-0.6, -0.08, 100), (-0.08, -0.02, 81), (-0.02, 0.04, 49), (0.04, 0.6, 9)))
#: Interval rows of three schemes: the rule above, a coarser one, and one whose budgets rise.
SCHEMES = [("base", 0.8, a, b, float(n)) for a, b, n in RULE.intervals] + [
    ("coarse", 0.5, -0.6, 0.0, 80.5), ("coarse", 0.5, 0.0, 0.6, None), ("rising", 0.8, -0.6, 0.0, 49.0), ("rising", 0.8, 0.0, 0.6, 81.0)]
SCHEME_SCHEMA = "scheme string, alpha double, tsim_left double, tsim_right double, budget double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Runs of a label from the 1,000th on have ids from WIDE + label * WIDE_STEP, as label * 1000 would run into the next label's.
WIDE, WIDE_STEP = 1 << 62, 1 << 30


def label_of(seq_id: Column) -> Column:
    return F.when(seq_id < WIDE >> 1, F.floor(seq_id / 1000)).otherwise(F.shiftright(seq_id - WIDE, 30))


#: Ids of a block in which a label's vectors are numbered.
BLOCK_IDS = 1024


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """The embeddings with their place ``rn`` in their label, by ``vec_id`` (the table's key), and that place: counts of the blocks of ids before,
    and the number in the block, so no task holds a label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.floor(F.col("vec_id") / BLOCK_IDS).alias("block"))
    counts = e.groupBy(F.col("label").alias("of"), F.col("block").alias("of_block")).agg(F.count("*").alias("n"))
    before = counts.select("of", "of_block", (F.sum("n").over(Window.partitionBy("of").orderBy("of_block")) - F.col("n")).alias("before"))
    own = e.withColumn("at", F.row_number().over(Window.partitionBy("label", "block").orderBy("vec_id")) - 1)
    return own.join(before, F.col("label").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))), F.col("before") + F.col("at")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written down once for the plans that read it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, vec_id, label, vector): eight vectors of one label after another make a sequence."""
    v, rn = _placed(spark, sf_dir)
    label, run = F.col("label").cast("long"), F.floor(rn / 8)
    seq_id = F.when(run < 1000, label * 1000 + run).otherwise(F.lit(WIDE) + label * WIDE_STEP + run)
    return written(v.select(seq_id.alias("seq_id"), (rn % 8).cast("int").alias("pos"), "vec_id", "label", F.col("embedding").alias("vector")), "states")


def long_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, vector): all vectors of a label in one sequence, 400 at a time, by ``vec_id``."""
    v, rn = _placed(spark, sf_dir)
    seq_id = F.col("label").cast("long") * WIDE_STEP + F.floor(rn / 400)
    return written(v.select(seq_id.alias("seq_id"), (rn % 400).cast("int").alias("pos"), F.col("embedding").alias("vector")), "long-states")


SEQ_SQL = f"""
v as (select label, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 rn from embeddings),
s as (select (case when rn // 8 < 1000 then label * 1000 else {WIDE} + label * {WIDE_STEP}::bigint end + rn // 8)::bigint as seq_id, (rn % 8)::int as pos, vec_id, label, embedding::double[] as e from v)"""
LABEL_SQL = f"(case when seq_id < {WIDE >> 1} then seq_id // 1000 else (seq_id - {WIDE}) >> 30 end)"
LONG_SEQ_SQL = f"""
v as (select label, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 rn from embeddings),
s as (select (label::bigint * {WIDE_STEP} + rn // 400)::bigint as seq_id, (rn % 400)::int as pos, embedding::double[] as e from v)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message sample a conversation; the first turn's image of every sixth is left out of the image lists."""
    c = table(spark, sf_dir, "conversations")
    image = F.concat(F.when(F.col("role") == "user", F.lit("input")).otherwise(F.lit("output")), F.lit("_image_"), F.col("turn").cast("string"))
    m = c.withColumn("image", image).withColumn("path", F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".jpg")))
    m = m.withColumn("listed", ~((F.col("turn") == 1) & (F.col("conv_id") % 6 == 0)))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.concat(F.lit("<"), F.col("image"), F.lit("> "), F.col("text")).alias("content"), "image", "path", "listed")))
    one = m.groupBy("conv_id").agg(turns.alias("turns"))
    side = lambda kind: F.transform(F.filter("turns", lambda t: t["listed"] & t["image"].startswith(kind)), lambda t: F.struct(t["image"].alias("id"), t["path"].alias("path")))
    return one.select("conv_id", F.col("conv_id").cast("string").alias("id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"), side("input").alias("input_images"), side("output").alias("output_images"))


MSG_SQL = r"""
m as (
  select conv_id, turn, role, text, (case role when 'user' then 'input' else 'output' end) || '_image_' || turn as img,
         'img/' || conv_id || '_' || turn || '.jpg' as path, not (turn = 1 and conv_id % 6 = 0) as listed from conversations),
toks as (
  select conv_id, flatten(list(regexp_extract_all('<' || img || '> ' || text, '<([A-Za-z0-9_]+)>', 1) order by turn)) as tokens,
         flatten(list(regexp_extract_all('<' || img || '> ' || text, '<(input_image_\d+|output_image_\d+)>', 1) order by turn)) as strict_tokens from m group by 1),
tk as (select conv_id, unnest(strict_tokens) as token, unnest(range(len(strict_tokens))) as k from toks),
res as (
  select tk.conv_id, list(m.path order by k) filter (where m.path is not null) as paths, min(k) filter (where m.path is null) as first_missing, list(token order by k) as strict
  from tk left join m on m.conv_id = tk.conv_id and m.img = tk.token and m.listed group by 1)"""


def budget_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_paths, num_tokens, ord): budgets for four in five sequences; some twice (the later wins), some null."""
    samples = messages(spark, sf_dir)
    paths = im.resolve_images(im.image_tokens(F.col("messages"), im.NUMBERED_TOKEN), im.image_map(F.col("input_images"), F.col("output_images")))
    base = samples.where("conv_id % 5 <> 0").withColumn("img_paths", paths)
    given = F.transform("img_paths", lambda p, i: F.when(i == 0, F.lit(144)).otherwise(9 * (1 + i % 3)).cast("int"))
    base = base.withColumn("num_tokens", F.when(F.col("conv_id") % 13 != 0, given))
    again = base.where("conv_id % 11 = 0").withColumn("num_tokens", F.transform("num_tokens", lambda b: b + 1)).withColumn("ord", F.lit(1))
    return base.withColumn("ord", F.lit(0)).unionByName(again).select("conv_id", "img_paths", "num_tokens", "ord")


TOK_SQL = MSG_SQL + """,
tok as (
  select conv_id, paths, case when conv_id % 13 <> 0 then list_transform(range(len(paths)), lambda i: (case when i = 0 then 144 else 9 * (1 + i % 3) end) + (case when conv_id % 11 = 0 then 1 else 0 end)) end as num_tokens
  from res where conv_id % 5 <> 0 and paths is not null),
merged as (
  select r.conv_id, r.paths, case when r.first_missing is not null then 'Missing image id: ' || r.strict[r.first_missing + 1] end as error,
         case when r.first_missing is null then t.num_tokens end as num_tokens, t.conv_id is not null as found
  from res r left join tok t on t.conv_id = r.conv_id)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, config, input_prompt, output_text, model_output_text, _global_idx): answers are languages."""
    d = table(spark, sf_dir, "documents")
    tail = lambda lang: F.concat(F.col("text"), F.lit("\n\nFinal Answer: "), lang)
    wrong = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("lang"), F.lit("x"))).otherwise(F.col("lang"))
    return d.select("doc_id", F.col("source").alias("config"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("input_prompt"),
                    F.when(F.col("doc_id") % 6 == 0, F.col("text")).otherwise(tail(F.col("lang"))).alias("output_text"), tail(wrong).alias("model_output_text"), F.col("doc_id").alias("_global_idx"))


ANS_SQL = r"""
ans as (
  select doc_id, source as config, case when doc_id % 6 = 0 then text else text || E'\n\nFinal Answer: ' || lang end as output_text,
         text || E'\n\nFinal Answer: ' || (case when doc_id % 4 = 0 then lang || 'x' else lang end) as model_output_text from documents),
rows as (
  select doc_id as _global_idx, config, 'q' || doc_id as question,
         case when position(E'\n\nFinal Answer:' in output_text) > 0 then trim(substr(output_text, position(E'\n\nFinal Answer:' in output_text) + 15), E' \n\t\r') end as gt,
         case when position(E'\n\nFinal Answer:' in model_output_text) > 0 then trim(substr(model_output_text, position(E'\n\nFinal Answer:' in model_output_text) + 15), E' \n\t\r') end as pred
  from ans)"""


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id < 64").select(F.col("vec_id").alias("code"), F.col("embedding").alias("vec"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id >= 64").select("vec_id", "label", F.col("embedding").alias("vector"))


CODE_SQL = """
norm as (select vec_id, label, list_transform(embedding::double[], lambda x: x / greatest(sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))), 1e-12)) as u from embeddings),
gaps as (
  select a.vec_id, a.label, b.vec_id as code, round(list_sum(list_transform(range(1, len(a.u) + 1), lambda i: (a.u[i] - b.u[i]) * (a.u[i] - b.u[i]))), 12) as d
  from norm a, norm b where a.vec_id >= 64 and b.vec_id < 64),
near as (select vec_id, any_value(label) as label, arg_min(code, (d, code)) as code, min(d) as d from gaps group by 1)"""


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.lit(64) + F.col("p_size") * 20).cast("int").alias("h"), (F.lit(64) + (F.col("p_partkey") % 50) * 30).cast("int").alias("w"))


IMG_SQL = "img as (select p_partkey, (64 + p_size * 20)::int as h, (64 + (p_partkey % 50) * 30)::int as w from part)"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("benchmark"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
                    F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("rank"), F.array_repeat(F.lit(9), (F.col("event_id") % 3).cast("int")).alias("tokens"))
