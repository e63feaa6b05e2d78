"""Queries that write derived data in a source's format and read it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.operators import merging as mg
from seqlattice.plans import fixtures as fx
from seqlattice.plans.queries import MERGED_SQL, _budgets, _merged, _parts, joined, query
from seqlattice.sources.scratch import scratch_path
from seqlattice.sources import io

#: Ids, or rows, that a written file holds at most: files grow in number, not in size.
FILE_IDS = 1000
TURNS = "conv_id long, turn long, role string, text string"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).withColumn("g", F.struct(*[F.floor(F.col(c) / FILE_IDS).alias(c) for c in ("conv_id", "turn")]))


def _array_file(df: DataFrame, path: str, by: str) -> str:
    """One JSON array a group, each a text row with a file of its own."""
    rows = df.groupBy(by).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    rows.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return path


@query("s1_read_jsonl", "select conv_id, turn, role, text from conversations")
def s1(spark, sf):
    path = scratch_path(spark, "jsonl")
    _turns(spark, sf).write.json(path)
    return io.read_jsonl(spark, path, TURNS)


@query("s1_bad_lines", "select 'turn=' || turn % 3 as folder, count(*) filter (where conv_id % 9 = 4) as n, coalesce(sum(conv_id) filter (where conv_id % 9 = 4), 0)::bigint as ids, coalesce(sum(rn) filter (where conv_id % 9 = 4), 0)::bigint as lines from (select *, 2 * row_number() over (partition by turn % 3 order by conv_id, turn) as rn from conversations) group by 1")
def s1_bad(spark, sf):
    """Every ninth conversation's lines are broken; a blank line stands before each line."""
    t = fx.table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("third"))
    good = F.to_json(F.struct("conv_id", "turn"))
    text = F.concat(F.lit("\n"), F.when(F.col("conv_id") % 9 == 4, F.concat(F.lit("{"), F.col("conv_id").cast("string"))).otherwise(good))
    path = scratch_path(spark, "bad-lines")
    t.select(text.alias("value"), "third", "conv_id", "turn").repartition("third").sortWithinPartitions("third", "conv_id", "turn").select("value", F.col("third").alias("turn")).write.partitionBy("turn").text(path)
    bad = io.bad_lines(spark, path, "conv_id long, turn long").select(F.regexp_extract("path", r"(turn=\d+)", 1).alias("folder"), "line", F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("conv_id"))
    folders = t.select(F.concat(F.lit("turn="), F.col("third").cast("string")).alias("folder")).distinct()
    return folders.join(bad, "folder", "left").groupBy("folder").agg(F.count("line").alias("n"), F.coalesce(F.sum("conv_id"), F.lit(0)).alias("ids"), F.coalesce(F.sum("line"), F.lit(0)).alias("lines"))


@query("w10_read_position", "select doc_id, (row_number() over (order by doc_id) - 1)::bigint as position from documents")
def w10_read(spark, sf):
    """Places of rows as they are read from files that were written in order."""
    path = scratch_path(spark, "in-order")
    fx.table(spark, sf, "documents").select("doc_id").orderBy("doc_id").write.parquet(path)
    return io.read_positions(spark, path)


@query("s2_read_json_array", "select conv_id, turn, role, text from conversations")
def s2(spark, sf):
    path = _array_file(_blocks(spark, sf), scratch_path(spark, "array"), "g")
    return io.read_json_array(spark, path, TURNS)


#: Rows of a large array.
ARRAY_ROWS = 50_000


def _large_arrays(df: DataFrame, path: str, n: int) -> str:
    """Rows numbered by ``at`` up to ``n`` in arrays of up to ``ARRAY_ROWS``, one a file, with line ends inside of items."""
    text = F.regexp_replace(F.to_json(F.struct(*[c for c in df.columns if c != "at"])), r'","', '",\n "')
    place = F.col("at") % ARRAY_ROWS
    first, last = F.when(place == 0, F.lit("[")).otherwise(F.lit(",")), F.when((place == ARRAY_ROWS - 1) | (F.col("at") == n - 1), F.lit("]")).otherwise(F.lit(""))
    lines = df.select(F.concat(first, text, last).alias("value"), F.floor(F.col("at") / ARRAY_ROWS).alias("file"), "at")
    lines.repartition("file").sortWithinPartitions("file", "at").drop("at").write.partitionBy("file").text(path)
    return path


@query("s2_split_array", "select conv_id, turn, role, text from conversations")
def s2_split(spark, sf):
    """Conversations in large arrays, each read in ranges."""
    rows = mg.row_position(_turns(spark, sf), ["conv_id", "turn", "role", "text"], "at")
    return io.read_json_array(spark, _large_arrays(rows, scratch_path(spark, "arrays"), rows.count()), TURNS, mark="}")


@query("s3_read_samples", "select conv_id, turn, 'array' as kind from conversations union all select conv_id, turn, 'jsonl' from conversations")
def s3(spark, sf):
    lines, array = scratch_path(spark, "jsonl"), scratch_path(spark, "array")
    _turns(spark, sf).write.json(lines)
    _array_file(_blocks(spark, sf), array, "g")
    read = lambda p: io.read_samples(spark, p, TURNS).select("conv_id", "turn", F.lit(io.detect_format(spark, p)).alias("kind"))
    return read(array).unionByName(read(lines))


@query("s4_read_similarity_map", "select 'v' || (vec_id // 4 * 4) as first_path, count(*) as n_rows, round(sum(embedding[1]), 4) as total from embeddings group by 1")
def s4(spark, sf):
    e = fx.table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 4)).withColumn("f", F.floor(F.col("g") / FILE_IDS))
    rows = e.groupBy("f", "g").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.element_at("embedding", 1).cast("double").alias("x")))).alias("r"))
    key = F.concat(F.lit("['"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("v"), x["vec_id"].cast("string"))), "', '"), F.lit("']"))
    one = rows.groupBy("f").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.transform("r", lambda x: F.array(x["x"])))))).alias("value"))
    path = scratch_path(spark, "similarity")
    one.select("value").write.option("maxRecordsPerFile", 1).text(path)
    sims = io.read_similarity_map(spark, path)
    return sims.select(F.element_at("img_paths", 1).alias("first_path"), F.size("triangle").cast("long").alias("n_rows"), F.round(F.aggregate(F.flatten("triangle"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s5_read_budget_table", f"with {fx.TOK_SQL} select array_to_string(paths, ',') as paths, coalesce(array_to_string(num_tokens, ','), '') as num_tokens from tok")
def s5(spark, sf):
    b = _budgets(spark, sf)
    b = b.withColumn("g", F.pmod(F.xxhash64("img_paths"), F.lit(b.count() // FILE_IDS + 1)))
    path = _array_file(b, scratch_path(spark, "budgets"), "g")
    return io.read_budget_table(spark, path).select(F.array_join("img_paths", ",").alias("paths"), F.coalesce(joined("num_tokens"), F.lit("")).alias("num_tokens"))


@query("s6_read_intervals", "select label::varchar as scheme, count(*) as n, round(sum(embedding[1]), 4) as left_sum, sum(vec_id)::double as budgets, 0.8::double as alpha from embeddings group by 1")
def s6(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.concat(F.lit("rule="), F.col("label").cast("string")).alias("name"), "label", F.floor(F.col("vec_id") / (50 * FILE_IDS)).alias("block"), F.struct(F.element_at("embedding", 1).cast("double").alias("tsim_left"), F.lit(1.0).alias("tsim_right"), F.col("vec_id").cast("double").alias("budget")).alias("i"))
    one = e.groupBy("label", "block").agg(F.to_json(F.struct(F.struct(F.lit(0.8).alias("alpha")).alias("config"), F.collect_list("i").alias("tsim_intervals"))).alias("value"))
    path = scratch_path(spark, "intervals")
    one.drop("block").write.option("maxRecordsPerFile", 1).partitionBy("label").text(path)
    # the folder names the scheme here, as Spark names the files
    rows = io.read_intervals(spark, [path], folder="label")
    return rows.groupBy("scheme").agg(F.count("*").alias("n"), F.round(F.sum("tsim_left"), 4).alias("left_sum"), F.sum("budget").alias("budgets"), F.first("alpha").alias("alpha"))


@query("s7_read_task_config", "with t as (select n_name, r_name, row_number() over (partition by r_name order by n_name) - 1 as i from nation join region on n_regionkey = r_regionkey) select r_name as group_name, i::int as dataset_idx, n_name || '.json' as path, n_name || '_tokens.json' as token from t")
def s7(spark, sf):
    n = fx.table(spark, sf, "nation").join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tasks = F.array_sort(F.collect_list(F.struct(F.concat("n_name", F.lit(".json")).alias("path"), F.concat("n_name", F.lit("_tokens.json")).alias("token"))))
    one = n.groupBy("r_name").agg(tasks.alias("t")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "t")))).alias("value"))
    path = scratch_path(spark, "config")
    one.write.text(path)
    return io.read_task_config(spark, path)


PART = "_global_idx long, n long"


@query("s8_read_parts", "select (doc_id % 8)::int as rank, count(*) as n_rows, sum(doc_id)::bigint as ids from documents where doc_id % 8 <> 5 group by 1")
def s8(spark, sf):
    path = scratch_path(spark, "parts")
    io.write_parts(_parts(spark, sf).where("rank <> 5").drop("rank"), path, 8)
    parts = io.read_parts(spark, path, PART, world_size=8, array=False)
    ranks = spark.range(8).select(F.col("id").cast("int").alias("rank"))
    counts = parts.groupBy("rank").agg(F.count("*").alias("n_rows"), F.sum("_global_idx").alias("ids"))
    return ranks.join(mg.missing_parts(ranks, parts), "rank", "left_anti").join(counts, "rank", "left")


@query("s9_write_image_lists", f"with {fx.MSG_SQL} select conv_id as row_idx, coalesce(array_to_string(paths, ','), '') as paths from res")
def s9(spark, sf):
    from seqlattice.streaming.operators import stream_extract

    path = scratch_path(spark, "lists")
    lists = stream_extract(fx.messages(spark, sf)).withColumn("row_idx", F.col("id").cast("long"))
    io.write_image_lists(lists, path)
    return io.read_jsonl(spark, path, "row_idx long, paths array<string>").select("row_idx", F.array_join("paths", ",").alias("paths"))


@query("s10_write_with_tokens", MERGED_SQL + "select 'g' || conv_id % 2 as group_name, (conv_id % 3)::int as dataset_idx, conv_id, coalesce(array_to_string(num_tokens, ','), '') as num_tokens from merged")
def s10(spark, sf):
    path = scratch_path(spark, "with-tokens")
    m = _merged(spark, sf).select("conv_id", "num_tokens", F.concat(F.lit("g"), (F.col("conv_id") % 2).cast("string")).alias("group_name"), (F.col("conv_id") % 3).cast("int").alias("dataset_idx"))
    io.write_with_tokens(m, path)
    back = io.read_jsonl(spark, path, "conv_id long, num_tokens array<int>, group_name string, dataset_idx int")
    return back.select("group_name", "dataset_idx", "conv_id", F.coalesce(joined("num_tokens"), F.lit("")).alias("num_tokens"))


@query("s10_with_tokens_files", MERGED_SQL + "select case when conv_id % 2 = 0 then 'even_with_tokens.json' else 'odd_with_tokens.jsonl' end as name, conv_id, coalesce(array_to_string(num_tokens, ','), '') as num_tokens from merged")
def s10_files(spark, sf):
    """Two data sets, one from a JSON file, one from JSON Lines."""
    root = scratch_path(spark, "with-tokens")
    m = _merged(spark, sf).select("conv_id", "num_tokens")
    out = None
    for rest, source in ((0, "data/even.json"), (1, "data/odd.jsonl")):
        path = io.write_with_tokens(m.where(F.col("conv_id") % 2 == rest), root, source=source)
        back = io.read_samples(spark, path, "conv_id long, num_tokens array<int>").withColumn("name", F.lit(path.rpartition("/")[2]))
        out = back if out is None else out.unionByName(back)
    return out.select("name", "conv_id", F.coalesce(joined("num_tokens"), F.lit("")).alias("num_tokens"))


@query("s11_write_parts", "select doc_id as _global_idx, coalesce(length(text), 0)::bigint as n from documents")
def s11(spark, sf):
    path = scratch_path(spark, "parts")
    io.write_parts(_parts(spark, sf).drop("rank"), path, 5)
    return mg.union_parts(spark.read.schema(PART).json(path)).select("_global_idx", "n")


@query("s12_append_records", "select event_type as benchmark, count(*) as records, sum(event_id)::bigint as ids from events group by 1")
def s12(spark, sf):
    path = scratch_path(spark, "log")
    log = fx.run_log(spark, sf)
    io.append_records(log.where("event_id % 2 = 0"), path)
    io.append_records(log.where("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, benchmark string").json(path).groupBy("benchmark").agg(F.count("*").alias("records"), F.sum("event_id").alias("ids"))


@query("s14_read_images", "select page_id, octet_length(encode(html))::bigint as length from pages")
def s14(spark, sf):
    """A file a page, of its id and its bytes. Files lie in one folder: a folder a page is slow to make, to commit and to list. They are written
    by many tasks, however few hold the table."""
    path = scratch_path(spark, "images")
    pages = fx.table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("content"))
    dealt = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    text = F.concat(F.col("page_id").cast("string"), F.lit(" "), F.coalesce(F.base64("content"), F.lit("null")))
    # by the second algorithm the tasks move their files into place, not the driver
    dealt.select(text.alias("value")).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    files = io.read_images(spark, path, "*.txt").select(F.split(F.decode("content", "utf-8"), " ", 2).alias("p")).where(F.trim(F.col("p")[0]) != "")
    raw = F.when(F.trim(F.translate(F.col("p")[1], "\r\n", "")) != "null", F.unbase64(F.regexp_replace(F.col("p")[1], r"\s", "")))
    return files.select(F.col("p")[0].cast("long").alias("page_id"), F.octet_length(raw).cast("long").alias("length"))
