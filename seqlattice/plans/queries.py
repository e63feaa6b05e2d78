"""Registered queries of the sequence operators, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.functions import images as im
from seqlattice.functions import text as tx
from seqlattice.functions import vectors as vec
from seqlattice.operators import budgets as bg
from seqlattice.operators import evaluate as ev
from seqlattice.operators import inference as inf
from seqlattice.operators import layout as ly
from seqlattice.operators import merging as mg
from seqlattice.operators import quantize as qz
from seqlattice.operators import similarity as sim
from seqlattice.plans import fixtures as fx
from seqlattice.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def joined(column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# Image references


@query("p1_image_tokens", f"with {fx.MSG_SQL} select conv_id, array_to_string(tokens, ',') as tokens, array_to_string(strict_tokens, ',') as strict_tokens from toks")
def p1(spark, sf):
    s = fx.messages(spark, sf)
    return s.select("conv_id", F.array_join(im.image_tokens(F.col("messages")), ",").alias("tokens"), F.array_join(im.image_tokens(F.col("messages"), im.NUMBERED_TOKEN), ",").alias("strict_tokens"))


@query("p2_image_map", f"with {fx.MSG_SQL} select conv_id, img as image_id, any_value(path) as path from m where listed group by 1, 2")
def p2(spark, sf):
    s = fx.messages(spark, sf)
    return s.select("conv_id", F.explode(im.image_map(F.col("input_images"), F.col("output_images"))).alias("image_id", "path"))


@query("p3_resolve_images", f"with {fx.MSG_SQL} select conv_id, coalesce(array_to_string(paths, ','), '') as paths, coalesce(len(paths), 0) as n, len(strict) as n_tokens from res")
def p3(spark, sf):
    s = fx.messages(spark, sf)
    tokens, m = im.image_tokens(F.col("messages"), im.NUMBERED_TOKEN), im.image_map(F.col("input_images"), F.col("output_images"))
    paths = im.resolve_images(tokens, m)
    return s.select("conv_id", F.array_join(paths, ",").alias("paths"), F.size(paths).alias("n"), F.size(im.resolve_images(tokens, m, "null")).alias("n_tokens"))


@query("p4_sequence_key", f"with {fx.TOK_SQL} select array_to_string(paths, ',') as paths, count(*) as n, count(distinct paths) as n_keys from (select paths from tok union all select paths from tok where conv_id % 11 = 0) group by 1")
def p4(spark, sf):
    t = fx.budget_table(spark, sf).withColumn("key", im.sequence_key(F.col("img_paths")))
    return t.groupBy("key", "img_paths").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys")).select(F.array_join("img_paths", ",").alias("paths"), "n", "n_keys")


@query("x1_valid_sequences", f"with {fx.MSG_SQL} select count(*) as n_all, count(*) filter (where conv_id % 3 <> 0 and paths is not null) as n_valid, (sum(len(paths)) filter (where conv_id % 3 <> 0))::bigint as n_images from res")
def x1(spark, sf):
    s = fx.messages(spark, sf)
    paths = im.resolve_images(im.image_tokens(F.col("messages"), im.NUMBERED_TOKEN), im.image_map(F.col("input_images"), F.col("output_images")))
    written = F.when(F.col("conv_id") % 3 == 0, F.lit("not a list")).otherwise(F.to_json(paths))
    parsed = s.select(im.parse_sequence(written).alias("p"))
    ok = im.valid_sequence(F.col("p"))
    return parsed.agg(F.count("*").alias("n_all"), F.count_if(ok).alias("n_valid"), F.sum(F.when(ok, F.size("p"))).alias("n_images"))


@query("p16_flatten_messages", f"with {fx.MSG_SQL} select conv_id, string_agg(path, ',' order by turn) as images, string_agg('<' || img || '> ' || text, '' order by turn) as prompt from m where listed group by 1")
def p16(spark, sf):
    s = fx.messages(spark, sf)
    m = im.image_map(F.col("input_images"), F.col("output_images"))
    parts = F.flatten(F.transform("messages", lambda t: F.transform(F.filter(im.image_tokens(F.array(t), im.NUMBERED_TOKEN), lambda k: F.map_contains_key(m, k)),
                                                                      lambda k: F.struct(F.lit("image").alias("type"), F.element_at(m, k).alias("value")))))
    listed = F.filter("messages", lambda t: F.exists(im.image_tokens(F.array(t), im.NUMBERED_TOKEN), lambda k: F.map_contains_key(m, k)))
    both = F.concat(parts, F.transform(listed, lambda t: F.struct(F.lit("text").alias("type"), t["content"].alias("value"))))
    images, prompt = im.flatten_messages(both)
    return s.select("conv_id", F.array_join(images, ",").alias("images"), prompt.alias("prompt"))


@query("p22_image_flags", "with n as (select conv_id, count(*) filter (where role = 'user') as i, count(*) filter (where role <> 'user') as o from conversations group by 1) select conv_id, array_to_string(list_concat(list_transform(range(2 * i), lambda x: 'false'), list_transform(range(o), lambda x: 'true')), ',') as flags from n")
def p22(spark, sf):
    n = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").cast("int").alias("i"), F.count_if(F.col("role") != "user").cast("int").alias("o"))
    return n.select("conv_id", joined(im.image_flags(F.col("i"), F.col("o"))).alias("flags"))


# Similarity and budgets

UNIT_SQL = "list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12))"


@query("p24_l2_normalize", f"with {fx.SEQ_SQL} select vec_id, round(u[1], 6) as first_value, round(list_sum(list_transform(u, lambda x: x * x)), 6) as norm from (select vec_id, {UNIT_SQL} as u from s)")
def p24(spark, sf):
    u = fx.states(spark, sf).withColumn("u", vec.l2_normalize(F.col("vector")))
    return u.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first_value"), F.round(vec.dot(F.col("u"), F.col("u")), 6).alias("norm"))


PAIRS_SQL = "select a.seq_id, a.pos as t, b.pos as j, round(list_cosine_similarity(a.e, b.e), 6) as sim from s a join s b on a.seq_id = b.seq_id and b.pos < a.pos"


@query("j3_causal_pairs", f"with {fx.SEQ_SQL} {PAIRS_SQL}")
def j3(spark, sf):
    return sim.causal_pairs(fx.states(spark, sf)).select("seq_id", "t", "j", F.round("sim", 6).alias("sim"))


TRI_SQL = f"with {fx.SEQ_SQL}, p as ({PAIRS_SQL}), r as (select seq_id, t, string_agg(printf('%.6f', sim), ',' order by j) as row, count(*) as n from p group by 1, 2) select seq_id, t::int as t, n::int as n, row from r union all select distinct seq_id, 0::int, 1::int, '1.000000' from s"


def _triangle_rows(tri: DataFrame) -> DataFrame:
    rows = tri.select("seq_id", F.posexplode("triangle").alias("t", "row"))
    return rows.select("seq_id", "t", F.size("row").alias("n"), F.array_join(F.transform("row", lambda x: F.format_string("%.6f", F.round(x, 6))), ",").alias("row"))


@query("a7_triangle", TRI_SQL)
def a7(spark, sf):
    s = fx.states(spark, sf)
    return _triangle_rows(sim.triangle(sim.causal_pairs(s), s.groupBy("seq_id").agg(F.count("*").alias("length"))))


@query("j3_triangle_array", TRI_SQL)
def j3_array(spark, sf):
    return _triangle_rows(sim.similarity_triangles(fx.states(spark, sf)))


@query("a6_pool_features", f"with {fx.SEQ_SQL}, x as (select seq_id, unnest(e) as x, unnest(range(len(e))) as dim from s), mean as (select seq_id, dim, avg(x) as x from x group by 1, 2), n as (select seq_id, sqrt(sum(x * x)) as n from mean group by 1) select seq_id, dim::int as dim, round(x / n, 6) as x from mean join n using (seq_id)")
def a6(spark, sf):
    f = sim.pool_features(fx.states(spark, sf), "seq_id")
    return f.select("seq_id", F.posexplode("feature").alias("dim", "v")).select("seq_id", "dim", F.round("v", 6).alias("x"))


BUDGET_SQL = "case when {x} < -0.08 then 100 when {x} < -0.02 then 81 when {x} < 0.04 then 49 else 9 end"
ALLOCATE_SQL = f"""
with recursive {fx.SEQ_SQL.strip()},
tri as (select a.seq_id, a.pos, list(list_cosine_similarity(a.e, b.e) order by b.pos) as row from s a join s b on a.seq_id = b.seq_id and b.pos < a.pos group by 1, 2),
r as (
  select distinct seq_id, 0 as pos, [144] as toks from s
  union all
  select t.seq_id, t.pos, list_append(r.toks, {BUDGET_SQL.format(x="w.sim")})
  from r join tri t on t.seq_id = r.seq_id and t.pos = r.pos + 1,
  lateral (select sum(t.row[j + 1] * pow(0.8, r.pos - j) * r.toks[j + 1]) / sum(pow(0.8, r.pos - j) * r.toks[j + 1]) as sim from range(r.pos + 1) g(j)) w),
alloc as (select seq_id, max_by(toks, pos) as num_tokens from r group by 1)"""


def _allocated(spark, sf) -> DataFrame:
    return bg.allocate_budgets(sim.similarity_triangles(fx.states(spark, sf)), fx.RULE)


@query("w1_allocate_budgets", ALLOCATE_SQL + " select seq_id, array_to_string(num_tokens, ',') as num_tokens from alloc")
def w1(spark, sf):
    return _allocated(spark, sf).select("seq_id", joined("num_tokens").alias("num_tokens"))


LONG_SQL = ALLOCATE_SQL.replace(fx.SEQ_SQL.strip(), fx.LONG_SEQ_SQL.strip())


@query("w1_allocate_long", LONG_SQL + " select seq_id, unnest(range(len(num_tokens)))::int as pos, unnest(num_tokens)::int as num_tokens from alloc")
def w1_long(spark, sf):
    """Sequences of up to 400 states, by the fold over sorted states."""
    return bg.allocate_states(fx.long_states(spark, sf), fx.RULE)


@query("w1_allocate_states", ALLOCATE_SQL + " select seq_id, unnest(range(len(num_tokens)))::int as pos, unnest(num_tokens)::int as num_tokens from alloc")
def w1_states(spark, sf):
    return bg.allocate_states(fx.states(spark, sf), fx.RULE)


@query("j3_block_pairs", f"with {fx.LONG_SEQ_SQL} {PAIRS_SQL}")
def j3_blocks(spark, sf):
    """Pairs of the long sequences, by blocks of states."""
    return sim.block_pairs(fx.long_states(spark, sf), block=64).select("seq_id", "t", "j", F.round("sim", 6).alias("sim"))


@query("a3_ew_weighted_mean", f"with {fx.SEQ_SQL}, p as ({PAIRS_SQL.replace('round(list_cosine_similarity(a.e, b.e), 6)', 'list_cosine_similarity(a.e, b.e)')}) select seq_id, t, round(sum(sim * pow(0.8, t - 1 - j) * (j + 1)) / sum(pow(0.8, t - 1 - j) * (j + 1)), 5) as mean from p group by 1, 2")
def a3(spark, sf):
    rows = sim.causal_pairs(fx.states(spark, sf)).groupBy("seq_id", "t").agg(F.array_sort(F.collect_list(F.struct("j", "sim"))).alias("row"))
    sims = F.transform("row", lambda r: r["sim"])
    weights = F.transform("row", lambda r: r["j"] + 1)
    return rows.select("seq_id", "t", F.round(vec.ew_weighted_mean(sims, weights, 0.8), 5).alias("mean"))


def _schemes(spark: SparkSession) -> DataFrame:
    return bg.interval_table(spark.createDataFrame(fx.SCHEMES, fx.SCHEME_SCHEMA))


@query("j2_budget_for_tsim", f"with {fx.SEQ_SQL}, p as ({PAIRS_SQL}), b as (select 'base' as scheme, {BUDGET_SQL.format(x='sim')} as budget from p union all select 'coarse', case when sim < 0 then 80 else 9 end from p union all select 'rising', case when sim < 0 then 49 else 81 end from p) select scheme, budget, count(*) as n from b group by 1, 2")
def j2(spark, sf):
    pairs = sim.causal_pairs(fx.states(spark, sf)).select(F.round("sim", 6).alias("tsim"))
    return bg.budget_for_tsim(pairs, _schemes(spark)).groupBy("scheme", "budget").agg(F.count("*").alias("n"))


RULES_SQL = "with d as (select doc_id as i, (n_chars % 97)::double / 7 + doc_id as l, (n_chars % 97)::double / 7 + doc_id + 0.5 as r, (doc_id % 5 * 10 + 9)::int as b, 's' || doc_id % 3 as scheme from documents), v as (select event_id, (event_id * 37 % (select max(doc_id) + 30 from documents))::double - 3 as tsim from events)"


@query("j2_indexed_budgets", RULES_SQL + """,
hit as (select v.event_id, d.scheme, arg_min(d.b, (d.l, d.r, d.b)) as b from v join d on v.tsim >= d.l and v.tsim < d.r group by 1, 2),
ends as (select scheme, min(l) as low, arg_min(b, (l, r, b)) as first_b, arg_max(b, (l, r, b)) as last_b from d group by 1)
select scheme, coalesce(h.b, case when tsim < low then first_b else last_b end) as budget, count(*) as n, sum(event_id)::bigint as ids
from v cross join ends left join hit h using (event_id, scheme) group by 1, 2""")
def j2_indexed(spark, sf):
    """Values of all events against three schemes with an interval for each document; intervals overlap and leave gaps."""
    d = fx.table(spark, sf, "documents")
    left = (F.col("n_chars") % 97).cast("double") / 7 + F.col("doc_id")
    rules = d.select(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("scheme"), left.alias("left"), (left + 0.5).alias("right"), (F.col("doc_id") % 5 * 10 + 9).cast("int").alias("budget"))
    most = d.agg(F.max("doc_id") + 30).head()[0]
    v = fx.table(spark, sf, "events").select("event_id", ((F.col("event_id") * 37 % most).cast("double") - 3).alias("tsim"))
    return bg.budget_for_tsim(v, rules).groupBy("scheme", "budget").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("x2_monotone_schemes", "with t as (select source, doc_id // 20 as slot, max(doc_id % 7) as b from documents group by 1, 2), l as (select source, b > lag(b) over (partition by source order by slot) as rise from t) select source as scheme from l group by 1 having not bool_or(coalesce(rise, false))")
def x2(spark, sf):
    d = fx.table(spark, sf, "documents").groupBy(F.col("source").alias("scheme"), F.floor(F.col("doc_id") / 20).alias("left")).agg(F.max(F.col("doc_id") % 7).alias("raw_budget"))
    return bg.monotone_schemes(d)


@query("x2_monotone_slots", "with t as (select coalesce(source, 'none') || '/' || doc_id % 40 as scheme, doc_id // 40 % 3 as slot, sum(n_chars) % 7 as b from documents group by 1, 2), l as (select scheme, b > lag(b) over (partition by scheme order by slot) as rise from t) select scheme from l group by 1 having not bool_or(coalesce(rise, false))")
def x2_slots(spark, sf):
    """Schemes of a few intervals each, of which some rise and some don't."""
    d = fx.table(spark, sf, "documents").groupBy(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), (F.col("doc_id") % 40).cast("string")).alias("scheme"), (F.floor(F.col("doc_id") / 40) % 3).alias("left"))
    return bg.monotone_schemes(d.agg((F.sum("n_chars") % 7).alias("raw_budget")))


@query("a1_avg_token", ALLOCATE_SQL + f" select {fx.LABEL_SQL}::bigint as label, round(sum(list_sum(num_tokens))::double / sum(len(num_tokens)), 6) as avg_token, count(*) as records from alloc group by 1")
def a1(spark, sf):
    rows = _allocated(spark, sf).withColumn("label", fx.label_of(F.col("seq_id")))
    return bg.avg_token(rows, ["label"], "num_tokens").select("label", F.round("avg_token", 6).alias("avg_token"), "records")


@query("j7_scheme_split_matrix", f"with {fx.SEQ_SQL} select scheme, case when label % 5 = 0 then 'test' else 'train' end as split, count(distinct seq_id) as n from s, (values ('base'), ('coarse'), ('rising')) t(scheme) group by 1, 2")
def j7(spark, sf):
    s = fx.states(spark, sf)
    seqs = lambda cond: s.where(cond).select("seq_id").distinct()
    both = bg.scheme_split_matrix({"train": seqs("label % 5 <> 0"), "test": seqs("label % 5 = 0")}, _schemes(spark).select("scheme").distinct())
    return both.groupBy("scheme", "split").agg(F.count("*").alias("n"))


COARSE_SQL = ALLOCATE_SQL.replace("0.8", "0.5").replace(BUDGET_SQL.format(x="w.sim"), "case when w.sim < 0 then 80 else 9 end").replace("r as (", "rc as (").replace("from r join", "from rc r join").replace("from r group", "from rc group").replace("alloc as", "alloc_c as")
COARSE_SQL = COARSE_SQL[COARSE_SQL.index("rc as (") :]


@query("a13_run_summary", ALLOCATE_SQL + ", " + COARSE_SQL + """,
both_of as (select 'base' as scheme, 0.8 as alpha, * from alloc union all select 'coarse', 0.5, * from alloc_c),
made as (select scheme, case when {LABEL} % 5 = 0 then 'test' else 'train' end as split, any_value(alpha)::double as alpha, round(sum(list_sum(num_tokens))::double / sum(len(num_tokens)), 6) as avg_token, count(*) as records from both_of group by 1, 2)
select scheme, split, coalesce(alpha, -1) as alpha, coalesce(avg_token, -1) as avg_token, coalesce(records, 0) as records
from (values ('base'), ('coarse'), ('rising')) a(scheme) cross join (values ('train'), ('test')) b(split) left join made using (scheme, split)""".replace("{LABEL}", fx.LABEL_SQL))
def a13(spark, sf):
    made = bg.allocate_schemes(sim.similarity_triangles(fx.states(spark, sf)), _schemes(spark))
    made = made.withColumn("split", F.when(fx.label_of(F.col("seq_id")) % 5 == 0, "test").otherwise("train"))
    out = bg.run_summary(_schemes(spark), ["train", "test"], made, "num_tokens")
    return out.select("scheme", "split", F.coalesce("alpha", F.lit(-1.0)).alias("alpha"), F.round(F.coalesce("avg_token", F.lit(-1.0)), 6).alias("avg_token"), "records")


# Merging


def _budgets(spark, sf) -> DataFrame:
    return mg.dedupe_last(fx.budget_table(spark, sf).drop("conv_id"), ["img_paths"], "ord").drop("ord")


def _merged(spark, sf) -> DataFrame:
    return mg.merge_budgets(mg.sample_paths(fx.messages(spark, sf)), _budgets(spark, sf))


@query("a4_dedupe_last", f"with {fx.TOK_SQL} select array_to_string(paths, ',') as paths, coalesce(array_to_string(num_tokens, ','), 'none') as num_tokens from tok")
def a4(spark, sf):
    return _budgets(spark, sf).select(F.array_join("img_paths", ",").alias("paths"), F.coalesce(joined("num_tokens"), F.lit("none")).alias("num_tokens"))


MERGED_SQL = f"with {fx.TOK_SQL} "


@query("j1_merge_budgets", MERGED_SQL + "select conv_id, coalesce(array_to_string(num_tokens, ','), '') as num_tokens, coalesce(error, '') as error, case when error is null and not found then 'token_not_found' else '' end as warn from merged")
def j1(spark, sf):
    return _merged(spark, sf).select("conv_id", F.coalesce(joined("num_tokens"), F.lit("")).alias("num_tokens"), F.coalesce("_error", F.lit("")).alias("error"), F.coalesce("_warn", F.lit("")).alias("warn"))


STATS_SQL = "count(*) as samples, count(*) filter (where error is null and num_tokens is not null) as matched, count(*) filter (where error is null and not found) as token_not_found, count(*) filter (where error is not null) as errors, round(count(*) filter (where error is null and num_tokens is not null)::double / count(*), 6) as match_rate"


@query("a2_merge_stats", MERGED_SQL + f"select (conv_id % 4)::bigint as dataset_idx, {STATS_SQL} from merged group by 1")
def a2(spark, sf):
    m = _merged(spark, sf).withColumn("dataset_idx", F.col("conv_id") % 4)
    return mg.merge_stats(m, ["dataset_idx"]).withColumn("match_rate", F.round("match_rate", 6))


@query("a5_bad_cases", MERGED_SQL + ", bad as (select conv_id, (conv_id % 4)::bigint as dataset_idx, case when error is not null then 'error' else 'token_not_found' end as kind, coalesce(error, '') as error, row_number() over (partition by conv_id % 4 order by conv_id) as r from merged where error is not null or not found) select dataset_idx, conv_id, kind, error from bad where r <= 10")
def a5(spark, sf):
    m = _merged(spark, sf).withColumn("dataset_idx", F.col("conv_id") % 4)
    return mg.bad_cases(m, ["dataset_idx"], "conv_id").withColumn("error", F.coalesce("error", F.lit("")))


@query("e1_skip_errors", MERGED_SQL + "select conv_id, len(paths) as n from merged where error is null")
def e1(spark, sf):
    s = mg.sample_paths(fx.messages(spark, sf))
    return mg.with_error_policy(s, F.col("_error"), "skip").select("conv_id", F.size("img_paths").alias("n"))


@query("e2_record_errors", MERGED_SQL + "select coalesce(error, '') as error, count(*) as n from merged group by 1")
def e2(spark, sf):
    s = mg.sample_paths(fx.messages(spark, sf))
    kept = mg.with_error_policy(s, F.col("_error"), "record")
    return kept.groupBy(F.coalesce("_error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


@query("e3_fail_fast", MERGED_SQL + "select count(*) as n from merged where error is null")
def e3(spark, sf):
    s = mg.sample_paths(fx.messages(spark, sf)).where("_error is null")
    return mg.with_error_policy(s, F.col("_error"), "fail").agg(F.count("*").alias("n"))


def _parts(spark, sf) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select((F.col("doc_id") % 8).cast("int").alias("rank"), F.col("doc_id").alias("_global_idx"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))


@query("u1_union_parts", "select rank, count(*) as n_rows, sum(_global_idx)::bigint as ids from (select (doc_id % 8)::int as rank, doc_id as _global_idx from documents union all select (doc_id % 8)::int, doc_id from documents where doc_id % 8 < 2) group by 1")
def u1(spark, sf):
    p = _parts(spark, sf)
    return mg.union_parts(p, p.where("rank < 2").drop("n")).groupBy("rank").agg(F.count("*").alias("n_rows"), F.sum("_global_idx").alias("ids"))


@query("u2_union_overwrite", "with p as (select (doc_id % 8)::int as rank, doc_id, doc_id // 8 as key from documents) select key, max(rank) as rank, max(doc_id) as _global_idx from p group by 1")
def u2(spark, sf):
    p = _parts(spark, sf).withColumn("key", F.floor(F.col("_global_idx") / 8)).drop("n")
    return mg.union_overwrite(p.withColumn("at", F.col("rank")), ["key"], "at").select("key", "rank", "_global_idx")


@query("u3_missing_parts", "select distinct (doc_id % 8)::int as rank from documents where doc_id % 8 = 5")
def u3(spark, sf):
    p = _parts(spark, sf)
    return mg.missing_parts(p, p.where("rank <> 5"))


@query("w10_global_index", "select doc_id as _global_idx, (doc_id % 8 + doc_id // 8 * 8)::bigint as idx, (row_number() over (order by doc_id) - 1)::bigint as position from documents")
def w10(spark, sf):
    p = _parts(spark, sf).withColumn("idx", mg.global_index(F.col("rank").cast("long"), F.floor(F.col("_global_idx") / 8), 8))
    return mg.row_position(p, ["_global_idx"]).select("_global_idx", "idx", "position")


@query("o1_restore_order", "select (doc_id % 8)::int as rank, coalesce(length(text), 0) as n from documents")
def o1(spark, sf):
    return mg.restore_order(_parts(spark, sf))


@query("o2_seeded_shuffle", "select count(*) as n, count(distinct doc_id) as n_ids, sum(doc_id)::bigint as total from documents")
def o2(spark, sf):
    return mg.seeded_shuffle(_parts(spark, sf), ["_global_idx"], 7).agg(F.count("*").alias("n"), F.count_distinct("_global_idx").alias("n_ids"), F.sum("_global_idx").alias("total"))


@query("o1_restored_positions", "select doc_id as idx, (row_number() over (order by doc_id) - 1)::bigint as position from documents")
def o1_positions(spark, sf):
    """The restored order, as written files hold it."""
    path = scratch_path(spark, "restored")
    mg.restore_order(_parts(spark, sf).repartition(7, "rank").withColumn("idx", F.col("_global_idx"))).write.parquet(path)
    at = [F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("row")]
    return mg.row_position(spark.read.parquet(path).select("idx", *at), ["file", "row"]).select("idx", "position")


@query("o2_shuffle_positions", "select count(*) as n, count(*) as n_places, count(*) as n_again, true as moved, true as other_seed_differs from documents")
def o2_positions(spark, sf):
    """Places of two runs over differently dealt rows, and of another seed."""
    p = _parts(spark, sf).select("_global_idx")
    places = [mg.shuffle_position(rows, ["_global_idx"], seed, name) for rows, seed, name in ((p, 7, "a"), (p.repartition(5), 7, "b"), (p, 8, "c"))]
    ranked = mg.row_position(p, ["_global_idx"], "rank")
    both = places[0].join(places[1], "_global_idx").join(places[2], "_global_idx").join(ranked, "_global_idx")
    return both.agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_places"), F.count_if(F.col("a") == F.col("b")).alias("n_again"), F.bool_or(F.col("a") != F.col("rank")).alias("moved"), F.bool_or(F.col("a") != F.col("c")).alias("other_seed_differs"))


@query("o3_shard", "select (doc_id % 3)::bigint as shard, count(*) as n from documents group by 1")
def o3(spark, sf):
    return mg.shard(_parts(spark, sf), 3).groupBy("shard").agg(F.count("*").alias("n"))


# Answers and runs


@query("p5_final_answer", f"with {fx.ANS_SQL} select _global_idx, coalesce(gt, 'none') as gt, coalesce(pred, 'none') as pred from rows")
def p5(spark, sf):
    a = fx.answers(spark, sf)
    return a.select("_global_idx", F.coalesce(tx.final_answer(F.col("output_text")), F.lit("none")).alias("gt"), F.coalesce(tx.final_answer(F.col("model_output_text")), F.lit("none")).alias("pred"))


@query("p6_answer_rows", f"with {fx.ANS_SQL} select _global_idx, config, question, coalesce(gt, '') as gt, coalesce(pred, '') as pred from rows")
def p6(spark, sf):
    return ev.answer_rows(fx.answers(spark, sf)).fillna("", ["gt", "pred"])


@query("a11_exact_match_accuracy", f"with {fx.ANS_SQL} select coalesce(config, 'all') as config, count(*) as n, count(*) filter (where gt = pred) as correct, round(count(*) filter (where gt = pred)::double / count(*), 6) as accuracy from rows where gt is not null group by rollup (config)")
def a11(spark, sf):
    return ev.exact_match_accuracy(ev.answer_rows(fx.answers(spark, sf)), "config").select(F.coalesce("config", F.lit("all")).alias("config"), "n", "correct", F.round("accuracy", 6).alias("accuracy"))


@query("p19_strip_special_tokens", "select doc_id, length(regexp_replace('<|im_start|>' || text || '<|im_end|>', '<\\|[^|>]*\\|>', '', 'g')) as n, length(text) + 22 as kept from documents")
def p19(spark, sf):
    marked = F.concat(F.lit("<|im_start|>"), F.col("text"), F.lit("<|im_end|>"))
    return fx.table(spark, sf, "documents").select("doc_id", F.length(tx.strip_special_tokens(marked)).alias("n"), F.length(tx.strip_special_tokens(marked, True)).alias("kept"))


@query("p11_output_path", "select page_id, 'out/' || case when page_id % 9 = 0 then 'unknown_benchmark' else substr(regexp_replace(trim(url), '[^\\p{L}\\p{N}._-]', '_', 'g'), 1, 120) end || '/sample_' || lpad(page_id::varchar, 6, '0') || '.png' as path from pages")
def p11(spark, sf):
    name = F.when(F.col("page_id") % 9 == 0, F.lit("  ")).otherwise(F.col("url"))
    return fx.table(spark, sf, "pages").select("page_id", tx.output_path("out", name, F.col("page_id")).alias("path"))


@query("p11_adapter_path", "select page_id, 'out/' || substr(regexp_replace(trim(url), '[^\\p{L}\\p{N}._-]', '_', 'g'), 1, 120) || '/sample_' || lpad(page_id::varchar, 8, '0') || '_rank' || page_id % 8 || '_pid' || (1000 + page_id % 3) || '.png' as path from pages")
def p11_adapter(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.output_path("out", F.col("url"), F.col("page_id"), F.col("page_id") % 8, 1000 + F.col("page_id") % 3).alias("path"))


@query("a12_run_log_summary", "select event_type as benchmark, (user_id % 4)::int as rank, count(*) as records, count(*) filter (where event_type = 'error') as errors, round(count(*) filter (where event_type = 'error')::double / count(*), 6) as error_rate, round(avg(event_id % 3), 6) as avg_images from events group by 1, 2")
def a12(spark, sf):
    return ev.run_log_summary(fx.run_log(spark, sf), ["benchmark", "rank"]).withColumn("error_rate", F.round("error_rate", 6)).withColumn("avg_images", F.round("avg_images", 6))


@query("p20_record_flags", "select event_id, event_id % 3 > 0 as has_generated_image, (event_id % 5)::int as input_image_count, event_id % 2 = 0 as gt_available, event_type = 'error' as has_decode_error from events")
def p20(spark, sf):
    e = fx.run_log(spark, sf)
    paths, truth = F.array_repeat(F.lit("p"), (F.col("event_id") % 5).cast("int")), F.when(F.col("event_id") % 2 == 0, F.lit("t"))
    return e.select("event_id", *inf.record_flags(F.col("tokens"), paths, truth, F.col("error")))


MODELS = "(values ('alpha'), ('beta'), ('gamma')) m(model)"


@query("j6_model_dataset_matrix", f"with d as (select distinct source as dataset from documents), f as (select model, dataset, case when length(dataset) % 2 = 0 then model || '/' || model || '_' || dataset || '.xlsx' else model || '/old/' || model || '_' || dataset || '.xlsx' end as path from {MODELS}, d where (length(model) + length(dataset)) % 3 <> 0) select m.model, d.dataset, coalesce(f.path, '') as path, f.path is not null as found from {MODELS} cross join d left join f on f.model = m.model and f.dataset = d.dataset")
def j6(spark, sf):
    models = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "model string")
    datasets = fx.table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    name = F.concat_ws("_", "model", "dataset")
    folder = F.when(F.length("dataset") % 2 == 0, F.concat("model", F.lit("/"))).otherwise(F.concat("model", F.lit("/old/")))
    files = models.crossJoin(datasets).where((F.length("model") + F.length("dataset")) % 3 != 0).select(F.concat(folder, name, F.lit(".xlsx")).alias("path"))
    return ev.model_dataset_matrix(models, datasets, files).select("model", "dataset", F.coalesce("path", F.lit("")).alias("path"), "found")


NAMED_SQL = "(select doc_id, ['MMMU_TEST', 'MMT-Bench_ALL_X', 'MLLMGuard_DS', 'AesBench_TEST', 'DocVQA_TEST', 'MMBench', 'EMMA', 'VisuLogic', 'OlympiadBench', 'Other', 'moviechat1k_x'][doc_id % 11 + 1] as dataset, ['MCQ', 'VQA', 'Y/N'][doc_id % 3 + 1] as kind from documents) d"


def _named(spark, sf) -> DataFrame:
    names = ["MMMU_TEST", "MMT-Bench_ALL_X", "MLLMGuard_DS", "AesBench_TEST", "DocVQA_TEST", "MMBench", "EMMA", "VisuLogic", "OlympiadBench", "Other", "moviechat1k_x"]
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))
    return fx.table(spark, sf, "documents").select("doc_id", pick(names, 11).alias("dataset"), pick(["MCQ", "VQA", "Y/N"], 3).alias("kind"))


@query("x3_evaluable_runs", f"select dataset, count(*) as n from {NAMED_SQL} where dataset in ('EMMA', 'VisuLogic', 'OlympiadBench', 'Other', 'moviechat1k_x') group by 1")
def x3(spark, sf):
    return ev.evaluable_runs(_named(spark, sf)).groupBy("dataset").agg(F.count("*").alias("n"))


@query("f3_judge_rule", f"select dataset, kind, case when kind in ('MCQ', 'Y/N') or dataset = 'moviechat1k_x' then case when dataset = 'VisuLogic' then 'exact_matching' else 'qwen2.5-vl-72b-instruct' end when dataset = 'EMMA' then 'qwen2.5-vl-72b-instruct' else 'none' end as judge, count(*) as n from {NAMED_SQL} group by 1, 2, 3")
def f3(spark, sf):
    judge = F.coalesce(ev.judge_rule(F.col("dataset"), F.col("kind")), F.lit("none"))
    return _named(spark, sf).groupBy("dataset", "kind", judge.alias("judge")).agg(F.count("*").alias("n"))


@query("f3_judge_table", f"select dataset, kind, case when kind in ('MCQ', 'Y/N') or dataset = 'moviechat1k_x' then case when dataset = 'VisuLogic' then 'exact_matching' else 'qwen2.5-vl-72b-instruct' end when dataset = 'EMMA' or dataset = 'OlympiadBench' and doc_id % 4 = 1 then 'qwen2.5-vl-72b-instruct' when doc_id % 4 = 2 then 'mine' else 'none' end as judge, case doc_id % 4 when 2 then '5' else '3' end as retry, count(*) as n from {NAMED_SQL} group by 1, 2, 3, 4")
def f3_table(spark, sf):
    """Rules as rows, and arguments as JSON: some ask for the judge of exams, some name a model and a number of tries."""
    runs = _named(spark, sf).withColumn("args", F.when(F.col("doc_id") % 4 == 1, F.lit('{"olympiad_use_api_judger": true}')).when(F.col("doc_id") % 4 == 2, F.lit('{"model": "mine", "retry": 5}')))
    found = ev.judged_runs(runs, ev.judge_rules(spark), arguments="args", defaults={"retry": "3", "verbose": "false"})
    return found.groupBy("dataset", "kind", F.coalesce("judge", F.lit("none")).alias("judge"), F.col("judge_args")["retry"].alias("retry")).agg(F.count("*").alias("n"))


class LetterOverlap(ev.Scorer):
    """Mean share of the letters that the expected and the given answer have in common."""

    def start(self):
        return [0.0, 0]

    def add(self, state, rows):
        for want, got in zip(rows["gt"], rows["pred"]):
            a, b = set(want), set(got or "")
            state = [state[0] + (len(a & b) / len(a | b) if a | b else 1.0), state[1] + 1]
        return state

    def merge(self, a, b):
        return [a[0] + b[0], a[1] + b[1]]

    def result(self, state):
        return {"score": state[0] / state[1] if state[1] else None, "n": state[1]}


@query("a11_scored_by", f"with {fx.ANS_SQL}, l as (select config, list_distinct(string_split(gt, '')) as a, list_distinct(string_split(coalesce(pred, ''), '')) as b from rows where gt is not null), s as (select config, len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) as score from l) select coalesce(config, 'none') as config, round(avg(score), 6) as score, count(*) as n, false as is_all from s group by 1 union all select 'none', round(avg(score), 6), count(*), true from s")
def a11_scored(spark, sf):
    rows = ev.answer_rows(fx.answers(spark, sf)).where("gt is not null")
    found = ev.scored_by(rows, "config", LetterOverlap(), "score double, n long")
    most = rows.count()
    return found.select(F.coalesce("config", F.lit("none")).alias("config"), F.round("score", 6).alias("score"), "n", (F.col("config").isNull() & (F.col("n") == most)).alias("is_all"))


# Prompts and budgets of samples

SAMPLES_SQL = MERGED_SQL + """,
smp as (select conv_id, num_tokens, len(paths) as n_img, least(len(paths), len(paths) // 2 + 1) as n_in from merged where num_tokens is not null)"""


def _samples(spark, sf) -> DataFrame:
    m = _merged(spark, sf).where("num_tokens is not null")
    return m.withColumn("n_img", F.size("img_paths")).withColumn("n_in", F.least(F.col("n_img"), F.floor(F.col("n_img") / 2).cast("int") + 1))


@query("p9_usable_budgets", SAMPLES_SQL + " select conv_id, array_to_string(num_tokens[2:n_in], ',') as budgets from smp")
def p9(spark, sf):
    return _samples(spark, sf).select("conv_id", joined(inf.usable_budgets(F.col("num_tokens"), F.col("n_in"))).alias("budgets"))


@query("p10_resolve_budgets", SAMPLES_SQL + " select conv_id, greatest(n_in - 1, 0)::int as n, case when conv_id % 2 = 0 then array_to_string(num_tokens[2:n_in], ',') when n_in > 1 then array_to_string(list_transform(range(n_in - 1), lambda i: 81), ',') else '' end as budgets from smp")
def p10(spark, sf):
    s = _samples(spark, sf)
    given = F.when(F.col("conv_id") % 2 == 0, inf.usable_budgets(F.col("num_tokens"), F.col("n_in")))
    got = inf.resolve_budgets(given, F.array_repeat(F.lit(81), F.col("n_in") + 3), F.col("conv_id"), F.col("n_in"))
    return s.select("conv_id", F.size(inf.resolve_budgets(given, F.array_repeat(F.lit(81), 1), F.col("conv_id"), F.col("n_in"), pad=True)).alias("n"), joined(got).alias("budgets"))


def _grids(n):
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(1).alias("t"), (2 + i % 3).cast("int").alias("h"), (4 + i % 2).cast("int").alias("w")))


GRID_SQL = "list_transform(range(1, n_in + 1), lambda i: ((2 + i % 3) * (4 + i % 2)) // 4)"
FIRSTED_SQL = "list_concat([144], num_tokens[2:n_in])[1:n_in]"


@query("p7_render_prompts", SAMPLES_SQL + f""" select conv_id, '<|im_start|>user' || chr(10) || array_to_string(list_transform(range(1, least(n_in, len(num_tokens)) + 1), lambda i: '<|vision_start|>' || repeat('<|image_pad|>', {GRID_SQL}[i]) || '<|vision_end|><|vision_start|>' || repeat('<|vision_pad|>', {FIRSTED_SQL}[i]) || '<|vision_end|>'), '') || 'q' || conv_id || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt from smp""")
def p7(spark, sf):
    s = _samples(spark, sf)
    prompt = inf.render_prompt(F.concat(F.lit("q"), F.col("conv_id").cast("string")), _grids(F.col("n_in")), inf.usable_budgets(F.col("num_tokens"), F.col("n_in")))
    return s.select("conv_id", prompt.alias("prompt"))


@query("p7_fill_placeholders", SAMPLES_SQL + " select conv_id, 'a' || repeat('<|image_pad|>', 2) || 'b' || repeat('<|image_pad|>', (conv_id % 4)::int) || 'c<|image_pad|>' as filled from smp")
def p7_fill(spark, sf):
    text = F.lit("a<|image_pad|>b<|image_pad|>c<|image_pad|>")
    return _samples(spark, sf).select("conv_id", inf.fill_placeholders(text, F.array(F.lit(2), (F.col("conv_id") % 4).cast("int"))).alias("filled"))


@query("p8_prompt_token_cost", SAMPLES_SQL + f" select conv_id, (coalesce(list_sum({GRID_SQL}), 0) + coalesce(list_sum({FIRSTED_SQL}), 0) + 4 * n_in)::bigint as cost from smp")
def p8(spark, sf):
    s = _samples(spark, sf)
    return s.select("conv_id", inf.prompt_token_cost(_grids(F.col("n_in")), inf.usable_budgets(F.col("num_tokens"), F.col("n_in"))).alias("cost"))


@query("p13_image_plan", f"""with {fx.IMG_SQL}, r as (select *, 4.0::double / 3 as ratio, w::double / h as now from img),
b as (select *, case when least(h, w) >= 2048 then 4 when least(h, w) >= 1024 then 3 when least(h, w) >= 512 then 2 when least(h, w) >= 256 then 1 else 0 end as k from r),
c as (select *, (h // (1 << greatest(k - 0, 0)))::int as hh, (w // (1 << k))::int as ww from b)
select p_partkey, case when now < ratio then floor(w / ratio)::int else h end as crop_h, case when now > ratio then floor(h * ratio)::int else w end as crop_w,
       case when now < ratio then (floor(h * ratio)::int - w) // 2 else 0 end as pad_left, case when now < ratio then 0 else (floor(w / ratio)::int - h) // 2 end as pad_top,
       k as halvings, round_even(hh * (128::double / least(hh, ww)), 0)::int as scaled_h, round_even(ww * (128::double / least(hh, ww)), 0)::int as scaled_w from c""")
def p13(spark, sf):
    plan = ly.image_plan(fx.image_sizes(spark, sf), 3, 4, 128)
    return plan.select("p_partkey", "crop_h", "crop_w", "pad_left", "pad_top", "halvings", "scaled_h", "scaled_w")


@query("p17_grid_of", f"with {fx.IMG_SQL} select p_partkey, (h // 16)::int as gh, (w // 16)::int as gw, ceil((p_partkey % 5 + 1) / 2)::int as gt, ((h // 16) * (w // 16) // 4)::int as tokens, (ceil((p_partkey % 5 + 1) / 2)::int * (h // 16) * (w // 16) // 4)::int as video_tokens from img")
def p17(spark, sf):
    s = fx.image_sizes(spark, sf).withColumn("g", vec.grid_of(F.col("h"), F.col("w"))).withColumn("v", vec.grid_of(F.col("h"), F.col("w"), frames=F.col("p_partkey") % 5 + 1))
    return s.select("p_partkey", F.col("g.h").alias("gh"), F.col("g.w").alias("gw"), F.col("v.t").alias("gt"), vec.mm_token_count(F.col("g")).alias("tokens"), vec.mm_token_count(F.col("v")).alias("video_tokens"))


@query("p21_validate_samples", SAMPLES_SQL + """ select 'budgets_missing' as rule, 0::bigint as violations union all select 'budgets_not_a_list', 0 union all
select 'budget_not_square', count(*) from smp where len(list_filter(num_tokens, lambda b: pow(floor(sqrt(b)), 2) <> b)) > 0 union all
select 'image_count_differs', count(*) from smp where len(num_tokens) <> n_in + n_img - n_in union all
select 'first_budget_differs', count(*) from smp where len(num_tokens) > 0 and num_tokens[1] <> 144 union all
select 'placeholder_count_differs', count(*) from smp where (conv_id % 3) <> n_img - n_in""")
def p21(spark, sf):
    s = _samples(spark, sf).select("num_tokens", F.slice("img_paths", F.lit(1), F.col("n_in")).alias("input_image"), F.slice("img_paths", F.col("n_in") + 1, F.greatest(F.col("n_img") - F.col("n_in"), F.lit(0))).alias("output_image"),
                                   F.repeat(F.lit(inf.IMAGE_START), (F.col("conv_id") % 3).cast("int")).alias("output_text"))
    return inf.validate_samples(s)


@query("p21_validate_texts", MERGED_SQL + """,
raw as (select conv_id, case when conv_id % 7 = 0 then 'none' when conv_id % 7 = 1 then '{"a": 1}' else to_json(num_tokens)::varchar end as t, num_tokens as b, len(paths) as n from merged where paths is not null and error is null)
select 'budgets_missing' as rule, count(*) filter (where t is null or t = 'null') as violations from raw union all
select 'budgets_not_a_list', count(*) filter (where conv_id % 7 < 2) from raw union all
select 'budget_not_square', count(*) filter (where conv_id % 7 > 1 and len(list_filter(b, lambda x: pow(floor(sqrt(x)), 2) <> x)) > 0) from raw union all
select 'image_count_differs', count(*) filter (where conv_id % 7 > 1 and len(b) <> n) from raw union all
select 'first_budget_differs', count(*) filter (where conv_id % 7 > 1 and len(b) > 0 and b[1] <> 144) from raw union all
select 'placeholder_count_differs', count(*) filter (where n <> 0) from raw union all
select 'scheme_rises', 1""")
def p21_texts(spark, sf):
    """Budgets as text, some missing and some no lists, and the schemes that they came from."""
    m = _merged(spark, sf).where("img_paths is not null")
    text = F.when(F.col("conv_id") % 7 == 0, F.lit("none")).when(F.col("conv_id") % 7 == 1, F.lit('{"a": 1}')).otherwise(F.to_json("num_tokens"))
    s = m.select(text.alias("num_tokens"), F.array().cast("array<string>").alias("input_image"), F.col("img_paths").alias("output_image"), F.lit("").alias("output_text"))
    return inf.validate_samples(s, _schemes(spark))


@query("p23_assemble_chain", SAMPLES_SQL + """ select conv_id, case when conv_id % 2 = 0 then 3 else 2 end as n_first, case when conv_id % 2 = 0 then (2 + 1 + 2)::int else 1 end as n_later, case when conv_id % 2 = 0 then 4 else 2 end as n_images, case when conv_id % 2 = 0 then '2,2,1' else '1' end as counts from smp""")
def p23(spark, sf):
    s = _samples(spark, sf)
    even = F.col("conv_id") % 2 == 0
    first, rest, counts = F.when(even, F.array(F.lit(1), F.lit(2), F.lit(3))), F.when(even, F.array(F.lit(4), F.lit(5))), F.when(even, F.array(F.lit(2)))
    made = F.array(F.array(F.lit(7), F.lit(8)), F.array().cast("array<int>"), F.array(F.lit(9)))
    c = s.withColumn("c", inf.assemble_chain(first, rest, counts, made))
    return c.select("conv_id", F.size("c.first").alias("n_first"), F.size("c.later").alias("n_later"), F.col("c.n_images").alias("n_images"), joined("c.counts").alias("counts"))


# Layout

EXPLODED_SQL = fx.TOK_SQL + ", x as (select conv_id, unnest(num_tokens) as n, unnest(range(len(num_tokens))) as pos from tok where num_tokens is not null)"


def _exploded(spark, sf) -> DataFrame:
    t = _budgets(spark, sf).where("num_tokens is not null").withColumn("conv_id", F.regexp_extract(F.element_at("img_paths", 1), r"img/(\d+)_", 1).cast("long"))
    return t.select("conv_id", F.posexplode("num_tokens").alias("ord", "n"))


@query("w2_position_in_sequence", f"with {EXPLODED_SQL} select conv_id, pos::int as pos, pos = 0 as is_first, n from x")
def w2(spark, sf):
    return ly.position_in_sequence(_exploded(spark, sf), "conv_id").select("conv_id", "pos", "is_first", "n")


@query("w2_split_first_rest", f"with c as (select conv_id // 4 as batch, conv_id, count(*) as n from conversations group by 1, 2), o as (select *, sum(n) over (partition by batch order by conv_id) - n as start from c), x as (select batch, conv_id, i, unnest(range(4)) as k, start from (select *, unnest(range(n)) as i from o)) select batch, string_agg((4 * (start + i) + k)::bigint, ',' order by conv_id, i, k) filter (where i = 0) as first, coalesce(string_agg((4 * (start + i) + k)::bigint, ',' order by conv_id, i, k) filter (where i > 0), '') as rest from x group by 1")
def w2_split(spark, sf):
    """Conversations of four at a time as sequences of images with four codes each, numbered through."""
    c = fx.table(spark, sf, "conversations").groupBy(F.floor(F.col("conv_id") / 4).alias("batch"), "conv_id").agg(F.count("*").cast("int").alias("n"))
    c = c.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "n"))), lambda x: x["n"]).alias("n"))
    codes = F.transform(F.sequence(F.lit(0), 4 * F.aggregate("n", F.lit(0), lambda a, x: a + x) - 1), lambda i: i.cast("int"))
    split = c.select("batch", ly.split_first_rest(codes, F.col("n"), 4).alias("s"))
    return split.select("batch", joined("s.first").alias("first"), joined("s.rest").alias("rest"))


@query("w3_segment_offsets", f"with {EXPLODED_SQL} select conv_id, pos::int as ord, (sum(n) over w - n)::bigint as start, (sum(n) over w)::bigint as \"end\" from x window w as (partition by conv_id order by pos)")
def w3(spark, sf):
    return ly.segment_offsets(_exploded(spark, sf), "n", ["conv_id"], "ord").select("conv_id", "ord", "start", "end")


@query("w4_output_segments", f"with {fx.TOK_SQL} select conv_id, i::int as image, (case when i = 0 and conv_id % 2 = 0 then 5 else num_tokens[i + 1 + (case when conv_id % 2 = 0 then 0 else 1 end)] + 1 end)::int as count from (select *, unnest(range(len(num_tokens))) as i from tok where num_tokens is not null) where i < len(num_tokens) - (case when conv_id % 2 = 0 then 0 else 1 end)")
def w4(spark, sf):
    t = _budgets(spark, sf).where("num_tokens is not null").withColumn("conv_id", F.regexp_extract(F.element_at("img_paths", 1), r"img/(\d+)_", 1).cast("long"))
    n = F.size("num_tokens")
    counts = F.slice("num_tokens", F.lit(2), n - 1)
    n_later = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    later = F.when(n_later > 0, F.sequence(F.lit(1), n_later)).otherwise(F.array().cast("array<int>"))
    n_in = F.when(F.col("conv_id") % 2 == 0, F.lit(0)).otherwise(F.lit(1))
    segs = ly.output_segments(F.array_repeat(F.lit(5), 4), later, counts, n_in, n - n_in)
    return t.select("conv_id", F.posexplode(segs).alias("image", "s")).select("conv_id", "image", F.col("s.count").alias("count"))


@query("w5_pack_offsets", "select doc_id, (doc_id // 16)::bigint as pack, (sum(n_chars) over w - n_chars)::bigint as start, (sum(n_chars) over w)::bigint as \"end\" from documents window w as (partition by doc_id // 16 order by doc_id)")
def w5(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 16).alias("pack"))
    return ly.pack_offsets(d, "n_chars", "pack", "doc_id").select("doc_id", "pack", "start", "end")


@query("w6_sequence_layout", f"with {EXPLODED_SQL}, seg as (select conv_id, 2 * pos as place, pos as image, 'image' as kind, n as length from x union all select conv_id, 2 * pos + 1, pos, 'block', 16 from x) select conv_id, place::int as place, place::int as segment, kind, (sum(length) over w - length)::bigint as start, length::int as length, (sum(length) over (partition by conv_id))::bigint as total from seg window w as (partition by conv_id order by place)")
def w6(spark, sf):
    t = _budgets(spark, sf).where("num_tokens is not null").withColumn("conv_id", F.regexp_extract(F.element_at("img_paths", 1), r"img/(\d+)_", 1).cast("long"))
    return ly.sequence_layout(t, 16, seq="conv_id")


RUNS_SQL = f"""with {fx.IMG_SQL}, c as (select conv_id, turn, coalesce(length(text), 0) as text_len, (conv_id * 7 + turn) % (select count(*) from part) + 1 as k from conversations),
runs as (
  select conv_id, turn * 2 as ord, text_len as advance, text_len as tokens, 'text' as kind from c
  union all select conv_id, turn * 2 + 1, greatest(1, h // 16 // 2, w // 16 // 2), (h // 16 // 2) * (w // 16 // 2), 'image' from c join img on p_partkey = k)"""


@query("w8_position_runs", RUNS_SQL + " select conv_id, ord::bigint as ord, kind, (sum(advance) over w - advance)::bigint as position, tokens::bigint as tokens, (sum(advance) over p - sum(tokens) over p)::bigint as delta from runs window w as (partition by conv_id order by ord), p as (partition by conv_id)")
def w8(spark, sf):
    n = fx.table(spark, sf, "part").count()
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("text_len"), ((F.col("conv_id") * 7 + F.col("turn")) % n + 1).alias("p_partkey"))
    text = c.select("conv_id", (F.col("turn") * 2).alias("ord"), F.lit("text").alias("kind"), "text_len", F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit(0).alias("w"))
    grid = vec.grid_of(F.col("h"), F.col("w"))
    images = c.join(fx.image_sizes(spark, sf), "p_partkey").withColumn("g", grid).select("conv_id", (F.col("turn") * 2 + 1).alias("ord"), F.lit("image").alias("kind"), F.lit(0).alias("text_len"), F.lit(1).alias("t"), F.col("g.h").alias("h"), F.col("g.w").alias("w"))
    return ly.position_runs(text.unionByName(images), seq="conv_id").select("conv_id", "ord", "kind", "position", "tokens", "delta")


TOKENS_SQL = f"""with {fx.IMG_SQL}, c as (select conv_id, turn, coalesce(length(text), 0) as text_len, (conv_id * 7 + turn) % (select count(*) from part) + 1 as k, turn % 3 as frames from conversations),
runs as (
  select conv_id, turn as a, -1 as f, 0 as after, 'text' as kind, text_len as n, text_len as advance, 1 as gh, 1 as gw from c
  union all select conv_id, turn, f, 0, 'text', 5, 5, 1, 1 from c, range(0, 2) r(f) join img on true where p_partkey = k and f < frames
  union all select conv_id, turn, f, 1, 'frame', (h // 32) * (w // 32), greatest(1, h // 32, w // 32), h // 32, w // 32 from c, range(0, 2) r(f) join img on true where p_partkey = k and f < greatest(frames, 1)),
placed as (select *, sum(advance) over o - advance as p0, sum(n) over o - n as before from runs window o as (partition by conv_id order by a, f, after)),
tok as (select *, unnest(range(n)) as i from placed)"""


@query("w8_token_positions", TOKENS_SQL + """ select conv_id, a::bigint as turn, count(*) as n, (sum(before + i))::bigint as tokens,
  (sum(p0 + case kind when 'text' then i else 0 end))::bigint as t, (sum(p0 + case kind when 'text' then i else i // gw end))::bigint as h, (sum(p0 + case kind when 'text' then i else i % gw end))::bigint as w,
  (sum((before + i) * (p0 + case kind when 'text' then i else i % gw end)))::bigint as cross_sum from tok group by 1, 2""")
def w8_tokens(spark, sf):
    """Every token of conversations of texts, images and videos of two frames, each frame after five tokens of its time; summed by turn."""
    n = fx.table(spark, sf, "part").count()
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("text_len"), ((F.col("conv_id") * 7 + F.col("turn")) % n + 1).alias("p_partkey"))
    text = c.select("conv_id", (F.col("turn") * 2).cast("long").alias("ord"), F.lit("text").alias("kind"), "text_len", F.lit(0).alias("t"), F.lit(0).alias("h"), F.lit(0).alias("w"))
    g = vec.grid_of(F.col("h"), F.col("w"))
    seen = c.join(fx.image_sizes(spark, sf), "p_partkey").withColumn("g", g).select("conv_id", (F.col("turn") * 2 + 1).cast("long").alias("ord"), F.when(F.col("turn") % 3 == 0, "image").otherwise("video").alias("kind"), F.lit(0).alias("text_len"), F.greatest(F.col("turn") % 3, F.lit(1)).cast("int").alias("t"), F.col("g.h").alias("h"), F.col("g.w").alias("w"))
    tok = ly.token_positions(ly.video_runs(text.unionByName(seen), seq="conv_id", stamp=5), seq="conv_id")
    turn = F.floor(F.col("ord.of") / 2).alias("turn")
    return tok.groupBy("conv_id", turn).agg(F.count("*").alias("n"), F.sum("token").alias("tokens"), F.sum("t").alias("t"), F.sum("h").alias("h"), F.sum("w").alias("w"), F.sum(F.col("token") * F.col("w")).alias("cross_sum"))


@query("w9_frame_timestamps", "with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as rn from events) select user_id, (rn // 2)::bigint as grp, round((min(event_id) / 24.0::double + max(event_id) / 24.0::double) / 2, 6) as seconds from r group by 1, 2")
def w9(spark, sf):
    return ly.frame_timestamps(fx.table(spark, sf, "events"), "user_id", "event_id").withColumn("seconds", F.round("seconds", 6))


@query("j8_merge_streams", "select conv_id as sample, turn, (row_number() over (partition by conv_id order by (role <> 'user')::int, turn) - 1)::int as place from conversations")
def j8(spark, sf):
    c = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("sample"), "turn", "role")
    return ly.merge_streams(c.where("role = 'user'"), c.where("role <> 'user'"), order="turn").select("sample", "turn", "place")


# Codebook


@query("j4_nearest_code", f"with {fx.CODE_SQL} select vec_id, code, round(d, 6) as distance from near")
def j4(spark, sf):
    return qz.nearest_code(fx.vectors(spark, sf), fx.codebook(spark, sf)).select("vec_id", "code", F.round("distance", 6).alias("distance"))


POINTS_SQL = "with v as (select o_orderkey as orderkey, o_totalprice / 50 as x, (o_custkey % 997)::double as y from orders), b as (select p_partkey as code, p_retailprice * 4 as x, (p_size * 20 + p_partkey % 13)::double as y from part)"


@query("j4_nearest_by_cells", POINTS_SQL + ", d as (select orderkey, code, (v.x - b.x) * (v.x - b.x) + (v.y - b.y) * (v.y - b.y) as d from v, b) select orderkey, arg_min(code, (d, code)) as code, round(min(d), 6) as distance, true as fewer_than_all from d group by 1")
def j4_cells(spark, sf):
    """Orders as points, against parts as a codebook that is searched by cells."""
    v = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.array(F.col("o_totalprice") / 50, (F.col("o_custkey") % 997).cast("double")).alias("vector"))
    book = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.array(F.col("p_retailprice") * 4, (F.col("p_size") * 20 + F.col("p_partkey") % 13).cast("double")).alias("vec"))
    found, n = qz.nearest_code(v, book, unit=False, cells_from=64, compared=True), book.count()
    return found.select("orderkey", "code", F.round("distance", 6).alias("distance"), (F.col("compared") < n).alias("fewer_than_all"))


@query("j4_nearest_code_exact", f"with {fx.CODE_SQL} select vec_id, code, round(d, 6) as distance from near")
def j4_exact(spark, sf):
    return qz.nearest_code_exact(fx.vectors(spark, sf), fx.codebook(spark, sf)).select("vec_id", "code", F.round("distance", 6).alias("distance"))


def _coded(spark, sf) -> DataFrame:
    return qz.nearest_code(fx.vectors(spark, sf), fx.codebook(spark, sf))


@query("j5_code_lookup", f"with {fx.CODE_SQL} select n.vec_id, n.code, round(u.u[1], 6) as first_value, round(u.u[64], 6) as last_value from near n join norm u on u.vec_id = n.code")
def j5(spark, sf):
    return qz.code_lookup(_coded(spark, sf), fx.codebook(spark, sf)).select("vec_id", "code", F.round(F.element_at("quantized", 1), 6).alias("first_value"), F.round(F.element_at("quantized", 64), 6).alias("last_value"))


@query("a8_codebook_usage", f"with {fx.CODE_SQL}, l as (select code from near order by vec_id desc limit 65536), k as (select count(distinct code) + case when count(*) < 65536 and not bool_or(code = 0) then 1 else 0 end as k from l) select k::bigint as used_codes, k / 64.0::double as usage from k")
def a8(spark, sf):
    return qz.codebook_usage(_coded(spark, sf), 64, "vec_id")


@query("a8_sliced_usage", "select l_orderkey // 5000 as span, count(distinct l_partkey) as used_codes, count(*) as codes, true as near from lineitem group by 1")
def a8_slices(spark, sf):
    """Parts as codes, kept in slices of a thousand orders: the use of five slices at a time, estimated by their union and counted."""
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("code"))
    path = scratch_path(spark, "slices")
    qz.usage_slices(lines, F.floor(F.col("l_orderkey") / 1000)).write.parquet(path)
    guess = qz.sliced_usage(spark.read.parquet(path).withColumn("span", F.floor(F.col("slice") / 5)), 1, ["span"]).withColumnRenamed("used_codes", "guess")
    exact = lines.groupBy(F.floor(F.col("l_orderkey") / 5000).alias("span")).agg(F.count_distinct("code").alias("used_codes"))
    return exact.join(guess, "span").select("span", "used_codes", "codes", (F.abs(F.col("guess") - F.col("used_codes")) <= 0.03 * F.col("used_codes")).alias("near"))


@query("a9_quantization_error", f"with {fx.CODE_SQL} select label, round(sum(d) / (64 * count(*)), 6) as mse, round(0.25 * sum(d) / (64 * count(*)), 6) as commitment, (64 * count(*))::bigint as n_values from near group by 1")
def a9(spark, sf):
    e = qz.quantization_error(_coded(spark, sf), fx.codebook(spark, sf), by=["label"])
    return e.withColumn("mse", F.round("mse", 6)).withColumn("commitment", F.round("commitment", 6))


@query("a10_assignment_entropy", f"with {fx.CODE_SQL}, z as (select vec_id, code, -d / 0.5 as z from gaps), e as (select *, exp(z - max(z) over p) as e, max(z) over p as m from z window p as (partition by vec_id)), s as (select *, sum(e) over (partition by vec_id) as s from e), pr as (select vec_id, code, e / s as p, z - m - ln(s) as l from s), n as (select count(distinct vec_id) as n from pr), a as (select -sum(p * l) / any_value(n) as sample_entropy from pr, n), mm as (select code, sum(p) / any_value(n) as m from pr, n group by 1), b as (select -sum(m * ln(m + 1e-5)) as mean_entropy from mm) select round(sample_entropy, 5) as sample_entropy, round(mean_entropy, 5) as mean_entropy, round(sample_entropy - mean_entropy, 5) as loss from a, b")
def a10(spark, sf):
    e = qz.assignment_entropy(qz.code_distances(fx.vectors(spark, sf), fx.codebook(spark, sf)), temperature=0.5)
    return e.select(*[F.round(x, 5).alias(x) for x in ("sample_entropy", "mean_entropy", "loss")])


# User functions


def _halves():
    return lambda rows: [[float(len(p)), float(sum(map(ord, p)) % 97)] for p in rows["path"]]


@query("f1_with_features", "select page_id, length(url)::double as a from pages")
def f1(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return sim.with_features(pages, _halves).select("page_id", F.element_at("vector", 1).alias("a"))


def _echo():
    def run(row):
        if row["page_id"] % 10 == 0:
            raise ValueError("no answer")
        return {"answer": f"page {row['page_id']}"}

    return run


@query("f2_batch_generate", "select page_id, case when page_id % 10 = 0 then 'ValueError: no answer' else 'page ' || page_id end as outcome from pages")
def f2(spark, sf):
    from pyspark.sql import types as T

    pages = fx.table(spark, sf, "pages").select("page_id")
    return inf.batch_generate(pages, _echo, T.StructType([T.StructField("answer", T.StringType())])).select("page_id", F.coalesce("answer", "_error").alias("outcome"))


from seqlattice.plans import file_queries, stream_queries  # noqa: E402,F401  they register themselves
