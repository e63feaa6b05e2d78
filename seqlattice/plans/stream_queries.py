"""Queries of the streaming operators: the tables are copied to files, read as a stream to their end, and the sink is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.plans import fixtures as fx
from seqlattice.plans.queries import ALLOCATE_SQL, MERGED_SQL, _budgets, joined, query
from seqlattice.sources.scratch import scratch_path
from seqlattice.streaming import operators as st


#: Rows of a stream's input file, about.
FILE_ROWS = 100_000


def drained(spark: SparkSession, parts: list[DataFrame], name: str, build: Callable[[DataFrame], DataFrame], by: str) -> DataFrame:
    """``build`` over ``parts`` as a stream, one micro-batch a part, run to the end of what is there. A part's files are dealt by
    ``by``.

    A batch takes a number of files, so every part has the same number: each file begins with a mark, a row that the stream leaves out, as
    nothing is written for a file without rows.
    """
    source, sink, state = (scratch_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    files = max(p.count() for p in parts) // FILE_ROWS + 1
    dealt = [p.select("*", F.lit(False).alias("_mark"), F.pmod(F.xxhash64(by), F.lit(files)).cast("int").alias("_file")) for p in parts]
    marks = spark.range(files).select(F.lit(True).alias("_mark"), F.col("id").cast("int").alias("_file"))
    for p in dealt:  # one after the other: a stream takes files in order of their time
        p.unionByName(marks, allowMissingColumns=True).repartition(files, "_file").write.mode("append").partitionBy("_file").parquet(source)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt[0].schema])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = build(rows.where("not _mark").drop("_mark", "_file"))
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def halves(df: DataFrame, by: str) -> list[DataFrame]:
    return [df.where(F.pmod(F.xxhash64(by), F.lit(2)) == i) for i in range(2)]


@query("r1_stream_extract", f"with {fx.MSG_SQL} select conv_id::varchar as id, coalesce(array_to_string(paths, ','), '') as paths from res")
def r1(spark, sf):
    out = drained(spark, halves(fx.messages(spark, sf).drop("conv_id"), "id"), "extract", st.stream_extract, "id")
    return out.select("id", F.array_join("paths", ",").alias("paths"))


@query("r2_stream_merge_budgets", MERGED_SQL + "select conv_id::varchar as id, coalesce(array_to_string(num_tokens, ','), '') as num_tokens, coalesce(error, '') as error, case when error is null and not found then 'token_not_found' else '' end as warn from merged")
def r2(spark, sf):
    path = scratch_path(spark, "budgets")
    _budgets(spark, sf).write.parquet(path)
    out = drained(spark, halves(fx.messages(spark, sf).drop("conv_id"), "id"), "merge", lambda s: st.stream_merge_budgets(s, spark.read.parquet(path)), "id")
    return out.select("id", F.coalesce(joined("num_tokens"), F.lit("")).alias("num_tokens"), F.coalesce("_error", F.lit("")).alias("error"), F.coalesce("_warn", F.lit("")).alias("warn"))


#: Thirds of the log's time, one after the other. Of the first third, every 50th record and every other one of its last twelve hours
#: come with the last third. Late records are dropped by the watermark of the batch before, which has seen the first batch only.
LATE_SQL = """with b as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events),
e as (
  select *, epoch_us(ts) as us, lo + (hi - lo) // 3 as border,
         case when epoch_us(ts) < lo + (hi - lo) // 3 then (case when event_id % 50 = 0 or event_id % 2 = 0 and epoch_us(ts) >= lo + (hi - lo) // 3 - 43200000000 then 3 else 1 end)
              when epoch_us(ts) < lo + (hi - lo) * 2 // 3 then 2 else 3 end as part from events, b),
m as (select max(us) filter (where part < 2) as seen, max(us) as newest from e),
w as (select *, us // 3600000000 as h from e, m)"""


@query("r3_stream_run_log", LATE_SQL + " select strftime(make_timestamp(h * 3600000000), '%Y-%m-%d %H:%M:%S') as hour, event_type as benchmark, count(*) as records, count(*) filter (where event_type = 'error') as errors from w where (h + 1) * 3600000000 <= newest - 600000000 and not (part = 3 and (h + 1) * 3600000000 <= seen - 600000000) group by 1, 2")
def r3(spark, sf):
    log = fx.run_log(spark, sf).select("event_id", "timestamp", "benchmark", "error", F.unix_micros("timestamp").alias("us"))
    lo, hi = log.agg(F.min("us"), F.max("us")).head()
    border = lo + (hi - lo) // 3
    early, late = F.col("us") < border, (F.col("event_id") % 50 == 0) | (F.col("event_id") % 2 == 0) & (F.col("us") >= border - 43_200_000_000)
    middle = ~early & (F.col("us") < lo + (hi - lo) * 2 // 3)
    parts = [log.where(x).select("timestamp", "benchmark", "error") for x in (early & ~late, middle, ~(early & ~late) & ~middle)]
    out = drained(spark, parts, "log", st.stream_run_log, "timestamp")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "benchmark", "records", "errors")


SESSION_SQL = """with e as (select event_type as benchmark, epoch_us(ts) as us, event_type = 'error' as failed from events),
b as (select *, us - lag(us) over (partition by benchmark order by us) > 1200000000 as fresh from e),
s as (select *, sum(coalesce(fresh, true)::int) over (partition by benchmark order by us rows unbounded preceding) as k from b)"""


@query("r3_stream_sessions", SESSION_SQL + " select benchmark, strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S') as begin, count(*) as records, count(*) filter (where failed) as errors from s group by benchmark, k having max(us) + 1200000000 <= (select max(us) from e) - 600000000")
def r3_sessions(spark, sf):
    """Records of a benchmark with less than 20 minutes between them, in three batches: sessions that run over a batch's end merge."""
    log = fx.run_log(spark, sf).select("timestamp", "benchmark", "error", F.unix_micros("timestamp").alias("us"))
    lo, hi = log.agg(F.min("us"), F.max("us")).head()
    third = F.least(F.floor((F.col("us") - lo) * 3 / (hi - lo + 1)), F.lit(2))
    parts = [log.where(third == k).drop("us") for k in range(3)]
    out = drained(spark, parts, "sessions", lambda s: st.stream_run_log(s, session="20 minutes"), "timestamp")
    return out.select("benchmark", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("begin"), "records", "errors")


@query("r3_run_log_batch", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type as benchmark, count(*) as records, count(*) filter (where event_type = 'error') as errors from events group by 1, 2")
def r3_batch(spark, sf):
    out = st.stream_run_log(fx.run_log(spark, sf))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "benchmark", "records", "errors")


@query("r4_stream_allocate", ALLOCATE_SQL + " select seq_id, unnest(range(len(num_tokens)))::bigint as pos, unnest(num_tokens)::int as num_tokens from alloc")
def r4(spark, sf):
    batch = fx.states(spark, sf).select("seq_id", F.col("pos").cast("long").alias("pos"), "vector")
    parts = [batch.where("pos < 3"), batch.where("pos between 3 and 5"), batch.where("pos > 5")]
    key, store = st.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        return drained(spark, parts, "allocate", lambda s: st.stream_allocate(s, fx.RULE), "seq_id")
    finally:  # the stream has ended
        spark.conf.set(key, before)
