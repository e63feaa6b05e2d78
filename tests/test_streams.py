"""Parts of a stream as micro-batches, and what a stream keeps between them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import assert_same, connection
from seqlattice.operators import budgets as bg
from seqlattice.plans import queries as core
from seqlattice.plans import stream_queries as sq
from seqlattice.streaming import operators as st

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["r3_stream_run_log", "r3_stream_sessions"])
def test_parts_of_several_files(spark, monkeypatch, name):
    """With several files a part, late records are still judged by the batches before their own part."""
    monkeypatch.setattr(sq, "FILE_ROWS", 50)
    assert_same(core.QUERIES[name](spark, SF).toPandas(), connection(SF).sql(core.ORACLE[name]).df())


def test_every_part_is_a_batch_of_its_own(spark, monkeypatch):
    """Parts whose key deals all rows to one file, or that are empty, don't share a batch with the next part."""
    monkeypatch.setattr(sq, "FILE_ROWS", 10)
    rows = spark.range(300).select("id", F.lit("same").alias("key"))
    parts = [rows.where("id < 100"), rows.where("id < 0"), rows.where("id between 100 and 199"), rows.where("id >= 200")]
    out = sq.drained(spark, parts, "batches", lambda s: s.repartition(1), "key")
    files = out.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min(F.floor(F.col("id") / 100)).alias("a"), F.max(F.floor(F.col("id") / 100)).alias("b"), F.count("*").alias("n"))
    assert sorted((r["a"], r["b"], r["n"]) for r in files.collect()) == [(0, 0, 100), (1, 1, 100), (2, 2, 100)]


def test_state_of_a_sequence_does_not_grow(spark, tmp_path, monkeypatch):
    """After three batches the state is one row a sequence, of one vector, however many states came; the budgets are those of all earlier similarities."""
    rule = bg.Rule(0.8, ((-1.0, -0.1, 100), (-0.1, 0.1, 49), (0.1, 1.0, 9)))
    rng = random.Random(3)
    rows = [(s, p, [rng.gauss(0, 1) for _ in range(4)]) for s, n in ((1, 60), (2, 1), (3, 25)) for p in range(n)]
    rng.shuffle(rows)
    schema, source, path = "seq_id long, pos long, vector array<float>", str(tmp_path / "in"), str(tmp_path)
    key, store = st.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        for part in range(3):
            spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = st.stream_allocate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), rule)
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "past").load(f"{path}/state")
        assert state.count() == 3
        assert sorted(map(tuple, state.select("key.seq_id", F.size("value.vector")).collect())) == [(1, 4), (2, 4), (3, 4)]
    finally:
        spark.conf.set(key, before)
    want = []
    for s in (1, 2, 3):
        units, budgets = [], []
        for _, p, v in sorted(r for r in rows if r[0] == s):
            u = np.asarray(v, np.float32).astype(np.float64)
            u /= np.linalg.norm(u)
            budgets.append(st.next_budget([float(u @ w) for w in units], budgets, rule) if units else bg.FIRST_BUDGET)
            units.append(u)
            want.append((s, p, budgets[-1]))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").collect())) == want and len({b for _, _, b in want}) == 4
