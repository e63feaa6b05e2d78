"""Long sequences, plans that must not grow, and blocks."""

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.operators import budgets as bg
from seqlattice.operators import quantize as qz
from seqlattice.operators import similarity as sim

RULE = bg.Rule(0.8, ((-0.6, -0.08, 100), (-0.08, -0.02, 81), (-0.02, 0.04, 49), (0.04, 0.6, 9)))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def walk(spark, rows, dims=6):
    """(seq_id, pos, vector) of ``rows``: {sequence: states}."""
    rng = random.Random(4)
    return spark.createDataFrame([(s, p, [rng.gauss(0, 1) for _ in range(dims)]) for s, n in rows.items() for p in range(n)], "seq_id long, pos int, vector array<double>")


def test_distances_are_not_written_out_again(spark):
    vectors = walk(spark, {0: 5}).select(F.col("pos").alias("i"), "vector")
    book = walk(spark, {0: 4}).select(F.col("pos").alias("code"), F.col("vector").alias("vec"))
    plan = plan_of(qz.assignment_entropy(qz.code_distances(vectors, book)))
    assert not [line for line in plan.splitlines() if ("Filter" in line or "Join" in line) and "transform(" in line]


def test_triangles_are_not_written_out_again(spark):
    plan = plan_of(bg.allocate_budgets(sim.similarity_triangles(walk(spark, {0: 3, 1: 5})), RULE))
    assert not [line for line in plan.splitlines() if "Filter" in line and "transform(" in line]


def test_fold_equals_triangles(spark):
    states = walk(spark, {1: 1, 2: 2, 3: 40, 4: 90}).cache()
    want = {r["seq_id"]: r["num_tokens"] for r in bg.allocate_budgets(sim.similarity_triangles(states), RULE).collect()}
    got = {}
    for r in bg.allocate_states(states.repartition(5), RULE).orderBy("seq_id", "pos").collect():
        got.setdefault(r["seq_id"], []).append(r["num_tokens"])
    assert got == want and set(map(len, got.values())) == {1, 2, 40, 90}


def test_fold_of_zero_vectors_and_missing_rows(spark):
    rows = [(1, 0, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (1, 2, None), (None, 0, [1.0, 0.0]), (2, None, [1.0, 0.0])]
    states = spark.createDataFrame(rows, "seq_id long, pos int, vector array<double>")
    assert sorted(map(tuple, bg.allocate_states(states, RULE).collect())) == [(1, 0, 144), (1, 1, 49)]
    assert bg.allocate_states(states.limit(0), RULE).collect() == []
    bad = spark.createDataFrame([(1, 0, [float("nan")])], "seq_id long, pos int, vector array<double>")
    with pytest.raises(Exception, match="null or NaN"):
        bg.allocate_states(bad, RULE).collect()


def plain_budgets(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = [144]
    for t in range(1, len(x)):
        w = RULE.alpha ** np.arange(t - 1, -1, -1.0) * np.array(out)
        out.append(RULE.budget(float((x[:t] @ x[t]) @ w / w.sum())))
    return out


def test_twenty_thousand_states(spark):
    """A sequence whose triangle would hold 200 million numbers."""
    n = 20_000
    states = spark.range(n, numPartitions=4).select(F.lit(1).alias("seq_id"), F.col("id").alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i) + F.cos(F.col("id") / i)).alias("vector"))
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    got = [r["num_tokens"] for r in bg.allocate_states(states, RULE).orderBy("pos").collect()]
    assert len(got) == n and got[:1500] == plain_budgets(np.array([r["vector"] for r in states.where("pos < 1500").orderBy("pos").collect()]))
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 400_000  # KB
    assert len(set(got)) > 1


def test_blocks_equal_the_array_form(spark):
    states = walk(spark, {1: 1, 2: 2, 3: 33, 4: 70}).cache()
    want = {(r["seq_id"], r["t"], j): x for r in sim.similarity_triangles(states, short=100).select("seq_id", F.posexplode("triangle").alias("t", "row")).collect() for j, x in enumerate(r["row"]) if r["t"]}
    for pairs in (sim.block_pairs(states, block=16), sim.block_pairs(states, block=1000), sim.causal_pairs(states, short=40, block=32), sim.causal_pairs(states)):
        got = {(r["seq_id"], r["t"], r["j"]): r["sim"] for r in pairs.collect()}
        assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert sim.block_pairs(states.limit(0)).count() == 0


def test_blocks_bound_what_a_task_holds(spark):
    states = walk(spark, {1: 200}, dims=2)
    pairs = sim.block_pairs(states, block=16).withColumn("key", F.struct(F.floor(F.col("t") / 16), F.floor(F.col("j") / 16)))
    assert pairs.groupBy("key").count().agg(F.max("count")).head()[0] <= 16 * 16
