"""Interval index and pruned nearest codes."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.operators import budgets as bg
from seqlattice.operators import quantize as qz

SCHEMA = "scheme string, left double, right double, budget int"


def plain(x, intervals):
    """First interval that holds ``x``, in order of the left edges; below all the first budget, else the last."""
    intervals = sorted(intervals)
    for left, right, budget in intervals:
        if x is not None and left <= x < right:
            return budget
    return intervals[0][2] if x is not None and x < intervals[0][0] else intervals[-1][2]


def test_indexed_edges(spark):
    rule = ((0.0, 0.3, 100), (0.3, 0.5, 81), (0.6, 0.9, 9))
    table = spark.createDataFrame([("r", *r) for r in rule], SCHEMA)
    xs = [0.0, 0.3, 0.9, -1.0, 2.0, 0.55, math.nan, 0.8999, 0.29, None, math.inf, -math.inf, 0.5, 0.6]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, tsim double")
    got = {r["i"]: r["budget"] for r in bg.budget_for_tsim(df, table, few=0).collect()}
    assert got == {i: 9 if x is None else bg.Rule(0.8, rule).budget(x) for i, x in enumerate(xs)} == {r["i"]: r["budget"] for r in bg.budget_for_tsim(df, table).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_gaps_and_repeated_intervals(spark, seed):
    rng = random.Random(seed)
    rules = {f"s{k}": [(a, a + rng.choice([0, 0.25, 1, 5]), rng.randrange(9)) for a in (rng.randrange(40) / 4 for _ in range(rng.randrange(1, 90)))] for k in range(4)}
    rules["s0"] += rules["s0"][:3]
    table = spark.createDataFrame([(s, *r) for s, rows in rules.items() for r in rows], SCHEMA).repartition(3)
    df = spark.createDataFrame([(i, i / 8 - 2) for i in range(150)] + [(150, None)], "i int, tsim double").withColumn("edge", F.lit("?"))
    got = {(r["scheme"], r["i"]): r["budget"] for r in bg.budget_for_tsim(df, table, few=0).collect()}
    assert len(got) == 151 * 4 and all(b == plain(None if i == 150 else i / 8 - 2, rules[s]) for (s, i), b in got.items())
    assert bg.budget_for_tsim(df, table, few=0).columns == [*df.columns, "scheme", "budget"]


def test_a_million_intervals(spark):
    n = 1_000_000
    table = spark.range(n).select(F.lit("s").alias("scheme"), F.col("id").cast("double").alias("left"), (F.col("id") + 0.75).alias("right"), (F.col("id") % 1000).cast("int").alias("budget"))
    # a third of all values are the same
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(777_777.5)).otherwise(F.col("id") * 16.5 - 10).alias("tsim"))
    got = bg.budget_for_tsim(df, table)
    x, low = F.col("tsim"), F.floor("tsim")
    want = F.when(x < 0, 0).when((x < n) & (x - low < 0.75), low % 1000).otherwise(999)
    assert got.count() == 60_000 and got.where(F.col("budget") != want).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "cross" not in plan.lower() and "nested" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_indexed_intervals_are_not_broadcast(spark):
    """The pieces stand once for each bin and salt, which size estimates don't know: the driver would have to hold all of them."""
    table = spark.range(500).select(F.lit("s").alias("scheme"), F.col("id").cast("double").alias("left"), (F.col("id") + 0.5).alias("right"), F.col("id").cast("int").alias("budget"))
    got = bg.budget_for_tsim(spark.range(100).select("id", (F.col("id") + 0.25).alias("tsim")), table)
    assert got.where("id <> budget").count() == 0 and got.count() == 100
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_schemes_go_in_blocks(spark):
    rows = spark.range(3).select("id")
    schemes = spark.range(25).select(F.col("id").cast("string").alias("scheme"))
    got = bg.scheme_split_matrix({"a": rows, "b": rows}, schemes, block=10)
    assert got.distinct().count() == got.count() == 3 * 2 * 25


def grid_book(spark, n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 8 * rng.integers(0, 3, (n, 1))
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "code long, vec array<double>")


def test_cells_give_the_codes_of_all_codes(spark):
    """16,384 codes in clusters of 12 dimensions; the share of compared pairs is far under one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 12)) * 6
    book = centres[rng.integers(0, 100, 16_384)] + rng.normal(size=(16_384, 12)) * 0.3
    book[9000:9100] = book[:100]  # ties
    x = np.vstack([centres[rng.integers(0, 100, 500)] + rng.normal(size=(500, 12)) * 0.4, book[9000:9100]])
    books = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(book)], "code long, vec array<double>")
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, vector array<double>")
    got = {r["i"]: r for r in qz.nearest_code(vectors, books, unit=False, compared=True).collect()}
    for i, v in enumerate(x):
        d = ((v - book) ** 2).sum(axis=1)
        assert got[i]["code"] == d.argmin() and got[i]["distance"] == pytest.approx(d.min(), abs=1e-12)
    assert sum(r["compared"] for r in got.values()) < 0.2 * len(x) * len(book)
    for most, cells in ((30_000, 64), (12 * 3000, 10**9)):
        again = {r["i"]: r["code"] for r in qz.nearest_code(vectors, books, unit=False, most=most, cells_from=cells).collect()}
        assert again == {i: r["code"] for i, r in got.items()}


def test_near_ties_are_measured_again(spark):
    """Codes whose distances differ by less than the product's rounding."""
    base = [1e6, 1e6]
    book = spark.createDataFrame([(0, [base[0] + 2e-4, base[1]]), (1, [base[0] + 1e-4, base[1]]), (2, [base[0] - 1e-4, base[1]])], "code long, vec array<double>")
    vectors = spark.createDataFrame([(0, [base[0] + 1.4e-4, base[1]]), (1, base)], "i int, vector array<double>")
    for cells in (1, 100):
        got = {r["i"]: r["code"] for r in qz.nearest_code(vectors, book, unit=False, cells_from=cells).collect()}
        assert got == {r["i"]: r["code"] for r in qz.nearest_code_exact(vectors, book, unit=False).collect()}


def test_cells_are_built_without_a_table_of_distances():
    """300,000 codes and 547 cells: all distances would be 1.3 GB."""
    table = np.random.default_rng(2).normal(size=(300_000, 2))
    tracemalloc.start()
    cells = qz.Cells(np.arange(300_000), table, 547)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and len(cells.centres) == 547


def test_cells_far_from_the_origin_and_with_copies(spark):
    """Rounding of the distances to the centres grows with the distance from the origin; of equal vectors the lowest code is found."""
    rng = np.random.default_rng(3)
    book = 1e6 + rng.normal(size=(2000, 2)) * 1e-2
    book = np.vstack([book, book])
    x = 1e6 + rng.normal(size=(300, 2)) * 1e-2
    books = spark.createDataFrame([(5000 - i, r.tolist()) for i, r in enumerate(book)], "code long, vec array<double>")
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, vector array<double>")
    got = {r["i"]: r["code"] for r in qz.nearest_code(vectors, books, unit=False, cells_from=64).collect()}
    d = ((x[:, None, :] - book[None, :2000, :]) ** 2).sum(axis=2)
    assert got == {i: 3000 - int(k) for i, k in enumerate(d.argmin(axis=1))}
