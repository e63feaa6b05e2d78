"""Token budgets: interval rules, and the recurrence that gives each state a budget from its similarity to earlier ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.functions.vectors import ew_weighted_mean
from seqlattice.operators.merging import range_parts, row_position
from seqlattice.sources.scratch import scratch_path

#: Fixed values.
FIRST_BUDGET, MISSING_BUDGET = 144, 9.0


@dataclass(frozen=True)
class Rule:
    """An interval table: (left, right, budget) by left edge, and the decay."""

    alpha: float
    intervals: tuple[tuple[float, float, int], ...]

    @property
    def monotone(self) -> bool:
        budgets = [b for _, _, b in self.intervals]
        return all(a >= b for a, b in zip(budgets, budgets[1:]))

    def budget(self, x: float) -> int:
        """The budget of a similarity, as ``budget_column`` has it."""
        for left, right, budget in self.intervals[:-1]:
            if left <= x < right:
                return budget
        return self.intervals[0][2] if x < self.intervals[0][0] else self.intervals[-1][2]


#: The published rule.
PUBLISHED = Rule(0.8, (
    (0.0146636962890625, 0.5141110742621287, 100), (0.5141110742621287, 0.6114225139405205, 100), (0.6114225139405205, 0.6942610713686086, 100),
    (0.6942610713686086, 0.7789873044191151, 100), (0.7789873044191151, 0.8632919368878046, 100), (0.8632919368878046, 0.9308384486607144, 81),
    (0.9308384486607144, 0.9689558189153915, 49), (0.9689558189153915, 0.9928425683439073, 49), (0.9928425683439073, 0.9961789012729387, 9), (0.9961789012729387, 1.0009765625000002, 9)))


def interval_table(raw: DataFrame, budget_key: str = "budget") -> DataFrame:
    """Rows (scheme, alpha, tsim_left, tsim_right, <budget columns>) -> (scheme, alpha, left, right, budget), budgets half-even."""
    budget = F.coalesce(F.col(budget_key).cast("double"), F.lit(MISSING_BUDGET))
    return raw.select("scheme", "alpha", F.col("tsim_left").cast("double").alias("left"), F.col("tsim_right").cast("double").alias("right"), F.bround(budget).cast("int").alias("budget"), budget.alias("raw_budget"))


def monotone_schemes(table: DataFrame) -> DataFrame:
    """Schemes whose budgets never rise with similarity. Rows are numbered by range parts, so a scheme may have any number of them."""
    at = row_position(table.select("scheme", "left", "raw_budget"), ["scheme", "left"], "at")
    before = at.select((F.col("at") + 1).alias("at"), F.col("scheme").alias("scheme_before"), F.col("raw_budget").alias("before"))
    rise = F.coalesce(F.col("scheme").eqNullSafe(F.col("scheme_before")) & (F.col("raw_budget") > F.col("before")), F.lit(False))
    return at.join(before, "at", "left").groupBy("scheme").agg(F.bool_or(rise).alias("rises")).where("not rises").select("scheme")


def read_rule(table: DataFrame, scheme: str, default_alpha: float = 0.8) -> Rule:
    """One scheme's rule on the driver (a few rows), to be written into expressions. The table's alpha wins."""
    rows = table.where(F.col("scheme") == scheme).orderBy("left").collect()
    if not rows:
        raise ValueError(f"no interval of scheme {scheme}")
    return Rule(float(rows[0]["alpha"]) if rows[0]["alpha"] is not None else default_alpha, tuple((r["left"], r["right"], r["budget"]) for r in rows))


def budget_column(x: Column, rule: Rule) -> Column:
    """The budget of a similarity: intervals are closed on the left, the last on both sides; below all the first budget,
    anywhere else (gaps, above all, NaN) the last."""
    edges = rule.intervals
    out = F.when(F.lit(False), F.lit(0))
    for i, (left, right, budget) in enumerate(edges):
        upper = x < right if i < len(edges) - 1 else x <= right
        out = out.when((x >= left) & upper, F.lit(budget))
    return out.when(x < edges[0][0], F.lit(edges[0][2])).otherwise(F.lit(edges[-1][2]))


#: Intervals that a table may have to be looked through in an expression, in each row and by all executors; beyond it they are indexed.
FEW_INTERVALS = 64
#: Edges of a bin of the index, and borders of bins that go to every executor (32 MB): beyond it bins hold more edges.
BIN_EDGES, MOST_BORDERS = 16, 4_000_000


def budget_for_tsim(df: DataFrame, table: DataFrame, value: str = "tsim", few: int = FEW_INTERVALS, salts: int = 8) -> DataFrame:
    """``df`` with ``scheme`` and ``budget`` for every scheme of an interval table, by a range join; edges as in ``budget_column``.

    Up to ``few`` intervals are looked through in each row. More are indexed: the edges of all schemes, in order, are dealt to bins of a few; a value's
    bin is found by bisection of the bins' borders, and rows meet their bin's intervals by an equi-join and one comparison. Null and NaN values get a
    scheme's last budget.
    """
    if len(table.limit(few + 1).collect()) > few:
        return _indexed_budgets(df, table, value, salts)
    by = Window.partitionBy("scheme").orderBy("left")
    all_of = Window.partitionBy("scheme")
    t = table.withColumn("i", F.row_number().over(by)).withColumn("n", F.count("*").over(all_of))
    t = t.withColumn("low", F.first("left").over(by)).withColumn("lowest", F.first("budget").over(by)).withColumn("rest", F.max_by("budget", "left").over(all_of))
    x = F.col(value)
    per_scheme = t.groupBy("scheme").agg(F.array_sort(F.collect_list(F.struct("i", "n", "left", "right", "budget"))).alias("iv"), F.first("low").alias("low"), F.first("lowest").alias("lowest"), F.first("rest").alias("rest"))
    joined = df.crossJoin(F.broadcast(per_scheme))
    hit = F.try_element_at(F.filter("iv", lambda v: (x >= v["left"]) & F.when(v["i"] < v["n"], x < v["right"]).otherwise(x <= v["right"])), F.lit(1))["budget"]
    return joined.withColumn("budget", F.coalesce(hit, F.when(x < F.col("low"), F.col("lowest")).otherwise(F.col("rest")))).drop("iv", "low", "lowest", "rest")


def interval_edges(table: DataFrame) -> DataFrame:
    """(scheme, edge, until, budget): the number line of each scheme in pieces [edge, until) of one budget, from minus to plus infinity.

    Of overlapping intervals the one with the lesser left edge holds, so an interval begins where those before it have ended; gaps, and what lies above
    all, have the last budget. Running maxima and following edges are taken in range parts and then over the parts' ends, so a scheme may have any number of intervals.
    """
    parts = range_parts(table.select("scheme", "left", "right", "budget"), ["scheme", "left", "right", "budget"])
    within = Window.partitionBy("scheme", "_part").orderBy("left", "right", "budget")
    over = Window.partitionBy("scheme").orderBy("_part")
    heads = parts.groupBy(F.col("scheme").alias("_scheme"), F.col("_part").alias("_of")).agg(F.max("right").alias("top"), F.min("left").alias("low"), F.max_by("budget", F.struct("left", "right", "budget")).alias("end"))
    heads = heads.withColumnRenamed("_of", "_part").withColumnRenamed("_scheme", "scheme")
    # one row a scheme and part
    heads = heads.select("scheme", "_part", F.max("top").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("low").over(over).alias("next_low"), F.last("end").over(Window.partitionBy("scheme").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rest"))
    heads = heads.withColumnRenamed("scheme", "_scheme").withColumnRenamed("_part", "_of")
    own = parts.join(heads, F.col("scheme").eqNullSafe(F.col("_scheme")) & (F.col("_part") == F.col("_of")))
    covered = F.greatest(F.max("right").over(within.rowsBetween(Window.unboundedPreceding, -1)), "before")
    own = own.withColumn("covered", covered).withColumn("next", F.coalesce(F.lead("left").over(within), "next_low"))
    begin, stop = F.greatest("left", "covered"), F.greatest("right", "covered")
    infinite = F.lit(float("inf"))
    first = F.when(F.col("covered").isNull(), F.struct(F.lit(float("-inf")).alias("edge"), F.col("left").alias("until"), F.col("budget").alias("budget")))
    held = F.when(begin < F.col("right"), F.struct(begin.alias("edge"), F.col("right").alias("until"), F.col("budget").alias("budget")))
    gap = F.when(stop < F.coalesce("next", infinite), F.struct(stop.alias("edge"), F.coalesce("next", infinite).alias("until"), F.col("rest").alias("budget")))
    pieces = own.select("scheme", F.inline(F.filter(F.array(first, held, gap), lambda p: p.isNotNull() & (p["edge"] < p["until"]))))
    return pieces.select("scheme", "edge", "until", "budget")


def _indexed_budgets(df: DataFrame, table: DataFrame, value: str, salts: int) -> DataFrame:
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "edges")
    interval_edges(table).write.parquet(path)
    edges = spark.read.parquet(path).withColumnsRenamed({"edge": "_edge", "until": "_until"})
    each = max(BIN_EDGES, -(-edges.count() // MOST_BORDERS))
    at = row_position(edges.select("_edge"), ["_edge"], "at")
    # a number for each bin, of which there are MOST_BORDERS at most
    borders = np.unique(np.array([r["_edge"] for r in at.where(F.col("at") % each == 0).select("_edge").toLocalIterator()], np.float64))
    shared = spark.sparkContext.broadcast(borders)

    @F.pandas_udf("int")
    def bin_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, x.fillna(np.inf).to_numpy(np.float64), "right") - 1)

    @F.pandas_udf("int")
    def last_bin_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(shared.value, x.to_numpy(np.float64), "left") - 1, 0))

    # null and NaN count as infinite; the last piece of each scheme reaches to there
    x = F.when(F.isnan(value) | F.col(value).isNull(), F.lit(float("inf"))).otherwise(F.col(value))
    bins = edges.withColumn("_last", last_bin_of("_until")).withColumn("_first", bin_of("_edge")).withColumn("_bin", F.explode(F.sequence("_first", F.greatest("_first", "_last")))).drop("_first", "_last")
    salted = bins.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else bins.withColumn("_salt", F.lit(0))
    rows = df.withColumn("_x", x).withColumn("_of", bin_of("_x")).withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    # by size estimates the intervals would be sent to all executors through the driver, as their copies for bins and salts aren't counted
    met = rows.join(salted.hint("merge"), (F.col("_of") == F.col("_bin")) & (F.col("_deal") == F.col("_salt")) & (F.col("_x") >= F.col("_edge")) & ((F.col("_x") < F.col("_until")) | (F.col("_until") == F.lit(float("inf")))))
    return met.select(*df.columns, "scheme", "budget")


def allocate_column(triangle: Column, rule: Rule, first: int = FIRST_BUDGET, include_first: bool = True) -> Column:
    """Budgets of a sequence from its similarity triangle; no rows: no budgets."""
    if not rule.monotone:
        raise ValueError("the rule's budgets rise with similarity")
    mean = lambda row, acc: ew_weighted_mean(F.slice(row, F.lit(1), F.size(acc)), acc, rule.alpha)
    grow = lambda acc, row: F.concat(acc, F.transform(F.array(mean(row, acc)), lambda m: budget_column(m, rule)))
    later = F.aggregate(F.slice(triangle, F.lit(2), F.greatest(F.size(triangle) - 1, F.lit(0))), F.array(F.lit(first)), grow)
    kept = later if include_first else F.slice(later, F.lit(2), F.greatest(F.size(later) - 1, F.lit(0)))
    return F.when(F.size(triangle) > 0, kept).otherwise(F.array().cast("array<int>"))


def allocate_budgets(triangles: DataFrame, rule: Rule, first: int = FIRST_BUDGET, include_first: bool = True) -> DataFrame:
    """``triangles`` with ``num_tokens``. A row of similarities that is empty where a mean is needed makes the result wrong
    for its sequence, so such sequences are left out."""
    ok = F.forall(F.slice("triangle", F.lit(2), F.greatest(F.size("triangle") - 1, F.lit(0))), lambda row: F.size(row) > 0)
    found = F.when(F.col("triangle").isNotNull() & ok, allocate_column(F.col("triangle"), rule, first, include_first))
    # exploded from an array of one, so that the filter stays above and the optimizer doesn't write the triangle out for it again
    return triangles.select("*", F.explode_outer(F.array(found)).alias("num_tokens")).where("num_tokens is not null")


def allocate_states(states: DataFrame, rule: Rule, first: int = FIRST_BUDGET, seq: str = "seq_id", pos: str = "pos", vector: str = "vector", partitions: int | None = None) -> DataFrame:
    """(seq, pos, num_tokens) of every state of sequences of any length: a fold over partitions sorted by sequence and position.

    The weighted mean of the similarities to all earlier states is the dot product of the new state's unit vector with the weighted sum of theirs, and
    that sum decays by alpha from state to state. So the fold keeps one vector and two numbers of the sequence it is in, no triangle and no history; the
    sort may spill. Rows without a sequence, a position or a vector are left out; of several rows of one position all count, in any order; vectors
    that hold nulls or NaN, or differ in length, make an error.
    """
    if not rule.monotone:
        raise ValueError("the rule's budgets rise with similarity")
    rows = states.where(F.col(seq).isNotNull() & F.col(pos).isNotNull() & F.col(vector).isNotNull()).select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), F.col(vector).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("seq", states.schema[seq].dataType), T.StructField("pos", states.schema[pos].dataType), T.StructField("num_tokens", T.IntegerType())])
    dealt = rows.repartition(partitions, "seq") if partitions else rows.repartition("seq")
    return dealt.sortWithinPartitions("seq", "pos").mapInArrow(partial(_fold, rule, first), schema).select(F.col("seq").alias(seq), F.col("pos").alias(pos), "num_tokens")


def next_state(v: np.ndarray, past: np.ndarray | None, weight: float, rule: Rule, first: int = FIRST_BUDGET) -> tuple[int, np.ndarray, float]:
    """The budget of a sequence's next state, and the weighted sum of the unit vectors and of the weights with it (before the first: None and 0)."""
    v = v / max(math.sqrt(v @ v), 1e-12)
    if past is None:
        return first, v * first, float(first)
    budget = rule.budget(float(v @ past) / weight if weight else 0.0)
    return budget, past * rule.alpha + v * budget, weight * rule.alpha + budget


def _fold(rule: Rule, first: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, past, weight = None, None, 0.0
    for b in batches:
        keys, at, budgets = b.column(0).to_pylist(), b.column(2).offsets.to_numpy(), []
        x = b.column(2).values.to_numpy(zero_copy_only=False)
        if b.column(2).values.null_count or np.isnan(x).any():
            raise ValueError("a vector holds a null or NaN")
        for i, key in enumerate(keys):
            if key != now:
                now, past, weight = key, None, 0.0
            budget, past, weight = next_state(x[at[i] : at[i + 1]], past, weight, rule, first)
            budgets.append(budget)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(budgets, pa.int32())], names=["seq", "pos", "num_tokens"])


def avg_token(rows: DataFrame, by: list[str] | None = None, paths: str = "img_paths", budgets: str = "num_tokens") -> DataFrame:
    """Budgets a path over all sequences that have budgets; 0.0 if there are none."""
    some = F.size(budgets) > 0
    tokens = F.sum(F.when(some, F.aggregate(budgets, F.lit(0).cast("long"), lambda a, x: a + x)))
    images = F.sum(F.when(some, F.size(paths)))
    mean = F.when(images > 0, tokens / images).otherwise(F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(mean.alias("avg_token"), F.count_if(some).alias("records"))


def scheme_split_matrix(splits: dict[str, DataFrame], schemes: DataFrame, block: int = 10_000) -> DataFrame:
    """Every split's rows with every scheme. Schemes go to all tasks in blocks of at most ``block`` rows, one block after the other."""
    rows = None
    for name, df in splits.items():
        part = df.withColumn("split", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    if len(schemes.limit(block + 1).collect()) <= block:
        return rows.crossJoin(F.broadcast(schemes))
    at = row_position(schemes, schemes.columns, "_at")
    out = None
    for k in range(-(-at.count() // block)):
        part = rows.crossJoin(F.broadcast(at.where(F.floor(F.col("_at") / block) == k).drop("_at")))
        out = part if out is None else out.unionByName(part)
    return out


def allocate_schemes(triangles: DataFrame, table: DataFrame, first: int = FIRST_BUDGET) -> DataFrame:
    """(.., scheme, alpha, num_tokens) for every monotone scheme of the table; the others give no rows."""
    good = [r["scheme"] for r in monotone_schemes(table).orderBy("scheme").collect()]
    out = None
    for name in good:
        rule = read_rule(table, name)
        part = allocate_budgets(triangles, rule, first).withColumn("scheme", F.lit(name)).withColumn("alpha", F.lit(rule.alpha))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return triangles.limit(0).withColumn("num_tokens", F.array().cast("array<int>")).withColumn("scheme", F.lit("")).withColumn("alpha", F.lit(0.0))
    return out


def run_summary(schemes: DataFrame, splits: list[str], produced: DataFrame, paths: str = "img_paths") -> DataFrame:
    """One row for each scheme and split: avg_token, alpha and number of records; 0 records where the scheme was skipped."""
    spark = schemes.sparkSession
    wanted = schemes.select("scheme").distinct().crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in splits], "split string")))
    made = avg_token(produced, ["scheme", "split", "alpha"], paths)
    return wanted.join(made, ["scheme", "split"], "left").select("scheme", "split", "alpha", "avg_token", F.coalesce("records", F.lit(0)).alias("records"))
