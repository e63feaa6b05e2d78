"""Budgets joined back to samples, merge statistics, parts put together, order and shards."""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.functions import images as im
from seqlattice.sources.scratch import scratch_path


def dedupe_last(df: DataFrame, key: list[str], order: str | list[str]) -> DataFrame:
    """The last row of each key by ``order``; a later row's nulls win too."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def sample_paths(samples: DataFrame) -> DataFrame:
    """``samples`` with ``img_paths`` by the merging grammar, and ``_error`` (then without paths) for a missing image or a
    message without text."""
    tokens = im.image_tokens(F.col("messages"), im.NUMBERED_TOKEN)
    with_map = samples.withColumn("_tokens", tokens).withColumn("_map", im.image_map(F.col("input_images"), F.col("output_images")))
    missing = im.missing_image(F.col("_tokens"), F.col("_map"))
    no_text = F.col("messages").isNull() | F.exists("messages", lambda m: m["content"].isNull())
    error = F.when(no_text, F.lit("message without text")).when(missing.isNotNull(), F.concat(F.lit("Missing image id: "), missing))
    return with_map.withColumn("_error", error).withColumn("img_paths", F.when(F.col("_error").isNull(), im.resolve_images(F.col("_tokens"), F.col("_map")))).drop("_tokens", "_map")


def merge_budgets(samples: DataFrame, budgets: DataFrame) -> DataFrame:
    """``samples`` (with ``img_paths`` and ``_error``) with the budgets of their sequence, and ``_warn`` where it has none.

    ``budgets`` has one row for each sequence (see ``dedupe_last``). Rows with an error have no paths and so match nothing; they
    carry no warning. A sequence found with null budgets is neither matched nor warned of.
    """
    right = budgets.select(F.col("img_paths").alias("_key"), "num_tokens", F.lit(True).alias("_found"))
    joined = samples.join(right, F.col("img_paths") == F.col("_key"), "left")
    warn = F.when(F.col("_error").isNull() & F.col("_found").isNull(), F.lit("token_not_found"))
    return joined.withColumn("_warn", warn).drop("_key", "_found")


def merge_stats(merged: DataFrame, by: list[str]) -> DataFrame:
    """Samples, matched, token_not_found, errors and the matched share of each data set."""
    matched = F.count_if(F.col("_error").isNull() & F.col("num_tokens").isNotNull())
    return merged.groupBy(*by).agg(
        F.count("*").alias("samples"), matched.alias("matched"), F.count_if(F.col("_warn") == "token_not_found").alias("token_not_found"),
        F.count_if(F.col("_error").isNotNull()).alias("errors"), (matched / F.count("*")).alias("match_rate"))


def bad_cases(merged: DataFrame, by: list[str], index: str, n: int = 10) -> DataFrame:
    """The first ``n`` failures of each data set: kind, row, error."""
    kind = F.when(F.col("_error").isNotNull(), F.lit("error")).when(F.col("_warn").isNotNull(), F.col("_warn"))
    failed = merged.withColumn("kind", kind).where("kind is not null").select(*by, index, "kind", F.col("_error").alias("error"))
    # n of each part first, so that no task sorts all failures of a data set
    ranked = failed.withColumn("_part", F.pmod(F.xxhash64(index), F.lit(int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    for keys in ([*by, "_part"], by):
        ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(index))).where(F.col("_rank") <= n)
    return ranked.select(*by, index, "kind", "error")


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def union_overwrite(parts: DataFrame, key: list[str], rank: str = "rank") -> DataFrame:
    """Parts as one dictionary: the row of the highest rank stays of each key."""
    return dedupe_last(parts, key, rank)


def missing_parts(expected: DataFrame, actual: DataFrame, rank: str = "rank") -> DataFrame:
    return expected.select(rank).distinct().join(actual.select(rank).distinct(), rank, "left_anti")


def global_index(rank: Column, local: Column, world: int) -> Column:
    return rank + local * F.lit(world)


def range_parts(df: DataFrame, order: list[str], shards: int | None = None) -> DataFrame:
    """``df`` in parts by ranges of ``order``, numbered in ``_part``, written down: the borders are sampled, so a second run of the same plan could draw others."""
    shards = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(df.sparkSession, "ranged")
    ranged = df.repartitionByRange(shards, *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def row_position(df: DataFrame, order: list[str], out: str = "position", shards: int | None = None) -> DataFrame:
    """0, 1, 2 .. in the given order: counts of range parts, then a window within each, so no task holds all rows."""
    ranged = range_parts(df, order, shards)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a part
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_at", within).join(base, "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def restore_order(df: DataFrame, index: str = "_global_idx") -> DataFrame:
    """Sorted by the index if every row has one, else, with a warning, as it is; without the index column."""
    complete = index in df.columns and df.where(F.col(index).isNull()).isEmpty()
    if not complete:
        warnings.warn(f"some rows have no {index}: their order is kept", stacklevel=2)
    return (df.orderBy(index) if complete else df).drop(index)


def drawn_seed(seed: int) -> int:
    """The seed, or for a negative one a random seed: drawn once, on the driver, so that all tasks share it."""
    return seed if seed >= 0 else secrets.randbelow(1 << 31)


def seeded_shuffle(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """A permutation that depends on keys and seed only; a negative seed stands for a random one."""
    return df.orderBy(F.xxhash64(F.lit(drawn_seed(seed)), *key), *key)


def shuffle_position(df: DataFrame, key: list[str], seed: int, out: str = "position") -> DataFrame:
    """``df`` with each row's place in ``seeded_shuffle``."""
    return row_position(df.withColumn("_hash", F.xxhash64(F.lit(drawn_seed(seed)), *key)), ["_hash", *key], out).drop("_hash")


def shard(df: DataFrame, n: int, index: str = "_global_idx", out: str = "shard") -> DataFrame:
    return df.withColumn(out, F.pmod(F.col(index), F.lit(n)))


def with_error_policy(df: DataFrame, error: Column, on_error: str, observation=None) -> DataFrame:
    """``skip`` drops rows with an error (counted by ``observation`` if given), ``record`` keeps it in ``_error``, ``fail`` ends the query."""
    marked = df.withColumn("_error", error)
    if on_error == "record":
        return marked
    if on_error == "fail":
        return marked.where(F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("boolean")).otherwise(F.lit(True))).drop("_error")
    if on_error == "skip":
        if observation is not None:
            marked = marked.observe(observation, F.count_if(F.col("_error").isNotNull()).alias("skipped"))
        return marked.where("_error is null").drop("_error")
    raise ValueError(f"on_error: {on_error}")
