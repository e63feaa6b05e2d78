"""Similarity of each visual state to the earlier ones of its sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.functions.vectors import dot, l2_normalize

#: Sequences up to this length have their triangle made in one row; longer ones by blocks of states.
SHORT = 64
#: States of a block: a task of the blocked join holds two blocks of vectors and one product of them.
BLOCK = 256


def triangle_column(vectors: Column, first_row: bool = True) -> Column:
    """Row t holds the cosines to states 0..t-1; row 0 is [1.0], or empty."""
    row0 = F.array(F.lit(1.0)) if first_row else F.array().cast("array<double>")
    unit = F.transform(vectors, l2_normalize)
    rows = lambda us: F.transform(us, lambda x, i: F.when(i == 0, row0).otherwise(F.transform(F.slice(us, F.lit(1), i), lambda y: dot(x, y))))
    return F.element_at(F.transform(F.array(unit), rows), 1)


def sequence_vectors(states: DataFrame, seq: str = "seq_id", pos: str = "pos", vector: str = "vector") -> DataFrame:
    """(seq, vectors): the states of each sequence in order."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, vector)))
    return states.groupBy(seq).agg(F.transform(ordered, lambda s: s[vector]).alias("vectors"))


def block_pairs(states: DataFrame, seq: str = "seq_id", pos: str = "pos", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(seq, t, j, sim) for all j < t of long sequences: a triangular self-join of blocks of ``block`` positions.

    Every state goes to each pair of blocks (i, k), k <= i, that its block is in; a pair is one group, whose similarities are one
    matrix product. So no task holds more than two blocks, and no sequence is one key. Positions are whole numbers from 0; several
    states of one position make their block larger and have no pairs with each other.
    """
    at = states.select(F.col(seq), F.col(pos).cast("long").alias("pos"), F.col(vector).cast("array<double>").alias("v"), F.floor(F.col(pos) / block).cast("int").alias("b"))
    last = at.groupBy(F.col(seq).alias("_of")).agg(F.max("b").alias("last"))
    at = at.join(last, F.col(seq) == F.col("_of")).drop("_of")
    pair = lambda i, k, later: F.struct(i.alias("i"), k.alias("k"), F.lit(later).alias("later"))
    # both roles from one generator: a union before the grouping could leave a pair's two blocks in different tasks
    roles = F.concat(F.transform(F.sequence(F.lit(0), F.col("b")), lambda k: pair(F.col("b"), k, True)), F.transform(F.sequence(F.col("b"), F.col("last")), lambda i: pair(i, F.col("b"), False)))
    dealt = at.select(seq, "pos", "v", F.inline(roles))
    schema = T.StructType([T.StructField("seq", states.schema[seq].dataType), *(T.StructField(n, T.LongType()) for n in ("t", "j")), T.StructField("sim", T.DoubleType())])

    def product(key: tuple, rows: pa.Table) -> pa.Table:
        late, at, v = rows["later"].to_numpy(), rows["pos"].to_numpy(), rows["v"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        sims = x[late] @ x[~late].T
        a, b = np.nonzero(at[late][:, None] > at[~late][None, :])
        return pa.table({"seq": pa.array([key[0].as_py()] * len(a), rows[seq].type), "t": at[late][a], "j": at[~late][b], "sim": sims[a, b]})

    found = dealt.groupBy(seq, "i", "k").applyInArrow(product, schema)
    return found.select(F.col("seq").alias(seq), F.col("t").cast(states.schema[pos].dataType), F.col("j").cast(states.schema[pos].dataType), "sim")


def lengths_of(states: DataFrame, seq: str, short: int) -> tuple[DataFrame, bool]:
    """(seq, length) of each sequence, and whether one is longer than ``short``: a job that runs while the plan is made."""
    lengths = states.groupBy(seq).agg(F.count("*").alias("length"))
    return lengths, not lengths.where(F.col("length") > short).isEmpty()


def causal_pairs(states: DataFrame, seq: str = "seq_id", pos: str = "pos", vector: str = "vector", short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(seq, t, j, sim) for all j < t: a self-join on the sequence for those of up to ``short`` states, ``block_pairs`` for longer ones."""
    lengths, long = lengths_of(states, seq, short)
    few = states.join(lengths.where(F.col("length") <= short), seq, "left_semi") if long else states
    unit = few.select(F.col(seq), F.col(pos), l2_normalize(F.col(vector)).alias("unit"))
    a, b = unit.select(seq, F.col(pos).alias("t"), F.col("unit").alias("a")), unit.select(seq, F.col(pos).alias("j"), F.col("unit").alias("b"))
    pairs = a.join(b, seq).where("j < t").select(seq, "t", "j", dot(F.col("a"), F.col("b")).alias("sim"))
    if not long:
        return pairs
    return pairs.unionByName(block_pairs(states.join(lengths.where(F.col("length") > short), seq, "left_semi"), seq, pos, vector, block))


def triangle(pairs: DataFrame, lengths: DataFrame, seq: str = "seq_id", first_row: bool = True) -> DataFrame:
    """(seq, t, j, sim) and (seq, length) -> (seq, triangle): rows in order, sequences of one state included."""
    rows = pairs.groupBy(seq, "t").agg(F.array_sort(F.collect_list(F.struct("j", "sim"))).alias("row"))
    tri = rows.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct("t", "row"))).alias("rows"))
    row0 = F.array(F.lit(1.0)) if first_row else F.array().cast("array<double>")
    later = F.transform("rows", lambda r: F.transform(r["row"], lambda x: x["sim"]))
    return lengths.where("length > 0").join(tri, seq, "left").select(seq, F.concat(F.array(row0), F.coalesce(later, F.array().cast("array<array<double>>"))).alias("triangle"))


def similarity_triangles(states: DataFrame, seq: str = "seq_id", pos: str = "pos", vector: str = "vector", first_row: bool = True, short: int = SHORT) -> DataFrame:
    """(seq, triangle) of every sequence; short ones in one row each, longer ones from ``block_pairs``.

    A triangle of T states holds T * T / 2 numbers in one row. For budgets of long sequences take ``budgets.allocate_states``, which makes none.
    """
    lengths, long = lengths_of(states, seq, short)
    few = states.join(lengths.where(F.col("length") <= short), seq, "left_semi") if long else states
    one = sequence_vectors(few, seq, pos, vector).select(seq, triangle_column(F.col("vectors"), first_row).alias("triangle"))
    if not long:
        return one
    many, sizes = states.join(lengths.where(F.col("length") > short), seq, "left_semi"), lengths.where(F.col("length") > short)
    return one.unionByName(triangle(block_pairs(many, seq, pos, vector), sizes, seq, first_row))


def pool_features(patches: DataFrame, image: str = "image", vector: str = "vector") -> DataFrame:
    """(image, feature): unit mean of an image's patch vectors. Dimensions are averaged one by one, so no image is gathered."""
    flat = patches.select(image, F.posexplode(vector).alias("dim", "x"))
    means = flat.groupBy(image, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return ordered.select(image, l2_normalize(F.transform("v", lambda s: s["x"])).alias("feature"))


def with_features(images: DataFrame, extractor: Callable[[], Callable[[pd.DataFrame], list]] | str, path: str = "path", out: str = "vector", seq: str | None = None) -> DataFrame:
    """``images`` with a feature for each path, from a user's extractor, or from a column of ready features, whose name is given instead.

    Each path is worked once. ``extractor`` is called once in each task and returns a function from a batch of rows (one
    for each path) to their vectors. With ``seq``, the column that names the sequences, images that are alone in theirs go past the extractor and have
    no feature: their similarities are known without. Images without a path have none either.
    """
    if isinstance(extractor, str):
        return images.withColumn(out, F.col(extractor).cast("array<double>"))
    wanted = images
    if seq is not None:
        several = images.groupBy(F.col(seq).alias("_several")).agg(F.count("*").alias("_n")).where("_n > 1").select("_several")
        wanted = images.join(several, F.col(seq).eqNullSafe(F.col("_several")), "left_semi")
    once = wanted.dropDuplicates([path]).where(F.col(path).isNotNull())
    schema = T.StructType([T.StructField("feature_path", T.StringType()), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = extractor()
        for b in batches:
            yield pd.DataFrame({"feature_path": b[path], out: [[float(x) for x in v] for v in extract(b)]})

    with_all = images.join(once.mapInPandas(run, schema), F.col(path) == F.col("feature_path"), "left").drop("feature_path")
    if seq is None:
        return with_all
    alone = with_all.join(several.withColumn("_known", F.lit(True)), F.col(seq).eqNullSafe(F.col("_several")), "left")
    return alone.withColumn(out, F.when(F.col("_known"), F.col(out))).drop("_several", "_known")
