"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over the training run (piecewise linear in progress 0..1). Its integral, scaled to the
source's target, is the cumulative demand; a document that starts after c words of its source are used up is read at the
progress where the demand reaches c. Range-sorting by that position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import SPACE, WORD, materialize

#: Weights and schedule shapes of the production mix, dealt to the sources in turn.
WEIGHTS = (5, 2, 1)
SHAPES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)))
SHARE, MOST_PASSES = 1.5, 2
#: Hex digits of the order key that name a bucket: 16^3 buckets a source, so no window holds a whole source.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source_key, source, source_size) with one row per source -> target and rank.

    ``share`` times all words are dealt by weight; a target stops at ``most`` times its source's words and the excess is
    dealt again by weight. Closed form: in order of cap / weight, a source is full if the level that the rest would get
    reaches its own. The windows run over one row per source.
    """
    by_name, by_ratio, everything = Window.orderBy("source_key"), Window.orderBy("ratio", "source_key"), Window.partitionBy()
    turn = ((F.col("rank") - 1) % len(weights)).cast("int")
    levels = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    )
    cap = F.col("cap").cast("double")
    first_open = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(everything)
    return levels.withColumn("open", first_open).select(
        "source_key", "source_size", "rank",
        F.least(cap, F.coalesce(F.col("open.level") * F.col("weight"), cap)).alias("target"),
    )


def _knots(shape) -> Column:
    """A schedule as segments: start, weight there, slope, and the share of the integral before it."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(shape, shape[1:])]
    whole, before, out = sum(areas), 0.0, []
    for (a, b), area in zip(zip(shape, shape[1:]), areas):
        out.append(F.struct(F.lit(a[0]).alias("t"), F.lit(a[1] / whole).alias("w"), F.lit((b[1] - a[1]) / (b[0] - a[0]) / whole).alias("slope"), F.lit(before / whole).alias("before")))
        before += area
    return F.array(*out)


def _position(used: Column, target: Column, knots: Column) -> Column:
    """Progress at which the cumulative demand reaches ``used`` words: the segment's quadratic, solved without cancellation."""
    share = F.when(target > 0, used / target).otherwise(F.lit(0.0))
    seg = F.element_at(F.filter(knots, lambda k: k["before"] <= share), -1)
    rest = share - seg["before"]
    root = seg["w"] + F.sqrt(F.greatest(seg["w"] * seg["w"] + 2 * seg["slope"] * rest, F.lit(0.0)))
    return F.least(seg["t"] + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0)), F.lit(1.0))


def curriculum_mix(docs: DataFrame, weights=WEIGHTS, shapes=SHAPES, share: float = SHARE, most: int = MOST_PASSES,
                   seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Deal every document its words and training positions.

    Returns one row per input row: id, size (words), source_size, target, taken (words the mix reads, repeats counted) and
    positions (progress 0..1 at which each pass over the document starts; empty if it isn't read). A source's documents
    are read in the order of md5(seed, id), pass after pass; the last one is cut where the target is reached, so the words
    taken from a source are its target rounded to a whole number, and no document is read more than ``most`` times.

    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Null id: ordered first in its
    source. Repeated rows are documents of their own. An empty table gives an empty result. Other columns are ignored.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.when(F.col(source_col).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("source_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)),
        "mix-sizes",
    )
    buckets = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_source = Window.partitionBy("source_key").orderBy("bucket")
    bases = buckets.select(
        "source_key", "bucket", (F.sum("bucket_size").over(in_source) - F.col("bucket_size")).alias("base")
    )
    targets = source_targets(buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = (
        sized.join(bases, ["source_key", "bucket"]).join(targets, "source_key")
        .withColumn("used", F.col("base") + F.sum("size").over(in_bucket) - F.col("size"))
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - full * F.col("source_size") + 0.5).cast("long")
    part = F.least(F.greatest(rest - F.col("used"), F.lit(0)), F.col("size"))
    turn = ((F.col("rank") - 1) % len(shapes)).cast("int")
    knots = F.when(turn == 0, _knots(shapes[0]))
    for i, shape in enumerate(shapes[1:], 1):
        knots = knots.when(turn == i, _knots(shape))
    passes = F.when(F.col("size") == 0, F.lit(0)).otherwise(full + F.when(part > 0, 1).otherwise(0)).cast("int")
    starts = F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), lambda p: _position((F.col("used") + p * F.col("source_size")).cast("double"), F.col("target"), F.col("knots")))).otherwise(F.array().cast("array<double>"))
    return dealt.withColumn("knots", knots).select(
        "doc_id", "size", "source_size", "target",
        (full * F.col("size") + part).alias("taken"),
        starts.alias("positions"),
    )


def training_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Rows range-sorted by training position; partition files follow each other in reading order. Nulls come first, rows of one
    position go by id; an empty table gives no rows."""
    return mixed.repartitionByRange(F.col(position), F.col("doc_id")).sortWithinPartitions(position, "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"{SPACE}*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows, with all their columns, once for every pass in which the mix reads them, in training order; unread ones go.

    The pass that a source's target ends in has the text only as far as it is read, and the length of that in ``chars_col`` if
    there is such a column. Rows of one id are read as that of them which is read most. Rows with null ids are read as one.
    Documents without words, null and empty ones too, are not read. An empty table gives no rows. Written files hold the rows
    in training order, one file after the other.
    """
    mixed = curriculum_mix(docs, id_col=id_col, text_col=text_col, **options)
    passes = mixed.groupBy(F.col("doc_id").alias("_mixed_id")).agg(F.max_by(F.struct("positions", "size", "taken"), F.struct(F.size("positions"), "taken", "positions")).alias("_read"))
    each = passes.select("_mixed_id", F.col("_read.size").alias("_size"), F.col("_read.taken").alias("_taken"), F.posexplode("_read.positions").alias("_pass", "_position"))
    words = F.least(F.col("_taken") - F.col("_pass") * F.col("_size"), F.col("_size"))
    joined = docs.join(each, docs[id_col].cast("long").eqNullSafe(each["_mixed_id"]))
    text = F.when(words < F.col("_size"), first_words(docs[text_col], words)).otherwise(docs[text_col])
    cut = {text_col: text} | ({chars_col: F.when(words < F.col("_size"), F.length(text)).otherwise(docs[chars_col]).cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    read = joined.select(*[cut.get(c, docs[c]).alias(c) for c in docs.columns], "_position", F.col("_mixed_id"))
    return read.repartitionByRange("_position", "_mixed_id").sortWithinPartitions("_position", "_mixed_id").drop("_position", "_mixed_id")
