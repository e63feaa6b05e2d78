"""Offsets, segments and positions of packed image sequences, and geometry of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.operators.inference import EOS

FPS, MERGE = 24.0, 2


def position_in_sequence(images: DataFrame, seq: str = "seq_id", order: str = "ord") -> DataFrame:
    """``images`` with ``pos`` (0, 1, ..) in its sequence and ``is_first``."""
    pos = F.row_number().over(Window.partitionBy(seq).orderBy(order)) - 1
    return images.withColumn("pos", pos).withColumn("is_first", F.col("pos") == 0)


def split_first_rest(codes: Column, n_images: Column, per_image: int) -> Column:
    """struct(first, rest) of the codes of several sequences end to end, ``per_image`` codes an image: those of each sequence's
    first image, and those of all later ones. ``n_images`` are the sequences' numbers of images; other lengths are an error."""
    total = F.aggregate(n_images, F.lit(0), lambda a, n: a + n.cast("int"))
    starts = F.transform(F.slice(offsets_of(n_images), F.lit(1), F.size(n_images)), lambda o: o * per_image)
    cut = lambda skip, take: F.flatten(F.zip_with(starts, n_images, lambda o, n: F.slice(codes, o + 1 + skip, F.greatest(take(n), F.lit(0)))))
    split = F.struct(cut(0, lambda n: F.least(n.cast("int"), F.lit(1)) * per_image).alias("first"), cut(per_image, lambda n: (n.cast("int") - 1) * per_image).alias("rest"))
    return F.when(F.size(codes) == total * per_image, split).otherwise(F.raise_error(F.lit("codes and images differ in number")).cast("struct<first:array<int>,rest:array<int>>"))


def segment_offsets(images: DataFrame, length: str = "n", by: list[str] | None = None, order: str = "pos") -> DataFrame:
    """``images`` with ``start`` (lengths before it) and ``end``."""
    w = Window.partitionBy(*(by or ["seq_id"])).orderBy(order)
    before = F.sum(length).over(w) - F.col(length)
    return images.withColumn("start", before).withColumn("end", before + F.col(length))


def offsets_of(lengths: Column) -> Column:
    """[0, l1, l1 + l2, ..] of an array of lengths."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x.cast("int"))))


def pack_offsets(samples: DataFrame, length: str, pack: str, order: str) -> DataFrame:
    """``samples`` with the place where each starts in its pack; the pack's last end closes the prefix."""
    return segment_offsets(samples, length, [pack], order)


def output_segments(first_codes: Column, later_codes: Column, counts: Column, n_in: Column, n_out: Column, eos: int = EOS) -> Column:
    """Array of struct(codes, count): each output image's codes with the end code, and their number.

    The first image of a sequence has its codes in ``first_codes``; ``counts`` are those of the later ones, input images before
    output images.
    """
    image = lambda codes: F.struct(F.concat(codes, F.array(F.lit(eos))).alias("codes"), (F.size(codes) + 1).alias("count"))
    starts = offsets_of(counts)
    skip = F.greatest(n_in - 1, F.lit(0))
    n_later = n_out - F.when((n_in == 0) & (n_out > 0), 1).otherwise(0)
    later = F.when(n_later > 0, F.transform(F.sequence(skip + 1, skip + n_later), lambda i: F.slice(later_codes, F.element_at(starts, i.cast("int")) + 1, F.element_at(counts, i.cast("int")))))
    lead = F.when((n_in == 0) & (n_out > 0), F.array(first_codes)).otherwise(F.array().cast("array<array<int>>"))
    return F.transform(F.concat(lead, F.coalesce(later, F.array().cast("array<array<int>>"))), image)


def sequence_layout(seqs: DataFrame, block_len: int, merged: bool = False, after_last: bool = True, seq: str = "seq_id", budgets: str = "num_tokens") -> DataFrame:
    """(seq, place, segment, kind, start, length, total): image, block, image, block .. of every sequence.

    ``merged``: an image and the block after it share a segment number. ``after_last``: a block follows the last image too.
    """
    n = F.size(budgets)
    parts = F.flatten(F.transform(budgets, lambda b, i: F.when(F.lit(after_last) | (i < n - 1), F.array(
        F.struct(F.lit("image").alias("kind"), b.cast("int").alias("length"), i.alias("image")), F.struct(F.lit("block").alias("kind"), F.lit(block_len).alias("length"), i.alias("image"))))
        .otherwise(F.array(F.struct(F.lit("image").alias("kind"), b.cast("int").alias("length"), i.alias("image"))))))
    flat = seqs.select(seq, F.posexplode(parts).alias("place", "p")).select(seq, "place", "p.*")
    w = Window.partitionBy(seq).orderBy("place")
    whole = Window.partitionBy(seq)
    return flat.select(seq, "place", (F.col("image") if merged else F.col("place")).alias("segment"), "kind", (F.sum("length").over(w) - F.col("length")).alias("start"), "length", F.sum("length").over(whole).alias("total"))


def position_runs(runs: DataFrame, merge: int = MERGE, seq: str = "seq_id", order: str = "ord") -> DataFrame:
    """Runs (seq, ord, kind, text_len, t, h, w) with their first position, tokens, and each sequence's delta.

    Text advances by its length. An image covers t * h/merge * w/merge tokens and advances by the largest of t, h/merge, w/merge.
    delta = last position + 1 - number of tokens. Videos come as one run a frame (t = 1).
    """
    gh, gw = F.floor(F.col("h") / merge), F.floor(F.col("w") / merge)
    text = F.col("kind") == "text"
    step = F.when(text, F.col("text_len")).otherwise(F.greatest(F.col("t"), gh, gw)).cast("long")
    tokens = F.when(text, F.col("text_len")).otherwise(F.col("t") * gh * gw).cast("long")
    r = runs.withColumn("advance", step).withColumn("tokens", tokens)
    w, whole = Window.partitionBy(seq).orderBy(order), Window.partitionBy(seq)
    return r.withColumn("position", F.sum("advance").over(w) - F.col("advance")).withColumn("delta", F.sum("advance").over(whole) - F.sum("tokens").over(whole))


def video_runs(videos: DataFrame, seq: str = "seq_id", order: str = "ord", stamp: int = 0) -> DataFrame:
    """A video's run (t, h, w) as t runs of one frame each, in order; with ``stamp``, a text run of that many tokens (the frame's time) before each frame.
    Runs of text and images stay as they are. The order becomes a struct (order, frame, after the stamp)."""
    frames = F.transform(F.sequence(F.lit(0), F.greatest(F.col("t"), F.lit(1)) - 1), lambda i: F.struct(i.alias("frame"), F.lit(1).alias("after")))
    marks = F.transform(frames, lambda f: F.struct(f["frame"].alias("frame"), F.lit(0).alias("after")))
    video = F.col("kind") == "video"
    whole = F.array(F.struct(F.lit(0).alias("frame"), F.lit(1).alias("after")))
    cut = videos.withColumn("_f", F.explode(F.when(video, F.concat(frames, marks) if stamp else frames).otherwise(whole)))
    time = video & (F.col("_f.after") == 0)
    out = cut.withColumn(order, F.struct(F.col(order).alias("of"), F.col("_f.frame").alias("frame"), F.col("_f.after").alias("after")))
    out = out.withColumn("text_len", F.when(time, F.lit(stamp)).otherwise(F.col("text_len"))).withColumn("t", F.when(video, F.lit(1)).otherwise(F.col("t")))
    return out.withColumn("kind", F.when(time, F.lit("text")).otherwise(F.col("kind"))).drop("_f")


#: Tokens of a run that are written out from one row.
TOKENS_AT_ONCE = 4096


def token_positions(runs: DataFrame, merge: int = MERGE, seq: str = "seq_id", order: str = "ord") -> DataFrame:
    """(seq, ord, kind, token, t, h, w): positions of every token of runs such as ``position_runs`` takes, numbered through each sequence.

    A text's tokens have one position each, the same in all three; those of an image or frame lie on its grid from the run's start. Runs without tokens
    give no rows. Long runs are written out in pieces, so that no row holds a whole one.
    """
    placed = position_runs(runs, merge, seq, order)
    w = Window.partitionBy(seq).orderBy(order)
    gh, gw = F.floor(F.col("h") / merge), F.floor(F.col("w") / merge)
    placed = placed.withColumn("_before", F.sum("tokens").over(w) - F.col("tokens")).withColumn("_gw", gw).withColumn("_area", gh * gw).where("tokens > 0")
    piece = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / TOKENS_AT_ONCE))))
    each = piece.withColumn("_i", F.explode(F.sequence(F.col("_piece") * TOKENS_AT_ONCE, F.least((F.col("_piece") + 1) * TOKENS_AT_ONCE, F.col("tokens")) - 1)))
    i, at, text = F.col("_i"), F.col("position"), F.col("kind") == "text"
    of = lambda x: (at + F.when(text, i).otherwise(x)).cast("long")
    return each.select(seq, order, "kind", (F.col("_before") + i).alias("token"), of(F.floor(i / F.col("_area"))).alias("t"), of(F.floor(i % F.col("_area") / F.col("_gw"))).alias("h"), of(i % F.col("_gw")).alias("w"))


def frame_timestamps(frames: DataFrame, video: str, index: str, fps: float = FPS, merge: int = MERGE) -> DataFrame:
    """(video, grp, seconds): frames in order, merged by ``merge``; the last frame fills up an incomplete group."""
    grp = F.floor((F.row_number().over(Window.partitionBy(video).orderBy(index)) - 1) / merge)
    return frames.withColumn("grp", grp).groupBy(video, "grp").agg(((F.min(index) / F.lit(fps) + F.max(index) / F.lit(fps)) / 2).alias("seconds"))


def merge_streams(inputs: DataFrame, outputs: DataFrame, sample: str = "sample", order: str = "ord") -> DataFrame:
    """Images of both streams with ``place``: a sample's input images, then its output images."""
    both = inputs.withColumn("stream", F.lit(0)).unionByName(outputs.withColumn("stream", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(sample).orderBy("stream", order)) - 1)


def image_plan(sizes: DataFrame, target_h: int, target_w: int, size: int) -> DataFrame:
    """(.., h, w) with three plans: crop box to the target's aspect, padding to it, and the square crop after halving.

    Crop and pad sizes are cut to whole numbers; the square's scaled sides are rounded half-even. The image is halved while its
    shorter side is at least twice ``size``.
    """
    ratio, now = F.lit(target_w / target_h), F.col("w") / F.col("h")
    cut_w, cut_h = F.floor(F.col("h") * ratio).cast("int"), F.floor(F.col("w") / ratio).cast("int")
    wide, tall = now > ratio, now < ratio
    crop_w, crop_h = F.when(wide, cut_w).otherwise(F.col("w")), F.when(tall, cut_h).otherwise(F.col("h"))
    half = lambda x: F.floor(x / 2).cast("int")
    # an int has 31 bits, so 31 halvings are enough for any side
    pad_w, pad_h = F.when(tall, cut_w - F.col("w")).otherwise(F.lit(0)), F.when(tall, F.lit(0)).otherwise(cut_h - F.col("h"))
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.lit(0).alias("times")),
                         lambda a, _: F.when(F.least(a["h"], a["w"]) >= 2 * size, F.struct(half(a["h"]).alias("h"), half(a["w"]).alias("w"), (a["times"] + 1).alias("times"))).otherwise(a))
    planned = sizes.withColumn("_b", halved)
    scale = F.lit(float(size)) / F.least("_b.h", "_b.w")
    to_h, to_w = F.bround(F.col("_b.h") * scale).cast("int"), F.bround(F.col("_b.w") * scale).cast("int")
    return planned.select(
        *sizes.columns, crop_h.alias("crop_h"), crop_w.alias("crop_w"), half(F.col("h") - crop_h).alias("crop_y"), half(F.col("w") - crop_w).alias("crop_x"),
        half(pad_w).alias("pad_left"), (pad_w - half(pad_w)).alias("pad_right"), half(pad_h).alias("pad_top"), (pad_h - half(pad_h)).alias("pad_bottom"),
        F.col("_b.times").alias("halvings"), to_h.alias("scaled_h"), to_w.alias("scaled_w"), half(to_h - size).alias("square_y"), half(to_w - size).alias("square_x"))
