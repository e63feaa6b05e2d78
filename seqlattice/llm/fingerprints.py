"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A text's paragraphs are its lines, long lines cut at the first word end past ``PIECE`` characters. The distinct paragraph
digests go into a sketch of three tables; a cell keeps how many digests it got, their exclusive or, and that of their
check values. Two versions' sketches subtract cell by cell; peeling single-digest cells recovers the digests in which the
versions differ, and with the sets' sizes their likeness. The small sketches of the fingerprints are compared in expressions.
Where peeling stalls, both versions are sketched again, larger, with a row for each cell, and again until they peel.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import materialize

#: Paragraph pieces end at the first word end past so many characters.
PIECE = 120
#: Cells in each of the three tables of a fingerprint.
CELLS = 8
TABLES = 3
#: Rounds of peeling of a fingerprint's few cells, at most one for each cell.
ROUNDS = TABLES * CELLS
#: Retries: each table has so many cells for each digest of the two versions and a few more, then twice as many at each try,
#: with other hash functions; a try peels every table so often.
RETRY_CELLS, SWEEPS = 0.6, 3
#: Documents in a bucket of the ordered walk, and the most buckets (their borders are kept on the driver).
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}[^\n ]*"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit("check"), key)


def _place(key: Column, cells: Column, seed: int, t: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * TABLES + t), key), cells)


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def sketch(keys: Column, cells: Column, seed: int = 0) -> Column:
    """struct(t0, t1, t2): the cells of each table. A cell that no digest falls into is found without a look at each."""
    add = lambda a, k: _cell(a["n"] + 1, a["key"].bitwiseXOR(k["key"]), a["check"].bitwiseXOR(k["check"]))
    zero = F.expr("struct(0 as n, 0L as key, 0L as check)")

    def one(t: int) -> Column:
        placed = F.transform(keys, lambda k: F.struct(k.alias("key"), _check(k).alias("check"), _place(k, cells, seed, t).alias("at")))
        fill = lambda ks, c: F.when(F.array_contains(ks["at"], c), F.aggregate(F.filter(ks, lambda k: k["at"] == c), zero, add)).otherwise(zero)
        return _let(placed, lambda ks: F.transform(F.sequence(F.lit(0).cast("long"), cells - 1), lambda c: fill(ks, c)))

    return F.struct(*[one(t).alias(f"t{t}") for t in range(TABLES)])


def subtract(a: Column, b: Column) -> Column:
    less = lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"]))
    return F.struct(*[F.zip_with(a[f"t{t}"], b[f"t{t}"], less).alias(f"t{t}") for t in range(TABLES)])


def peel(cells: Column, width: Column, seed: int = 0) -> Column:
    """struct(cells, only_a, only_b, done): what is left after peeling, and the recovered digests of each version.

    A round takes the digests of all cells that hold just one, and takes them out of their cells in every table.
    """
    single = lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))
    pure = lambda cs: F.array_distinct(F.transform(F.concat(*[F.filter(cs[f"t{t}"], single) for t in range(TABLES)]), lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))
    take = lambda c, k: _cell(c["n"] - k["n"], c["key"].bitwiseXOR(k["key"]), c["check"].bitwiseXOR(k["check"]))

    def drop(cs: Column, found: Column, t: int) -> Column:
        placed = F.transform(found, lambda k: F.struct(k["n"].alias("n"), k["key"].alias("key"), _check(k["key"]).alias("check"), _place(k["key"], width, seed, t).alias("at")))
        return _let(placed, lambda ks: F.transform(cs[f"t{t}"], lambda c, i: F.when(F.array_contains(ks["at"], i.cast("long")), F.aggregate(F.filter(ks, lambda k: k["at"] == i), c, take)).otherwise(c)))

    side = lambda found, n: F.transform(F.filter(found, lambda k: k["n"] == n), lambda k: k["key"])

    def step(state: Column, _: Column) -> Column:
        go = lambda found: F.struct(
            F.when(F.size(found) == 0, state["cells"]).otherwise(F.struct(*[drop(state["cells"], found, t).alias(f"t{t}") for t in range(TABLES)])).alias("cells"),
            F.array_union(state["only_a"], side(found, 1)).alias("only_a"), F.array_union(state["only_b"], side(found, -1)).alias("only_b"), (F.size(found) == 0).alias("done"))
        return F.when(state["done"], state).otherwise(_let(pure(state["cells"]), go))

    none = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), none.alias("only_a"), none.alias("only_b"), F.lit(False).alias("done")), step)


def _decoded(state: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard likeness of the two digest sets; null where peeling stalled or its counts can't be true."""
    clean = F.forall(F.concat(*[state["cells"][f"t{t}"] for t in range(TABLES)]), lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))
    a, b = F.size(state["only_a"]), F.size(state["only_b"])
    fits = (size_a - a == size_b - b) & (size_a >= a)
    return F.when(clean & fits, F.when(size_a + b == 0, F.lit(1.0)).otherwise((size_a - a) / (size_a + b)))


def likeness(keys_a: Column, sketch_a: Column, keys_b: Column, sketch_b: Column) -> Column:
    """Likeness of two fingerprints (0 to 1) by their own cells; null where these don't suffice."""
    return _let(peel(subtract(sketch_a, sketch_b), F.lit(CELLS).cast("long")), lambda s: _decoded(s, F.size(keys_a), F.size(keys_b)))


def _peeled_rows(pairs: DataFrame, times: int, seed: int, digests: bool) -> DataFrame:
    """(pair, w, t, c, n, key, check): the cells that peeling leaves (t below ``TABLES``), and what it recovers: t = ``TABLES``
    for the first version's digests, one more for the second's; c tells them apart, or adds them up in one row.

    Rows are dealt by pair once; all that follows keeps each pair in its partition. Peeling takes one table after another, so
    that no digest comes out of two cells at once.
    """
    is_single = lambda t: (F.col("t") == t) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
    width = (F.ceil((F.size("a") + F.size("b")) * RETRY_CELLS) + CELLS).cast("long") * times
    placed = lambda t: F.pmod(F.xxhash64(t + F.lit(seed * TABLES), F.col("key")), F.col("w"))
    signed = pairs.repartition("pair").select("pair", width.alias("w"), F.size("a").alias("in_a"), F.posexplode(F.concat("a", "b")).alias("at", "key"))
    signed = signed.select("pair", "w", "key", F.when(F.col("at") < F.col("in_a"), 1).otherwise(-1).alias("n"), _check(F.col("key")).alias("check"))
    cells = signed.withColumn("t", F.explode(F.array(*map(F.lit, range(TABLES))))).withColumn("c", placed(F.col("t")))
    add = lambda rows: rows.groupBy("pair", "w", "t", "c").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")).where("n <> 0 or key <> 0 or check <> 0")
    cells = add(cells)
    row = lambda t, c, n: F.struct(t.cast("int").alias("t"), c.alias("c"), n.alias("n"), F.col("key").alias("key"), F.col("check").alias("check"))
    for step in range(SWEEPS * TABLES):
        table = step % TABLES
        found = F.when(F.col("n") > 0, F.lit(TABLES)).otherwise(F.lit(TABLES + 1))
        others = [row(F.lit(t), placed(F.lit(t)), -F.col("n")) for t in range(TABLES) if t != table]
        taken = F.array(row(found, F.col("key") if digests else F.lit(0).cast("long"), F.abs("n")), *others)
        moved = F.when(is_single(table), taken).otherwise(F.array(row(F.col("t"), F.col("c"), F.col("n"))))
        cells = add(cells.select("pair", "w", F.explode(moved).alias("r")).select("pair", "w", "r.*"))
    return cells


def differences(pairs: DataFrame, digests: bool = True) -> DataFrame:
    """(pair, a, b) -> (pair, n_only_a, n_only_b, likeness), and with ``digests`` the arrays only_a and only_b: in which digests
    two versions differ, by subtracted and peeled sketches; where peeling stalls, by larger ones, until none stalls.

    ``pair`` names a row; a and b are arrays of distinct digests. Two empty versions are alike (1). An empty table gives no rows.
    """
    spark, done, times = pairs.sparkSession, [], 1
    while True:
        rows = _peeled_rows(pairs, times, len(done) + 1, digests)
        only = lambda t: F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).cast("int")
        lists = [F.collect_list(F.when(F.col("t") == TABLES + i, F.col("key"))).alias(f"only_{side}") for i, side in enumerate("ab")] if digests else []
        summed = rows.groupBy("pair").agg(F.count_if(F.col("t") < TABLES).alias("left"), only(TABLES).alias("n_only_a"), only(TABLES + 1).alias("n_only_b"), *lists)
        sizes = pairs.select("pair", F.size("a").alias("in_a"), F.size("b").alias("in_b"))
        none = [F.coalesce(f"only_{side}", F.array().cast("array<bigint>")).alias(f"only_{side}") for side in "ab"] if digests else []
        summed = sizes.join(summed, "pair", "left").select("pair", "in_a", "in_b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left", "n_only_a", "n_only_b")], *none)
        summed = materialize(summed, "peeled")
        fits = (F.col("left") == 0) & (F.col("in_a") - F.col("n_only_a") == F.col("in_b") - F.col("n_only_b")) & (F.col("in_a") >= F.col("n_only_a"))
        united = F.col("in_a") + F.col("n_only_b")
        near = F.when(united == 0, F.lit(1.0)).otherwise((F.col("in_a") - F.col("n_only_a")) / united)
        done.append(summed.where(fits).select("pair", "n_only_a", "n_only_b", near.alias("likeness"), *([f"only_{side}" for side in "ab"] if digests else [])))
        stalled = summed.where(~fits).select("pair")
        if stalled.isEmpty():
            break
        pairs, times = materialize(pairs.join(stalled, "pair", "left_semi"), "stalled"), times * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fingerprint_text(cells: Column, size: Column) -> Column:
    """The sketch as hexadecimal text: the number of digests, then count, key and check of every cell."""
    hexed = lambda v, n: F.lpad(F.hex(v), n, "0")
    return F.concat(hexed(size, 8), F.array_join(F.transform(F.concat(*[cells[f"t{t}"] for t in range(TABLES)]), lambda c: F.concat(hexed(c["n"], 8), hexed(c["key"], 16), hexed(c["check"], 16))), ""))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, keys, next_keys): the text and the digests of the next document in descending id order, after
    the last those of the first.

    Ids are cut into buckets at approximate quantiles; each bucket also gets the first document of the one below it, so
    a window walks one bucket only and the texts are shuffled once. Null ids come last; rows of one id go by text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = lambda rows: rows.withColumn("keys", paragraph_digests(F.col("text")))
    n = max(1, min(MOST_BUCKETS, math.ceil(rows.count() / BUCKET_ROWS)))
    borders = []
    if n > 1:
        got = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).head()["q"] or []
        borders = sorted(set(got))
    step = max(1, math.isqrt(len(borders)))
    fine = [borders[i : i + step] for i in range(0, len(borders), step)]

    def bucket(x: Column) -> Column:
        if not borders:
            return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0))
        # one folded value in the plan, however many borders there are
        parts = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
        heads = F.from_json(F.lit(json.dumps([f[0] for f in fine])), "array<bigint>")
        below = lambda values: F.size(F.filter(values, lambda b: b < x))
        part = F.greatest(below(heads) - 1, F.lit(0))
        return F.when(x.isNull(), F.lit(-1)).otherwise(part * step + below(F.element_at(parts, part + 1)))

    placed = keyed(rows).withColumn("bucket", bucket(F.col("doc_id"))).withColumn("halo", F.lit(0))
    # one row per bucket; the highest follows the lowest
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    above = Window.orderBy("bucket")
    first_of_all = Window.partitionBy()
    tops = tops.select("top", F.coalesce(F.lead("bucket").over(above), F.min("bucket").over(first_of_all)).alias("to"))
    halo = keyed(rows).join(F.broadcast(tops), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "keys", F.col("to").alias("bucket"), F.lit(1).alias("halo"))
    walk = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    both = placed.unionByName(halo).withColumn("next_text", F.lead("text").over(walk)).withColumn("next_keys", F.lead("keys").over(walk))
    return both.where("halo = 0").select("doc_id", "text", "next_text", "keys", "next_keys")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_digests, fingerprint) of every row. Null text counts as empty; its sketch is all zeros."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), paragraph_digests(F.coalesce(F.col(text_col), F.lit(""))).alias("keys"))
    cells = sketch(F.col("keys"), F.lit(CELLS).cast("long"))
    return keyed.select("doc_id", F.size("keys").cast("long").alias("n_digests"), fingerprint_text(cells, F.size("keys")).alias("fingerprint"))


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited text (the last third replaced by the start of the next document's) and against the
    next document's.

    Null text counts as empty, and two empty texts are alike (1); a single document follows itself; rows of one id follow
    each other by text; an empty table gives no rows."""
    third = F.floor(F.length("text") / 3).cast("int")
    walked = with_next_text(docs, id_col, text_col).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)))
    width = F.lit(CELLS).cast("long")
    keyed = walked.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("keys").alias("a"), paragraph_digests(F.col("edited")).alias("e"), F.col("next_keys").alias("n"),
    )
    sketched = keyed.select("*", *[sketch(F.col(k), width).alias(f"s{k}") for k in ("a", "e", "n")])
    near = [likeness(F.col("a"), F.col("sa"), F.col(k), F.col(f"s{k}")).alias(name) for k, name in (("e", "near_edited"), ("n", "near_next"))]
    # digests are written, not the fingerprints, which take several times their room
    first = materialize(sketched.select("doc_id", "n_chars", "edited_sha256", "a", "e", "n", *near).withColumn("row", F.monotonically_increasing_id()), "versions")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.when(F.col(c).isNull(), F.col(k)).alias("b")) for i, (c, k) in enumerate((("near_edited", "e"), ("near_next", "n")))])
    pairs = first.select("row", "a", F.explode(sides).alias("v")).where("v.b is not null").select((F.col("row") * 2 + F.col("v.side")).alias("pair"), "a", F.col("v.b").alias("b"))
    found = differences(pairs, digests=False).select(F.shiftright("pair", 1).alias("row"), F.when(F.col("pair") % 2 == 0, F.col("likeness")).alias("l0"), F.when(F.col("pair") % 2 == 1, F.col("likeness")).alias("l1"))
    found = found.groupBy("row").agg(F.max("l0").alias("l0"), F.max("l1").alias("l1"))
    return first.drop("n").join(found, "row", "left").select(
        "doc_id", "n_chars", "edited_sha256",
        *[fingerprint_text(sketch(F.col(k), width), F.size(k)).alias(name) for k, name in (("a", "fingerprint"), ("e", "edited_fingerprint"))],
        F.coalesce("near_edited", "l0").alias("near_edited"), F.coalesce("near_next", "l1").alias("near_next"),
    )
