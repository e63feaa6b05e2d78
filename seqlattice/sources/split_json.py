"""Large JSON files read by many tasks: one top-level array or object, split at its items' borders.

A file is read as text whose records end at a closing bracket instead of a line's end, so Spark itself deals out its byte ranges, on any file system, and
no record is longer than the text between two such brackets. Where a range begins, it is not known whether it is inside a string and how deep it is
nested. A first pass therefore follows each range from every state it could begin in; the ranges of a file are then composed in order (one small row a
range and state), and a second pass, which knows each range's beginning, cuts the items out. Items that run over a range's end are put together by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.sources.scratch import bounded_batches, scratch_path

#: Ranges up to which their states go to every task; of more they are joined by file and range.
MOST_RANGES = 200_000
QUOTE, BACKSLASH = 34, 92
PAIRS = {b"[": b"]", b"{": b"}"}
OPEN, SHUT, COMMA = np.array([91, 123], np.uint8), np.array([93, 125], np.uint8), 44
#: White space of JSON, and the mark that files may begin with.
BLANK = b" \t\r\n\xef\xbb\xbf"
#: The states a range can begin in: outside of a string, inside, and inside right after a backslash.
STATES = ((False, False), (True, False), (True, True))


def escapes(text: np.ndarray, pending: bool) -> tuple[np.ndarray, bool]:
    """Which bytes follow a backslash that counts, and whether the byte after the last one does."""
    out = np.zeros(len(text) + 1, bool)
    out[0] = pending
    at = np.flatnonzero(text == BACKSLASH)
    if len(at):
        first = np.r_[True, np.diff(at) > 1]
        run = np.maximum.accumulate(np.where(first, at, 0))
        place = at - run + (pending & (run == 0))
        out[at[place % 2 == 0] + 1] = True
    return out[:-1], bool(out[-1])


@dataclass
class Walk:
    """A text followed from one state: where it is now, and how many borders it has met by nesting (relative to its beginning)."""

    inside: bool
    pending: bool
    depth: int = 0
    borders: dict[int, int] = field(default_factory=dict)

    def brackets(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the brackets and commas outside of strings, and the nesting in which each stands: a bracket counts to what it encloses. Moves on."""
        after, pending = escapes(text, self.pending)
        parity = np.cumsum((text == QUOTE) & ~after) + self.inside
        kind = np.zeros(len(text), np.int8)
        kind[np.isin(text, OPEN)] = 1
        kind[np.isin(text, SHUT)] = -1
        at = np.flatnonzero(((kind != 0) | (text == COMMA)) & (parity % 2 == 0))
        step = kind[at].astype(np.int64)
        nested = np.cumsum(step) + self.depth
        level = nested + (step < 0)
        if len(text):
            self.inside, self.pending = bool(parity[-1] % 2), pending
            self.depth = int(nested[-1]) if len(at) else self.depth
        return at, level

    def follow(self, text: np.ndarray) -> None:
        for level, n in zip(*np.unique(self.brackets(text)[1], return_counts=True)):
            self.borders[int(level)] = self.borders.get(int(level), 0) + int(n)


def _runs(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[tuple[str, int], dict, np.ndarray]]:
    """(file and range, the first row's other columns, bytes) in order; ``mark`` stands between two records of a range."""
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("path").dictionary_encode(), b.column("start").to_numpy()
        values = b.column("value").cast(pa.binary()).to_pylist()
        which = file.indices.to_numpy()
        borders = [0, *(np.flatnonzero((np.diff(which) != 0) | (np.diff(start) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(borders, borders[1:]):
            key = (file.dictionary[int(which[lo])].as_py(), int(start[lo]))
            text = mark.join(values[lo:hi])
            yield key, {n: b.column(n)[lo].as_py() for n in b.schema.names if n not in ("path", "start", "value")}, np.frombuffer(mark + text if key == before else text, np.uint8)
            before = key


def _followed(mark: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: (path, start, entry, inside, pending, depth, levels, counts) of each range and state."""
    names = ["path", "start", "entry", "inside", "pending", "depth", "levels", "counts"]
    key, walks = None, []

    def rows() -> pa.RecordBatch:
        own = [(*key, i, w.inside, w.pending, w.depth, list(w.borders), list(w.borders.values())) for i, w in enumerate(walks)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], names=names)

    for now, _, text in _runs(batches, mark):
        if now != key:
            if key:
                yield rows()
            key, walks = now, [Walk(*s) for s in STATES]
        for w in walks:
            w.follow(text)
    if key:
        yield rows()


def _composed(top: bytes, mark: bytes, key: tuple, rows: pa.Table) -> pa.Table:
    """The states in which the ranges of one file begin: (path, start, inside, pending, depth, borders, last)."""
    by: dict[int, dict[int, dict]] = {}
    for r in rows.to_pylist():
        by.setdefault(r["start"], {})[r["entry"]] = r
    at, borders, out, starts = Walk(False, False), 0, [], sorted(by)
    for i, start in enumerate(starts):
        last = i == len(starts) - 1
        out.append((key[0].as_py(), start, at.inside, at.pending, at.depth, borders, last))
        if (at.inside, at.pending) not in STATES:
            raise ValueError(f"{key[0].as_py()} holds a backslash outside of strings")
        r = by[start][STATES.index((at.inside, at.pending))]
        borders += sum(n for level, n in zip(r["levels"], r["counts"]) if level + at.depth == 1)
        at = Walk(r["inside"], r["pending"], at.depth + r["depth"])
        if not last:
            borders += int((at.brackets(np.frombuffer(mark, np.uint8))[1] == 1).sum())
    if at.inside or at.depth > hidden_end(top, mark) or at.depth < 0:
        raise ValueError(f"{key[0].as_py()} ends inside of an item")
    return pa.table({n: pa.array(c) for n, c in zip(("path", "start", "inside", "pending", "depth", "borders", "last"), zip(*out))})


def hidden_end(top: bytes, mark: bytes) -> int:
    """The nesting at which a file may end as it is read: 1 where its last bracket can be a record's mark, which isn't shown."""
    return int(mark == PAIRS[top])


def _cut(top: bytes, mark: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: (path, item, part, whole, last, text). ``item`` counts from 1; a part that isn't whole runs over an end of its range ``part``;
    after the ``last`` one the array ends."""
    names = ["path", "item", "part", "whole", "last", "text"]
    key = end = walk = None
    item, held, whole, found = 0, [], False, []

    def keep(done: bool, last: bool) -> None:
        text = b"".join(held)
        outside = walk_level == 0
        if outside and text.strip(BLANK):
            raise ValueError(f"{key[0]} holds text outside of its array or object")
        if not outside:
            found.append((key[0], item, key[1], whole and done, last, text.decode()))

    def feed(text: np.ndarray) -> None:
        nonlocal item, held, whole, walk_level
        at, level = walk.brackets(text)
        raw, lo = text.tobytes(), 0
        for i in at[level == 1].tolist():
            held.append(raw[lo:i])
            keep(True, raw[i] in b"]}")
            if walk_level == 0 and raw[i : i + 1] != top or walk_level == 0 and item:
                raise ValueError(f"{key[0]} does not hold one {'array' if top == b'[' else 'object'}")
            walk_level = 0 if raw[i] in b"]}" else 1
            item, held, whole, lo = item + 1, [], True, i + 1
        held.append(raw[lo:])

    def close() -> None:
        if not end["last"]:
            feed(np.frombuffer(mark, np.uint8))
        elif walk.depth == 1:
            feed(np.frombuffer(mark, np.uint8))
        keep(False, False)

    walk_level = 0
    for now, state, text in _runs(batches, mark):
        if now != key:
            if key:
                close()
            key, end, walk, item, held, whole = now, state, Walk(state["inside"], state["pending"], state["depth"]), state["borders"], [], False
            walk_level = 1 if state["depth"] > 0 else 0
        feed(text)
        if len(found) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)
            found.clear()
    if key:
        close()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)


def split_items(spark: SparkSession, path, mark: str, top: str = "[") -> DataFrame:
    """(path, item, text) of the items of each file's one array (with ``top`` ``{``: object); ``item`` counts from 1 in each file.

    ``mark`` is the bracket at which records end: ``}`` where items hold objects, ``]`` where they hold arrays. The files are read twice. Files that
    don't end with their array or object are an error, as is other text around it. An empty file, array or object has no items. Bytes that are
    no UTF-8 become replacement characters.
    """
    if mark not in ("}", "]") or top not in ("[", "{"):
        raise ValueError(f"mark: {mark}, top: {top}")
    bounded_batches(spark)
    sign, first = mark.encode(), top.encode()
    text = spark.read.option("lineSep", mark).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    ranges = text.mapInArrow(lambda b: _followed(sign, b), "path string, start long, entry int, inside boolean, pending boolean, depth long, levels array<long>, counts array<long>")
    kept = scratch_path(spark, "ranges")
    ranges.groupBy("path").applyInArrow(lambda k, t: _composed(first, sign, k, t), "path string, start long, inside boolean, pending boolean, depth long, borders long, last boolean").write.parquet(kept)
    states = spark.read.parquet(kept)
    if states.count() <= MOST_RANGES:
        known = text.join(F.broadcast(states), ["path", "start"])  # the rows stay in their order
    else:
        known = text.withColumn("n", F.monotonically_increasing_id()).join(states, ["path", "start"]).sortWithinPartitions("path", "start", "n").drop("n")
    parts = known.mapInArrow(lambda b: _cut(first, sign, b), "path string, item long, part long, whole boolean, last boolean, text string")
    over = parts.where("not whole").groupBy("path", "item").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"), F.bool_or("last").alias("last"))
    joined = over.select("path", "item", "last", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    items = parts.where("whole").select("path", "item", "last", "text").unionByName(joined)
    nothing = (F.col("item") == 1) & F.col("last") & (F.trim(F.translate("text", "\t\r\n", "   ")) == "")
    return items.where(~nothing).drop("last")
