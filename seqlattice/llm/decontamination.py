"""Benchmark decontamination: MinHash containment search of short test items in long documents, then an exact check.

Items are partitioned by their number of shingles. Every item keeps the bottom-k MinHash sketch of its shingle set, where
k is one more than the most shingles that may be missing at the threshold, for the largest set of its partition: a
document that contains enough of the item must then hold at least one sketch value, so the search loses no match.
Candidates are checked by exact containment of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import batches_of, lower_ascii, shingle_hashes, span_hashes, text_bytes, text_rows, word_spans

SHINGLE, PERCENT = 5, 80
#: Shingles of the items that one pass over the documents carries; larger benchmarks take more passes.
BLOCK_SHINGLES = 1 << 20


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, and the row offsets: A-Z lower-cased, words between ASCII white space."""
    raw, at = text_bytes(texts)
    raw = lower_ascii(raw)
    starts, ends, word_at = word_spans(raw, at)
    return shingle_hashes(span_hashes(raw, starts, ends), word_at, n)


def item_sets(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "text", 1 << 20):
            h, at = shingle_sets(b.column("text"), n)
            rows = [np.unique(h[a:z]).view(np.int64) for a, z in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "shingles": pa.array(rows, pa.list_(pa.int64()))})

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(sets, "item_id long, shingles array<long>")


class ItemIndex:
    """Sketches and sets of one block of items, as flat sorted arrays."""

    def __init__(self, rows: list[tuple[int | None, list[int]]], percent: int) -> None:
        self.ids = [i for i, _ in rows]
        self.size = np.array([len(s) for _, s in rows], np.int64)
        self.need = -(-percent * self.size // 100)
        # size partitions: powers of two; within one, k follows from its largest set
        group = np.ceil(np.log2(np.maximum(self.size, 1))).astype(int)
        values, owners = [], []
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            k = int((self.size[mine] - self.need[mine]).max()) + 1
            for r in mine:
                sketch = np.sort(np.array(rows[r][1], np.int64).view(np.uint64))[:k]
                values.append(sketch), owners.append(np.full(len(sketch), r))
        self.sketch, self.sketch_item = self._sorted(values, owners)
        sets = [np.array(s, np.int64).view(np.uint64) for _, s in rows]
        self.value, self.value_item = self._sorted(sets, [np.full(len(s), r) for r, s in enumerate(sets)])
        low = np.zeros(1 << 16, bool)
        low[(self.sketch & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.low = low

    @staticmethod
    def _sorted(values: list, owners: list) -> tuple[np.ndarray, np.ndarray]:
        v, o = (np.concatenate([*x, np.zeros(0, k)]).astype(k) for x, k in ((values, np.uint64), (owners, np.int64)))
        order = np.argsort(v, kind="stable")
        return v[order], o[order]

    @staticmethod
    def _hits(found: np.ndarray, keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        n = hi - lo
        each = np.repeat(np.arange(len(found)), n)
        return each, owners[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def matches(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every document row that holds enough of an item."""
        maybe = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at, item = self._hits(h[maybe], self.sketch, self.sketch_item)
        if not len(at):
            return []
        pairs = np.unique(row[maybe[at]] * len(self.ids) + item)
        out = []
        rows = np.unique(pairs // len(self.ids))
        for r in rows:
            lo, hi = np.searchsorted(row, [r, r + 1])
            _, held = self._hits(np.unique(h[lo:hi]), self.value, self.value_item)
            shared = np.bincount(held, minlength=len(self.ids))
            for i in pairs[np.searchsorted(pairs, r * len(self.ids)) : np.searchsorted(pairs, (r + 1) * len(self.ids))] % len(self.ids):
                if shared[i] >= self.need[i]:
                    out.append((int(r), int(i), int(shared[i])))
        return out


def item_blocks(items: DataFrame, n: int, percent: int, item_col: str, item_text_col: str, block_shingles: int) -> Iterator[ItemIndex]:
    """Indexes of the items in blocks of at most ``block_shingles`` shingles; a larger item is a block by itself."""
    block, size = [], 0
    for row in item_sets(items, n, item_col, item_text_col).toLocalIterator():
        if not row["shingles"]:
            continue
        if block and size + len(row["shingles"]) > block_shingles:
            yield ItemIndex(block, percent)
            block, size = [], 0
        block.append((row["item_id"], row["shingles"]))
        size += len(row["shingles"])
    if block:
        yield ItemIndex(block, percent)


FOUND = "doc_id long, item_id long, item_shingles long, shared_shingles long, containment double"


def contained_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) for every document that holds at least ``percent``
    per cent of an item's distinct n-word shingles.

    The items are the stated query set: they go through in blocks of at most ``block_shingles`` shingles (one larger item is
    a block by itself), every block against all documents. Null or empty text holds nothing and is found nowhere; a text
    of fewer than n words is one shingle. Repeated rows and ids each give their own rows. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches_of(batches, "text", 1 << 20):
                h, at = shingle_sets(b.column("text"), n)
                found = index.matches(h, np.repeat(np.arange(b.num_rows), np.diff(at)))
                r, i, shared = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").take(pa.array(r)), "item_id": pa.array([index.ids[k] for k in i], pa.int64()),
                    "item_shingles": pa.array(index.size[i]), "shared_shingles": pa.array(shared),
                    "containment": pa.array(shared / np.maximum(index.size[i], 1)),
                })

        return texts.mapInArrow(run, FOUND)

    out = spark.createDataFrame([], FOUND)
    for index in item_blocks(items, n, percent, item_col, item_text_col, block_shingles):
        out = out.unionByName(search(spark.sparkContext.broadcast(index)))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows, with all their columns, that hold no item (see ``contained_items``)."""

    def clean(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_of(batches, text_col, 1 << 20):
                h, at = shingle_sets(b.column(text_col), n)
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, _, _ in held.value.matches(h, np.repeat(np.arange(b.num_rows), np.diff(at)))]] = False
                yield b.filter(pa.array(keep))

        return run

    rows = text_rows(docs, F.col("*"))
    for index in item_blocks(items, n, percent, item_col, item_text_col, block_shingles):
        rows = rows.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return rows
