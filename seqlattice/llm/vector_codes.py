"""Vector codes: each part of a vector is named by its nearest codebook entry; codebooks are refined in rounds with norm-of-sum bounds.

A vector's part carries, from round to round, an upper bound of the distance to its own entry, a lower bound of that to any other, and the round in
which each was measured (its stamp). All codebooks so far are retained, so a bound moves by the length of the entry's net displacement since its stamp, the
norm of the sum of its moves, which is at most the sum of their norms. Only where the bounds then meet is the upper one measured again, and only where
they still meet are all entries compared. Vectors are whole numbers, so distances are exact, and bounds are rounded away from each other.

Nulls: a row whose vector is null, empty, or holds a null, NaN or infinite entry is left out. A row without an id is coded but never gives a first codebook
entry. Rows of one id are coded each; among the first entries ties of ids go by the vectors. With fewer kept vectors than entries codebooks are
smaller; an empty table gives no rows. Vectors of different lengths, and lengths that cannot be cut into equal parts, are errors.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqlattice.llm.common import materialize
from seqlattice.llm.vector_rows import Batches, stacked, summed, whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Bounds closer than this share of themselves are not trusted: more than the error of 32-bit floats.
MARGIN = 1e-6
#: Different labels up to which their sums go to every task.
LABELS = 100_000


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(part, entry, position): the vectors of the smallest ids. Each task sends its own smallest; tasks are two for each core."""

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []
        for b in batches:
            ids = b.column("id").to_pylist()
            order = (stacked(b.column("x")).view("<u8") ^ np.uint64(1 << 63)).astype(">u8")  # whose bytes sort as the numbers do
            most = held[-1][0] if len(held) == entries else None
            held = heapq.nsmallest(entries, held + [(i, order[k].tobytes()) for k, i in enumerate(ids) if i is not None and (most is None or i <= most)])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], kind), pa.array([h[1] for h in held], pa.binary())], names=["id", "x"])

    kind = to_arrow_type(rows.schema["id"].dataType)
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, 2)
    found = rows.select("id", "x").coalesce(tasks).mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("x", T.BinaryType())])).collect()
    found = heapq.nsmallest(entries, ((r["id"], bytes(r["x"])) for r in found))
    if not found:
        return None
    x = np.array([(np.frombuffer(r[1], ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64) for r in found])
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of one part to all its entries."""
    reach = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * reach * reach * x.shape[1] >= 1 << 62:
        raise ValueError("a vector's entry is too large")
    if 4 * reach * reach * x.shape[1] < 1 << 52:  # exact in doubles
        x, book = x.astype(np.float64), book.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)


def own_distance(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    gap = x - book[code]
    return (gap * gap).sum(axis=1)


class State:
    """Of a batch, by (row, part): code, upper and lower bound, and their stamps."""

    FIELDS = (("code", "<u2"), ("upper", "<f4"), ("lower", "<f4"), ("upper_at", "u1"), ("lower_at", "u1"))

    def __init__(self, n: int, parts: int) -> None:
        for name, kind in self.FIELDS:
            setattr(self, name, np.zeros((n, parts), kind))
        self.scans = np.zeros(n, np.int64)

    @classmethod
    def read(cls, b: pa.RecordBatch, parts: int) -> State:
        out = cls(b.num_rows, parts)
        for name, kind in cls.FIELDS:
            setattr(out, name, stacked(b.column(name), kind).copy())
        out.scans = b.column("scans").to_numpy().copy()
        return out

    def arrays(self) -> list[pa.Array]:
        return [pa.array([r.tobytes() for r in getattr(self, name)], pa.binary()) for name, _ in self.FIELDS] + [pa.array(self.scans)]

    def scan(self, x: np.ndarray, book: np.ndarray, part: int, rows: np.ndarray, now: int) -> None:
        """Compares ``rows`` with all entries; the lowest of the nearest wins."""
        if not len(rows):
            return
        d = distances(x[rows], book)
        best = d.argmin(axis=1)
        near = d[np.arange(len(rows)), best]
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(rows), np.inf)
        self.code[rows, part] = best
        self.upper[rows, part] = np.sqrt(near.astype(np.float64)) * (1 + MARGIN)
        self.lower[rows, part] = second * (1 - MARGIN)
        self.upper_at[rows, part] = self.lower_at[rows, part] = now
        self.scans[rows] += 1

    def refresh(self, x: np.ndarray, history: list[np.ndarray], part: int) -> None:
        """Codes by the newest codebook of ``history``, all entries compared only where the bounds meet."""
        now, code = len(history) - 1, self.code[:, part].astype(np.int64)
        moved = np.stack([np.sqrt(((history[now][part] - h[part]) ** 2).sum(axis=1).astype(np.float64)) for h in history])  # (stamp, entry)
        most = moved.argmax(axis=1)
        second = np.sort(moved, axis=1)[:, -2] if moved.shape[1] > 1 else np.zeros(len(moved))
        since = self.lower_at[:, part]
        others = np.where(most[since] == code, second[since], moved[since, most[since]])
        lower = self.lower[:, part].astype(np.float64) - others
        upper = self.upper[:, part].astype(np.float64) + moved[self.upper_at[:, part], code]
        close = lambda rows: rows[upper[rows] * (1 + MARGIN) >= lower[rows] * (1 - MARGIN)]
        open_ = close(np.arange(len(x)))
        if len(open_):
            upper[open_] = np.sqrt(own_distance(x[open_], history[now][part], code[open_]).astype(np.float64)) * (1 + MARGIN)
            self.upper[open_, part], self.upper_at[open_, part] = upper[open_], now
            self.scan(x, history[now][part], part, close(open_), now)


def coded(rows: DataFrame, history: list[np.ndarray], before: bool) -> DataFrame:
    """``rows`` with their state after the newest codebook of ``history``; ``before``: they have the state of the round before."""
    parts = len(history[0])
    fields = [f for f in rows.schema.fields if f.name in ("id", "x", "label")]
    schema = T.StructType([*fields, *[T.StructField(n, T.BinaryType()) for n, _ in State.FIELDS], T.StructField("scans", T.LongType())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            x = stacked(b.column("x")).reshape(b.num_rows, parts, -1)
            state = State.read(b, parts) if before else State(b.num_rows, parts)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                if before:
                    state.refresh(part, history, p)
                else:
                    state.scan(part, history[-1][p], p, np.arange(b.num_rows), 0)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], *state.arrays()], names=schema.names)

    return rows.mapInArrow(run, schema)


def moved_codebooks(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    parts, entries, width = book.shape

    def of(b: pa.RecordBatch) -> np.ndarray:
        x, code = stacked(b.column("x")).reshape(-1, width), stacked(b.column("code"), "<u2").astype(np.int64)
        out = np.zeros((parts * entries, width + 1), np.int64)
        np.add.at(out, (code + np.arange(parts) * entries).ravel(), np.hstack([x, np.ones((len(x), 1), np.int64)]))
        return out

    total = summed(state, of).reshape(parts, entries, width + 1)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), book)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((id, code, error, label, scans), final codebooks): two hex digits a part; the squared distances added up; how often the row's parts
    were compared with all entries. Codebooks are None without rows."""
    if not 1 <= entries <= 256 or not 1 <= rounds <= 254:
        raise ValueError("a code has two digits, a stamp one byte")
    rows = whole_vectors(vectors, id_col, vector, SCALE, 0, "whole", label=F.col(label))
    out = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label", vectors.schema[label].dataType), T.StructField("scans", T.LongType())])
    head = rows.head()
    if head is not None and len(head["x"]) // 8 % parts:
        raise ValueError(f"vectors of length {len(head['x']) // 8} cannot be cut into {parts} equal parts")
    book = first_codebooks(rows, parts, entries)
    if book is None:
        return rows.sparkSession.createDataFrame([], out), None
    history, state = [book], rows
    for r in range(rounds):
        state = materialize(coded(state, history, r > 0), f"codes-{r}")
        history.append(moved_codebooks(state, history[-1]))
    final = history[-1]

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            x, code = stacked(b.column("x")).reshape(b.num_rows, parts, -1), stacked(b.column("code"), "<u2").astype(np.int64)
            error = sum(own_distance(x[:, p], final[p], code[:, p]) for p in range(parts))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([bytes(r.astype(np.uint8)).hex() for r in code]), pa.array(error), b.column("label"), b.column("scans")], names=out.names)

    return coded(state, history, True).mapInArrow(run, out), final


def codebooks_digest(book: np.ndarray | None) -> str:
    """SHA-256 of all entries' numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(b"" if book is None else ",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(found: DataFrame, label: str = "label", error: str = "error", salts: int = 16) -> DataFrame:
    """``found`` with ``label_error``: the error summed over equal labels, nulls together. Few labels' sums go to every task; of more, each is copied
    ``salts`` times, so that no label's rows meet in one task."""
    found = materialize(found, "coded")
    sums = materialize(found.groupBy(F.col(label).alias("_label")).agg(F.sum(error).alias("label_error")), "label-error")
    same = F.col(label).eqNullSafe(F.col("_label"))
    if sums.count() <= LABELS:
        return found.join(F.broadcast(sums), same).drop("_label")
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in found.columns if c != label]), F.lit(salts)))
    copies = sums.withColumn("_salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, same & (F.col("_salt") == F.col("_salt_of"))).drop("_label", "_salt", "_salt_of")
