"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where a local run leaves it unset."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = getattr(spark.sparkContext, "_seqlattice_shared", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext._seqlattice_shared = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Row groups of written tables: small ones, so that writers of wide rows buffer little.
ROW_GROUP = 16 << 20


def materialize(df: DataFrame, name: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors. ``by``: a column with a
    folder for each of its few values, so that a filter on it reads only its rows."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("parquet.block.size", ROW_GROUP).option("compression", compression)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_level(n: Column) -> Column:
    """Eight steps for each power of two: levels by which the most frequent entries are chosen."""
    return F.floor(F.log2(n) * 8).cast("int")


def least_level(sizes: dict[int, int], most: int) -> int:
    """The least level from which on there are no more than ``most`` entries; ``sizes`` has the entries of each level."""
    least = max(sizes, default=0) + 1
    for level in sorted(sizes, reverse=True):
        most -= sizes[level]
        if most < 0:
            break
        least = level
    return least


#: Rows and bytes of text that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def text_rows(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs.select(columns)`` for a Python stage: bounds the batches that Spark hands to Python workers, unless the session already does."""
    conf = docs.sparkSession.conf
    for key, usual, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", None, BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now == usual or usual is None and (now is None or not now.isdigit() or int(now) > value):
            conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return docs.select(*columns)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's text modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(n)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, one row after the other, and the row offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))


def word_spans(raw: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of words before it (with a last entry for all)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(row_at), np.int64)
    word = ~IS_SPACE[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = False
    before[1:] = word
    first = row_at[:-1][row_at[:-1] < len(raw)]
    start = word & ~before[:-1]
    start[first] = word[first]  # a word never runs on into the next row
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:] = word
    stop[1:-1] &= ~word[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, row_at)


def _odd_powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        _POWERS["up"], _POWERS["down"] = _odd_powers(_BASE, size), _odd_powers(_INVERSE, size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes wherever they stand.

    A polynomial over the byte codes modulo 2^64, from running sums; worked in blocks to bound the memory.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _BLOCK, "right"))
        j = max(j, i + 1)
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE_CODE[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every row, in order, and the row offsets.

    A row with 1 to n - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    count = np.diff(word_at)
    whole = np.maximum(count - n + 1, 0)
    each = np.where(count == 0, 0, np.maximum(whole, 1))
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(at[-1], np.uint64)
    if len(words) >= n:
        rolled = np.full(len(words) - n + 1, 0x5851F42D4C957F2D * n % (1 << 64), np.uint64)
        for k in range(n):
            rolled = mix64(rolled ^ words[k : len(words) - n + 1 + k])
        first = np.repeat(word_at[:-1] - at[:-1], whole)
        to = np.flatnonzero(np.repeat(whole > 0, each))
        out[to] = rolled[to + first]
    for r in np.flatnonzero((count > 0) & (count < n)):
        h = np.full(1, 0x5851F42D4C957F2D * int(count[r]) % (1 << 64), np.uint64)
        for w in words[word_at[r] : word_at[r + 1]]:
            h = mix64(h ^ w)
        out[at[r]] = h[0]
    return out, at


def return_memory() -> None:
    """Lets a Python worker give memory back as soon as it is free: Arrow takes its buffers from the C library, and this takes large blocks from the
    system one by one. Workers live on from stage to stage, and would otherwise keep the most that any stage has needed."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except (OSError, AttributeError):  # another C library
            pass


def batches_of(batches: Iterator[pa.RecordBatch], text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size: very long texts make small batches."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.diff(text_bytes(b.column(text))[1]))
        lo = 0
        while lo < b.num_rows:
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
