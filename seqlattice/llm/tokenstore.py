"""Token-ID files: every document's ids compressed by itself with one shared zstandard dictionary.

A store is a folder of three Parquet tables, so that Spark's committer makes the write atomic on any file system:

* ``dictionary``: one row (dict_hash, dictionary), the dictionary trained on serialized id arrays of a bounded sample;
* ``blocks``: rows of consecutive documents, in ascending id order or in the order of the files that they come from. ``payload`` holds their zstandard frames end to end,
  ``frame_at`` (u64, one more than documents) is the offset index into it, ``doc_ids`` (i64) and ``token_at`` (u64) tell
  which document a frame is and how many ids of the block come before it; ``dict_hash`` names the dictionary;
* ``parts``: for each range part, the number of ids before it.

A frame decompresses to little-endian ids of ``width`` bytes. One short document is read by the index without the rest.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import IS_SPACE, batches_of, lower_ascii, materialize, scratch_path, span_hashes, text_bytes, text_rows, word_spans

END_ID = 2
#: The dictionary is trained on this many documents (those of the smallest id hash), on the first ids of each: so many.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 2000, 4096, 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 3
_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: Fixed value: the pre-tokenizer pattern of word tokenizers whose texts ``units_of`` cuts itself.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Units that are put together, with a blank between them, for one call of the tokenizer.
JOINED = 32


def _cuts_words(tok) -> bool:
    """Whether the tokenizer lower-cases, drops white space, cuts by ``WORD_PATTERN`` and marks the last token of each cut."""
    spec = json.loads(tok.to_str())
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORD_PATTERN} and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"] and bool(spec["model"].get("end_of_word_suffix"))
        and all(t["content"].startswith("<|") for t in spec["added_tokens"])
    )


def units_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, plain, first unit of each row and one more): what ``WORD_PATTERN`` cuts, already lower-cased.

    A piece between white space with other letters than a-z and the letters of Latin-1, or with ``<|`` (special tokens), is a
    unit as it stands, and not plain.
    """
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(at), np.int64)
    before, after = np.concatenate([[0], raw[:-1]]), np.concatenate([raw[1:], [0]])
    second = (before == 0xC3) & (raw >= 0x80) & (raw != 0x97) & (raw != 0xB7)
    low = lower_ascii(raw)
    low[second & (raw <= 0x9E)] += 0x20
    letter = (low >= 97) & (low <= 122) | second
    letter[:-1] |= second[1:]
    odd = (raw >= 0x80) & ~letter | (raw == 60) & (after == 124)
    starts, ends, _ = word_spans(raw, at)
    run = np.concatenate([[0], np.cumsum(odd)])
    other = run[ends] > run[starts]
    kind = np.where(letter, 1, np.where((raw >= 48) & (raw <= 57), 2, 3)).astype(np.int8)
    kind[IS_SPACE[raw]] = 0
    mark = np.zeros(n + 1, np.int8)
    mark[starts[other]] += 1
    mark[ends[other]] -= 1
    whole = np.cumsum(mark[:-1], dtype=np.int8) > 0
    kind[whole] = 4
    head = np.zeros(n + 1, bool)
    head[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    head[:n] &= kind > 0
    head[starts] = True
    # the short forms: an apostrophe that opens its run, and the letters after it
    mark = np.flatnonzero((low == 39) & (kind == 3) & head[:n])
    ends_at = ends[np.searchsorted(starts, mark, "right") - 1]
    follow = np.concatenate([low, [0, 0, 0]])
    one, two = follow[mark + 1], follow[mark + 2]
    short = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108), 2, 0))
    short[mark + short >= ends_at] = 0
    mark, short, ends_at = mark[short > 0], short[short > 0], ends_at[short > 0]
    head[mark + 1] = False
    mark += short + 1
    head[mark[mark < ends_at]] = True
    first = np.flatnonzero(head)
    tail = np.zeros(n + 1, bool)
    tail[1:] = kind > 0
    tail[1:n] &= head[1:n] | (kind[1:] == 0)
    return np.where(whole, raw, low), first, np.flatnonzero(tail), ~whole[first], np.searchsorted(first, at)


class UnitIds:
    """Ids of the units seen so far in this worker, looked up by 64-bit hash; emptied when it holds ``MOST`` units.

    Two sorted tables: a large one, and one of the newest units that joins it when it has half its size.
    """

    MOST = 1_000_000

    def __init__(self, tokenizer_path: str) -> None:
        # every worker has a core of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = _tokenizer(tokenizer_path)
        self.cuts = _cuts_words(self.tok)
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        if self.cuts:
            end = json.loads(self.tok.to_str())["model"]["end_of_word_suffix"]
            self.is_end = np.zeros(self.tok.get_vocab_size(), bool)
            self.is_end[[i for w, i in self.tok.get_vocab().items() if w.endswith(end)]] = True
        self.clear()

    def clear(self) -> None:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.tables, self.flat, self.used = [empty, empty], np.zeros(1 << 16, self.kind), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text)."""
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), self.kind), np.fromiter(map(len, got), np.int64, len(got))

    def _encode_units(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for units of ``text``, the plain ones first."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        size = (ends - starts)[order] + 1  # and a blank
        stop = np.cumsum(size)
        joined = text[np.minimum(np.repeat(starts[order] - (stop - size), size) + np.arange(stop[-1]), len(text) - 1)]
        joined[stop - 1] = 32
        joined = joined.tobytes()
        cut = [0, *stop[:n][JOINED - 1 :: JOINED].tolist(), *([int(stop[n - 1])] if n % JOINED else [])]
        flat, _ = self.encode([joined[a:z].decode() for a, z in zip(cut[:-1], cut[1:])])
        last = np.flatnonzero(self.is_end[flat]) + 1
        if len(last) != n:
            raise ValueError("the tokenizer cuts words otherwise than it says")
        rest, each = self.encode([joined[a : z - 1].decode() for a, z in zip((stop - size)[n:].tolist(), stop[n:].tolist())])
        sizes = np.empty(len(order), np.int64)
        sizes[order] = np.concatenate([np.diff(last, prepend=0), each])
        # back in the order of the units
        ids, at = np.concatenate([flat, rest]), np.empty(len(order), np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, size, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for known, first, n in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                start[hit], size[hit] = first[at[hit]], n[at[hit]]
                found |= hit
        return start, size, found

    def find(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``flat``, number of ids) of each unit; ``keys`` are distinct and ascending."""
        start, size, found = self._look(keys)
        new = np.flatnonzero(~found)
        if not len(new):
            return start, size
        if sum(len(t[0]) for t in self.tables) + len(new) > self.MOST and any(len(t[0]) for t in self.tables):
            self.clear()
            return self.find(keys, text, starts, ends, plain)
        ids, n = self._encode_units(text, starts[new], ends[new], plain[new])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), len(self.flat)), self.kind)])
        self.flat[self.used : self.used + len(ids)] = ids
        start[new], size[new] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)
        large, fresh = self.tables
        fresh = self._merged(fresh, (keys[new], start[new], n))
        if 2 * len(fresh[0]) > len(large[0]):
            large, fresh = self._merged(large, fresh), tuple(c[:0] for c in fresh)
        self.tables = [large, fresh]
        return start, size

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))


def encode_texts(texts: pa.Array, tokenizer_path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text with the end id. For word tokenizers (``_cuts_words``) each distinct unit is encoded once a worker, as
    no token crosses a unit; others encode whole texts. ``tests`` hold the result against whole texts.
    """
    known = _loaded.get(("units", tokenizer_path))
    if known is None:
        known = _loaded["units", tokenizer_path] = UnitIds(tokenizer_path)
    if known.cuts:
        raw, at = text_bytes(texts)
        text, starts, ends, plain, unit_at = units_of(raw, at)
        keys, one, code = np.unique(span_hashes(text, starts, ends), return_index=True, return_inverse=True)
        start, size = known.find(keys, text, starts[one], ends[one], plain[one])
        start, size = start[code], size[code]
        stop = np.cumsum(size)
        ids = known.flat[np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        cut = np.concatenate([[0], stop])[unit_at]
    else:
        ids, each = known.encode([t.as_py() or "" for t in texts])
        cut = np.concatenate([[0], np.cumsum(each)])
    cut = cut.tolist()
    return [np.append(ids[a:b], ids.dtype.type(end_id)) for a, b in zip(cut[:-1], cut[1:])]


def _width(tokenizer_path: str) -> int:
    return 2 if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample; the raw samples where they are too few to train.

    The sample is ``SAMPLE_DOCS`` different (id, text) pairs in the order of the id's hash, the first ``SAMPLE_IDS`` ids of each.
    """
    width = _width(tokenizer_path)
    keyed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    picked = keyed.select("id", "h").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(SAMPLE_DOCS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "text", 2 << 20):
            ids = encode_texts(b.column("text"), tokenizer_path)
            yield pa.RecordBatch.from_pydict({"ids": pa.array([x[:SAMPLE_IDS].astype(f"<u{width}").tobytes() for x in ids], pa.binary())})

    rows = text_rows(keyed.join(F.broadcast(picked), ["id", "h"]).dropDuplicates(["id", "h"]), F.col("text")).mapInArrow(sample, "ids binary")
    samples = sorted(bytes(r[0]) for r in rows.collect())  # at most SAMPLE_DOCS
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def file_order(docs: DataFrame) -> list[Column]:
    """Columns that sort documents read from Parquet files as they stand there: number of the part file, row in it."""
    return [F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long"), F.col("_metadata.row_index")]


def _encoded(docs: DataFrame, tokenizer_path: str, dictionary: bytes, id_col: str, text_col: str, order: list[Column]) -> DataFrame:
    width, keys = _width(tokenizer_path), [f"key{i}" for i in range(len(order))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for b in batches_of(batches, "text", 2 << 20):
            ids = encode_texts(b.column("text"), tokenizer_path)
            yield pa.RecordBatch.from_pydict({
                **{c: b.column(c) for c in ("doc_id", *keys)},
                "n": pa.array([len(x) for x in ids], pa.int64()),
                "frame": pa.array([press.compress(x.astype(f"<u{width}").tobytes()) for x in ids], pa.binary()),
            })

    rows = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), *[c.cast("long").alias(k) for c, k in zip(order, keys)], F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, " + "".join(f"{k} long, " for k in keys) + "n long, frame binary")


def _blocks(width: int, dict_hash: str):
    names = ["part", "first_doc", "last_doc", "n_docs", "n_tokens", "part_tokens_before", "width", "dict_hash", "doc_ids", "has_id", "token_at", "frame_at", "payload"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        ids, counts, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [part, min(known, default=None), max(known, default=None), len(ids), sum(counts), before, width, dict_hash,
                   np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], "u1").tobytes(),
                   np.cumsum([0, *counts]).astype("<u8").tobytes(), np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(), b"".join(frames)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for b in batches:
            for doc, n, frame in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "frame"))):
                ids.append(doc), counts.append(n), frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield block()
                    before += sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield block()

    return pack


BLOCK_SCHEMA = "part int, first_doc long, last_doc long, n_docs long, n_tokens long, part_tokens_before long, width int, dict_hash string, doc_ids binary, has_id binary, token_at binary, frame_at binary, payload binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None) -> str:
    """Encode every document and write the store in ascending id order, or in that of ``order`` (whole numbers); returns ``path``.

    Null or empty text: only the end id. Null ids come first. Rows of one id stay separate documents, ordered by their
    number of ids, then a hash of their frames. An empty table makes a store without blocks.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, id_col, text_col)
    name = dictionary_hash(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    frames = materialize(_encoded(docs, tokenizer_path, dictionary, id_col, text_col, order or []), "frames")  # else the range sampling would encode twice
    # the sampled range keys reach the driver: a hash stands for the frame
    keys = [f"key{i}" for i in range(len(order or []))]
    ordered = frames.withColumn("h", F.xxhash64("frame")).repartitionByRange(*keys, "doc_id", "n", "h").sortWithinPartitions(*keys, "doc_id", "n", "h", "frame").drop("h", *keys)
    ordered.mapInArrow(_blocks(_width(tokenizer_path), name), BLOCK_SCHEMA).write.parquet(f"{path}/blocks", compression="uncompressed")
    parts = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # one row per range part
    parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before")).coalesce(1).write.parquet(f"{path}/parts")
    return path


def _open(block: dict, dictionary: bytes):
    if block["dict_hash"] != dictionary_hash(dictionary):
        raise ValueError(f"the block needs dictionary {block['dict_hash']}")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the store: doc_id, start (ids before it), n_tokens, ids (u32 little-endian), ids_crc32."""
    dictionary = bytes(spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").head()["dictionary"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                opener = _open(block, dictionary)
                frame_at, token_at = np.frombuffer(block["frame_at"], "<u8"), np.frombuffer(block["token_at"], "<u8").astype(np.int64)
                docs, has = np.frombuffer(block["doc_ids"], "<i8"), np.frombuffer(block["has_id"], "u1")
                kind = f"<u{block['width']}"
                ids = [np.frombuffer(opener.decompress(block["payload"][a:z]), kind).astype("<u4").tobytes() for a, z in zip(frame_at[:-1], frame_at[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs, mask=has == 0),
                    "start": pa.array(token_at[:-1] + (block["before"] + block["part_tokens_before"])),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                })

    blocks, parts = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks"), spark.read.schema("part int, before long").parquet(f"{path}/parts")
    return blocks.join(parts, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the document (one list per row of that id, in their order): block statistics prune the scan, the index finds its
    frame. An id that isn't there gives no list; rows without an id can't be asked for."""
    dictionary = bytes(spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").head()["dictionary"])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    out = []
    for row in blocks.orderBy("part", "part_tokens_before").toLocalIterator():
        block = row.asDict()
        opener, frame_at = _open(block, dictionary), np.frombuffer(block["frame_at"], "<u8")
        docs, has = np.frombuffer(block["doc_ids"], "<i8"), np.frombuffer(block["has_id"], "u1")
        for i in np.flatnonzero((docs == doc_id) & (has == 1)):
            out.append(np.frombuffer(opener.decompress(bytes(block["payload"][frame_at[i] : frame_at[i + 1]])), f"<u{block['width']}").tolist())
    return out


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None) -> DataFrame:
    """Write the store and read it back (see ``write_store``)."""
    path = path or scratch_path(docs.sparkSession, "token-store")
    return read_store(docs.sparkSession, write_store(docs, path, tokenizer_path, id_col, text_col, order))
