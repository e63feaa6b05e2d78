"""Removal of repeated passages: every byte covered by a string of ``WIDTH`` bytes that also starts earlier.

Suffix arrays are built over the places that may repeat, not over whole texts:

1. Every start of a WIDTH-byte string is named by the least hash among its ``GRAM``-byte grams (the leftmost such gram), so equal
   strings have the same name. Runs of starts with one gram make a context: the bytes from the first start to WIDTH
   past the last. A name found once in the corpus has no repeats.
2. Contexts of repeated names go to the shard of their name. Contexts with the same bytes (found by hash, then compared) travel as
   one, with a list of the places where they stand.
3. A shard's contexts are cut into blocks in document order. Each block gets a suffix array by Larsson-Sadakane refinement
   and Kasai's common prefixes; suffixes that share WIDTH bytes form a class. All places of a class but the first are repeats.
   Classes of later blocks are looked up among those of earlier ones by binary search.
4. A name with more than ``HOT`` places is dealt to several shards; their sorted classes are merged by binary search.

The repeats then meet their texts again. Hashes only choose what is compared: bytes decide about every repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import _BYTE_CODE, _powers, batches_of, materialize, mix64, span_hashes, text_bytes, text_rows

WIDTH, GRAM = 100, 32
#: Rows and bytes of text that a bucket holds on average, at most.
BUCKET_ROWS, BUCKET_BYTES = 4000, 12 << 20
#: Bytes that are named at once, bytes of a block with a suffix array of its own, places of a name in one shard.
PIECE, BLOCK, HOT = 1 << 20, 4 << 20, 50_000
#: Shards for each bucket.
SHARDS = 8
#: Bytes of text whose names are counted together before they meet the others.
COUNTED = 16 << 20
#: Where a context stands: document, first start, row in its bucket, and an order of documents with the same id.
PLACE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("row", "<i4"), ("sub", "<u2")])
#: Hot names whose list is sent to all executors; beyond it the list is joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Starts that Kasai's rule carries its bound along before it is found afresh.
KASAI_RUN = 32
#: Bits of a gram's place in a piece; the other bits of its hash decide which gram is least.
PLACE_BITS = np.uint64(24)


def bucket_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, int]:
    """The bucket of each row, by a hash of id and text (rows with the same id and text share one), and the number of buckets."""
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).head()
    buckets = max(1, math.ceil(size["rows"] / BUCKET_ROWS), math.ceil(size["bytes"] / BUCKET_BYTES))
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(buckets)), buckets


def packed_texts(docs: DataFrame, bucket: Column, id_col: str, text_col: str) -> DataFrame:
    """(bucket, doc_id, text): the texts, compressed."""
    rows = text_rows(docs, bucket.alias("bucket"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches_of(batches, "text"):
            text = pa.array([press.compress((t.as_py() or "").encode()) for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("doc_id"), text], ["bucket", "doc_id", "text"])

    return rows.mapInArrow(pack, "bucket long, doc_id long, text binary")


def contexts_in(texts: list[bytes], size: int):
    """Batches of (row, first start, starts, name, place of the gram, hash of the context) over texts of ``size`` bytes in all."""
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= size):
            total += len(texts[hi])
            hi += 1
        raw = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])])
        for begin in range(0, max(len(raw) - WIDTH + 1, 0), 8 * size):  # one very long text goes in overlapping pieces
            row, start, n, name, gram, ctx = contexts_of(raw[begin : begin + 8 * size + WIDTH - 1], np.clip(at - begin, 0, None))
            yield lo + row, start + begin - at[row], n, name, gram, ctx
        lo = hi


def binary_array(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values that stand end to end."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


class Bucket:
    """The texts of a bucket in document order; ``sub`` orders rows of one id by a hash of their text, in every bucket alike."""

    def __init__(self, rows: pa.Table) -> None:
        opener = zstandard.ZstdDecompressor()
        texts = [opener.decompress(t.as_py()) for t in rows.column("text").combine_chunks()]
        ids = rows.column("doc_id").to_pylist()
        name = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") >> 21 for t in texts]
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, name[i]))
        self.texts, self.ids = [texts[i] for i in order], [ids[i] for i in order]
        self.key = np.array([np.iinfo(np.int64).min if i is None else i for i in self.ids], np.int64)
        self.sub = np.array([name[i] >> 27 for i in order], np.uint16)


def contexts_of(raw: np.ndarray, row_at: np.ndarray):
    """Contexts of concatenated texts; starts are offsets into ``raw``. See ``contexts_in``."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < WIDTH:
        return empty, empty, empty, empty.astype(np.uint64), empty, empty.astype(np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[:n], out=sums[1:])
    gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = gram >> PLACE_BITS << PLACE_BITS | np.arange(len(gram), dtype=np.uint64)
    span, window = 1, WIDTH - GRAM + 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)  # of every start 0 .. n - WIDTH
    stop = np.clip(row_at, 0, n)
    inside = np.ones(len(at), bool)
    for cut in stop[1:-1].tolist():
        inside[max(cut - WIDTH + 1, 0) : cut] = False
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    start = np.flatnonzero(inside & change)
    tail = np.ones(len(at), bool)
    tail[:-1] = (at[1:] != at[:-1]) | ~inside[1:]
    last = np.flatnonzero(inside & tail)
    row = np.searchsorted(row_at, start, "right") - 1
    whole = mix64((sums[last + WIDTH] - sums[start]) * down[start] + (last - start).astype(np.uint64))
    return row, start, last - start + 1, gram[at[start]], at[start] - start, whole


def _names(batches):
    """(name, bucket, n, first): how many contexts of each name the texts have, by bucket, in parts of ``COUNTED`` bytes of text.

    The first row of a name in a part carries the part's count; a row that isn't the first is of a name found twice.
    """

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        name, bucket = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.uint64, np.int64), zip(*parts) if parts else ((), ())))
        order = np.lexsort((bucket, name))
        name, bucket = name[order], bucket[order]
        first, new = np.ones(len(name), bool), np.ones(len(name), bool)
        first[1:] = name[1:] != name[:-1]
        new[1:] = first[1:] | (bucket[1:] != bucket[:-1])
        head = np.flatnonzero(first)
        n = np.zeros(len(name), np.int64)
        n[head] = np.diff(np.append(head, len(name)))
        return pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), pa.array(bucket[new]), pa.array(n[new]), pa.array(first[new])], ["name", "bucket", "n", "first"])

    parts, size = [], 0
    for b in batches_of(batches, "text", 8 << 20):
        raw, at = text_bytes(b.column("text"))
        bucket = b.column("bucket").to_numpy()
        parts += [(name, bucket[row]) for row, _, _, name, _, _ in contexts_in([raw[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())], PIECE)]
        size += len(raw)
        if size >= COUNTED:
            yield counted(parts)
            parts, size = [], 0
    yield counted(parts)


def repeated_names(docs: DataFrame, bucket: Column, text_col: str, hot: int) -> DataFrame:
    """(bucket, name, salts): the names of each bucket's contexts that are found more than once in the corpus, and the number of
    shards that each is dealt to.

    A name meets itself once for each ``COUNTED`` bytes of text; its other rows are known to repeat and are dealt by bucket.
    """
    rows = text_rows(docs, bucket.alias("bucket"), F.col(text_col).alias("text")).mapInArrow(_names, "name long, bucket long, n long, first boolean")
    dealt = rows.withColumn("apart", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("bucket")))
    counted = dealt.withColumn("found", F.sum("n").over(Window.partitionBy("name", "apart")))
    needed = materialize(counted.where("found > 1 or not first").select("bucket", "name", "n"), "names")
    many = materialize(needed.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("name", F.ceil(F.col("n") / hot).alias("salts")), "hot-names")
    listed = F.broadcast(many) if many.count() <= MOST_BROADCAST else many
    return needed.join(listed, "name", "left").select("bucket", "name", F.coalesce("salts", F.lit(1)).alias("salts"))


CONTEXTS = "name long, salts long, bucket long, n int, ctx binary, places binary"


def same_bytes(ident: np.ndarray, size: np.ndarray, piece) -> np.ndarray:
    """For every context the first one with its bytes: those of equal hash are compared. ``piece(i)`` gives the bytes."""
    order = np.argsort(ident, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = ident[order][1:] != ident[order][:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    kept, seen = None, -1
    for i in order[~head].tolist():
        if first[i] != seen:
            seen = int(first[i])
            kept = piece(seen)
        if size[i] != size[seen] or piece(i) != kept:
            first[i] = i  # hashes alike by chance: it goes by itself
    return first


def _repeated_contexts(rows: pa.Table, names: pa.Table) -> pa.Table:
    """Contexts of a bucket whose names repeat: a row for each different one, with the places where it stands."""
    b = Bucket(rows)
    keys = names.column("name").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, salts = keys[order], names.column("salts").to_numpy()[order]
    parts = []
    for row, start, n, name, gram, ctx in contexts_in(b.texts, PIECE):
        at = np.minimum(np.searchsorted(keys, name), max(len(keys) - 1, 0))
        hit = np.flatnonzero(keys[at] == name) if len(keys) else np.zeros(0, np.int64)
        parts.append((row[hit], start[hit], n[hit], name[hit], gram[hit], ctx[hit], salts[at[hit]] if len(keys) else np.zeros(0, np.int64)))
    if not parts:
        parts = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.uint64, np.int64))]
    row, start, n, name, gram, ctx, salts = (np.concatenate(x) for x in zip(*parts))
    rows_of, starts, sizes = row.tolist(), start.tolist(), (n + WIDTH - 1).tolist()
    piece = lambda i: b.texts[rows_of[i]][starts[i] : starts[i] + sizes[i]]
    first = same_bytes(ctx, n, piece)
    order = np.argsort(first, kind="stable")  # places of a context in document order, as the rows are
    head = np.flatnonzero(np.concatenate([[True], first[order][1:] != first[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    one = first[order][head]
    places = np.empty(len(order), PLACE)
    places["doc"], places["start"], places["row"], places["sub"] = b.key[row[order]], start[order], row[order], b.sub[row[order]]
    bucket = rows.column("bucket")[0].as_py() if rows.num_rows else 0
    data = np.frombuffer(b"".join([piece(i) for i in one.tolist()]), np.uint8)
    return pa.table({
        "name": name[one].view(np.int64), "salts": salts[one], "bucket": np.full(len(one), bucket, np.int64), "n": n[one].astype(np.int32),
        "ctx": binary_array(data, np.concatenate([[0], np.cumsum(n[one] + WIDTH - 1)])), "places": binary_array(places.view(np.uint8) if len(places) else np.zeros(0, np.uint8), np.append(head, len(order)) * PLACE.itemsize)})


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of ``x`` in order: Larsson-Sadakane refinement.

    Sorted by 8 bytes first; then groups that aren't sorted yet are refined by the rank of the suffix h further on, h doubling.
    The order is full, as Kasai's rule needs it.
    """
    n = len(x)
    padded = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    sa = np.argsort(key)
    key = key[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)  # one more: the end of the text ranks before all
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    h = 8
    while True:
        loose = ~head
        loose[:-1] |= ~head[1:]
        slot = np.flatnonzero(loose)
        if not len(slot):
            break
        pos = sa[slot]
        key = rank[pos] << 32 | rank[np.minimum(pos + h, n)]
        order = np.argsort(key)
        sa[slot], key = pos[order], key[order]
        split = np.ones(len(slot), bool)
        split[1:] = key[1:] != key[:-1]
        head[slot] = split
        rank[sa[slot]] = np.maximum.accumulate(np.where(split, slot, 0)) + 1
        h *= 2
    return sa


def common_prefixes(x: np.ndarray, sa: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the array, ``depth`` at most: Kasai's rule along the text.

    The prefix at text position i + 1 is at most one shorter than that at i, so only further bytes are compared. Runs of
    ``KASAI_RUN`` positions go side by side.
    """
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    runs = np.arange(0, n, KASAI_RUN)
    have = np.zeros(len(runs), np.int64)
    for step in range(KASAI_RUN):
        i = runs + step
        runs, have, i = runs[i < n], have[i < n], i[i < n]
        have = np.maximum(have - 1, 0)
        j = before[i]
        have[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (have < depth))
        while len(live):
            a, b = i[live] + have[live], j[live] + have[live]
            ok = (a < n) & (b < n)
            ok[ok] = x[a[ok]] == x[b[ok]]
            live = live[ok]
            have[live] += 1
            live = live[have[live] < depth]
        out[i] = have
    return out[sa]


def _first_of_class(x: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted start (ascending) the first start with the same WIDTH bytes, and the classes' first starts in string order."""
    sa = suffix_array(x)
    lcp = common_prefixes(x, sa)
    kind = np.cumsum(lcp < WIDTH)
    flag = np.zeros(len(x), bool)
    flag[wanted] = True
    keep = flag[sa]
    pos, kind = sa[keep], kind[keep]
    head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(pos, head) if len(head) else np.zeros(0, np.int64)
    first = np.zeros(len(x), np.int64)
    first[pos] = np.repeat(least, np.diff(np.append(head, len(pos))))
    return first[wanted], least


def _strings(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The WIDTH bytes from each start as one sortable value each."""
    rows = np.ones((len(starts), WIDTH + 1), np.uint8)  # a last byte that isn't zero keeps trailing zeros
    rows[:, :WIDTH] = x[starts[:, None] + np.arange(WIDTH)]
    return rows.view(f"S{WIDTH + 1}").ravel()


def repeated_starts(ctx: list[bytes], starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For contexts in document order, with ``starts`` strings each: which starts, one after the other, have an equal string at an
    earlier start."""
    size = np.array([len(c) for c in ctx], np.int64)
    seen: list[np.ndarray] = []  # sorted class strings of the blocks so far
    out, lo = [np.zeros(0, bool)], 0
    while lo < len(ctx):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), block, "right")) + lo)
        x = np.frombuffer(b"".join(ctx[lo:hi]), np.uint8)
        at = np.cumsum(size[lo:hi]) - size[lo:hi]
        n = starts[lo:hi]
        wanted = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first, least = _first_of_class(x, wanted)
        again = first != wanted
        if hi < len(ctx) or seen:
            mine = _strings(x, least)
            old = np.zeros(len(x), bool)
            for past in seen:
                hit = np.minimum(np.searchsorted(past, mine), len(past) - 1)
                old[least[past[hit] == mine]] = True
            again |= old[first]
            seen.append(mine)
        out.append(again)
        lo = hi
    return np.concatenate(out)


REPEATS = "bucket long, doc long, sub int, row int, start int, n int, shard long, at long, text binary"


def _shard_repeats(rows: pa.Table) -> pa.Table:
    """Repeated starts of a shard as runs. Classes of names that are dealt to several shards also come back: their first place
    and their string (``text``), in string order (``at``), for the merge."""
    bucket, n, salts = rows.column("bucket").to_numpy(), rows.column("n").to_numpy().astype(np.int64), rows.column("salts").to_numpy()
    raw, at = text_bytes(rows.column("ctx"))
    whole, cut = raw.tobytes(), at.tolist()
    data = lambda i: whole[cut[i] : cut[i + 1]]
    first = same_bytes(span_hashes(raw, at[:-1], at[1:]), n, data)
    places, each = text_bytes(rows.column("places"))
    of = np.repeat(np.arange(rows.num_rows), np.diff(each) // PLACE.itemsize)
    places = np.frombuffer(places.tobytes(), PLACE)
    # all places in document order; the first of each context stands for it
    order = np.lexsort((places["start"], places["row"], bucket[of], places["sub"], places["doc"]))
    of, places = of[order], places[order]
    _, lead = np.unique(first[of], return_index=True)
    lead = np.sort(lead)
    copy = np.ones(len(of), bool)
    copy[lead] = False
    starts = n[of[lead]]
    again = repeated_starts([data(k) for k in of[lead].tolist()], starts)
    base = np.cumsum(starts) - starts
    inner = np.ones(len(again) + 1, bool)  # whether a start belongs to the same context as the one before it
    inner[base], inner[-1] = False, False
    opens, closes = again.copy(), again.copy()
    opens[1:] &= ~(again[:-1] & inner[1:-1])
    closes[:-1] &= ~(again[1:] & inner[1:-1])
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
    run = np.searchsorted(base, opens, "right") - 1
    alone = np.flatnonzero(~again & np.repeat(salts[of[lead]] > 1, starts))
    mine = np.searchsorted(base, alone, "right") - 1
    heads = sorted((data(of[lead[c]])[k : k + WIDTH], c, k) for c, k in zip(mine.tolist(), (alone - base[mine]).tolist()))
    head_place, head_off = lead[np.array([c for _, c, _ in heads], np.int64)], np.array([k for _, _, k in heads], np.int64)
    i = np.concatenate([np.flatnonzero(copy), lead[run], head_place])
    off = np.concatenate([np.zeros(int(copy.sum()), np.int64), opens - base[run], head_off])
    length = np.concatenate([n[of[copy]], closes - opens + 1, np.ones(len(heads), np.int64)])
    runs = len(i) - len(heads)
    shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
    return pa.table({
        "bucket": bucket[of[i]], "doc": places["doc"][i], "sub": places["sub"][i].astype(np.int32), "row": places["row"][i], "start": (places["start"][i] + off).astype(np.int32), "n": length.astype(np.int32),
        "shard": np.full(len(i), shard, np.int64), "at": np.arange(len(i)) - runs, "text": pa.array([None] * runs + [t for t, _, _ in heads], pa.binary())})


def _merged_classes(rows: pa.Table) -> pa.Table:
    """First places of the same classes in several shards -> all but the earliest: each shard's sorted strings are looked up by
    binary search among those of the shards before it."""
    rows = rows.sort_by([("shard", "ascending"), ("at", "ascending")])
    text = np.frombuffer(text_bytes(rows.column("text"))[0].tobytes(), f"S{WIDTH}") if rows.num_rows else np.zeros(0, f"S{WIDTH}")
    shard = rows.column("shard").to_numpy()
    key = [rows.column(c).to_numpy() for c in ("doc", "sub", "bucket", "row", "start")]
    rank = np.empty(len(shard), np.int64)
    rank[np.lexsort(key[::-1])] = np.arange(len(shard))
    gone = np.zeros(len(shard), bool)
    known, least = text[:0], np.zeros(0, np.int64)  # sorted strings so far, and the row of the earliest place of each
    for mine in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
        at = np.searchsorted(known, text[mine])
        hit = np.zeros(len(mine), bool)
        inside = at < len(known)
        hit[inside] = known[at[inside]] == text[mine[inside]]
        old, new = least[at[hit]], mine[hit]
        later = rank[new] > rank[old]
        gone[np.where(later, new, old)] = True
        least[at[hit]] = np.where(later, old, new)
        known = np.insert(known, at[~hit], text[mine[~hit]])
        least = np.insert(least, at[~hit], mine[~hit])
    return rows.filter(pa.array(gone)).select(["bucket", "row", "start", "n"])


def _removed(rows: pa.Table, repeats: pa.Table) -> pa.Table:
    """Texts of a bucket without the bytes that repeats cover."""
    b = Bucket(rows)
    size = np.array([len(t) for t in b.texts], np.int64)
    base = np.cumsum(size) - size
    row, start, n = (repeats.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "n"))
    lo, hi = base[row] + start, base[row] + start + n + WIDTH - 1
    order = np.argsort(lo, kind="stable")
    row, lo, hi = row[order], lo[order], hi[order]
    # runs that meet are one, but for the end of a text
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    row, lo, hi = row[head], lo[head], np.maximum.reduceat(hi, head) if len(head) else hi
    spans, removed = (np.bincount(row, w, len(size)).astype(np.int64) for w in (None, hi - lo))
    kept: list[list[bytes]] = [[] for _ in b.texts]
    done = [0] * len(b.texts)
    for r, a, z in zip(row.tolist(), (lo - base[row]).tolist(), (hi - base[row]).tolist()):
        kept[r].append(b.texts[r][done[r] : a])
        done[r] = z
    kept = [b"".join([*k, t[d:]]) for k, t, d in zip(kept, b.texts, done)]
    return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": size, "n_removed": removed, "n_spans": spans,
                     "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document row; ``kept`` are the remaining bytes.

    Earlier means a smaller id, or the same document and an earlier start. Null ids come before all others; rows of one id
    are documents of their own, ordered by a hash of their text. Null text counts as empty; texts shorter than WIDTH bytes keep
    everything. An empty table gives no rows.
    """
    bucket, buckets = bucket_of(docs, id_col, text_col)
    packed = packed_texts(docs, bucket, id_col, text_col)
    names = repeated_names(docs, bucket, text_col, hot)
    contexts = packed.groupBy("bucket").cogroup(names.groupBy("bucket")).applyInArrow(_repeated_contexts, CONTEXTS)
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("bucket"), "salts")).otherwise(F.lit(0))
    dealt = contexts.withColumn("shard", F.pmod(F.xxhash64("name", salt), F.lit(SHARDS * buckets)))
    found = materialize(dealt.drop("name").groupBy("shard").applyInArrow(_shard_repeats, REPEATS), "repeats")
    place = ["bucket", "row", "start", "n"]
    split = found.where("text is not null").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(SHARDS * buckets)))
    later = split.groupBy("part").applyInArrow(_merged_classes, "bucket long, row int, start int, n int")
    repeats = found.where("text is null").select(*place).unionByName(later)
    return packed.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
