"""Jaccard join, decontamination and repeated passages against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from rows import SF, documents, edge_rows
from plain import component_ids, held_items, without_repeats
from pyspark.sql import functions as F

from seqlattice.llm import decontamination, jaccard_join, queries, suffix_dedup


def key(v):
    return (v is not None, v)


def compared(rows, got):
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=lambda x: tuple(map(key, x))) == sorted(rows, key=lambda x: tuple(map(key, x)))


@pytest.mark.parametrize("block", [2000, 2])
def test_components_of_edge_rows(spark, edge, block):
    rows = edge_rows()
    got = jaccard_join.similar_components(edge, 4, 85, block).collect()
    compared(list(zip([r[0] for r in rows], component_ids(rows, 4, 85))), got)
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (5, 6, 7, 8)} == {5: 0, 6: 0, 7: 0, 8: 1}


def near_copies():
    """Chains and bunches of near copies around a shared passage, so that blocks have to meet."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for _ in range(5):
        base = [word() for _ in range(40)] + passage
        for step in range(12):
            i += 1
            rows.append((i, " ".join(base)))
            base = list(base)
            base[(step * 7) % 40] = word()
    return rows


@pytest.mark.parametrize("block", [2000, 4])
def test_components_of_chains(spark, block):
    rows = near_copies()
    compared(list(zip([r[0] for r in rows], component_ids(rows, 4, 85))), jaccard_join.similar_components(documents(spark, rows), 4, 85, block).collect())


def test_components_of_documents(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    compared(list(zip([r[0] for r in rows], component_ids(rows, 5, 80))), jaccard_join.similar_components(small, 5, 80).collect())


def test_keep_first(edge, nothing):
    kept = jaccard_join.keep_first(edge, 5, 80)
    assert kept.columns == edge.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {1, 4, 5, 6, 7, 8, None} <= ids and not {2, 3, 9} & ids
    assert jaccard_join.keep_first(nothing, 5, 80).count() == 0
    assert jaccard_join.similar_components(nothing).count() == 0


@pytest.mark.parametrize("percent", [0, 49, 101])
def test_percents_that_would_lose_links(edge, percent):
    with pytest.raises(ValueError, match="from 50 to 100"):
        jaccard_join.similar_components(edge, 4, percent)


def test_tree_and_bitmaps_agree_with_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy() if rng.random() < 0.7 else rng.integers(0, 2**63, 60, dtype=np.uint64)
        s[rng.integers(0, 60, rng.integers(0, 14))] = rng.integers(0, 2**63)
        sets.append(np.unique(s[: rng.integers(48, 61)]))
    size = np.array([len(s) for s in sets])
    tree = jaccard_join.tree_links(size, [s.astype("<u8").tobytes() for s in sets], jaccard_join.Components(40), 85)
    maybe = jaccard_join.possible_links(size, [jaccard_join.parity_bitmap(s) for s in sets], jaccard_join.Components(40), 85)
    want = jaccard_join.Components(40)
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (size[i] + size[j] - both):
                want.join(i, j)
                assert maybe.find(i) == maybe.find(j)
    assert [tree.find(i) for i in range(40)] == [want.find(i) for i in range(40)]


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_items_in_documents(spark, edge, nothing, block):
    items = [(1, edge_rows()[16][1]), (2, "two words"), (3, None), (4, ""), (5, "not there at all in any"), (6, "one two three four five")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("shingles", F.lit("?"))
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontamination.contained_items(edge, table, block_shingles=block).collect())
    assert got == sorted((str(r[0]), i) for r in edge_rows() for i in held_items(r[1], items))
    clean = decontamination.drop_contaminated(edge, table, block_shingles=block)
    assert clean.columns == edge.columns and clean.count() == sum(not held_items(r[1], items) for r in edge_rows())
    assert decontamination.contained_items(nothing, table).count() == 0
    assert decontamination.contained_items(edge, table.limit(0)).count() == 0
    assert decontamination.drop_contaminated(edge, table.limit(0)).count() == edge.count()


def test_partly_held_items(spark):
    item = [f"t{i}" for i in range(40)]
    docs = []
    for cut in range(0, 20):
        docs.append((cut, " ".join(["pre"] * 9 + item[cut:] + ["post"] * 9)))
    got = {r["doc_id"] for r in decontamination.contained_items(documents(spark, docs), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {d for d, t in docs if held_items(t, [(1, " ".join(item))])} and 0 < len(got) < 20


def repeats_match(rows, got):
    # rows of one id go by a hash of their text: compare such ids as bags
    plain = dict(zip(range(len(rows)), without_repeats([r[1] for r in rows])))
    want = sorted((str(r[0]), *plain[i][:3]) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == want


def in_order(rows):
    import hashlib

    name = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little") >> 21
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, name(r[1])))


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_of_edge_rows(edge, nothing, hot):
    repeats_match(in_order(edge_rows()), suffix_dedup.remove_repeats(edge, hot=hot).collect())
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_of_documents(small, spark):
    rows = sorted((r["doc_id"], r["text"]) for r in small.collect())
    got = {r["doc_id"]: r for r in queries.op9_suffix_dedup(spark, SF).collect()}
    import hashlib

    for (i, _), (n, removed, spans, kept) in zip(rows, without_repeats([t for _, t in rows])):
        assert tuple(got[i])[1:] == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for text in (rng.integers(97, 100, 400).astype(np.uint8), np.frombuffer(b"abab" * 90, np.uint8), np.frombuffer(b"\0" * 130 + b"a", np.uint8)):
        raw = text.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == want
        lcp = suffix_dedup.common_prefixes(text, sa)
        for k in range(1, len(sa)):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, suffix_dedup.WIDTH)


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_blocks_meet_by_binary_search(block):
    rng = np.random.default_rng(4)
    passage = bytes(rng.integers(97, 123, 160).astype(np.uint8))
    ctx = [bytes(rng.integers(97, 123, 20).astype(np.uint8)) + passage for _ in range(5)]
    starts = np.array([len(c) - 99 for c in ctx])
    got = np.split(suffix_dedup.repeated_starts(ctx, starts, block), np.cumsum(starts)[:-1])
    seen = set()
    for c, n, flags in zip(ctx, starts, got):
        want = []
        for s in range(n):
            want.append(c[s : s + 100] in seen)
            seen.add(c[s : s + 100])
        assert flags.tolist() == want


def one_bucket(texts):
    import zstandard

    press = zstandard.ZstdCompressor()
    return pa.table({"bucket": pa.array([0] * len(texts), pa.int64()), "doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([press.compress(t) for t in texts], pa.binary())})


def test_suffix_arrays_decide_every_repeat(monkeypatch):
    texts = [(r[1] or "").encode() for r in edge_rows()] * 2
    names = {n for _, _, _, name, _, _ in suffix_dedup.contexts_in(texts, 1000) for n in name.tolist()}
    known = pa.table({"name": pa.array(np.array(sorted(names), np.uint64).view(np.int64)), "salts": pa.array([1] * len(names), pa.int64())})
    contexts = suffix_dedup._repeated_contexts(one_bucket(texts), known).append_column("shard", pa.array([0] * suffix_dedup._repeated_contexts(one_bucket(texts), known).num_rows, pa.int64()))
    seen, plain = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda x: seen.append(x.tobytes()) or plain(x))
    runs = suffix_dedup._shard_repeats(contexts).to_pylist()
    starts = {(r["doc"], s) for r in runs for s in range(r["start"], r["start"] + r["n"])}
    want, before = set(), set()
    for doc, t in enumerate(texts):
        for s in range(len(t) - 99):
            if t[s : s + 100] in before:
                want.add((doc, s))
            before.add(t[s : s + 100])
    assert starts == want and sum(r["n"] for r in runs) == len(want) > 1000
    assert all(any(texts[d][s : s + 100] in x for x in seen) for d, s in starts)


def test_equal_hashes_of_other_bytes_go_by_themselves():
    data = [b"aa", b"bb", b"aa", b"aaa", b"cc", b"cc"]
    got = suffix_dedup.same_bytes(np.array([7, 7, 7, 7, 1, 1]), np.array([2, 2, 2, 3, 2, 2]), data.__getitem__)
    assert got.tolist() == [0, 1, 0, 3, 4, 4]


def test_classes_of_shards_merge():
    rng = np.random.default_rng(6)
    pool = sorted({bytes(rng.integers(0, 3, 100).astype(np.uint8)) for _ in range(30)} | {b"\0" * 100, b"a" * 99 + b"\0"})
    rows = []
    for shard in (5, 2, 9):
        mine = sorted(pool[i] for i in rng.choice(len(pool), 18, replace=False))
        rows += [{"bucket": 0, "doc": int(d), "sub": 0, "row": int(d), "start": 0, "n": 1, "shard": shard, "at": k, "text": t} for k, (t, d) in enumerate(zip(mine, rng.integers(0, 1 << 40, 18)))]
    first = {}
    for r in rows:
        first[r["text"]] = min(first.get(r["text"], r["doc"]), r["doc"])
    got = suffix_dedup._merged_classes(pa.Table.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("bucket", "doc", "sub", "row", "start", "n", "shard", "at")] + [("text", pa.binary())])))
    assert sorted(got.column("row").to_pylist()) == sorted(r["doc"] for r in rows if r["doc"] != first[r["text"]])
