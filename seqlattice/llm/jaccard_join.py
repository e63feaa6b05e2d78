"""N-gram Jaccard join: components of documents whose shingle sets are similar, by prefix filtering and a prefix-tree join.

All sets follow one global order: shingles that are common in the corpus last (levels from a counting pass over all
documents), else by hash. Steps, none of which lists the pairs of a group:

1. Equal sets become one node. Each node keeps an extended prefix of its ordered set: similar sets share at least
   ``extra`` shingles of these prefixes, so a node with fewer shared ones links with nothing.
2. Prefix shingles with the same nodes form one bucket. In a bucket, parity bitmaps (whose difference never exceeds the
   sets') tell which sets can't be similar; a spanning forest of the rest goes on. Its components are candidate groups.
3. In a group the ordered sets form a prefix tree. Each set walks it with the overlap so far, shared by all sets below a
   branch, leaves out branches that the remaining lengths rule out, and those already in its component.

Buckets and groups larger than ``BLOCK`` are worked in blocks: within each, then one set for each component found, and only
where several components are left, block against block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import batches_of, lower_ascii, materialize, mix64, shingle_hashes, span_hashes, text_bytes, text_rows, word_spans

SHINGLE, PERCENT = 4, 85
#: Counters of the frequency pass: a shingle's level is the power of two by which its counter exceeds twice the mean.
COUNTERS = 1 << 16
BLOCK = 2000
EXTRA_PERCENT = 5


def document_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    raw, at = text_bytes(texts)
    raw = lower_ascii(raw)
    starts, ends, word_at = word_spans(raw, at)
    h, cut = shingle_hashes(span_hashes(raw, starts, ends), word_at, n)
    return [np.unique(h[a:z]) for a, z in zip(cut[:-1], cut[1:])]


def shingle_levels(docs: DataFrame, n: int, id_col: str, text_col: str) -> np.ndarray:
    """Level of every counter: 0 for usual shingles, higher for ones found in many documents. Counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches_of(batches, "text", 2 << 20):
            slots = np.concatenate(document_sets(b.column("text"), n)) >> np.uint64(48)
            total += np.bincount(slots.astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_pydict({"counter": pa.array(np.arange(COUNTERS)), "n": pa.array(total)})

    rows = text_rows(docs, F.col(text_col).alias("text")).mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(COUNTERS)
    total[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return np.maximum(np.floor(np.log2(np.maximum(total, 1) / max(2 * total.mean(), 1))) + 1, 0).astype(np.uint8)


def global_order(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order, as integers that compare in it: level in the top bits, then a mixed hash."""
    level = levels[(s >> np.uint64(48)).astype(np.int64)].astype(np.uint64)
    return np.sort(level << np.uint64(58) | mix64(s) >> np.uint64(6))


def need(a, b, percent: int):
    """Least intersection at which sets of sizes a and b are similar."""
    return -(-percent * (np.asarray(a) + b) // (100 + percent))


def least_shared(n: int, percent: int) -> int:
    """The intersection with a similar set is at least this share of either set."""
    return -(-percent * n // 100)


def extra_shared(n: int) -> int:
    return max(1, n * EXTRA_PERCENT // 100)


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """(must, size): a set of n shingles shares with every similar one ``must`` shingles of both extended prefixes.

    At most n - least shingles aren't common, so the first e common ones stand in the first n - least + e; e is what both
    sets extend by, and the smallest similar set extends least.
    """
    least = least_shared(n, percent)
    return min(extra_shared(least), least), min(n, n - least + extra_shared(n))


def parity_bitmap(s: np.ndarray) -> bytes:
    """One bit for each shingle's slot, flipped by each shingle in it; as many slots as the next power of two of the size."""
    bits = bitmap_bits(len(s))
    slots = np.bincount((mix64(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(slots.astype(bool)).tobytes()


def bitmap_bits(n: int) -> int:
    return max(64, 1 << int(n - 1).bit_length()) if n else 64


class Components:
    """Union-find over row numbers; the smallest number names a component."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def possible_links(size: np.ndarray, payload: list[bytes], known: Components, percent: int) -> Components:
    """Components of the sets that their sizes and parity bitmaps don't keep apart."""
    root = np.array([known.find(i) for i in range(len(size))], np.int64)
    bits = np.array([len(p) * 8 for p in payload])
    members = {int(w): np.flatnonzero(bits == w) for w in np.unique(bits)}
    maps = {w: np.stack([np.frombuffer(payload[i], np.uint8) for i in m]) for w, m in members.items()}
    for i in range(len(size)):
        mine, w = np.frombuffer(payload[i], np.uint8), int(bits[i])
        later = members[w] > i
        wider = members.get(2 * w, np.zeros(0, np.int64))
        for cand, other in ((members[w][later], lambda ok: maps[w][later][ok]), (wider, lambda ok: np.bitwise_xor(maps[2 * w][ok][:, : len(mine)], maps[2 * w][ok][:, len(mine) :]))):
            least = need(size[i], size[cand], percent)
            ok = (root[cand] != root[i]) & (least <= np.minimum(size[i], size[cand]))
            if not ok.any():
                continue
            cand, least = cand[ok], least[ok]
            apart = np.bitwise_count(other(ok) ^ mine).sum(axis=1, dtype=np.int64)
            for old in np.unique(root[cand[apart <= size[i] + size[cand] - 2 * least]]):
                root[(root == old) | (root == root[i])] = min(old, root[i])
    known.up = root.tolist()
    return known


class Branch:
    """``joined``: so many of the first rows are known to be in one component; it only grows."""

    __slots__ = ("lo", "hi", "of", "kids", "leaves", "shortest", "longest", "rows", "joined")

    def __init__(self, of: int, lo: int, hi: int) -> None:
        self.of, self.lo, self.hi, self.kids, self.leaves, self.rows, self.joined = of, lo, hi, [], [], [], 0

    def within(self, known: Components, component: int) -> bool:
        """Whether all rows are in the component."""
        lead = known.find(self.rows[0])
        while self.joined < len(self.rows) and known.find(self.rows[self.joined]) == lead:
            self.joined += 1
        return lead == component and self.joined == len(self.rows)


def prefix_tree(sets: list[np.ndarray]) -> Branch:
    """The sets as a prefix tree; chains without a fork are one branch (shingles lo..hi of set ``of``)."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())

    def build(rows: list[int], lo: int) -> Branch:
        first, last = sets[rows[0]], sets[rows[-1]]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[lo:m] != last[lo:m])
        hi = lo + int(differ[0]) if len(differ) else m
        node = Branch(rows[0], lo, hi)
        node.rows = rows
        sizes = [len(sets[r]) for r in rows]
        node.shortest, node.longest = min(sizes), max(sizes)
        stack: list[int] = []
        for r in rows:
            if len(sets[r]) == hi:
                node.leaves.append(r)
            elif stack and sets[stack[0]][hi] != sets[r][hi]:
                node.kids.append((stack, hi))
                stack = [r]
            else:
                stack.append(r)
        if stack:
            node.kids.append((stack, hi))
        return node

    root = build(order, 0)
    todo = [root]
    while todo:
        node = todo.pop()
        node.kids = [build(rows, at) for rows, at in node.kids]
        todo += node.kids
    return root


def tree_links(size: np.ndarray, payload: list[bytes], known: Components, percent: int) -> Components:
    """Exact components: every set walks the prefix tree."""
    sets = [np.frombuffer(p, "<u8") for p in payload]
    root = prefix_tree(sets)
    for x, mine in enumerate(sets):
        n = len(mine)
        todo = [(root, 0)]
        while todo:
            node, shared = todo.pop()
            if need(n, node.shortest, percent) > n or need(n, node.longest, percent) > node.longest:
                continue
            if node.within(known, known.find(x)):
                continue
            part = sets[node.of][node.lo : node.hi]
            left = n
            if len(part):
                at = np.searchsorted(mine, part)
                shared += int((mine[np.minimum(at, n - 1)] == part).sum())
                left = n - int(np.searchsorted(mine, part[-1], "right"))
            for leaf in node.leaves:
                if leaf != x and shared >= need(n, len(sets[leaf]), percent):
                    known.join(x, leaf)
            for kid in node.kids:
                if shared + min(left, kid.longest - node.hi) >= need(n, kid.shortest, percent):
                    todo.append((kid, shared))
    return known


Linker = Callable[[np.ndarray, list, Components, int], Components]
LINKS = "grp long, salt long, a long, b long"


def _link_rows(linker: Linker, percent: int):
    """Rows (grp, salt, node, class, n, payload) of one block -> (grp, salt, a, b): the smallest-numbered node of b's component."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("node", "ascending")])
        node, kind = block.column("node").to_numpy(), block.column("class").to_numpy()
        known = Components(len(node))
        first: dict[int, int] = {}
        for i, k in enumerate(kind.tolist()):
            known.join(first.setdefault(k, i), i)
        known = linker(block.column("n").to_numpy(), [p.as_py() for p in block.column("payload")], known, percent)
        return pa.table({"grp": block.column("grp"), "salt": block.column("salt"), "a": pa.array(node[[known.find(i) for i in range(len(node))]]), "b": pa.array(node)})

    return run


def linked_in_groups(rows: DataFrame, linker: Linker, percent: int, block: int = BLOCK) -> DataFrame:
    """(grp, node, n, payload) -> (grp, a, b): edges that join each group's components, each set to itself included."""
    # only large groups need a number; as they aren't joined by a shuffle on grp, a group's blocks are dealt to several tasks
    large = materialize(rows.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1"), "large-groups")
    few = large.count() <= MOST_BROADCAST
    dealt = rows.join(F.broadcast(large) if few else large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt if few else dealt.repartition("grp", "salt")
    run = _link_rows(linker, percent)
    inside = materialize(dealt.withColumn("class", F.col("node")).select("grp", "salt", "node", "class", "n", "payload")
                         .groupBy("grp", "salt").applyInArrow(run, LINKS), "links")
    many = dealt.where("blocks > 1")
    if many.isEmpty():
        return inside.select("grp", "a", "b")
    labelled = many.join(inside.select("grp", F.col("b").alias("node"), F.col("a").alias("class")), ["grp", "node"])
    heads = labelled.where(F.col("node") == F.col("class")).select("grp", "node", "n", "payload")
    if heads.count() == labelled.count():  # no block joined anything: go on block against block
        joined = None
    else:
        joined = materialize(linked_in_groups(materialize(heads, "heads"), linker, percent, block), "head-links")
    edges = inside.select("grp", "a", "b")
    if joined is not None:
        edges = edges.unionByName(joined)
        renamed = components_in(joined)
        labelled = labelled.join(renamed, ["grp", "class"]).withColumn("class", F.col("new")).drop("new")
    open_groups = labelled.groupBy("grp").agg(F.count_distinct("class").alias("k")).where("k > 1").select("grp")
    rest = materialize(labelled.join(open_groups, "grp"), "open-groups")
    if rest.isEmpty():
        return edges
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("salt"))
    pairs = rest.withColumn("other", F.explode(others)).withColumn("salt", F.least("salt", "other") * F.col("blocks") + F.greatest("salt", "other"))
    across = pairs.select("grp", "salt", "node", "class", "n", "payload").groupBy("grp", "salt").applyInArrow(run, LINKS)
    return edges.unionByName(across.select("grp", "a", "b"))


def components_in(edges: DataFrame) -> DataFrame:
    """(grp, a, b) -> (grp, class, new): every group's nodes and the smallest node of their component."""
    node = lambda c: F.xxhash64("grp", c)
    names = edges.select("grp", F.col("b").alias("class"), node("b").alias("node"))
    roots = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    named = names.distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.withColumn("new", F.col("root")).select("grp", "class", "new").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of every connected component, by alternating star contractions."""
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialize(small, "edges")
        same = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
        pairs = after
        if after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head() == same:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each set, 0 for an empty one, and a second one that tells apart sets whose first names are alike by chance."""
    filled = [len(s) > 0 for s in sets]
    sums, others = (np.array([np.add.reduce(mix64(s + salt)) for s in sets], np.uint64) for salt in (np.uint64(0), np.uint64(0x2545F4914F6CDD1D)))
    tops = np.array([s[-1] if len(s) else 0 for s in sets], np.uint64)
    name = lambda total: np.where(filled, mix64(total + mix64(tops ^ np.uint64(0x9E3779B97F4A7C15))), np.uint64(0)).view(np.int64)
    return name(sums), name(others)


#: Nodes, or large groups, whose list is sent to all executors; beyond it they are found by a shuffled join.
MOST_BROADCAST = 1_000_000
PROFILE = "doc_id long, n long, node long, check long, prefix array<long>, bitmap binary, extra long"


def similar_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document row.

    Two documents link when 100 * shared >= percent * united distinct n-word shingles; component_id is the smallest doc_id
    that links reach. A text of 1 to n - 1 words is one shingle; null texts and ones without words have 0 shingles
    and are components by themselves. Rows with the same id are documents of their own in the same component if their
    sets link. A null id never names a component unless all of its documents have null ids. Empty tables give no rows.
    A percent under 50 is an error: bitmaps are compared with those of the same or twice the width only, and such sets may be further apart.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be from 50 to 100, not {percent}")
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs, n, id_col, text_col))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "text", 2 << 20):
            sets = document_sets(b.column("text"), n)
            sizes = [prefix_sizes(len(s), percent) if len(s) else (0, 0) for s in sets]
            ordered = [global_order(s, levels.value) for s in sets]
            nodes, checks = set_names(sets)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes), "check": pa.array(checks),
                "prefix": pa.array([o[:k].view(np.int64) for o, (_, k) in zip(ordered, sizes)], pa.list_(pa.int64())),
                "bitmap": pa.array([parity_bitmap(s) for s in sets], pa.binary()), "extra": pa.array([e for e, _ in sizes], pa.int64()),
            })

    texts = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = materialize(texts.mapInArrow(profile, PROFILE), "profiles")
    while True:
        filled = profiles.where("n > 0")
        by_node = materialize(filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bitmap").alias("payload"), F.first("extra").alias("extra"),
                                                         (F.min("check") != F.max("check")).alias("mixed")), "nodes")
        mixed = [r["node"] for r in by_node.where("mixed").select("node").collect()]  # a handful in 10^10 sets
        if not mixed:
            break
        profiles = materialize(profiles.withColumn("node", F.when(F.col("node").isin(mixed), F.col("node").bitwiseXOR(F.col("check"))).otherwise(F.col("node"))), "profiles")
    copies = materialize(filled.select("doc_id", "node").join(by_node.select("node", "first_id"), "node").where("doc_id <> first_id").select("doc_id", "node"), "copies")
    if copies.count() <= MOST_BROADCAST:  # equal sets need no postings of their own; with more of them they only cost room
        filled = filled.join(F.broadcast(copies), ["doc_id", "node"], "left_anti")
    postings = filled.select(F.explode("prefix").alias("token"), "node")
    shared = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    held = materialize(postings.join(shared, "token").distinct(), "postings")
    counts = held.groupBy("node").agg(F.count("*").alias("held"))
    alive = materialize(by_node.join(counts, "node").where("held >= extra").select("node", F.col("first_id").alias("doc_id"), "n", "payload"), "alive")
    living = alive.select("node")
    held = materialize(held.join(F.broadcast(living) if alive.count() <= MOST_BROADCAST else living, "node"), "alive-postings")
    # shingles with the same nodes are one bucket
    marks = held.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("k > 1")
    buckets = marks.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token")
    rows = held.join(buckets, "token").join(alive.select("node", "n", "payload"), "node").select(F.col("token").alias("grp"), "node", "n", "payload")
    groups = components(linked_in_groups(materialize(rows, "buckets"), possible_links, percent, block))
    groups = materialize(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "text", 2 << 20):
            plain = document_sets(b.column("text"), n)
            (name, check), node = set_names(plain), b.column("node").to_numpy()
            same = (name == node) | (name ^ check == node)  # an id may stand for several texts
            b, sets = b.filter(pa.array(same)), [global_order(s, levels.value) for s, ok in zip(plain, same) if ok]
            yield pa.RecordBatch.from_pydict({"grp": b.column("grp"), "node": b.column("node"), "n": pa.array([len(s) for s in sets], pa.int64()), "payload": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())})

    chosen = alive.select("node", "doc_id").join(groups, "node").select(F.col("doc_id").alias("want"), "node", F.col("root").alias("grp"))
    chosen = materialize(chosen, "chosen")
    wanted = F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("want"))).select("grp", "node", "text").mapInArrow(sets_of, "grp long, node long, n long, payload binary").dropDuplicates(["grp", "node"])
    links = components(linked_in_groups(materialize(found, "sets"), tree_links, percent, block))
    # sets first, then documents; tables that are written down, so that a join on a common root or set can be split
    rooted = by_node.select("node", "first_id").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    named = materialize(rooted.select("node", "root").join(smallest, "root").select("node", "component_id"), "components")
    found = profiles.select("doc_id", "n", "node").join(named, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document of each component: that with the smallest id.

    Rows of one id stay or go together; they stay if one of them is the first of its component. Rows without an id stay.
    """
    found = similar_components(docs, n, percent, id_col=id_col, text_col=text_col)
    verdict = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"))
    gone = materialize(verdict.where("not first").select(F.col("doc_id").alias("gone")), "duplicates")
    small = gone.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col] == gone["gone"], "left_anti")
