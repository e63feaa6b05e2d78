"""Scoring of texts by a hidden Markov language model, trained by Baum-Welch over all training documents.

Tokens are words and one end. Expected counts are gathered in the executors and added up by word hash or by code:

1. The model is found over codes, which every worker holds: the ``FREQUENT`` commonest words each have a code, the others share
   one with the words of a like ending. The documents are dealt to ``SLICES`` parts, and each of ``EPOCHS`` passes over all of
   them updates the model after every part (incremental expectation-maximisation: a part's counts replace those of its last visit).
2. A last pass counts, for every single word, how often each state emits it. In the final model every word has emissions of
   its own: (count + share of the state) / (the state's tokens + share * (words + 1)), the adding of one to each word that the
   base score does, dealt to the states. A word that wasn't seen has the base score's probability in every state.

All chains go in step, a step's tokens side by side. Long documents are worked in blocks, but as whole chains: products of the
steps of each block carry the states over its borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import batches_of, count_level, least_level, lower_ascii, materialize, mix64, return_memory, span_hashes, text_bytes, text_rows, word_spans

STATES, CLASSES = 8, 64
#: Words with a code of their own while the model is found, and words whose emissions every worker holds; those of the others
#: are joined to the documents that need them.
FREQUENT, HELD = 1 << 13, 1 << 17
SLICES, EPOCHS = 4, 2
#: Tokens that a block of a chain has, and that are worked at once.
BLOCK, TOKENS = 2048, 1 << 18
#: Expected counts are added up as whole multiples of 1 / UNIT, so that their sums don't depend on the order.
UNIT = 1 << 12
END = np.uint64(1)
#: Marks the code of a token whose word isn't held; the other bits are its class. Codes from WIDE on are written apart.
OTHER, WIDE = np.uint32(1 << 31), np.uint32(0xFFFF)
#: A word's shares of the states are kept as whole multiples of 1 / PARTS, PACKED in a long.
PARTS, PACKED = 65535, 4


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, row offsets) of the tokens of every text; each text ends with the end token."""
    raw, at = text_bytes(texts)
    raw = lower_ascii(raw)
    starts, ends, word_at = word_spans(raw, at)
    h = span_hashes(raw, starts, ends)
    last = raw[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    for back in (2, 3):
        last = (last << np.uint64(8)) | np.where(ends - back >= starts, raw[np.maximum(ends - back, 0)], 0).astype(np.uint64) if len(ends) else last
    kind = (mix64(last) % np.uint64(CLASSES)).astype(np.int32)
    rows = len(at) - 1
    stop = word_at[1:] + np.arange(1, rows + 1) - 1  # where the ends stand
    out, classes = np.empty(len(h) + rows, np.uint64), np.zeros(len(h) + rows, np.int32)
    inner = np.ones(len(out), bool)
    inner[stop] = False
    out[inner], classes[inner] = h, kind
    out[stop] = END
    return out, classes, np.concatenate([[0], stop + 1])


def distinct_words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, place of each token among them)."""
    coded = pa.array(h).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)


@dataclass
class Vocabulary:
    """``table`` (h, n, class): every training word. Of the held ones: ascending hashes and their places in the order of counts;
    in that order hashes, counts, and codes while the model is found."""

    table: DataFrame
    tokens: int  # N
    distinct: int  # V
    keys: np.ndarray
    places: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    frequent: int
    code_tokens: np.ndarray  # training tokens and words of each code
    code_words: np.ndarray

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash among the held words, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.places[at], self.keys[at] == h


def vocabulary(rows: DataFrame, frequent: int = FREQUENT, held: int = HELD) -> Vocabulary:
    """Counts of the words of all training rows (held_out, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        for b in batches_of(batches, "text", 4 << 20):
            h, kind, _ = word_hashes(b.column("text"))
            words, place = distinct_words(h)
            classes = np.zeros(len(words), np.int32)
            classes[place] = kind
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(place, minlength=len(words))), pa.array(classes)], ["h", "n", "class"])

    counted = rows.where("not held_out").select("text").mapInArrow(count, "h long, n long, class int")
    table = materialize(counted.groupBy("h").agg(F.sum("n").alias("n"), F.first("class").alias("class")), "vocabulary")
    # a few hundred rows: words and tokens of each class and count level
    steps = table.groupBy(count_level(F.col("n")).alias("level"), "class").agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    sizes: dict[int, int] = {}
    for r in steps:
        sizes[r["level"]] = sizes.get(r["level"], 0) + r["words"]
    own, near = least_level(sizes, frequent), least_level(sizes, held)
    got = table.where(count_level(F.col("n")) >= near).select("h", "n", "class", (count_level(F.col("n")) >= own).alias("own")).toArrow()  # at most ``held``
    keys, counts, kind, mine = (got.column(c).to_numpy() for c in ("h", "n", "class", "own"))
    keys = keys.view(np.uint64)
    order = np.lexsort((keys, -counts))
    keys, counts, kind, mine = keys[order], counts[order], kind[order], mine[order]
    n_own = int(mine.sum())  # they come first
    codes = n_own + kind.astype(np.int64)
    codes[:n_own] = np.arange(n_own)
    tokens, words = np.zeros(n_own + CLASSES), np.zeros(n_own + CLASSES)
    tokens[:n_own], words[:n_own] = counts[:n_own], 1
    for r in steps:
        if r["level"] < own:
            tokens[n_own + r["class"]] += r["tokens"]
            words[n_own + r["class"]] += r["words"]
    by_hash = np.argsort(keys)
    return Vocabulary(table, sum(r["tokens"] for r in steps), sum(r["words"] for r in steps), keys[by_hash], by_hash, keys, counts, codes, n_own, tokens, words)


def encoded(rows: DataFrame, vocab: Vocabulary, slices: int = SLICES) -> DataFrame:
    """(row, slice, doc_id, held_out, n_tokens, n_known, base_sum, codes, wide, others): each document's tokens as places among
    the held words, or OTHER and a class (see ``codes_of``); the hashes of the words that aren't held, in order; known tokens and
    summed log10(count + 1) of the held ones."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        vocab = shared.value
        for b in batches_of(batches, "text", 4 << 20):
            h, kind, at = word_hashes(b.column("text"))
            words, token = distinct_words(h)
            place, known = vocab.place(words)
            logs = np.zeros(len(words))
            logs[known] = np.log10(vocab.counts[place[known]] + 1.0)
            held = known[token]
            code = np.where(held, place[token].astype(np.uint32), OTHER | kind.astype(np.uint32))
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            lists = lambda mask, values: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(row[mask], minlength=b.num_rows))]).astype(np.int32), pa.array(values[mask]))
            raw = np.minimum(code, WIDE).astype("<u2").tobytes()
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": np.diff(at), "n_known": np.bincount(row[held], minlength=b.num_rows), "base_sum": np.bincount(row, logs[token], b.num_rows),
                "codes": pa.array([raw[2 * a : 2 * z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), "wide": lists(code >= WIDE, code.view(np.int32)), "others": lists(~held, h.view(np.int64)),
            })

    out = rows.mapInArrow(encode, "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, codes binary, wide array<int>, others array<long>")
    part = F.when(F.col("held_out"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(slices)).cast("int"))
    return materialize(out.withColumn("row", F.monotonically_increasing_id()).withColumn("slice", part), "encoded", by="slice", compression="zstd")


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (codes, K)


def smoothed(start: np.ndarray, move: np.ndarray, emits: np.ndarray, words: np.ndarray, distinct: int) -> Model:
    """The model of expected counts: one more for each start, move and word, the latter dealt to the states by their tokens."""
    share = emits.sum(axis=0)
    tokens = share.sum()
    share = share / tokens if tokens > 0 else np.full(len(start), 1 / len(start))
    emit = (emits + words[:, None] * share) / (share * (tokens + distinct + 1))
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(axis=1, keepdims=True), emit)


def first_model(vocab: Vocabulary, states: int = STATES) -> Model:
    """Unigram shares, shaken by a fixed hash of state and code so that the states can part."""
    n = len(vocab.code_tokens)
    share = (vocab.code_tokens + vocab.code_words) / (vocab.tokens + vocab.distinct + 1)
    noise = mix64(np.arange(n * states, dtype=np.uint64) + np.uint64(12345)).reshape(n, states) / 2.0**64
    emit = share[:, None] * (0.5 + noise)
    stay = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Model(np.full(states, 1 / states), stay, emit / np.maximum(emit.sum(axis=0), 1e-300))


def _in_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains by falling length, and how many of them are still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")


class Steps:
    """Chains in step: token t of every chain that is so long, side by side; ``order`` has the longest chains first, ``at`` the
    place of every step, ``live`` its number of tokens, ``tokens`` which token stands where."""

    def __init__(self, begin: np.ndarray, length: np.ndarray) -> None:
        self.order, self.live = _in_step(length)
        self.at = np.cumsum(self.live) - self.live
        length = length[self.order]
        row, step = np.repeat(np.arange(len(length)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        self.tokens = np.empty(len(row), np.int64)
        self.tokens[self.at[step] + row] = np.repeat(begin[self.order], length) + step

    def each(self):
        """(step, slice of its tokens, slice of the tokens before them)."""
        for t, (lo, n) in enumerate(zip(self.at.tolist(), self.live.tolist())):
            before = int(self.at[t - 1]) if t else 0
            yield t, slice(lo, lo + n), slice(before, before + n)


@dataclass
class Blocks:
    """Chains cut into blocks: chain and number in it of each; the states' distribution on entering a block (at the token before it),
    and their weights on leaving it (what the tokens behind it say)."""

    steps: Steps
    chain: np.ndarray
    number: np.ndarray
    enter: np.ndarray
    leave: np.ndarray


def blocks_of(pot_of, starts: np.ndarray, lengths: np.ndarray, model: Model, kind, size: int = BLOCK) -> Blocks:
    """``pot_of(tokens)`` gives the tokens' emissions in each state."""
    each = -(-lengths // size)
    chain = np.repeat(np.arange(len(lengths)), each)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(each) - each, each)
    begin, length = starts[chain] + number * size, np.minimum(lengths[chain] - number * size, size)
    k = len(model.start)
    enter, leave = np.zeros((len(chain), k), kind), np.ones((len(chain), k), kind)
    several = np.flatnonzero(each[chain] > 1)
    if len(several):
        whole = np.zeros((len(chain), k, k), kind)
        whole[several] = _products(pot_of, begin[several], length[several], number[several] == 0, model, kind)
        for step in range(1, int(each.max())):
            i = np.flatnonzero(number == step)
            v = whole[i - 1, 0] if step == 1 else np.einsum("bi,bij->bj", enter[i - 1], whole[i - 1])
            enter[i] = v / v.sum(axis=1, keepdims=True)
        for step in range(int(each.max()) - 2, -1, -1):
            i = np.flatnonzero((number == step) & (each[chain] > step + 1))
            v = np.einsum("bij,bj->bi", whole[i + 1], leave[i + 1])
            leave[i] = v / v.sum(axis=1, keepdims=True)
    return Blocks(Steps(begin, length), chain, number, enter, leave)


def _products(pot_of, begin: np.ndarray, length: np.ndarray, opens: np.ndarray, model: Model, kind) -> np.ndarray:
    """For each block the product of its steps, to a scale: from the state before it to the state of its last token. Every row of a
    block that opens a chain is the chain's start."""
    steps = Steps(begin, length)
    pot, move, start = pot_of(steps.tokens), model.move.astype(kind), model.start.astype(kind)
    k = len(start)
    p = np.where(opens[steps.order][:, None, None], start[None, None, :], move[None])
    for t, now, _ in steps.each():
        n = now.stop - now.start
        q = ((p[:n].reshape(n * k, k) @ move).reshape(n, k, k) if t else p) * pot[now][:, None, :]
        p[:n] = q / q.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(p)
    out[steps.order] = p
    return out


def forward(pot: np.ndarray, blocks: Blocks, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors of all tokens in step, and the scales: each token's probability after those before it in its chain."""
    order = blocks.steps.order
    move, start = model.move.astype(pot.dtype), model.start.astype(pot.dtype)
    fwd, scales = np.empty_like(pot), np.empty(len(pot), pot.dtype)
    for t, now, before in blocks.steps.each():
        a = (fwd[before] @ move if t else np.where((blocks.number[order] == 0)[:, None], start, blocks.enter[order] @ move)) * pot[now]
        scales[now] = scale = a.sum(axis=1)
        np.divide(a, scale[:, None], out=fwd[now])
    return fwd, scales


def posteriors(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts and moves of whole chains by scaled forward-backward; tokens in some order, and their distributions over the states."""
    emit = model.emit.astype(np.float32)
    pot_of = lambda tokens: emit[codes[tokens]]
    blocks = blocks_of(pot_of, starts, lengths, model, np.float32, size)
    steps, order = blocks.steps, blocks.steps.order
    pot, move = pot_of(steps.tokens), model.move.astype(np.float32)
    gamma, _ = forward(pot, blocks, model)  # turned into the distributions from the back
    later, opens = blocks.leave[order], blocks.number[order] == 0
    moves = np.zeros(model.move.shape)

    def cross(before: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        back = ahead @ move.T
        norm = 1 / np.einsum("ij,ij->i", before, back)[:, None]
        moves[:] += (before.T @ (ahead * norm)).astype(np.float64) * model.move
        return back * norm

    for t, now, before in reversed(list(steps.each())):
        n = now.stop - now.start
        ahead = later[:n] * pot[now]
        g = gamma[now] * later[:n]
        if t:
            later[:n] = cross(gamma[before], ahead)
        elif not opens.all():
            cross(blocks.enter[order][~opens], ahead[~opens])
        np.divide(g, g.sum(axis=1, keepdims=True), out=gamma[now])
    return gamma[: len(order)][opens].sum(axis=0).astype(np.float64), moves, steps.tokens, gamma


def expected_counts(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of each code of the chains."""
    start, moves, tokens, gamma = posteriors(codes, starts, lengths, model, size)
    codes = codes[tokens]
    return start, moves, np.stack([np.bincount(codes, gamma[:, s], len(model.emit)) for s in range(len(model.start))], axis=1)


def log_likelihoods(emit: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model, size: int = BLOCK) -> np.ndarray:
    """log10 probability of each whole chain by the scaled forward recursion; ``emit`` has each code's emissions."""
    pot_of = lambda tokens: emit[codes[tokens]]
    blocks = blocks_of(pot_of, starts, lengths, model, np.float64, size)
    _, scales = forward(pot_of(blocks.steps.tokens), blocks, model)
    chain = np.empty(len(codes), np.int64)
    chain[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(chain[blocks.steps.tokens], np.log10(scales), len(lengths))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches put together up to a size: rows, their codes end to end, and each row's number of codes."""
    return_memory()
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("codes").nbytes // 2
        if size >= TOKENS:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]):
    rows = pa.Table.from_batches(held).combine_chunks()
    raw, at = text_bytes(rows.column("codes"))
    codes = np.frombuffer(raw.tobytes(), "<u2").astype(np.uint32)
    codes[codes == WIDE] = rows.column("wide").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    return rows, codes, np.diff(at) // 2


def tied(code: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Codes of the tokens while the model is found."""
    other = code >= OTHER
    out = np.empty(len(code), np.int64)
    out[other] = vocab.frequent + (code[other] & ~OTHER)
    out[~other] = vocab.codes[code[~other]]
    return out


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, slices: int = SLICES, epochs: int = EPOCHS) -> Model:
    """Baum-Welch over the training rows of ``encoded``: counts per code are added up by Spark, the model by the driver."""
    model = first_model(vocab, states)
    n_codes, spark = len(vocab.code_tokens), rows.sparkSession
    kept: list[np.ndarray | None] = [None] * slices
    names = [f"s{k}" for k in range(states)]
    words = spark.sparkContext.broadcast(vocab)

    for step in range(slices * epochs):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + states + n_codes, states))
            for _, code, each in _flat(batches):
                s, m, e = expected_counts(tied(code, words.value), np.cumsum(each) - each, each, shared.value)
                total[0] += s
                total[1 : 1 + states] += m
                total[1 + states :] += e
            units = np.rint(total * UNIT).astype(np.int64)
            some = np.flatnonzero(units.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(units[some, k]) for k in range(states)]], ["place", *names])

        part = rows.where(F.col("slice") == step % slices)
        sums = part.select("codes", "wide").mapInArrow(count, "place long, " + ", ".join(f"{n} long" for n in names)).groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        counts = np.zeros((1 + states + n_codes, states))
        counts[sums.column("place").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], axis=1) / UNIT
        kept[step % slices] = counts
        total = sum(c for c in kept if c is not None)
        model = smoothed(total[0], total[1 : 1 + states], total[1 + states :], vocab.code_words, vocab.distinct)
    return model


@dataclass
class WordModel:
    """Emissions of every word: ``emit`` of the held ones, ``unseen`` of a word that isn't known; ``rest`` (h, n, p0, p1, ..) has
    the states' shares of the others, packed. ``share``: each state's part of all tokens."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    share: np.ndarray
    size: float  # N + V + 1
    rest: DataFrame | None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def emissions(self, counts: np.ndarray) -> np.ndarray:
        return (counts + self.share) / (self.share * self.size)

    def counts_of(self, n: np.ndarray, packed: list[np.ndarray]) -> np.ndarray:
        """Expected counts of words of ``rest``."""
        states = len(self.start)
        parts = np.stack([packed[k // PACKED].view(np.uint64) >> np.uint64(16 * (k % PACKED)) & np.uint64(PARTS) for k in range(states)], axis=1)
        return parts * (n / PARTS)[:, None]

    @property
    def unseen(self) -> float:
        return 1 / self.size


def word_model(rows: DataFrame, vocab: Vocabulary, model: Model) -> WordModel:
    """The last pass: expected counts of each word in each state over all training rows of ``encoded``."""
    spark, states = rows.sparkSession, len(model.start)
    shared, words = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(vocab)
    names = [f"s{k}" for k in range(states)]

    def out(kind: int, h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        units = np.rint(counts * UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), *[pa.array(units[:, k]) for k in range(states)]], ["kind", "h", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = shared.value, words.value
        sums, held = np.zeros((1 + states, states)), np.zeros((len(vocab.keys), states))
        for t, code, each in _flat(batches):
            start, moves, tokens, gamma = posteriors(tied(code, vocab), np.cumsum(each) - each, each, model)
            sums[0] += start
            sums[1:] += moves
            # places of the held words, then of the others of this batch
            other = code >= OTHER
            h, place = distinct_words(t.column("others").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            word = code.astype(np.int64)
            word[other] = len(held) + place
            word = word[tokens]
            counts = np.stack([np.bincount(word, gamma[:, k], len(held) + len(h)) for k in range(states)], axis=1)
            held += counts[: len(held)]
            yield out(1, h, counts[len(held) :])
        some = np.flatnonzero(held.any(axis=1))
        yield out(0, vocab.words[some], held[some])
        yield out(2, np.arange(1 + states, dtype=np.uint64), sums)

    counted = rows.where("slice >= 0").select("codes", "wide", "others").mapInArrow(count, "kind int, h long, " + ", ".join(f"{n} long" for n in names))
    table = materialize(counted.groupBy("kind", "h").agg(*[F.sum(n).alias(n) for n in names]), "word-states")
    tokens = table.where("kind < 2").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).head()
    tokens = np.array([tokens[n] for n in names]) / UNIT
    share = np.maximum(tokens / tokens.sum() if tokens.sum() > 0 else np.full(states, 1 / states), 1e-9)
    share /= share.sum()
    near = table.where("kind <> 1").select("kind", "h", *names).toArrow()  # the held words, and a row for starts and each move
    values = np.stack([near.column(n).to_numpy() for n in names], axis=1) / UNIT
    kind, h = near.column("kind").to_numpy(), near.column("h").to_numpy()
    sums, held = np.zeros((1 + states, states)), np.zeros((len(vocab.keys), states))
    sums[h[kind == 2]] = values[kind == 2]
    held[vocab.place(h[kind == 0].view(np.uint64))[0]] = values[kind == 0]
    done = WordModel((sums[0] + 1) / (sums[0] + 1).sum(), (sums[1:] + 1) / (sums[1:] + 1).sum(axis=1, keepdims=True), held, share, vocab.tokens + vocab.distinct + 1.0, None)
    done.emit = done.emissions(held)
    every = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    part = lambda k: F.coalesce(F.rint(F.col(names[k]) / every * PARTS), F.lit(0)).cast("long")
    packed = [sum((F.shiftleft(part(k), 16 * (k % PACKED)) for k in range(lo + 1, min(lo + PACKED, states))), part(lo)).alias(f"p{lo // PACKED}") for lo in range(0, states, PACKED)]
    done.rest = vocab.table.select("h", "n").join(table.where("kind = 1").select("h", *packed), "h")
    return done


def score(rows: DataFrame, model: WordModel) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of the rows of ``encoded``."""
    spark, states = rows.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    names, norm = [f"p{k}" for k in range(-(-states // PACKED))], math.log10(model.size)
    used = rows.select("row", F.explode(F.array_distinct("others")).alias("h")).join(model.rest, "h")
    known = used.groupBy("row").agg(F.collect_list(F.struct("h", "n", *names)).alias("found"))  # a document's words at most
    both = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_sum", "codes", "wide", "others").join(known, "row", "left").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for t, code, each in _flat(batches):
            found = t.column("found").combine_chunks().flatten()
            h = found.field("h").to_numpy(zero_copy_only=False).view(np.uint64)
            h, first = np.unique(h, return_index=True)
            n = found.field("n").to_numpy(zero_copy_only=False)[first]
            counts = model.counts_of(n, [found.field(p).to_numpy(zero_copy_only=False)[first] for p in names])
            n = np.append(n, 0)
            emit = np.concatenate([model.emit, model.emissions(counts), np.full((1, states), model.unseen)])
            other = code >= OTHER
            asked = t.column("others").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.minimum(np.searchsorted(h, asked), max(len(h) - 1, 0))
            at = np.where(h[at] == asked, at, len(h)) if len(h) else np.zeros(len(asked), np.int64)
            place = np.empty(len(code), np.int64)
            place[~other], place[other] = code[~other], len(model.emit) + at
            value = log_likelihoods(emit, place, np.cumsum(each) - each, each, model)
            row = np.repeat(np.arange(len(each)), each)[other]
            base = t.column("base_sum").to_numpy() + np.bincount(row, np.log10(n[at] + 1.0), len(each)) - each * norm
            seen = t.column("n_known").to_numpy() + np.bincount(row, n[at] > 0, len(each)).astype(np.int64)
            columns = [*[t.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")], pa.array(seen), pa.array(base), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, frequent: int = FREQUENT, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document row.

    Learns from the rows that ``held_out`` doesn't mark. base_score sums log10((c + 1) / (N + V + 1)) over the tokens.
    Null text counts as empty: one token, the end. Without training rows all counts are 0. Repeated rows are each counted and
    scored, null ids too; an empty table gives no rows.
    """
    rows = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    vocab = vocabulary(rows, frequent, held)
    tokens = encoded(rows, vocab)
    model = word_model(tokens, vocab, train(tokens, vocab, states))
    out = score(tokens, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
