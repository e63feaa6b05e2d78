"""Quality of documents: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of character classes, repeated words, repeated lines and the like, of the line itself and of
its neighbours. The chain is trained on documents whose lines all take the document's label. A document's quality is the
length-weighted mean of its lines' forward-backward marginals, calibrated on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.llm.common import batches_of, materialize, span_hashes, text_bytes, text_rows, word_spans

#: The sample on which the chain is fitted: whole documents in order of their ids' hashes, at most so many of them and of their lines together. Documents of
#: more than ``LONGEST`` lines are not in it. So what the driver holds is bounded, whatever the texts.
TRAIN_ROWS, TRAIN_LINES, LONGEST = 6000, 200_000, 4096
STEPS, RATE, RIDGE = 150, 0.1, 2e-4
THRESHOLD = 0.3


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, first line of each row and one more): the non-empty lines of every text."""
    raw, at = text_bytes(texts)
    n = len(at) - 1
    if not len(raw):
        return np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    feed = raw == 10
    edge = np.unique(np.concatenate([at, np.flatnonzero(feed), np.flatnonzero(feed) + 1]))
    starts, ends = edge[:-1], edge[1:]
    keep = ~feed[starts]
    starts, ends = starts[keep], ends[keep]
    size = ends - starts
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros((0, WIDTH)), size, first

    def count(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (run[ends] - run[starts]).astype(np.float64)

    after = np.concatenate([[0], raw[:-1]])
    upper = (raw >= 65) & (raw <= 90) | (after == 0xC3) & (raw >= 0x80) & (raw <= 0x9E)
    lower = (raw >= 97) & (raw <= 122)
    wide = raw >= 128
    digit = (raw >= 48) & (raw <= 57)
    stop = np.isin(raw, np.frombuffer(b".,;:?'\"()-", np.uint8))
    blank = np.isin(raw, np.frombuffer(b" \t\r\x0b\x0c", np.uint8))
    odd = ~(upper | lower | wide | digit | stop | blank)
    ws, we, word_at = word_spans(raw, at)
    h = span_hashes(raw, ws, we)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[word_at[:-1][word_at[:-1] < len(h)]] = False  # what another text of the batch ends with doesn't matter
    odd_end = odd[we - 1] if len(we) else np.zeros(0, bool)
    wlo, whi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    runs = lambda x: np.concatenate([[0], np.cumsum(x)])
    n_words = np.maximum(whi - wlo, 1).astype(np.float64)
    row = np.searchsorted(at, starts, "right") - 1
    line_hash = span_hashes(raw, starts, ends) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, copies = np.unique(line_hash, return_inverse=True, return_counts=True)
    letters = np.maximum(count(upper) + count(lower) + count(wide), 1)
    x = np.stack([
        count(upper) / letters, count(digit) / size, count(odd) / size, count(stop) / size, count(blank) / size, count(wide) / size,
        count(raw == 33) / size, count(raw == 124) / size, (runs(same)[whi] - runs(same)[wlo]) / n_words, (runs(odd_end)[whi] - runs(odd_end)[wlo]) / n_words,
        (copies[inverse] > 1).astype(np.float64), np.minimum(size / n_words, 30) / 10, np.log1p(size) / 5, np.isin(raw[ends - 1], np.frombuffer(b".!?:\"'", np.uint8)).astype(np.float64),
    ], axis=1)
    return x, size, first


WIDTH = 14


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, its predecessor's and successor's in the same document (zeros at the ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    head = first[:-1][first[:-1] < first[1:]]
    before[head] = 0
    after[first[1:][first[:-1] < first[1:]] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


@dataclass
class Chain:
    weight: np.ndarray
    move: np.ndarray
    slope: float
    shift: float
    prior: float


def marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) by scaled forward-backward over all chains in step, and the expected transitions."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    pot = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
    m = np.exp(move)
    fwd, bwd = np.ones((len(score), 2)), np.ones((len(score), 2))
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        i = start[: live[t]] + t
        a = (fwd[i - 1] @ m if t else 1.0) * pot[i]
        fwd[i] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        i = start[: live[t + 1]] + t
        c = (bwd[i + 1] * pot[i + 1]) @ m.T
        bwd[i] = c / c.sum(axis=1, keepdims=True)
    joint = fwd * bwd
    good = joint[:, 1] / joint.sum(axis=1)
    inner = np.ones(len(score), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    i = np.flatnonzero(inner)
    pair = fwd[i - 1][:, :, None] * m * (bwd[i] * pot[i])[:, None, :]
    return good, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(i) else np.zeros((2, 2))


def document_means(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals; NaN for a document without lines."""
    run = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[first])
    with np.errstate(invalid="ignore"):
        return run(good * size) / run(size)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def flat_chain(prior: float) -> Chain:
    """Gives every document the score ``prior``."""
    return Chain(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), 0.0, float(_logit(np.array(np.clip(prior, 1e-3, 1 - 1e-3)))), prior)


def fit_chain(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> Chain:
    """Maximise the conditional likelihood by Adam; then fit slope and shift of the documents' log odds."""
    prior = float(label.mean()) if len(label) else 0.5
    if not len(x) or label.min() == label.max():
        return flat_chain(prior)
    length = np.diff(first)
    full = with_neighbours(x, first)
    y = np.repeat(label, length).astype(np.float64)
    heads = np.zeros(len(x), bool)
    heads[first[:-1][first[:-1] < len(x)]] = True
    inner = np.flatnonzero(~heads)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(full.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pairs = marginals(full @ theta[:-4], first, theta[-4:].reshape(2, 2))
        grad = np.concatenate([full.T @ (y - good), (seen - pairs).ravel()]) / len(x) - RIDGE * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weight, move = theta[:-4], theta[-4:].reshape(2, 2)
    some = length > 0
    good, _ = marginals(full @ weight, first, move)
    odds, target = _logit(document_means(good, size, first)[some]), label[some].astype(np.float64)
    slope, shift = 0.5, 0.0
    for _ in range(60):  # Newton steps of a two-parameter logistic regression, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((target - p) * odds).sum() - slope, (target - p).sum() - shift * 1e-3])
        hess = np.array([[(v * odds * odds).sum() + 1, (v * odds).sum()], [(v * odds).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        slope, shift = slope + d[0], shift + d[1]
        if np.abs(d).max() < 1e-9:
            break
    return Chain(weight, move, float(slope), float(shift), prior)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lines: int = TRAIN_LINES) -> Chain:
    """Fit on whole chains of at most ``rows`` labelled documents with at most ``lines`` lines together; their features come from the executors.

    Rows without an id or a label teach nothing. Of several labels of one id the largest holds, of several texts that of the
    least hash. Labels of ids that aren't there are left out; without any, or where the sample has one label only, all scores are the labels' mean,
    to which the documents count whose lines are too many for the sample.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = text_rows(docs, F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(picked), F.col("doc") == F.col("id")).select("id", "label", "text")
    chosen = chosen.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "text", 1 << 20):
            x, size, first = lines_of(b.column("text"))
            spans = [(a, z) if z - a <= LONGEST else None for a, z in zip(first[:-1], first[1:])]  # None: the label counts, not the lines
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "n": pa.array([s and s[1] - s[0] for s in spans], pa.int64()), "label": b.column("label").cast(pa.int32()),
                "x": pa.array([s and x[s[0] : s[1]].astype("<f4").tobytes() for s in spans], pa.binary()),
                "size": pa.array([s and size[s[0] : s[1]].astype("<i8").tobytes() for s in spans], pa.binary()),
            })

    kept = materialize(chosen.mapInArrow(features, "id long, n long, label int, x binary, size binary"), "lines")
    some = kept.where("n is not null")
    # at most ``rows`` rows of numbers
    sizes = some.select("id", "n", (F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id")) <= lines).alias("in")).where("in").select("id")
    got = sorted(some.join(F.broadcast(sizes), "id").toLocalIterator(), key=lambda r: (r["id"], bytes(r["x"])))
    label = np.array([r["label"] for r in got], np.int64)
    if len(np.unique(label)) < 2:
        mean = kept.agg(F.avg("label")).head()[0]
        return flat_chain(0.5 if mean is None else mean)
    x = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, WIDTH).astype(np.float64) for r in got]
    first = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64)
    return fit_chain(np.concatenate([np.zeros((0, WIDTH)), *x]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(bytes(r["size"]), "<i8") for r in got)]), first, label)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, bad_lines): the document's quality from 0 to 1, and how many of its lines are likelier bad.

    Null or empty text, or only line feeds: the training rows' share of good documents. Repeated rows are each scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, scores(b.column("text"), chain))], ["doc_id", "score", "bad_lines"])

    return text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, bad_lines long")


def scores(texts: pa.Array, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    x, size, first = lines_of(texts)
    good, _ = marginals(with_neighbours(x, first) @ chain.weight, first, chain.move)
    mean = document_means(good, size, first)
    value = 1 / (1 + np.exp(-np.clip(chain.slope * _logit(mean) + chain.shift, -30, 30)))
    bad = np.diff(np.concatenate([[0], np.cumsum(good < 0.5)])[first])
    return np.where(np.isnan(mean), chain.prior, value), bad.astype(np.int64)


def keep_good(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches ``threshold``. Null and empty texts have the training rows' share of good
    documents as score; repeated rows stay or go together; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, text_col, 1 << 20):
            yield b.filter(pa.array(scores(b.column(text_col), chain)[0] >= threshold))

    return text_rows(docs, F.col("*")).mapInArrow(run, docs.schema)
