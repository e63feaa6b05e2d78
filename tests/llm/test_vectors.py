"""Whitening and vector codes against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.llm import queries, vector_codes, vector_rows, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, component string, code string, error string, scans string, _label string, n string"
BAD = [(100, None, 1), (101, [], 1), (102, [1.0, None, 1.0, 1.0] * 4, 1), (103, [float("nan")] * 16, 1), (104, [float("inf")] * 16, None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 8) for r in rows], SCHEMA).repartition(3)


def gauss(n, d, seed=1):
    rng = random.Random(seed)
    return [[rng.gauss(0, 1 + k % 3) for k in range(d)] for _ in range(n)]


def ints(vectors, scale, shift):
    return [[math.floor(scale * float(np.float32(c))) + shift for c in v] for v in vectors]


def assert_whitened(got, ids, x, most=32):
    """``got`` rows against the eigenvectors of the covariance of ``x``."""
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    far = {i: sum((n * c - s) ** 2 for c, s in zip(r, sums)) for i, r in zip(ids, x)}
    xc = (np.array(x, object) * n - np.array(sums, object)).astype(float) / n
    values, vectors = np.linalg.eigh(xc.T @ xc / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-11 * values[0]).sum()))
    assert {r["component"] for r in got} == set(range(1, k + 1)) and len(got) == n * k
    assert all(r["deviation"] == far[r["vec_id"]] and r["n"] == n and r["identity_error"] < 1e-9 for r in got)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert all(abs(by[ids[0], c + 1]["explained"] - values[c] / values.sum()) < 1e-10 for c in range(k))
    z = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    lone = [c for c in range(k) if all(abs(values[c] - v) > 1e-6 * values[0] for j, v in enumerate(values) if j != c)]
    want = xc @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want)[:, lone].max(initial=0) < 1e-6
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-9


@pytest.mark.parametrize("n,d", [(40, 16), (200, 48), (5, 16)])
def test_whitening_equals_eigenvectors(spark, n, d):
    v = gauss(n, d)
    rows = [(i, x, 0) for i, x in enumerate(v)] + ([] if d != 16 else BAD)
    got = whitening.whiten(table(spark, rows)).collect()
    assert_whitened(got, list(range(n)), ints(v, 64, 1_000_000))


def test_whitening_of_equal_eigenvalues(spark):
    """Plus and minus each axis: all eigenvalues equal, so every step begins again."""
    v = [[s * 8.0 if k == j else 0.0 for k in range(16)] for j in range(16) for s in (1, -1)]
    got = whitening.whiten(table(spark, [(i, x, 0) for i, x in enumerate(v)])).collect()
    assert_whitened(got, list(range(32)), ints(v, 64, 1_000_000))


def test_whitening_of_a_plane_and_repeated_rows(spark):
    rng = random.Random(2)
    v = [[float(a * k + b * (k % 2)) for k in range(16)] for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(30))]
    v += v[:10]
    got = whitening.whiten(table(spark, [(i, x, 0) for i, x in enumerate(v)])).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert_whitened(got, list(range(40)), ints(v, 64, 1_000_000))


def test_whitening_of_small_deviations(spark):
    """Deviations over six powers of ten."""
    rng = random.Random(3)
    v = [[rng.gauss(0, 10.0 ** (4 - k / 2)) for k in range(12)] for _ in range(300)]
    assert_whitened(whitening.whiten(table(spark, [(i, x, 0) for i, x in enumerate(v)])).collect(), list(range(300)), ints(v, 64, 1_000_000))


def test_whitening_without_deviation(spark):
    for rows in ([], BAD, [(1, [2.0] * 16, 0)] * 4):
        out = whitening.whiten(table(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(1))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"))


def test_whitening_of_the_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert_whitened(queries.op11_whitening(spark, SF).collect(), [r["vec_id"] for r in t], ints([r["embedding"] for r in t], 64, 1_000_000))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{id: (code, error)}, {label: error} and the digest, every part against every entry in every round."""
    kept = [(i, ints([v], 256, 0)[0], lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][1]))[:entries]
    book = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(book[p])), key=lambda e: (far(c[p], book[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                own = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if own:
                    book[p][e] = [sum(x[j] for x in own) // len(own) for j in range(w)]
    codes = assign()
    found, labels = [], {}
    for (i, _, lab), c, code in zip(kept, cut, codes):
        error = sum(far(c[p], book[p][code[p]]) for p in range(parts))
        labels[lab] = labels.get(lab, 0) + error
        found.append((i, "".join(f"{e:02x}" for e in code), error, lab))
    return sorted(found, key=str), labels, hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()


@pytest.mark.parametrize("n,rounds", [(300, 2), (300, 6), (20, 2), (1, 2)])
def test_codes_equal_a_plain_version(spark, monkeypatch, n, rounds):
    rng = random.Random(n)
    rows = [(i * 3, x, rng.choice([1, 2, None])) for i, x in enumerate(gauss(n, 32, n))]
    rows += [(0, rows[0][1], 1), (0, rows[-1][1], None), (None, rows[0][1], 2)] + [(b[0], b[1], b[2]) for b in BAD if n == 20 and not b[1]]
    found, book = vector_codes.encode(table(spark, rows), rounds=rounds)
    want, labels, digest = plain_codes(rows, rounds=rounds)
    for most in (100, 0):
        monkeypatch.setattr(vector_codes, "LABELS", most)
        got = vector_codes.with_label_error(found).collect()
        assert sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in got), key=str) == want
        assert all(r["label_error"] == labels[r["label"]] for r in got)
    assert vector_codes.codebooks_digest(book) == digest


def test_bounds_spare_comparisons(spark):
    """Groups that lie apart: after the first round hardly a part is compared with all entries again, and codes stay exact."""
    rng = random.Random(9)
    centres = gauss(64, 16, 7)
    rows = [(i, [10 * c + rng.gauss(0, 0.01) for c in centres[i % 64]], 0) for i in range(1000)]
    found, book = vector_codes.encode(table(spark, rows), parts=2, rounds=5)
    got = found.collect()
    want, _, digest = plain_codes(rows, parts=2, rounds=5)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in got), key=str) == want and vector_codes.codebooks_digest(book) == digest
    assert sum(r["scans"] for r in got) < 1.2 * 2 * len(got)  # of 6 rounds' 12


def test_net_displacement_is_tighter_than_drift(spark):
    """An entry that goes and comes back has moved by nothing, so nothing is compared again."""
    x = np.array([[0], [10]], np.int64)
    there, away = np.array([[[0], [9]]], np.int64), np.array([[[4], [9]]], np.int64)
    state = vector_codes.State(2, 1)
    state.scan(x, there[0], 0, np.arange(2), 0)
    before = state.scans.copy()
    state.refresh(x, [there, away, there], 0)
    assert (state.scans == before).all() and state.code[:, 0].tolist() == [0, 1] and (state.upper_at == 0).all()


def test_codes_of_nothing(spark):
    for rows in ([], BAD, [(None, [1.0] * 16, 1)]):
        found, book = vector_codes.encode(table(spark, rows))
        assert book is None and vector_codes.with_label_error(found).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode(table(spark, [(1, [1.0] * 17, 1)]))


def test_rows_are_summed_without_a_shuffle(spark):
    rows = vector_rows.whole_vectors(table(spark, [(i, [float(i), -0.01], 0) for i in range(100)]), "vec_id", "embedding", 64, 5, "t")
    assert vector_rows.summed(rows, lambda b: vector_rows.stacked(b.column("x")).sum(axis=0)).tolist() == [64 * 4950 + 500, 400]
    assert vector_rows.summed(rows.limit(0), lambda b: vector_rows.stacked(b.column("x"))) is None
    assert rows.where(F.col("id") == 3).count() == 1
