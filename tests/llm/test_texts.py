"""Quality, language, language-model scores, mixing, fingerprints, personal data and token files."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from compare import assert_same, connection
from rows import SF, edge_rows
from plain import words
from pyspark.sql import functions as F

from seqlattice.llm import fingerprints, langid, lm_scoring, mixing, pii, quality, queries, tokenstore


LARGER = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), connection(SF).sql(queries.ORACLE[name]).df())


# quality


def plain_features(text):
    """(14 features, bytes) of every line that isn't empty, byte by byte."""
    raw = (text or "").encode()
    lines, out, at = [x for x in raw.split(b"\n") if x], [], 0
    space = b" \t\r\x0b\x0c\n"
    for line in lines:
        at = raw.index(line, at)
        before, at = raw[at - 1] if at else 0, at + len(line)
        is_upper = [65 <= c <= 90 or p == 0xC3 and 0x80 <= c <= 0x9E for p, c in zip(bytes([before]) + line, line)]
        is_lower, is_wide, is_digit = [97 <= c <= 122 for c in line], [c >= 128 for c in line], [48 <= c <= 57 for c in line]
        is_stop, is_blank = [c in b".,;:?'\"()-" for c in line], [c in b" \t\r\x0b\x0c" for c in line]
        is_odd = [not any(x) for x in zip(is_upper, is_lower, is_wide, is_digit, is_stop, is_blank)]
        words, now = [], None  # (text, its last byte is odd)
        for i, c in enumerate(line + b" "):
            if c not in space and now is None:
                now = i
            if c in space and now is not None:
                words.append((line[now:i], is_odd[i - 1]))
                now = None
        n, m, letters = len(line), max(len(words), 1), max(sum(is_upper) + sum(is_lower) + sum(is_wide), 1)
        previous = out[-1][2][-1][0] if out and out[-1][2] else next((w[-1][0] for _, _, w in reversed(out) if w), None)
        same = sum(a[0] == b for a, b in zip(words, [previous] + [w[0] for w in words]))
        out.append(([sum(is_upper) / letters, sum(is_digit) / n, sum(is_odd) / n, sum(is_stop) / n, sum(is_blank) / n, sum(is_wide) / n, line.count(b"!") / n, line.count(b"|") / n, same / m,
                     sum(w[1] for w in words) / m, float(lines.count(line) > 1), min(n / m, 30) / 10, math.log1p(n) / 5, float(line[-1] in b".!?:\"'")], n, words))
    return [(f, n) for f, n, _ in out]


def plain_score(text, chain):
    """The score by counting through all labellings of the lines."""
    lines = plain_features(text)
    if not lines:
        return chain.prior
    zero = [0.0] * 14
    full = [f + (lines[i - 1][0] if i else zero) + (lines[i + 1][0] if i + 1 < len(lines) else zero) + [1.0] for i, (f, _) in enumerate(lines)]
    gain = [max(-30.0, min(30.0, sum(a * b for a, b in zip(f, chain.weight)))) for f in full]
    total, good = 0.0, [0.0] * len(lines)
    for y in itertools.product((0, 1), repeat=len(lines)):
        w = math.exp(sum(g for g, k in zip(gain, y) if k) + sum(chain.move[a][b] for a, b in zip(y, y[1:])))
        total += w
        good = [g + w * k for g, k in zip(good, y)]
    mean = sum(g / total * n for g, (_, n) in zip(good, lines)) / sum(n for _, n in lines)
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    return 1 / (1 + math.exp(-(chain.slope * math.log(mean / (1 - mean)) + chain.shift)))


def test_quality_equals_a_plain_version(spark, small, edge):
    chain = quality.train(small, spark.read.parquet(f"{SF}/labels.parquet"))
    seen = 0
    for df in (small, edge):
        got = {(r["doc_id"], r["text"]): r for r in quality.score(df, chain).join(df.select("doc_id", "text"), "doc_id").collect() if r["doc_id"] not in (3, 4)}
        for (_, text), r in got.items():
            x, size, first = quality.lines_of(pa.array([text]))
            want = plain_features(text)
            assert len(want) == len(x) and all(n == m for (_, n), m in zip(want, size))
            assert all(a == pytest.approx(list(b), abs=1e-9) for (a, _), b in zip(want, x))
            if len(want) <= 9:
                seen += 1
                assert r["score"] == pytest.approx(plain_score(text, chain), abs=1e-6)
    assert seen > 50
    pair = pa.array(["the word", "word for word", "word word"])
    assert np.allclose(quality.lines_of(pair)[0], np.concatenate([quality.lines_of(pair.slice(i, 1))[0] for i in range(3)]))


def test_quality_sample_is_bounded_by_lines(spark, monkeypatch):
    """Whole documents in hash order as long as their lines fit; long ones are not in the sample."""
    docs = spark.createDataFrame([(i, "\n".join(["Good line here."] * 5 if i % 2 else ["### !!! |||"] * 5)) for i in range(20)] + [(20, "\n".join(["x y z."] * 50))], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    held = []
    monkeypatch.setattr(quality, "fit_chain", lambda x, size, first, label: held.append((len(x), len(label))))
    quality.train(docs, labels)
    quality.train(docs, labels, lines=33)
    monkeypatch.setattr(quality, "LONGEST", 10)
    quality.train(docs, labels)
    assert held[0] == (150, 21) and held[2] == (100, 20) and held[1][0] <= 33 and held[1][1] >= 1


def test_labels_of_long_documents_count(spark, monkeypatch):
    """Where all good documents are too long for the sample, it can't tell good from bad: all have the share of good ones, none is dropped."""
    docs = spark.createDataFrame([(1, "\n".join(["x y z."] * 50)), (2, "### !!! |||"), (3, "Good line here."), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "LONGEST", 10)
    chain = quality.train(docs, labels)
    assert {round(r["score"], 9) for r in quality.score(docs, chain).collect()} == {0.5} and quality.keep_good(docs, chain).count() == 4


def test_long_chains_are_fitted_whole():
    """A document of 300 lines and its transitions: the fit sees 299 of them."""
    x = np.random.default_rng(1).random((600, quality.WIDTH))
    first = np.array([0, 300, 600])
    chain = quality.fit_chain(x, np.ones(600, np.int64), first, np.array([0, 1]))
    _, pairs = quality.marginals(quality.with_neighbours(x, first) @ chain.weight, first, chain.move)
    assert pairs.sum() == pytest.approx(598) and pairs[0, 0] + pairs[1, 1] > 590


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, LARGER).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(got[i], q) for i, q in labels.items() if got[i]["held_out"]]
    assert all(r["held_out"] == (fold(i, 5) == 0) for i, r in got.items())
    assert np.mean([r["predicted"] == q for r, q in held]) >= 0.9


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (16, 0, 0), (14, 0, 0), (99, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    chain = quality.train(edge, labels)
    rows = quality.score(edge, chain).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (5, 6)} == {chain.prior}
    kept = quality.keep_good(edge, chain, 0.0)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert quality.score(nothing, chain).count() == 0
    flat = quality.train(nothing, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(edge, flat).collect())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=5), rng.normal(size=(2, 2))
    first = np.array([0, 4, 4, 5])
    good, pairs = quality.marginals(score, first, move)
    want, moves = np.zeros(5), np.zeros((2, 2))
    for a, z in ((0, 4), (4, 5)):
        total, part, each = 0.0, np.zeros(z - a), np.zeros((2, 2))
        for bits in range(1 << (z - a)):
            y = [bits >> k & 1 for k in range(z - a)]
            w = math.exp(sum(score[a + k] * y[k] for k in range(z - a)) + sum(move[y[k], y[k + 1]] for k in range(z - a - 1)))
            total += w
            part += w * np.array(y)
            for k in range(z - a - 1):
                each[y[k], y[k + 1]] += w
        want[a:z], moves = part / total, moves + each / total
    assert np.allclose(good, want) and np.allclose(pairs, moves)


# language


def test_language_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op3_language(spark, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert np.mean([got[i]["lang_pred"] == v for i, v in lang.items() if got[i]["held_out"]]) >= 0.95


def plain_languages(trained, texts):
    """(language, score) of each text: dictionaries, one word after another."""
    found = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    grams = lambda w, n: [f"\x02{w}\x03"[i : i + n] for i in range(len(w) + 3 - n)]
    languages = sorted({lang for lang, t in trained if lang is not None and found(t)})
    counts = [defaultdict(Counter) for _ in range(6)]
    for lang, t in trained:
        for w in found(t) if lang is not None else ():
            counts[0][w][lang] += 1
            for n in range(1, 6):
                for g in grams(w, n):
                    counts[n][g][lang] += 1
    base = [{lang: sum(c[lang] for c in units.values()) + 0.5 * max(1, len(units)) for lang in languages} for units in counts]

    def score(w):
        if w in counts[0]:
            return [math.log((counts[0][w][lang] + 0.5) / base[0][lang]) for lang in languages]
        for n in range(5, 0, -1):
            known = [counts[n][g] for g in grams(w, n) if g in counts[n]]
            if known:
                return [sum(math.log((c[lang] + 0.5) / base[n][lang]) for c in known) / len(known) for lang in languages]
        return [0.0] * len(languages)

    out = []
    for t in texts:
        total = [sum(x) for x in zip(*map(score, found(t)))]
        best = max(range(len(total)), key=lambda i: (total[i], -i), default=None)
        out.append(("und", 0.0) if best is None else (languages[best], 1 / sum(math.exp(x - total[best]) for x in total)))
    return out


@pytest.mark.parametrize("held", [langid.HELD, 300, 1])
def test_languages_equal_a_plain_version(small, held):
    rows = small.where("doc_id < 120").collect()
    trained = small.where("doc_id < 120 and doc_id % 3 <> 0")
    want = dict(zip([r["doc_id"] for r in rows], plain_languages([(r["lang"], r["text"]) for r in rows if r["doc_id"] % 3], [r["text"] for r in rows])))
    model = langid.train(trained, held=held)
    assert (model.rest is None) == (held == langid.HELD)
    got = langid.identify(small.where("doc_id < 120"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-6)


def test_held_scores_are_bounded_for_any_number_of_languages(small):
    for languages in (1, 4, 40):
        rows = small.where("doc_id < 160").withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % languages).cast("string")))
        model = langid.train(rows, held=400)
        assert len(model.languages) == languages
        assert all(scores.size <= 400 for _, scores in model.held) and (languages == 40 or any(len(keys) for keys, _ in model.held))


@pytest.mark.parametrize("held", [langid.HELD, 20])
def test_language_edges(edge, nothing, held):
    model = langid.train(edge, held=held)
    assert model.languages == ["de", "en", "fr"]
    want = Counter((i, *p) for i, p in zip([r[0] for r in edge_rows()], [(a, round(b, 6)) for a, b in plain_languages([(r[2] if len(r) > 2 else "x", r[1]) for r in edge_rows()], [r[1] for r in edge_rows()])]))
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.identify(edge, model).collect()) == want
    assert langid.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge, langid.train(nothing)).collect()} == {"und"}


def test_unseen_words_back_off():
    units = {0: {"theta": (3, 1)}, 3: {"the": (3, 1), "eta": (2, 2)}, 1: {"q": (1, 0)}}
    held = []
    for n in range(6):
        got = sorted((int(langid.hashes(pa.array([u]))[0]), c) for u, c in units.get(n, {}).items())
        held.append((np.array([h for h, _ in got], np.uint64), np.array([c for _, c in got], float).reshape(-1, 2)))
    model = langid.LanguageModel(["a", "b"], held)
    assert model.word_scores(pa.array(["theta", "thetas", "xthe", "qq", "zz"])).tolist() == [[3, 1], [2.5, 1.5], [3, 1], [1, 0], [0, 0]]


# language model


def test_base_scores_and_model(small):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    got = {r["doc_id"]: r for r in lm_scoring.language_model_scores(small, held).collect()}
    texts = {r["doc_id"]: [*words(r["text"]), None] for r in small.collect()}
    count = Counter(w for i, t in texts.items() if fold(i, 7) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in texts.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize("size", [1024, 2, 1])
def test_forward_and_counts_equal_enumeration(size):
    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = lm_scoring.Model(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((3, 2)), 0))
    codes, starts, lengths = np.array([0, 2, 1, 2, 1, 1, 0, 2, 2, 0, 1]), np.array([0, 3, 4]), np.array([3, 1, 7])
    s, m, e = lm_scoring.expected_counts(codes, starts, lengths, model, size)
    want_s, want_m, want_e, likes = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), []
    for a, n in zip(starts, lengths):
        paths = [([b >> k & 1 for k in range(n)]) for b in range(1 << n)]
        w = [model.start[p[0]] * math.prod(model.move[p[k], p[k + 1]] for k in range(n - 1)) * math.prod(model.emit[codes[a + k], p[k]] for k in range(n)) for p in paths]
        likes.append(math.log10(sum(w)))
        for p, x in zip(paths, w):
            x /= sum(w)
            want_s[p[0]] += x
            for k in range(n):
                want_e[codes[a + k], p[k]] += x
            for k in range(n - 1):
                want_m[p[k], p[k + 1]] += x
    assert np.allclose(lm_scoring.log_likelihoods(model.emit, codes, starts, lengths, model, size), likes)
    assert np.allclose(s, want_s, atol=1e-5) and np.allclose(m, want_m, atol=1e-5) and np.allclose(e, want_e, atol=1e-5)


@pytest.mark.parametrize("frequent,held", [(lm_scoring.FREQUENT, lm_scoring.HELD), (50, 400), (0, 0)])
def test_scores_equal_a_plain_forward_pass(small, frequent, held):
    docs = small.where("doc_id < 90").select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    vocab = lm_scoring.vocabulary(docs, frequent, held)
    rows = lm_scoring.encoded(docs, vocab)
    model = lm_scoring.word_model(rows, vocab, lm_scoring.train(rows, vocab, 3))
    counts = {r["h"] % (1 << 64): model.counts_of(np.array([r["n"]]), [np.array([r["p0"]])])[0] for r in model.rest.collect()}
    assert len(counts) + len(vocab.keys) == vocab.distinct
    emit = {h: model.emissions(c) for h, c in counts.items()} | dict(zip(vocab.words.tolist(), model.emit))
    mass = sum(emit.values()) + model.unseen
    assert np.allclose(mass, 1, atol=1e-3)  # each state's emissions add up to one
    count = Counter(h for i, t in texts.items() if i % 7 != 2 for h in lm_scoring.word_hashes(pa.array([t]))[0].tolist())
    assert count.keys() == emit.keys() and all(abs(c.sum() - count[h]) < 0.05 + 0.01 * count[h] for h, c in counts.items())
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(rows, model).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        state, total = None, 0.0
        for h in lm_scoring.word_hashes(pa.array([t]))[0].tolist():
            state = (model.start if state is None else state @ model.move) * emit.get(h, model.unseen)
            total += math.log10(state.sum())
            state = state / state.sum()
        assert got[i] == pytest.approx(total, rel=1e-9, abs=1e-6)


def test_a_repeated_table_gives_the_same_vocabulary_and_like_scores(small):
    docs = small.where("doc_id < 60").select("doc_id", "text", F.lit(False).alias("held_out"))
    twice = docs.unionByName(docs)
    one, two = (lm_scoring.vocabulary(d, 40, 300) for d in (docs, twice))
    assert one.keys.tolist() == two.keys.tolist() and one.codes.tolist() == two.codes.tolist() and two.tokens == 2 * one.tokens and two.distinct == one.distinct
    per_token = [{r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.language_model_scores(d, F.lit(False), states=2, frequent=40, held=300).collect()} for d in (docs, twice)]
    assert np.mean([abs(per_token[0][i] - per_token[1][i]) for i in per_token[0]]) < 0.35


def test_language_model_edges(edge, nothing):
    rows = lm_scoring.language_model_scores(edge, F.col("doc_id") % 7 == 2, states=3).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (5, 6, 7)} == {1}
    assert lm_scoring.language_model_scores(nothing, F.lit(False)).count() == 0
    untrained = lm_scoring.language_model_scores(edge.limit(4), F.lit(True), states=2).collect()
    assert {(r["base_score"], r["train_tokens"], r["n_known"]) for r in untrained} == {(0.0, 0, 0)}


# mixing


def test_mix_edges(edge, nothing):
    rows = mixing.curriculum_mix(edge).collect()
    assert len(rows) == edge.count()
    assert sum(r["size"] for r in rows) == sum(len(words(r[1])) for r in edge_rows())
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and all(0 <= p <= 1 for p in r["positions"])
        by[r["source_size"], r["target"]].append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.01)
    for (_, target), group in by.items():
        assert abs(sum(r["taken"] for r in group) - target) <= 1
    assert mixing.curriculum_mix(nothing).count() == 0
    again = mixing.curriculum_mix(edge).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    read = mixing.mixed_documents(edge)
    assert read.columns == edge.columns and read.count() > 0


def test_positions_follow_the_schedule(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.lit("s").alias("source"))
    got = mixing.curriculum_mix(docs, shapes=(((0.0, 0.0), (1.0, 2.0)),), share=1.0).select(F.col("positions")[0].alias("p")).orderBy("p").collect()
    for k, r in enumerate(got):  # demand is the square of progress
        assert r["p"] == pytest.approx(math.sqrt(k / 400), abs=1e-9)


def test_training_order(small):
    mixed = mixing.curriculum_mix(small).select("doc_id", F.get("positions", F.lit(0)).alias("position")).where("position is not null")
    got = [r["position"] for r in mixing.training_order(mixed).collect()]
    assert got == sorted(got)


# fingerprints


def pieces(t):
    return set(re.findall(r"[^\n]{1,%d}[^\n ]*" % fingerprints.PIECE, t))


def test_versions(spark, small):
    got = {r["doc_id"]: r for r in queries.op6_fingerprints(spark, SF).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in small.collect()), reverse=True)
    like = lambda a, b: len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b)) if pieces(a) | pieces(b) else 1.0
    seen = {}
    for k, (i, text) in enumerate(rows):
        after, r, third = rows[(k + 1) % len(rows)][1], got[i], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(text, edited)) and r["near_next"] == pytest.approx(like(text, after))
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(seen.values())) == len(seen)


def test_fingerprint_edges(edge, nothing):
    rows = fingerprints.compare_versions(edge).collect()
    assert len(rows) == edge.count() and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert {r["edited_sha256"] for r in rows if r["doc_id"] == 6} == {hashlib.sha256(b"").hexdigest()}
    assert fingerprints.compare_versions(nothing).count() == 0
    assert fingerprints.fingerprints(edge).where("doc_id = 5").head()["n_digests"] == 0


def test_differing_digests_are_recovered(spark, monkeypatch):
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64).tolist()
    rows = []
    for n, gone, more in [(0, 0, 0), (0, 0, 9), (5, 0, 0), (5, 5, 0), (40, 3, 0), (40, 40, 40), (400, 390, 700), (3000, 1000, 1), *[(20, 20, 20)] * 40]:
        base = draw(n)
        rows.append((len(rows), base, base[gone:] + draw(more)))
    pairs = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")
    for few in (False, True):
        if few:  # so few cells that many pairs need several tries
            monkeypatch.setattr(fingerprints, "RETRY_CELLS", 0.3)
        got = {r["pair"]: r for r in fingerprints.differences(pairs).collect()}
        assert len(got) == len(rows)
        for i, a, b in rows:
            r, a, b = got[i], set(a), set(b)
            assert (set(r["only_a"]), set(r["only_b"])) == (a - b, b - a) and (r["n_only_a"], r["n_only_b"]) == (len(a - b), len(b - a))
            assert r["likeness"] == (pytest.approx(len(a & b) / len(a | b)) if a | b else 1.0)
    assert fingerprints.differences(pairs.limit(0)).count() == 0


def test_versions_of_very_long_texts(spark):
    lines = [f"line number {i} of a long text" for i in range(100_000)]
    texts = {3: "\n".join(lines), 2: "\n".join(lines[10_000:] + ["one more"]), 1: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.compare_versions(docs).collect()}
    assert got[3]["near_next"] == pytest.approx(90_000 / 100_001) and got[2]["near_next"] == 0.0 and got[1]["near_next"] == 0.0
    edited = texts[3][: len(texts[3]) - len(texts[3]) // 3] + texts[2][: len(texts[3]) // 3]
    assert got[3]["near_edited"] == pytest.approx(len(pieces(texts[3]) & pieces(edited)) / len(pieces(texts[3]) | pieces(edited)))


def test_walk_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    docs = spark.range(100).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next_text(docs).collect()}
    assert got == {f"t{i}": f"t{(i - 1) % 100}" for i in range(100)}


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 14 <= len(digits) <= 19 and pii.luhn(digits)
            elif kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, small):
    got = {r["doc_id"]: r for r in queries.op7_pii(spark, SF).collect()}
    found = 0
    for r in small.collect():
        want = plain_base(r["text"] or "")
        found += len(want)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
        assert set(want) <= set(g["spans"].split(","))
    assert found > 0


@pytest.mark.parametrize("text", [
    "a@b.c.d@e.f g.h@@i.j @k.l x@y m@n.o-", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004 1..2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000 12 3-4", "+1 (555) 010-9999, +49.30.1234567890123456 +1+2 5555555555 +12",
    "é+a@ü.de ñ a@b.de\n+44 20 7946 0958\n", "a" * 3000 + "@", "1" * 3000, "1." * 2000, "@" * 500 + "a.b"])
def test_base_patterns(text):
    assert [f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)] == plain_base(text)


def test_added_kinds_and_redaction(spark, edge, nothing):
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"] and kinds("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("my social security number is 536-90-4399") == ["ssn"] and kinds("part 536-90-4399") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == ["secret"] and kinds("plain words only") == []
    docs = spark.createDataFrame([(1, "mail a@b.de or call +1 555 010 9999"), (2, None), (3, "")], "spans long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("spans").collect()] == ["mail <EMAIL> or call <PHONE>", None, ""]
    assert pii.find_pii(edge).count() == edge.count() and pii.find_pii(nothing).count() == 0


def test_long_secrets_and_ibans_before_other_groups(spark):
    values = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.find_spans(t)]
    for n in (20, 180, 200, 201, 240, 5000):
        key = ("aB3dE5fG7hJ9kL1m" * n)[:n]
        assert values(f"api key {key}, keep it") == [("secret", key)]
    docs = spark.createDataFrame([("api key " + "aB3dE5fG7hJ9kL1m" * 15,)], "text string")
    assert pii.redact(docs).head()[0] == "api key <SECRET>"
    be, at, de = "BE68539007547034", "AT611904300234573201", "DE89 3704 0044 0532 0130 00"
    assert values(f"{be} EUR") == [("iban", be)] and values(f"{at} CODE") == [("iban", at)] and values(f"{de} EUR 12") == [("iban", de)]
    assert values(f"{be} {de}") == [("iban", be), ("iban", de)] and values(f"AB12 3456 7890 {de}") == [("iban", de)]
    assert values("BE68539007547035 EUR") == []


def test_many_spans_in_a_long_text(edge, nothing):
    text = " ".join(f"a{i}@b.de ssn 536-90-{i % 9000 + 1000} api key aB3dE5fG7hJ9kL1m{i:06d} 10.0.0.{i % 256}" for i in range(20_000))
    spans = pii.find_spans(text)
    count = Counter(s.kind for s in spans)
    assert count["email"] == count["ip"] == count["ssn"] == count["secret"] == 20_000 and all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    assert pii.redact(edge).columns == edge.columns and pii.redact(nothing).count() == 0


def test_taken_places():
    rng = random.Random(2)
    spans = [(a, a + rng.randrange(1, 9)) for a in rng.sample(range(300), 40)]
    taken = pii.Taken(spans)
    for a in range(300):
        for n in (1, 4, 12):
            assert taken.free(a, a + n) == (not any(x < a + n and a < y for x, y in spans))
            if taken.free(a, a + n) and rng.random() < 0.1:
                taken.add(a, a + n)
                spans.append((a, a + n))


def test_quality_of_repeated_ids(spark):
    rows = [(1, "Good prose stands here, and more of it."), (1, "!!! ### $$$ %%%"), (2, "@@@ |||| ####"), (3, "Another good line of words."), (3, "Another good line of words."), (4, "|||| ~~~~ ||||")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality.train(d, labels, rows=3) for d in (docs, docs.repartition(3).unionByName(docs)))
    assert a.weight.tolist() == b.weight.tolist() and (a.slope, a.shift, a.prior) == (b.slope, b.shift, b.prior)


# token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


SHORT = ["don't I'll we've you're he'd I'm it's", "''s 's's 'sx 'llama 're've 'd'd'", "d'une l'été qu'il O'Neil's \"'s\" 'T 'LL 'Re'", "1's 22'll3 a1b2 x--y...z't", "ÀÉÎõü×÷ÿß'sÉ çà'Tà ü1é 'é", "a<|b <|endoftext|>x</w> <b|c", "…'s “don't” naïve—café\u0301 e\u0301 =\u0338 A\u030a'S", "'", "''", "' 's", "x'", "x'l", "x'r'e", "a\x00b\x7fc\x1b'm"]
ODD = ["", None, " \n ", "a b c d", "Ünï é ́x don't it's'll 12 3", "x\x1cy\x85z", "<|endoftext|> hi<|startoftext|>", "\tA\rB\x0bC\x0cD", "ΣΑΣ Σ İ", "a" * 3000]


def test_pieces_equal_whole_texts(tokenizer, small):
    texts = ODD + SHORT + [r["text"] for r in small.limit(60).collect()]
    got = tokenstore.encode_texts(pa.array(texts), queries.tokenizer_path())
    assert [g.tolist() for g in got] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@given(st.lists(st.text(alphabet="stmdrevlaAÉßx'\"-1 \n<|.…\u0301", max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_units_equal_whole_texts(texts):
    tok = tokenstore._tokenizer(queries.tokenizer_path())
    assert [g.tolist() for g in tokenstore.encode_texts(pa.array(texts, pa.string()), queries.tokenizer_path())] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for t in ODD + SHORT if t is not None]
    assert [g.tolist() for g in tokenstore.encode_texts(pa.array(texts), path)] == [[*tokenstore._tokenizer(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_piece_cache_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenstore.UnitIds, "MOST", 5)
    monkeypatch.setattr(tokenstore, "_loaded", {})
    texts = [f"word{i} word{i + 1} again" for i in range(30)]
    for t in texts:
        assert tokenstore.encode_texts(pa.array([t]), queries.tokenizer_path())[0].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_store_round_trip(spark, edge, nothing, tokenizer, tmp_path):
    path = str(tmp_path / "store")
    tokenstore.write_store(edge, path, queries.tokenizer_path())
    rows = tokenstore.read_store(spark, path).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] is not None and r["doc_id"] for r in rows] == sorted((r[0] is not None and r[0] for r in edge_rows()))
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert sorted((str(r["doc_id"]), r["ids_crc32"], bytes(r["ids"])) for r in rows) == sorted((str(i), zlib.crc32(ids(t)), ids(t)) for i, t, *_ in edge_rows())
    assert tokenstore.read_document(spark, path, 17) == [np.frombuffer(ids("one two three four five"), "<u4").tolist()]
    assert len(tokenstore.read_document(spark, path, 4)) == 2 and tokenstore.read_document(spark, path, 999) == []
    assert tokenstore.token_files(nothing, queries.tokenizer_path()).count() == 0
