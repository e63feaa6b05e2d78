"""Language identification: known words by per-language log frequency, unseen words by ever shorter character n-grams.

Counts are taken over all training rows, and every counted word and n-gram is known. The most frequent ones, at most ``HELD``
scores of each length over all languages together, go to all workers; the rest stay in a table, and the words of the documents
that need them are joined to it. Where a count is kept changes no score. An unseen word is scored by its n-grams of the longest length of which at least one is
known. Words and n-grams are named by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlattice.llm.common import batches_of, count_level, least_level, materialize, return_memory, span_hashes, text_bytes, text_rows

#: Scores of words, and of n-grams of each length, that every worker holds: those of the most frequent ones, an entry having one
#: for each language. What is broadcast so has the same bound for any number of languages.
HELD = 1 << 20
LONGEST = 5
#: Added to every count of a known entry, so that a language that lacks it isn't ruled out.
SMOOTH = 0.5
UNDETERMINED = "und"
#: Words whose n-grams are counted at once, and counted n-grams of a length that a task gathers before it passes them on.
CHUNK_WORDS, GATHERED = 1 << 17, 1 << 20


class LanguageModel:
    """``held``: for each length (0: words) ascending hashes and a row of scores for each; ``rest`` (length, h, score) is the
    table of the others; None: there are none."""

    def __init__(self, languages: list[str], held: list[tuple[np.ndarray, np.ndarray]], rest: DataFrame | None = None) -> None:
        self.languages, self.held, self.rest = languages, held, rest

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def look(self, length: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the held scores, whether it is there) of each hash."""
        known = self.held[length][0]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)

    def gram_sums(self, words: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word the number of its held n-grams and the sum of their scores; hash and word of the n-grams that aren't held."""
        keys, word = gram_hashes(words, length)
        at, hit = self.look(length, keys)
        hits = np.bincount(word[hit], minlength=len(words))
        sums = np.stack([np.bincount(word[hit], self.held[length][1][at[hit], j], len(words)) for j in range(len(self.languages))], axis=1).astype(np.float64) if len(self.languages) else np.zeros((len(words), 0))
        return hits, sums, keys[~hit], word[~hit]

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Log frequency of each word in each language, from the held entries; nothing known: zeros."""
        out = np.zeros((len(words), len(self.languages)))
        at, hit = self.look(0, hashes(words))
        out[hit] = self.held[0][1][at[hit]]
        todo = np.flatnonzero(~hit)
        for n in range(LONGEST, 0, -1):
            if not len(todo):
                break
            hits, sums, _, _ = self.gram_sums(words.take(pa.array(todo)), n)
            found = hits > 0
            out[todo[found]] = sums[found] / hits[found, None]
            todo = todo[~found]
        return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word of each place, row of each place): lower-cased maximal runs of letters. The empty string stands for none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}]+")
    words = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(at))


def hashes(units: pa.Array) -> np.ndarray:
    raw, at = text_bytes(units)
    return span_hashes(raw, at[:-1], at[1:])


def gram_hashes(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word of every n-gram of code points of the words, each with a mark at its start and its end."""
    first, last, nothing = (pa.scalar(x, pa.large_string()) for x in ("\x02", "\x03", ""))
    raw, at = text_bytes(pc.binary_join_element_wise(first, words.cast(pa.large_string()), last, nothing))
    point = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first = np.searchsorted(point, at)
    word = np.repeat(np.arange(len(words)), np.diff(first))
    start = np.flatnonzero(np.arange(len(word)) + n <= first[1:][word])
    return span_hashes(raw, point[start], point[start + n]), word[start]


def word_counts(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, unit, n) over every row with a language and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        for b in batches_of(batches, "text", 8 << 20):
            words, code, row = words_of(b.column("text"))
            lang = b.column("lang").dictionary_encode()
            pair, n = np.unique(lang.indices.to_numpy()[row].astype(np.int64) * len(words) + code, return_counts=True)
            out = pa.RecordBatch.from_pydict({"lang": lang.dictionary.take(pa.array(pair // max(len(words), 1))), "unit": words.take(pa.array(pair % max(len(words), 1))).cast(pa.string()), "n": pa.array(n, pa.int64())})
            yield out.filter(pc.not_equal(out.column("unit"), ""))

    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return text_rows(known, F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, code = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(code, n[:, j], len(keys)) for j in range(n.shape[1])], axis=1)


def unit_counts(counts: DataFrame, languages: list[str]) -> DataFrame:
    """(length, h, n0, n1, ..): every word (length 0) and n-gram with its count in each language. The n-grams come from the
    distinct words, each as often as the word."""
    k, place = len(languages), {lang: i for i, lang in enumerate(languages)}
    names = [f"n{i}" for i in range(k)]

    def rows(length: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length, np.int32)), pa.array(keys.view(np.int64)), *[pa.array(n[:, i].astype(np.int64)) for i in range(k)]], ["length", "h", *names])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK_WORDS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held).combine_chunks()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return_memory()
        gathered = [(np.zeros(0, np.uint64), np.zeros((0, k))) for _ in range(LONGEST + 1)]
        for t in chunks(batches):
            words = t.column("unit").combine_chunks()
            n = np.zeros((len(words), k))
            n[np.arange(len(words)), [place[lang] for lang in t.column("lang").to_pylist()]] = t.column("n").to_numpy()
            yield rows(0, *_summed(hashes(words), n))
            for length in range(1, LONGEST + 1):
                keys, word = gram_hashes(words, length)
                more = _summed(keys, n[word])
                old = gathered[length]
                gathered[length] = _summed(np.concatenate([old[0], more[0]]), np.concatenate([old[1], more[1]]))
                if len(gathered[length][0]) >= GATHERED:
                    yield rows(length, *gathered[length])
                    gathered[length] = (np.zeros(0, np.uint64), np.zeros((0, k)))
        for length in range(1, LONGEST + 1):
            yield rows(length, *gathered[length])

    out = counts.mapInArrow(count, "length int, h long" + "".join(f", {n} long" for n in names))
    return out.groupBy("length", "h").agg(*[F.sum(n).alias(n) for n in names])


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", held: int = HELD) -> LanguageModel:
    """Count the words and n-grams of every row with a language and a text. Other rows teach nothing; repeated rows count each
    time; an empty table gives a model without languages. ``held``: scores of each length that workers hold, so ``held`` over
    the number of languages are entries; under that number all entries stay in the table."""
    counts = materialize(word_counts(rows, lang_col, text_col), "word-counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    k = len(languages)
    if not k:
        return LanguageModel([], [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * (LONGEST + 1))
    names = [f"n{i}" for i in range(k)]
    units = materialize(unit_counts(counts, languages), "unit-counts")
    both = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    # a few hundred rows: how many units of each length have how high a count
    steps = units.groupBy("length", count_level(both).alias("level")).agg(F.count("*").alias("units"), *[F.sum(n).alias(n) for n in names]).collect()
    bases, least = [], []
    for length in range(LONGEST + 1):
        mine = [r for r in steps if r["length"] == length]
        bases.append(np.array([sum(r[n] for r in mine) for n in names]) + SMOOTH * max(1, sum(r["units"] for r in mine)))
        least.append(least_level({r["level"]: r["units"] for r in mine}, held // k))
    sent = count_level(both) >= F.element_at(F.array(*map(F.lit, least)), F.col("length") + 1)
    near = units.where(sent).select("length", "h", *names).toArrow()  # at most ``held // k`` of each length
    tables = []
    for length, base in enumerate(bases):
        t = near.filter(pc.equal(near.column("length"), length))
        keys = t.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        n = np.stack([t.column(c).to_numpy() for c in names], axis=1)[order]
        tables.append((keys[order], np.log((n + SMOOTH) / base)))
    rest = None
    if len(near) < sum(r["units"] for r in steps):
        base = F.element_at(F.array(*[F.array(*map(F.lit, b.tolist())) for b in bases]), F.col("length") + 1)
        rest = units.where(~sent).select("length", "h", F.array(*[F.log((F.col(n) + SMOOTH) / base[i]) for i, n in enumerate(names)]).alias("score"))
    return LanguageModel(languages, tables, rest)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language with the highest summed word score, and its share among the languages.

    Null text, or a text without letters: ``und`` and 0. Nothing in the text known: the first language by name, and an equal
    share. A model without languages answers ``und``. Equal scores go to the first language by name. Rows that repeat are each
    answered, null ids too; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    local, k = model.rest is None, len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches_of(batches, "text", 8 << 20):
            words, code, row = words_of(b.column("text"))
            letters = hashes(words) != hashes(pa.array([""]))[0]
            if local:
                scores, later = model.word_scores(words), np.zeros(len(words), bool)
            else:
                at, hit = model.look(0, hashes(words))
                scores, later = np.zeros((len(words), k)), letters & ~hit
                scores[hit] = model.held[0][1][at[hit]]
            scores[~letters] = 0
            total = np.stack([np.bincount(row, scores[code, j], b.num_rows) for j in range(k)], axis=1) if k else np.zeros((b.num_rows, 1))
            any_letter = np.bincount(row, letters[code], b.num_rows) > 0
            if not local:
                pair, times = np.unique(row[later[code]] * max(len(words), 1) + code[later[code]], return_counts=True)
                each = np.concatenate([[0], np.cumsum(np.bincount(pair // max(len(words), 1), minlength=b.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id"), "letters": pa.array(any_letter), "total": pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), k).cast(pa.list_(pa.float64())),
                    "words": pa.ListArray.from_arrays(each, words.take(pa.array(pair % max(len(words), 1))).cast(pa.string())), "times": pa.ListArray.from_arrays(each, pa.array(times, pa.int64())),
                })
                continue
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            decided = any_letter & (k > 0)
            names = np.array([*model.languages, UNDETERMINED], object)[np.where(decided, best, k)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(decided, share, 0.0))})

    rows = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if local:
        return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    rows = rows.mapInArrow(run, "doc_id long, letters boolean, total array<double>, words array<string>, times array<bigint>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows")
    used = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    scores = _looked_up(used.select("word").distinct(), model, shared)
    more = used.join(scores, "word").groupBy("row").agg(*[F.sum(F.col("times") * F.col("score")[i]).alias(f"s{i}") for i in range(k)])
    total = F.array(*[F.col("total")[i] + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(k)])
    rows = rows.drop("words", "times").join(more, "row", "left").select("doc_id", "letters", total.alias("total")).withColumn("most", F.array_max("total"))
    name = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("total", F.col("most")).cast("int"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda a, t: a + F.exp(t - F.col("most")))
    return rows.select("doc_id", F.when(F.col("letters"), name).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))


def _looked_up(words: DataFrame, model: LanguageModel, shared) -> DataFrame:
    """(word, score) of distinct words that aren't held, from the table of the rest; words of which nothing is known are left out."""
    k = len(model.languages)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(hashes(b.column("word")).view(np.int64))], ["word", "h"])

    known = model.rest.where("length = 0").select("h", "score")
    looked = materialize(words.mapInArrow(named, "word string, h long").join(known, "h", "left").select("word", "score"), "looked-up-words")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            words = b.column("word")
            for n in range(LONGEST, 0, -1):
                hits, sums, keys, word = model.gram_sums(words, n)
                each = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    words, pa.array(np.full(len(words), n, np.int32)), pa.array(hits.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), k).cast(pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(each, pa.array(keys.view(np.int64)))], ["word", "length", "hits", "sum", "others"])
                words = words.filter(pa.array(hits == 0))  # else no shorter length can count
                if not len(words):
                    break

    cut = materialize(looked.where("score is null").select("word").mapInArrow(grams, "word string, length int, hits long, sum array<double>, others array<long>"), "word-grams")
    others = cut.select("word", "length", F.explode("others").alias("h")).join(model.rest, ["length", "h"]).select("word", "length", F.lit(1).cast("long").alias("hits"), F.col("score").alias("sum"))
    both = cut.select("word", "length", "hits", "sum").unionByName(others)
    both = both.groupBy("word", "length").agg(F.sum("hits").alias("hits"), *[F.sum(F.col("sum")[i]).alias(f"s{i}") for i in range(k)]).where("hits > 0")
    mean = F.array(*[F.col(f"s{i}") / F.col("hits") for i in range(k)])
    return looked.where("score is not null").unionByName(both.groupBy("word").agg(F.max_by(mean, "length").alias("score")))
