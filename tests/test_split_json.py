"""Arrays and objects split at any byte."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.sources import io
from seqlattice.sources import split_json as sj

HARD = ['}', ']', '[{', '\\', '\\\\', '"', '\\"', 'a"}]', '{"x": [1]}', ',', '\n', '\\\\"', 'é}ß]', '\t ', '']


def hard_rows(n, seed=1):
    rng = random.Random(seed)
    return [{"i": i, "t": "".join(rng.choice(HARD) for _ in range(rng.randrange(6))), "a": [{"v": rng.choice(HARD)} for _ in range(rng.randrange(3))]} for i in range(n)]


def test_escapes_of_every_text():
    rng = random.Random(3)
    for _ in range(500):
        text, pending = bytes(rng.choice(b'\\\\"x') for _ in range(rng.randrange(9))), rng.random() < 0.5
        want, now = [], pending
        for c in text:
            want.append(now)
            now = c == 92 and not now
        got, after = sj.escapes(np.frombuffer(text, np.uint8), pending)
        assert got.tolist() == want and after == now


def test_states_compose_at_every_cut():
    """Following two halves one after the other is following the whole, from whatever state the second begins in."""
    text = json.dumps(hard_rows(6), ensure_ascii=False).encode()
    whole = sj.Walk(False, False)
    whole.follow(np.frombuffer(text, np.uint8))
    assert (whole.inside, whole.depth) == (False, 0)
    for cut in range(len(text) + 1):
        first = sj.Walk(False, False)
        first.follow(np.frombuffer(text[:cut], np.uint8))
        assert (first.inside, first.pending) in sj.STATES
        rest = sj.Walk(first.inside, first.pending)
        rest.follow(np.frombuffer(text[cut:], np.uint8))
        assert (rest.inside, first.depth + rest.depth) == (False, 0)
        borders = first.borders.get(1, 0) + rest.borders.get(1 - first.depth, 0)
        assert borders == whole.borders[1] == 7


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]

    def of(size):
        for k, v in zip(keys, (size, 1, 1)):
            spark.conf.set(k, v)

    yield of
    for k, v in zip(keys, before):
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


KIND = "i long, t string, a array<struct<v:string>>"


def as_rows(df):
    return sorted((r["i"], r["t"], [x["v"] for x in r["a"]]) for r in df.collect())


@pytest.mark.parametrize("size,indent", [(7, None), (50, 1), (333, None), (100_000, 1)])
def test_arrays_in_ranges(spark, tmp_path, small_ranges, size, indent):
    rows = hard_rows(8 if size < 100 else 100, size)
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(("\n " if k else "") + json.dumps(rows[k::2], ensure_ascii=False, indent=indent) + ("\n" if k else ""))
    small_ranges(size)
    got = io.read_json_array(spark, str(tmp_path), KIND, mark="}")
    assert as_rows(got) == sorted((r["i"], r["t"], [x["v"] for x in r["a"]]) for r in rows) == as_rows(io.read_json_array(spark, str(tmp_path), KIND))
    items = sj.split_items(spark, str(tmp_path / "0.json"), "}")
    assert [json.loads(r["text"]) for r in items.orderBy("item").collect()] == rows[::2]


def test_lists_and_scalars_in_ranges(spark, tmp_path, small_ranges):
    small_ranges(19)
    for k, value in enumerate([[["a", "b]"], [], ["c"]], [], [[]], [1, 2.5, None, "x,]", True], [[[1], [2]], [[3]]]]):
        for end, mark in (("", "]"), ("\n", "]"), ("", "}")):
            path = tmp_path / f"{k}{len(end)}{ord(mark)}.json"
            path.write_text(json.dumps(value) + end)
            assert [json.loads(r["text"]) for r in sj.split_items(spark, str(path), mark).orderBy("item").collect()] == value


def test_maps_in_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    sims = {str([f"p{i}", f"q{i}]"]): [[1.0], [rng.random()], [rng.random(), rng.random()]] for i in range(20)} | {"no list": [[1.0]], "{}": []}
    (tmp_path / "s.json").write_text(json.dumps(sims))
    small_ranges(97)
    got = {str(r["img_paths"]): r["triangle"] for r in io.read_similarity_map(spark, str(tmp_path / "s.json")).collect()}
    assert got == {k: v for k, v in sims.items() if k[0] == "["}
    (tmp_path / "e.json").write_text("{}")
    assert io.read_similarity_map(spark, str(tmp_path / "e.json")).collect() == []


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '[{"a": 1},', '[{"a": 1}] x', '{"a": 1}', '[{"a": "1}]', '[{"a": 1}][{"a": 2}]', '[{"a": 1},,{"a": 2}]', '[{"a": 1}, nonsense]', "[[{", '[,{"a": 1}]'])
def test_broken_arrays_fail(spark, tmp_path, small_ranges, text):
    small_ranges(9)
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(Exception):
        io.read_json_array(spark, str(tmp_path / "b.json"), "a int", mark="}").collect()


def test_empty_files(spark, tmp_path):
    for k, text in enumerate(["", " \n", "[]", "[ \n ]", "﻿[]"]):
        (tmp_path / f"{k}.json").write_text(text)
    assert io.read_json_array(spark, str(tmp_path), "a int", mark="}").collect() == []


def test_a_large_array_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    path = str(tmp_path / "large")
    n = 200_000
    body = spark.range(n).select(F.concat(F.when(F.col("id") == 0, "[").otherwise(","), F.lit('{"i": '), "id", F.lit(', "t": "'), F.repeat(F.lit("ab} "), 20), F.lit('"}'), F.when(F.col("id") == n - 1, "]").otherwise("")).alias("value"))
    body.coalesce(1).write.text(path)
    small_ranges(2 << 20)
    df = io.read_json_array(spark, path, "i long, t string", mark="}")
    read = df.select(F.spark_partition_id().alias("p"), "i").groupBy("p").agg(F.count("*").alias("n"), F.sum("i").alias("s")).collect()
    assert sum(r["n"] for r in read) == n and sum(r["s"] for r in read) == n * (n - 1) // 2 and len(read) >= 8 and max(r["n"] for r in read) < n / 4
