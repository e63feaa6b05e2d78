"""Edge rules on small inline rows."""

import math

import pytest
from pyspark.sql import functions as F

from seqlattice.functions import images as im
from seqlattice.functions import text as tx
from seqlattice.functions import vectors as vec
from seqlattice.operators import budgets as bg
from seqlattice.operators import evaluate as ev
from seqlattice.operators import inference as inf
from seqlattice.operators import layout as ly
from seqlattice.operators import merging as mg
from seqlattice.operators import quantize as qz
from seqlattice.operators import similarity as sim
from seqlattice.sources import io
from seqlattice.streaming.operators import next_budget

IMAGES = "array<struct<id:string,path:string>>"
SAMPLE = f"id string, messages array<struct<role:string,content:string>>, input_images {IMAGES}, output_images {IMAGES}"


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (int, float, str)) else F.lit(v))
    return df.select(column.alias("x")).head()["x"]


def sample(spark, content, inputs, outputs=()):
    return spark.createDataFrame([("s", None if content is None else [("user", c) for c in content], inputs, list(outputs))], SAMPLE)


def test_grammars_and_missing_images(spark):
    df = sample(spark, ["<input_image_2> <x1> <input_image_9>"], [("input_image_2", "p2"), ("x1", "px")])
    m = im.image_map(F.col("input_images"), F.col("output_images"))
    tokens = im.image_tokens(F.col("messages"))
    assert df.select(im.resolve_images(tokens, m)).head()[0] == ["p2", "px"]
    assert df.select(im.resolve_images(tokens, m, "null")).head()[0] == ["p2", "px", None]
    merged = mg.sample_paths(df).head()
    assert merged["_error"] == "Missing image id: input_image_9" and merged["img_paths"] is None
    with pytest.raises(Exception, match="Missing image id"):
        df.select(im.resolve_images(tokens, m, "error")).collect()


def test_output_images_win_and_last_wins(spark):
    df = sample(spark, ["<a>"], [("a", "p1"), ("b", "q1"), ("b", "q2"), (None, "z")], [("a", "p2")])
    assert df.select(im.image_map(F.col("input_images"), F.col("output_images"))).head()[0] == {"a": "p2", "b": "q2"}


def test_null_lists_and_contents(spark):
    df = sample(spark, [None, "<a>"], None, [("a", "p")])
    assert df.select(im.resolve_images(im.image_tokens(F.col("messages")), im.image_map(F.col("input_images"), F.col("output_images")))).head()[0] == ["p"]
    assert mg.sample_paths(df).head()["_error"] == "message without text"
    assert sample(spark, None, None).select(im.image_tokens(F.col("messages"))).head()[0] == []


RULE = bg.Rule(0.8, ((0.0, 0.3, 100), (0.3, 0.5, 81), (0.6, 0.9, 9)))


@pytest.mark.parametrize("x,want", [(0.0, 100), (0.3, 81), (0.9, 9), (-1.0, 100), (2.0, 9), (0.55, 9), (math.nan, 9), (0.8999, 9), (0.29, 100)])
def test_interval_edges(spark, x, want):
    assert one(spark, bg.budget_column(F.col("v"), RULE), v=F.lit(x)) == want
    assert next_budget([x], [144], RULE) == want
    table = spark.createDataFrame([("r", 0.8, a, b, float(n)) for a, b, n in RULE.intervals], "scheme string, alpha double, tsim_left double, tsim_right double, budget double")
    assert bg.budget_for_tsim(spark.createDataFrame([(x,)], "tsim double"), bg.interval_table(table)).head()["budget"] == want


@pytest.mark.parametrize("x,want", [(-0.2, 100), (0.5, 100), (0.9, 81), (0.95, 49), (0.99, 49), (0.995, 9), (1.0009765625, 9), (1.1, 9)])
def test_published_rule(spark, x, want):
    assert bg.PUBLISHED.monotone and one(spark, bg.budget_column(F.col("v"), bg.PUBLISHED), v=F.lit(x)) == want


def test_missing_and_half_budgets(spark):
    raw = spark.createDataFrame([("a", 0.8, 0.0, 0.5, 80.5), ("a", 0.8, 0.5, 1.0, None)], "scheme string, alpha double, tsim_left double, tsim_right double, budget double")
    assert [r["budget"] for r in bg.interval_table(raw).orderBy("left").collect()] == [80, 9]


def test_rising_budgets_skip_the_scheme(spark):
    raw = spark.createDataFrame([("up", 0.8, 0.0, 0.5, 49.0), ("up", 0.8, 0.5, 1.0, 81.0), ("ok", 0.8, 0.0, 1.0, 9.0)], "scheme string, alpha double, tsim_left double, tsim_right double, budget double")
    assert [r[0] for r in bg.monotone_schemes(bg.interval_table(raw)).collect()] == ["ok"]
    with pytest.raises(ValueError):
        bg.allocate_column(F.col("t"), bg.Rule(0.8, ((0.0, 0.5, 49), (0.5, 1.0, 81))))


def test_monotone_schemes_of_large_ids(spark, tmp_path):
    from seqlattice.plans.queries import QUERIES

    falls, rises = (6, 6, 4, 0), (6, 2, 0, 3)  # max(doc_id % 7) of slots of one document each
    ids = lambda first, budgets: [next(i for i in range(first + 20 * k, first + 20 * k + 20) if i % 7 == b) for k, b in enumerate(budgets)]
    rows = [(i, "late") for i in ids(40000, falls)] + [(i, "low") for i in ids(100, falls)] + [(i, "rises late") for i in ids(19940, rises)] + [(i, None) for i in ids(60000, rises)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r[0] for r in QUERIES["x2_monotone_schemes"](spark, str(tmp_path)).collect()) == ["late", "low"]


def test_sequences_of_large_labels(spark, tmp_path):
    from seqlattice.plans import fixtures as fx

    rows = [(i, int(i >= 8100), [1.0]) for i in range(8120)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = fx.states(spark, str(tmp_path)).withColumn("of", fx.label_of(F.col("seq_id"))).collect()
    assert len(got) == 8120 == len({(r["seq_id"], r["pos"]) for r in got}) and all(r["of"] == r["label"] for r in got)
    assert len({r["seq_id"] for r in got}) == 1013 + 3
    assert all(r["seq_id"] == (r["vec_id"] // 8 if r["label"] == 0 else 1000 + (r["vec_id"] - 8100) // 8) for r in got if r["vec_id"] < 8000 or r["label"])


def test_sequence_lengths(spark):
    states = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0])], "seq_id long, pos int, vector array<double>")
    for short in (64, 1):
        got = {r["seq_id"]: r["num_tokens"] for r in bg.allocate_budgets(sim.similarity_triangles(states, short=short), RULE).collect()}
        assert (short, got) == (short, {1: [144], 2: [144, 9]})
    assert one(spark, bg.allocate_column(F.array().cast("array<array<double>>"), RULE)) == []


def test_weighted_mean(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vec.ew_weighted_mean(arr(0.5, 1.0), arr(0, 0), 0.8)) == 0.0
    assert one(spark, vec.ew_weighted_mean(F.array().cast("array<double>"), arr(1), 0.8)) is None
    assert one(spark, vec.ew_weighted_mean(arr(0.5, 1.0), arr(144, 9), 0.8)) == pytest.approx((0.5 * 0.8 * 144 + 9) / (0.8 * 144 + 9))


def test_later_budgets_win_even_null(spark):
    df = spark.createDataFrame([(["a"], [1], 0), (["a"], [2], 1), (["b"], [3], 0), (["b"], None, 1)], "img_paths array<string>, num_tokens array<int>, ord int")
    assert {r["img_paths"][0]: r["num_tokens"] for r in mg.dedupe_last(df, ["img_paths"], "ord").collect()} == {"a": [2], "b": None}


def test_null_budget_counts_nowhere(spark):
    samples = spark.createDataFrame([(["a"], None), (["b"], None), (["c"], None), (None, "bad")], "img_paths array<string>, _error string").withColumn("d", F.lit(1))
    budgets = spark.createDataFrame([(["a"], [144]), (["b"], None)], "img_paths array<string>, num_tokens array<int>")
    s = mg.merge_stats(mg.merge_budgets(samples, budgets), ["d"]).head()
    assert (s["samples"], s["matched"], s["token_not_found"], s["errors"]) == (4, 1, 1, 1)


@pytest.mark.parametrize("text,want", [
    ("x\n\nFinal Answer: 7 \n", "7"), ("x\n\nFinal Answer:  ", ""), ("x\n\nFinal Answer: a\n\nFinal Answer: b", "a\n\nFinal Answer: b"), ("x. Final Answer: 17.", None), ("x\nFinal Answer: 1", None)])
def test_final_answer(spark, text, want):
    assert one(spark, tx.final_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize("name,want", [(None, "unknown_benchmark"), ("  ", "unknown_benchmark"), ("a b/ç-_.", "a_b_ç-_."), ("x" * 130, "x" * 120)])
def test_safe_name(spark, name, want):
    assert one(spark, tx.safe_name(F.col("t")), t=F.lit(name).cast("string")) == want


def test_budget_resolution(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    none = F.lit(None).cast("array<int>")
    resolve = lambda given, routed, n, pad=False: one(spark, inf.resolve_budgets(given, routed, F.lit("k"), F.lit(n), pad))
    assert resolve(arr(1, 2, 3), none, 3) == [1, 2]
    assert resolve(arr(1), none, 3) == [1]
    padded = resolve(arr(1), none, 4, True)
    assert padded[0] == 1 and len(padded) == 3 and set(padded[1:]) <= set(inf.BUDGETS)
    assert resolve(none, arr(81), 2) == [81]
    assert len(resolve(none, none, 3)) == 2 and resolve(none, none, 1) == []
    assert one(spark, inf.usable_budgets(arr(144, 100, 81), F.lit(2))) == [100]
    with pytest.raises(Exception, match="no budgets"):
        one(spark, inf.usable_budgets(none, F.lit(2), strict=True))


def test_order_and_parts(spark):
    part = spark.createDataFrame([(2, "b"), (1, "a")], "_global_idx long, v string")
    assert [r["v"] for r in mg.restore_order(part).collect()] == ["a", "b"]
    open_ = part.unionByName(spark.createDataFrame([(None, "c")], "_global_idx long, v string"))
    assert mg.restore_order(open_).columns == ["v"] and mg.restore_order(open_).count() == 3
    a, b = (mg.seeded_shuffle(part, ["v"], s).collect() for s in (1, 1))
    assert a == b
    assert [r["position"] for r in mg.row_position(spark.range(10), ["id"]).orderBy("id").collect()] == list(range(10))


def test_error_policies(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1,), (2,)], "v int")
    bad = F.when(F.col("v") == 2, F.lit("two"))
    seen = Observation()
    assert mg.with_error_policy(df, bad, "skip", seen).count() == 1 and seen.get["skipped"] == 1
    assert mg.with_error_policy(df, bad, "record").where("_error = 'two'").count() == 1
    with pytest.raises(Exception, match="two"):
        mg.with_error_policy(df, bad, "fail").collect()


def test_readers(spark, tmp_path):
    lines, array, empty = tmp_path / "l.json", tmp_path / "a.json", tmp_path / "e.json"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    array.write_text('\n [{"a": 1},\n {"a": 2}]')
    empty.write_text("\n")
    assert io.detect_format(spark, str(lines)) == "jsonl" and io.detect_format(spark, str(array)) == "array"
    for p in (lines, array):
        assert sorted(r["a"] for r in io.read_samples(spark, str(p), "a int").collect()) == [1, 2]
    with pytest.raises(ValueError):
        io.detect_format(spark, str(empty))
    bad = tmp_path / "b.json"
    bad.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(bad), "a int").collect()
    rule = tmp_path / "rule.json"
    rule.write_text('{"config": {"alpha": 0.7}, "tsim_intervals": [{"tsim_left": 0.5, "tsim_right": 1.0, "other": 3}, {"tsim_left": 0.0, "tsim_right": 0.5}]}')
    table = bg.interval_table(io.read_intervals(spark, [str(rule)], "other"))
    assert bg.read_rule(table, "rule") == bg.Rule(0.7, ((0.0, 0.5, 9), (0.5, 1.0, 3)))
    sims = tmp_path / "sims.json"
    sims.write_text('{"[\'a\', \'b\']":\n  [[1.0],\n [0.5]], "no list": [[1.0]]}')
    assert [(r["img_paths"], r["triangle"]) for r in io.read_similarity_map(spark, str(sims)).collect()] == [(["a", "b"], [[1.0], [0.5]])]


def test_parts_and_missing_ranks(spark, tmp_path):
    for r in (0, 2, 10):
        (tmp_path / f"result_part_rank{r}.json").write_text(f'[{{"v": {r}}}]')
    df = io.read_parts(spark, str(tmp_path), "v int")
    assert sorted((r["rank"], r["v"]) for r in df.collect()) == [(0, 0), (2, 2), (10, 10)]
    want = spark.range(3).select(F.col("id").cast("int").alias("rank"))
    assert [r["rank"] for r in mg.missing_parts(want, df).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        io.read_parts(spark, str(tmp_path), "v int", world_size=3, strict=True)


def test_parts_and_intervals_of_folders(spark, tmp_path):
    parts = spark.range(40).select(F.col("id").alias("_global_idx"))
    io.write_parts(parts.where("_global_idx % 12 <> 5"), str(tmp_path / "parts"), 12)
    (tmp_path / "parts" / "note.txt").write_text("no part")
    df = io.read_parts(spark, str(tmp_path / "parts"), "_global_idx long", world_size=12, array=False)
    assert sorted(map(tuple, df.select("rank", "_global_idx").collect())) == sorted((i % 12, i) for i in range(40) if i % 12 != 5)
    want = spark.range(12).select(F.col("id").cast("int").alias("rank"))
    assert [r["rank"] for r in mg.missing_parts(want, df).collect()] == [5]
    with pytest.raises(FileNotFoundError):
        io.read_parts(spark, str(tmp_path / "parts"), "_global_idx long", world_size=12, strict=True, array=False)
    for name in ("007", "a b"):
        (tmp_path / "rules" / f"label={name}").mkdir(parents=True)
        (tmp_path / "rules" / f"label={name}" / "part-0.json").write_text('{"config": {"alpha": 0.7}, "tsim_intervals": [{"tsim_left": 0.0, "tsim_right": 1.0, "budget": 3}]}')
    rules = io.read_intervals(spark, [str(tmp_path / "rules")], folder="label")
    assert sorted(map(tuple, rules.collect())) == [("007", 0.7, 0.0, 1.0, 3.0), ("a b", 0.7, 0.0, 1.0, 3.0)]


def test_files_grow_in_number(spark, tmp_path):
    from seqlattice.plans import file_queries as fq

    rows = spark.range(20000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = fq.s2(spark, str(tmp_path)).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in got) == 20000 and max(r["count"] for r in got) <= 1000


def test_codes(spark):
    book = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "code int, vec array<double>")
    vectors = spark.createDataFrame([(0, [3.0, 0.1]), (1, [0.0, 0.5])], "i int, vector array<double>")
    for f in (qz.nearest_code, qz.nearest_code_exact):
        assert [r["code"] for r in f(vectors, book).orderBy("i").collect()] == [0, 2]
    used = qz.codebook_usage(spark.createDataFrame([(0, 1), (1, 2)], "i int, code int"), 4, "i").head()
    assert used["used_codes"] == 3 and used["usage"] == 0.75
    parts = spark.createDataFrame([(1.0, 1), (4.0, 3)], "mse double, n_values long")
    assert qz.combined_error(parts).head()["mse"] == pytest.approx(13 / 4)


def test_layout(spark):
    seqs = spark.createDataFrame([(1, [144, 9])], "seq_id int, num_tokens array<int>")
    rows = [(r["segment"], r["kind"], r["start"]) for r in ly.sequence_layout(seqs, 4, merged=True, after_last=False).orderBy("place").collect()]
    assert rows == [(0, "image", 0), (0, "block", 144), (1, "image", 148)]
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    got = one(spark, ly.output_segments(arr(1, 2), arr(3, 4, 5), arr(1, 2), F.lit(0), F.lit(3)))
    assert [(s["codes"], s["count"]) for s in got] == [([1, 2, 16384], 3), ([3, 16384], 2), ([4, 5, 16384], 3)]
    got = one(spark, ly.output_segments(arr(1, 2), arr(3, 4, 5), arr(1, 2), F.lit(2), F.lit(1)))
    assert [s["codes"] for s in got] == [[4, 5, 16384]]
    assert one(spark, ly.output_segments(arr(1), arr(), arr(), F.lit(1), F.lit(0))) == []
    runs = spark.createDataFrame([(1, 0, "text", 5, 0, 0, 0), (1, 1, "image", 0, 1, 4, 8), (1, 2, "text", 2, 0, 0, 0)], "seq_id int, ord int, kind string, text_len int, t int, h int, w int")
    assert [(r["position"], r["delta"]) for r in ly.position_runs(runs).orderBy("ord").collect()] == [(0, -4), (5, -4), (9, -4)]
    frames = spark.createDataFrame([(1, 0), (1, 24), (1, 48)], "v int, i int")
    assert [r["seconds"] for r in ly.frame_timestamps(frames, "v", "i").orderBy("grp").collect()] == [0.5, 2.0]


def test_model_errors_are_recorded(spark):
    from pyspark.sql import types as T

    def model():
        return lambda row: {"out": 1 // row["v"]}

    df = spark.createDataFrame([(0,), (1,)], "v int")
    got = {r["v"]: (r["out"], r["_error"]) for r in inf.batch_generate(df, model, T.StructType([T.StructField("out", T.LongType())])).collect()}
    assert got[1] == (1, None) and got[0][1].startswith("ZeroDivisionError")


def test_judges(spark):
    judge = lambda d, k: one(spark, ev.judge_rule(F.lit(d), F.lit(k)))
    assert judge("VisuLogic", "MCQ") == ev.EXACT and judge("OlympiadBench", "VQA") is None and judge("EMMA", "VQA") == ev.JUDGE and judge("Other", "VQA") is None
    assert one(spark, ev.judge_rule(F.lit("EMMA"), F.lit("VQA"), override=F.lit("mine"))) == "mine"


def test_session_and_sliding_windows(spark):
    from seqlattice.streaming.operators import stream_run_log

    log = spark.createDataFrame([("2024-01-01 00:00:00", "b", None), ("2024-01-01 00:20:00", "b", "x"), ("2024-01-01 02:00:00", "b", None)], "timestamp string, benchmark string, error string").withColumn("timestamp", F.to_timestamp("timestamp"))
    assert sorted(r["records"] for r in stream_run_log(log, session="30 minutes").collect()) == [1, 2]
    assert stream_run_log(log, length="1 hour", slide="30 minutes").agg(F.sum("records")).head()[0] == 6


def test_first_and_later_images(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    got = one(spark, ly.split_first_rest(arr(*range(12)), arr(2, 0, 1, 3), 2))
    assert (got["first"], got["rest"]) == ([0, 1, 4, 5, 6, 7], [2, 3, 8, 9, 10, 11])
    with pytest.raises(Exception, match="differ in number"):
        one(spark, ly.split_first_rest(arr(1, 2, 3), arr(2), 2))


def test_names_with_tokens(spark, tmp_path):
    assert [io.with_tokens_name(n) for n in ("a/b.json", "x.y.jsonl")] == ["b_with_tokens.json", "x.y_with_tokens.jsonl"]
    with pytest.raises(ValueError, match="csv"):
        io.with_tokens_name("a.csv")
    df = spark.range(25).select(F.col("id").alias("v"), F.lit("a\nb").alias("t"))
    io.write_json_array(df.coalesce(1), str(tmp_path / "arrays"), 10)
    files = list((tmp_path / "arrays").glob("part*"))
    assert len(files) == 3 and all(f.read_text().startswith("[") for f in files)
    assert sorted(map(tuple, io.read_json_array(spark, str(tmp_path / "arrays"), "v long, t string").collect())) == [(i, "a\nb") for i in range(25)]


def test_parts_that_are_no_lists(spark, tmp_path):
    (tmp_path / "result_part_rank0.json").write_text('\n [{"v": 1}]')
    with pytest.warns(UserWarning, match="ranks \\[1\\]"):
        assert io.read_parts(spark, str(tmp_path), "v int", world_size=2).count() == 1
    (tmp_path / "result_part_rank1.json").write_text('{"v": 1}')
    with pytest.raises(ValueError, match="does not contain a list"):
        io.read_parts(spark, str(tmp_path), "v int")


def test_adapter_paths_and_empty_chains(spark):
    path = tx.output_path("out/", F.col("n"), F.lit(7), F.lit(2), F.lit(99))
    assert one(spark, path, n="a b") == "out/a_b/sample_00000007_rank2_pid99.png"
    none = F.lit(None).cast("array<int>")
    empty = F.array(F.array().cast("array<int>"))
    with pytest.raises(Exception, match="no codes"):
        one(spark, inf.assemble_chain(none, none, none, empty))
    assert one(spark, inf.assemble_chain(none, none, none, empty, strict=False)) is None


def test_large_codebooks_go_in_blocks(spark):
    book = spark.createDataFrame([(i, [math.cos(i // 2), math.sin(i // 2)]) for i in range(9)], "code int, vec array<double>")
    vectors = spark.createDataFrame([(i, [math.cos(i * 0.7), math.sin(i * 0.7)]) for i in range(20)], "i int, vector array<double>")
    whole = {r["i"]: (r["code"], r["distance"]) for r in qz.nearest_code(vectors, book).collect()}
    for most in (2, 5, 100):
        for f in (qz.nearest_code, qz.nearest_code_exact):
            got = {r["i"]: (r["code"], r["distance"]) for r in f(vectors, book, most=most).collect()}
            assert all(got[i][0] == whole[i][0] and got[i][1] == pytest.approx(whole[i][1], abs=1e-9) for i in range(20)) and len(got) == 20
        far = {r["i"]: r["distances"] for r in qz.code_distances(vectors, book, most=most).collect()}
        assert all(len(d) == 9 and min(d) == pytest.approx(whole[i][1], abs=1e-9) for i, d in far.items())
    assert [r["code"] for r in qz.nearest_code(vectors, book.limit(0)).collect()] == [None] * 20


def test_entropy_equals_a_plain_version(spark):
    rows = [[0.1, 0.5, 0.2], [0.0, 0.3, 0.9], [0.4, 0.4, 0.4]]
    got = qz.assignment_entropy(spark.createDataFrame([(r,) for r in rows], "distances array<double>"), temperature=0.2).head()
    p = [[math.exp(-d / 0.2) for d in r] for r in rows]
    p = [[x / sum(r) for x in r] for r in p]
    sample = sum(-sum(x * math.log(x) for x in r) for r in p) / 3
    mean = [sum(r[k] for r in p) / 3 for k in range(3)]
    entropy = -sum(m * math.log(m + 1e-5) for m in mean)
    assert (got["sample_entropy"], got["mean_entropy"], got["loss"]) == (pytest.approx(sample), pytest.approx(entropy), pytest.approx(sample - entropy))


def test_large_images(spark):
    plan = ly.image_plan(spark.createDataFrame([(1 << 30, 1 << 30)], "h int, w int"), 3, 4, 2).head()
    assert plan["halvings"] == 29


def test_bad_cases_take_the_first(spark):
    merged = spark.range(40).select(F.col("id").alias("i"), F.lit(1).alias("d"), F.when(F.col("id") % 2 == 0, "bad").alias("_error"), F.lit(None).cast("string").alias("_warn"))
    assert [r["i"] for r in mg.bad_cases(merged, ["d"], "i", 5).orderBy("i").collect()] == [0, 2, 4, 6, 8]


def test_shuffle_positions_follow_the_shuffle(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    want = [r["k"] for r in mg.seeded_shuffle(df, ["k"], 3).collect()]
    assert [r["k"] for r in mg.shuffle_position(df, ["k"], 3).orderBy("position").collect()] == want != list(range(50))
