"""Rules, positions, scorers, line numbers, places, and streams that stop and go on."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlattice.operators import budgets as bg
from seqlattice.operators import evaluate as ev
from seqlattice.operators import inference as inf
from seqlattice.operators import layout as ly
from seqlattice.operators import merging as mg
from seqlattice.operators import quantize as qz
from seqlattice.operators import similarity as sim
from seqlattice.sources import io
from seqlattice.streaming import operators as st

RUNS = "seq_id int, ord int, kind string, text_len int, t int, h int, w int"


def test_one_video_between_texts(spark):
    """Texts of 2 and 1 tokens round a video of two frames of 4 x 6 patches, merged by 2, with one token of time before each frame."""
    runs = spark.createDataFrame([(1, 0, "text", 2, 0, 0, 0), (1, 1, "video", 0, 2, 4, 6), (1, 2, "text", 1, 0, 0, 0)], RUNS)
    got = [(r["token"], r["t"], r["h"], r["w"]) for r in ly.token_positions(ly.video_runs(runs, stamp=1)).orderBy("token").collect()]
    frame = lambda at: [(at, at + i // 3, at + i % 3) for i in range(6)]
    text = lambda at: [(at, at, at)]
    want = text(0) + text(1) + text(2) + frame(3) + text(6) + frame(7) + text(10)
    assert got == [(i, *p) for i, p in enumerate(want)]


def test_positions_of_long_and_empty_runs(spark):
    n = 3 * ly.TOKENS_AT_ONCE + 5
    runs = spark.createDataFrame([(1, 0, "text", 0, 0, 0, 0), (1, 1, "text", n, 0, 0, 0), (1, 2, "image", 0, 2, 4, 2), (2, 0, "image", 0, 1, 2, 2)], RUNS)
    out = ly.token_positions(runs).cache()
    assert out.where("seq_id = 1").count() == n + 4 and out.where("kind = 'text' and not (t = token and h = token and w = token)").count() == 0
    assert [tuple(r)[3:] for r in out.where("seq_id = 1 and kind = 'image'").orderBy("token").collect()] == [(n + i, n + i // 2, n + i % 2, n) for i in range(4)]
    assert [tuple(r)[3:] for r in out.where("seq_id = 2").collect()] == [(0, 0, 0, 0)]


NAMES = ["MMVet", "LLaVABench_KO", "MathVista_MINI", "OlympiadBench", "MathVista_OlympiadBench", "OlympiadBench_EMMA", "VisuLogic", "VisualPuzzles_x", "WeMath", "MME-Reasoning", "moviechat1k_a", "EMMA", "Other", "mme-reasoning", None]


def test_the_table_gives_the_judges_of_the_rules(spark):
    runs = spark.createDataFrame([(n, k) for n in NAMES for k in ("MCQ", "VQA", "MCQ_MMMU_Pro", None)], "dataset string, kind string")
    got = ev.judged_runs(runs, ev.judge_rules(spark)).withColumn("rule", ev.judge_rule(F.col("dataset"), F.col("kind"))).collect()
    both = [n for n in NAMES if n and "OlympiadBench" in n and n != "OlympiadBench"]  # the table takes the first rule that holds, in order
    assert len(got) == 4 * len(NAMES) and all(r["judge"] == r["rule"] for r in got if r["dataset"] not in both)
    assert {r["dataset"]: r["judge"] for r in got if r["dataset"] in both and r["kind"] == "VQA"} == {both[0]: ev.JUDGE, both[1]: None}


def test_arguments_of_judges(spark):
    rows = [("EMMA", "VQA", None, None), ("EMMA", "VQA", '{"retry": 5, "model": "other"}', None), ("Other", "VQA", '{"model": "other", "x": {"y": 1}}', None), ("EMMA", "VQA", "{}", "mine"), ("OlympiadBench", "VQA", '{"olympiad_use_api_judger": true}', None), ("OlympiadBench", "VQA", '{"olympiad_use_api_judger": false}', None)]
    runs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, dataset string, kind string, args string, own string")
    got = {r["i"]: r for r in ev.judged_runs(runs, ev.judge_rules(spark), arguments="args", judge="own", defaults={"retry": "3", "nproc": "4"}).collect()}
    assert [got[i]["judge"] for i in range(6)] == [ev.JUDGE, ev.JUDGE, "other", "mine", ev.JUDGE, None]
    assert got[0]["judge_args"] == {"retry": "3", "nproc": "4"} and got[1]["judge_args"] == {"retry": "5", "nproc": "4", "model": "other"} and got[2]["judge_args"]["x"] == '{"y":1}'
    with pytest.raises(Exception):
        ev.judged_runs(runs.withColumn("args", F.lit("{no")), ev.judge_rules(spark), arguments="args").collect()


def mean_scorer():
    class Mean(ev.Scorer):
        def start(self):
            return (0, 0)

        def add(self, state, rows):
            return (state[0] + int(rows["v"].sum()), state[1] + len(rows))

        def merge(self, a, b):
            return (a[0] + b[0], a[1] + b[1])

        def result(self, state):
            return {"mean": state[0] / state[1]}

    return Mean()


def test_scorers_merge_states(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("c"), F.col("id").alias("v")).repartition(6)
    want = {r["c"]: r["m"] for r in df.groupBy("c").agg(F.avg("v").alias("m")).collect()}
    for held in (10_000, 3):
        monkeypatch.setattr(ev, "HELD_STATES", held)
        got = ev.scored_by(df, "c", mean_scorer(), "mean double").collect()
        assert {r["c"]: r["mean"] for r in got if r["c"]} == pytest.approx({k: v for k, v in want.items() if k}) and sorted(r["mean"] for r in got if not r["c"]) == pytest.approx(sorted([want[None], 499.5]))
    assert ev.scored_by(df.limit(0), "c", mean_scorer(), "mean double").collect() == []


def test_slices_are_near_the_exact_use(spark):
    codes = spark.range(200_000).select("id", F.pmod(F.xxhash64("id"), F.lit(16_384)).alias("code"))
    slices = qz.usage_slices(codes.unionByName(codes.limit(5).withColumn("code", F.lit(None).cast("long"))), F.floor(F.col("id") / 10_000)).cache()
    for since in (0, 15, 19):
        exact = codes.where(F.col("id") >= since * 10_000).agg(F.count_distinct("code")).head()[0]
        r = qz.sliced_usage(slices.where(F.col("slice") >= since), 16_384).head()
        assert abs(r["used_codes"] - exact) <= 0.03 * exact and r["usage"] == r["used_codes"] / 16_384


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_bad_lines_have_numbers(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for name in ("a", "b"):
        lines = []
        for i in range(1, 60):
            kind = rng.choice(["good", "good", "blank", "bad"])
            lines.append({"good": '{"v": %d}' % i, "blank": " " * (i % 2), "bad": '{"v": '}[kind])
            want += [(name + ".json", i)] if kind == "bad" else []
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = io.bad_lines(spark, str(tmp_path), "v int").collect()
        assert sorted((r["path"].rpartition("/")[2], r["line"]) for r in got) == sorted(want)
        with pytest.raises(ValueError, match=rf"a\.json, line {want[0][1]}:"):
            io.read_jsonl(spark, str(tmp_path), "v int", check=True)
        (tmp_path / "a.json").unlink()
        (tmp_path / "b.json").write_text('\n{"v": 1}\n')
        assert io.read_jsonl(spark, str(tmp_path), "v int", check=True).count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_are_read_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000, numPartitions=7).select(F.col("id").alias("v")).where("v not between 300 and 500").write.parquet(path)
    df = io.read_positions(spark, path)
    kept = [v for v in range(1000) if not 300 <= v <= 500]
    assert [r["v"] for r in df.orderBy("position").collect()] == kept and df.agg(F.max("position")).head()[0] == len(kept) - 1
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_order_warning_and_drawn_seeds(spark):
    part = spark.createDataFrame([(1, "a"), (None, "b")], "_global_idx long, v string")
    with pytest.warns(UserWarning, match="_global_idx"):
        assert mg.restore_order(part).count() == 2
    with pytest.warns(UserWarning, match="_global_idx"):
        mg.restore_order(part.drop("_global_idx"))
    assert mg.drawn_seed(5) == 5 and 0 <= mg.drawn_seed(-1) < 1 << 31 and len({mg.drawn_seed(-1) for _ in range(20)}) > 1
    df = spark.range(30).select(F.col("id").alias("k"))
    shuffled = mg.seeded_shuffle(df, ["k"], -1)
    assert shuffled.collect() == shuffled.collect()


def test_features_that_are_there_and_images_that_are_alone(spark):
    seen = []

    def extractor():
        return lambda rows: [[float(len(p))] for p in rows["path"] if seen.append(p) is None]

    rows = [(1, "a"), (1, "bb"), (2, "ccc"), (3, None), (3, "a"), (None, "lone")]
    images = spark.createDataFrame(rows, "seq int, path string")
    got = {(r["seq"], r["path"]): r["vector"] for r in sim.with_features(images, extractor, seq="seq").collect()}
    assert got == {(1, "a"): [1.0], (1, "bb"): [2.0], (2, "ccc"): None, (3, None): None, (3, "a"): [1.0], (None, "lone"): None}
    ready = sim.with_features(images.withColumn("f", F.array(F.lit(2.0))), "f")
    assert all(r["vector"] == [2.0] for r in ready.collect())
    states = sim.with_features(images.where("path is not null and seq is not null").withColumn("seq_id", F.col("seq")).withColumn("pos", F.when(F.col("path") == "bb", 1).otherwise(0)), extractor, seq="seq")
    triangles = {r["seq_id"]: r["triangle"] for r in sim.similarity_triangles(states.where("seq < 3")).collect()}
    assert triangles == {1: [[1.0], [1.0]], 2: [[1.0]]}


def test_budgets_that_are_no_lists(spark):
    rows = [(t,) for t in ("[144, 9]", "[]", "none", '"x"', '{"a": 1}', "7", None, '["a"]', "[144, 10]")]
    s = spark.createDataFrame(rows, "num_tokens string").select("num_tokens", F.array().cast("array<string>").alias("input_image"), F.array(F.lit("p"), F.lit("q")).alias("output_image"), F.lit("").alias("output_text"))
    table = bg.interval_table(spark.createDataFrame([("up", 0.8, 0.0, 0.5, 49.0), ("up", 0.8, 0.5, 1.0, 81.0), ("ok", 0.8, 0.0, 1.0, 9.0)], "scheme string, alpha double, tsim_left double, tsim_right double, budget double"))
    got = {r["rule"]: r["violations"] for r in inf.validate_samples(s, table).collect()}
    assert got["budgets_not_a_list"] == 5 and got["budgets_missing"] == 1 and got["budget_not_square"] == 1 and got["image_count_differs"] == 1 and got["scheme_rises"] == 1


def run_once(stream, path, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    """A session that is open when the first run ends goes on in the second, which has the same checkpoint."""
    log = lambda rows: spark.createDataFrame(rows, "timestamp string, benchmark string, error string").withColumn("timestamp", F.to_timestamp("timestamp"))
    path, source = str(tmp_path), str(tmp_path / "in")
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    first, second = [(minute(m), "b", None) for m in (0, 10, 25)], [(minute(m), "b", "x") for m in (40, 200, 400)]
    schema = log(first).schema
    for rows in (first, second):
        log(rows).coalesce(1).write.mode("append").parquet(source)
        run_once(st.stream_run_log(spark.readStream.schema(schema).parquet(source), session="20 minutes"), path)
    got = sorted((str(r["window_start"])[11:16], r["records"], r["errors"]) for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [("00:00", 4, 1), ("03:20", 1, 1)]


RULE = bg.Rule(0.8, ((-1.0, 0.5, 100), (0.5, 1.0, 9)))
STATES = "seq_id long, pos long, vector array<double>"


@pytest.fixture
def rocks(spark):
    key, store = st.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    yield
    spark.conf.set(key, before)


def test_sequences_go_on_after_a_restart(spark, tmp_path, rocks):
    rng = random.Random(1)
    rows = [(s, p, [rng.gauss(0, 1) for _ in range(3)]) for s in range(4) for p in range(6)]
    path, source = str(tmp_path), str(tmp_path / "in")
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], STATES).coalesce(1).write.mode("append").parquet(source)
        run_once(st.stream_allocate(spark.readStream.schema(STATES).parquet(source), RULE), path)
    want = sorted(map(tuple, bg.allocate_states(spark.createDataFrame(rows, STATES), RULE).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{path}/out").collect())) == want and len(want) == 24


def test_idle_sequences_are_forgotten(spark, tmp_path, rocks):
    """A state that comes after ``idle`` finds nothing of its sequence and begins it again."""
    path, source = str(tmp_path), str(tmp_path / "in")
    out = lambda: sorted(map(tuple, spark.read.schema("seq_id long, pos long, num_tokens int").parquet(f"{path}/out").collect()))
    add = lambda pos: spark.createDataFrame([(1, pos, [1.0, 0.0])], STATES).coalesce(1).write.mode("append").parquet(source)
    add(0)
    stream = st.stream_allocate(spark.readStream.schema(STATES).parquet(source), RULE, idle="2 seconds")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").start()
    try:  # such a query never runs out of batches, so its output is looked at until it is there
        for pos in range(2):
            end = time.time() + 60
            while time.time() < end and (not (tmp_path / "out" / "_spark_metadata").exists() or len(out()) <= pos):
                time.sleep(0.5)
            if pos == 0:
                time.sleep(4)
                add(1)
    finally:
        q.stop()
    assert out() == [(1, 0, 144), (1, 1, 144)]
