"""Answers, scores, runs and run logs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.functions.text import final_answer

#: Which data sets a run can't score, and why.
EXPORT_ONLY, EXPORT_PARTS = ("MMMU_TEST",), ("MMT-Bench_ALL",)
UNSUPPORTED_PARTS = ("MLLMGuard_DS",)
SENT_AWAY = ("AesBench_TEST",)
WITHOUT_TRUTH = ("DocVQA_TEST", "InfoVQA_TEST", "Q-Bench1_TEST", "A-Bench_TEST")
SERVER_ONLY = ("MMBench_TEST_CN", "MMBench_TEST_EN", "MMBench", "MMBench_CN", "MMBench_TEST_CN_V11", "MMBench_TEST_EN_V11", "MMBench_V11", "MMBench_CN_V11")

#: The judge of a data set. Choice questions first, then names by part.
JUDGE, EXACT = "qwen2.5-vl-72b-instruct", "exact_matching"
CHOICE_TYPES = ("MCQ", "Y/N", "MCQ_MMMU_Pro")
CHOICE_NAMES = ("moviechat1k", "mme-reasoning")
CHOICE_EXACT = ("VisualPuzzles", "VisuLogic")
CHOICE_JUDGED = ("WeMath", "MME-Reasoning")
JUDGED_NAMES = (
    "MMVet", "LLaVABench", "MMBench_Video", "VGRPBench", "MathVista", "MathVerse", "MathVision", "DynaMath", "VL-RewardBench", "LogicVista", "MOAT", "OCR_Reasoning",
    "VSP_maze_task_main_original", "MMLongBench", "MMDU", "DUDE", "SLIDEVQA", "MIA-Bench", "WildVision", "MMAlignBench", "MM-IFEval", "ChartMimic", "VDC", "Video_MMLU_QA",
    "Video_MMLU_CAP", "MMVMBench", "CVQA_EN", "CVQA_LOC", "M4Bench", "AyaVisionBench", "MathCanvas", "MMReason", "EMMA",
)
API_JUDGED, API_ARGUMENT = ("OlympiadBench",), "olympiad_use_api_judger"


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def answer_rows(results: DataFrame, position: str | None = None) -> DataFrame:
    """(_global_idx, config, question, gt, pred): answers found in the expected and the produced text.

    Without ``_global_idx`` the row's ``position`` column stands in.
    """
    idx = F.col("_global_idx") if "_global_idx" in results.columns else F.col(position)
    return results.select(idx.cast("long").alias("_global_idx"), "config", F.col("input_prompt").alias("question"), final_answer(F.col("output_text")).alias("gt"), final_answer(F.col("model_output_text")).alias("pred"))


def exact_match_accuracy(answers: DataFrame, by: str) -> DataFrame:
    """Accuracy of each category and of all (category null): equal answers over rows with an expected one."""
    hit = F.coalesce(F.col("gt") == F.col("pred"), F.lit(False))
    return answers.where("gt is not null").rollup(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), (F.count_if(hit) / F.count("*")).alias("accuracy"))


class Scorer:
    """A user's score as a mergeable state: rows of a category are added up part by part, the parts' states merged, and a result made of the whole."""

    def start(self):
        raise NotImplementedError

    def add(self, state, rows: pd.DataFrame):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def result(self, state) -> dict:
        raise NotImplementedError


#: Categories whose states a task holds at once.
HELD_STATES = 10_000


def scored_by(answers: DataFrame, by: str, scorer: Scorer, schema: str | T.StructType) -> DataFrame:
    """(by, .. ``schema``): a user's score of each category and of all rows (category null, beside that of rows without one), in two phases.

    Every task adds its rows to one state a category; only states are shuffled and merged, so no category is gathered.
    """
    key = answers.schema[by].dataType
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = T.StructType([T.StructField(by, key), T.StructField("_all", T.BooleanType()), T.StructField("_state", T.BinaryType())])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        whole, some = scorer.start(), False
        rows = lambda held, all_: pd.DataFrame({by: pd.Series(list(held), dtype=object), "_all": all_, "_state": [pickle.dumps(s) for s in held.values()]})
        for b in batches:
            for k, own in b.groupby(by, dropna=False, sort=False):
                k = None if pd.isna(k) else k
                states[k] = scorer.add(states[k] if k in states else scorer.start(), own)
            if len(b):
                whole, some = scorer.add(whole, b), True
            if len(states) > HELD_STATES:
                yield rows(states, False)
                states = {}
        if states:
            yield rows(states, False)
        if some:
            yield rows({None: whole}, True)

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        total = scorer.start()
        for s in states["_state"]:
            total = scorer.merge(total, pickle.loads(s))
        return pd.DataFrame([{by: states[by].iloc[0], **scorer.result(total)}])

    return answers.mapInPandas(add, parts).groupBy(by, "_all").applyInPandas(merge, T.StructType([T.StructField(by, key), *out.fields]))


def run_log_summary(records: DataFrame, by: list[str]) -> DataFrame:
    errors = F.count_if(F.col("error").isNotNull())
    return records.groupBy(*by).agg(F.count("*").alias("records"), errors.alias("errors"), (errors / F.count("*")).alias("error_rate"), F.avg(F.size("tokens")).alias("avg_images"))


def model_dataset_matrix(models: DataFrame, datasets: DataFrame, files: DataFrame) -> DataFrame:
    """(model, dataset, path, found): every pair with its result file ``<model>_<dataset>.<ext>`` under the model's folder.

    ``files`` has (path): the file in the folder itself is taken, else the first of that name below it. Models and data sets
    are short lists, so their product is small.
    """
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    listed = files.select(F.col("path"), name.alias("_name"), F.size(F.split("path", "/")).alias("_depth"))
    pairs = models.crossJoin(datasets).withColumn("_name", F.concat_ws("_", "model", "dataset"))
    best = pairs.join(listed, "_name", "left").where(F.col("path").isNull() | F.contains(F.col("path"), F.concat(F.col("model"), F.lit("/"))))
    pick = best.groupBy("model", "dataset").agg(F.min_by("path", F.struct("_depth", "path")).alias("path"))
    return pairs.select("model", "dataset").join(pick, ["model", "dataset"], "left").withColumn("found", F.col("path").isNotNull())


def run_action(dataset: Column, official_server: Column | None = None) -> Column:
    """What becomes of a run: evaluate, export, unsupported, send_away, no_truth or server_only."""
    official = F.lit(False) if official_server is None else official_server
    return (
        F.when(dataset.isin(*EXPORT_ONLY) | _has_any(dataset, EXPORT_PARTS), "export").when(_has_any(dataset, UNSUPPORTED_PARTS), "unsupported")
        .when(dataset.isin(*SENT_AWAY), "send_away").when(dataset.isin(*WITHOUT_TRUTH), "no_truth").when(dataset.isin(*SERVER_ONLY) & ~official, "server_only").otherwise("evaluate")
    )


def evaluable_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("action", run_action(F.col("dataset"))).where("action = 'evaluate'")


def judge_rule(dataset: Column, kind: Column, override: Column | None = None, api_judge: Column | None = None) -> Column:
    """The judge of a data set by its type and name; an override wins; null where no rule names one."""
    choice = kind.isin(*CHOICE_TYPES) | _has_any(F.lower(dataset), CHOICE_NAMES)
    for_choice = F.when(_has_any(dataset, CHOICE_JUDGED), JUDGE).when(_has_any(dataset, CHOICE_EXACT), EXACT).otherwise(JUDGE)
    olympiad = _has_any(dataset, API_JUDGED)
    by_name = F.when(_has_any(dataset, JUDGED_NAMES) & ~olympiad, JUDGE).when(olympiad & (F.lit(False) if api_judge is None else api_judge), JUDGE)
    found = F.when(choice, for_choice).otherwise(by_name)
    return found if override is None else F.coalesce(override, found)


#: Columns of a rule: of two that apply the lesser ``priority`` wins. A null column holds for all: the data set's type, a part of its name, a part of
#: its name in small letters, an argument that must be true. A rule without a judge leaves the data set without one.
RULE_SCHEMA = "priority int, kind string, part string, small_part string, needs string, judge string"


def judge_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules above as a table."""
    choice = [(k, None) for k in CHOICE_TYPES] + [(None, n) for n in CHOICE_NAMES]
    first = [(None, kind, part, small, None, judge) for parts, judge in ((CHOICE_JUDGED, JUDGE), (CHOICE_EXACT, EXACT), ((None,), JUDGE)) for part in parts for kind, small in choice]
    exam = JUDGED_NAMES.index("MMLongBench")
    named = lambda names: [(None, None, n, None, None, JUDGE) for n in names]
    api = [(None, None, n, None, needs, judge) for n in API_JUDGED for needs, judge in ((API_ARGUMENT, JUDGE), (None, None))]
    rows = first + named(JUDGED_NAMES[:exam]) + api + named(JUDGED_NAMES[exam:])
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], RULE_SCHEMA)


def judged_runs(runs: DataFrame, rules: DataFrame, dataset: str = "dataset", kind: str = "kind", arguments: str | None = None, judge: str | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """``runs`` with ``judge`` and ``judge_args`` (name -> value as text).

    The rule of the least priority that holds names the judge; a judge in column ``judge`` goes before it, and one among the arguments after it. ``arguments``: a column of
    JSON objects, laid over ``defaults``; what is no JSON object is an error. Rules meet the different (data set, type, arguments) only, of which there
    are few, and are sent to all tasks: over 10,000 rules are an error.
    """
    if len(rules.limit(10_001).collect()) > 10_000:
        raise ValueError("too many rules to send to every task")
    text = F.col(arguments) if arguments else F.lit(None).cast("string")
    given = F.coalesce(F.from_json(text, "map<string,string>", {"mode": "FAILFAST"}), F.create_map().cast("map<string,string>"))
    keyed = runs.withColumn("_name", F.col(dataset)).withColumn("_kind", F.col(kind)).withColumn("_text", text)
    keys = keyed.select("_name", "_kind", "_text").distinct().withColumn("_given", F.coalesce(F.from_json("_text", "map<string,string>"), F.create_map().cast("map<string,string>")))
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    holds = lambda column, test: F.col(column).isNull() | test
    met = keys.join(F.broadcast(r), holds("r_kind", F.col("_kind") == F.col("r_kind")) & holds("r_part", F.contains("_name", "r_part")) & holds("r_small_part", F.contains(F.lower("_name"), F.col("r_small_part")))
                    & holds("r_needs", F.coalesce(F.lower(F.try_element_at("_given", F.col("r_needs"))) == "true", F.lit(False))), "left")
    found = met.groupBy("_name", "_kind", "_text").agg(F.min_by(F.struct("r_judge"), "r_priority").alias("_rule"))
    found = found.select(F.col("_name").alias("_n"), F.col("_kind").alias("_k"), F.col("_text").alias("_t"), F.col("_rule.r_judge").alias("_ruled"))
    both = keyed.join(found, F.col("_name").eqNullSafe(F.col("_n")) & F.col("_kind").eqNullSafe(F.col("_k")) & F.col("_text").eqNullSafe(F.col("_t")), "left")
    usual = F.create_map(*[F.lit(x) for pair in (defaults or {}).items() for x in pair]).cast("map<string,string>")
    merged = F.map_concat(F.map_filter(usual, lambda k, _: ~F.map_contains_key(F.col("_args"), k)), "_args")
    model = F.coalesce(F.col(judge) if judge else F.lit(None).cast("string"), "_ruled", F.try_element_at("_args", F.lit("model")))
    done = both.withColumn("_args", given).withColumn("judge", model).withColumn("judge_args", merged)
    return done.drop("_name", "_kind", "_text", "_n", "_k", "_t", "_ruled", "_args")
