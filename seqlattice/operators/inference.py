"""Budgets, prompts and costs of samples that go through a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.functions.vectors import is_perfect_square
from seqlattice.operators.budgets import monotone_schemes

#: Marks of the prompt format, the first image's budget, and the budgets that later images may have.
USER, ASSISTANT = "<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
IMAGE_START, IMAGE_END, IMAGE_PAD, BUDGET_PAD = "<|vision_start|>", "<|vision_end|>", "<|image_pad|>", "<|vision_pad|>"
FIRST_BUDGET, BUDGETS = 144, (144,)
EOS = 16384


def usable_budgets(num_tokens: Column, n_input: Column, strict: bool = False) -> Column:
    """Budgets of the input images after the first; without any, null, or (strict) an error."""
    kept = F.slice(num_tokens, F.lit(2), F.greatest(F.least(F.size(num_tokens), n_input) - 1, F.lit(0)))
    return F.when(num_tokens.isNotNull(), kept).otherwise(F.raise_error(F.lit("no budgets")).cast("array<int>") if strict else F.lit(None).cast("array<int>"))


def fallback_budgets(key: Column, n: Column, seed: int = 0, choices: tuple[int, ...] = BUDGETS) -> Column:
    """Budgets chosen by a hash of key, seed and position: the same on every run."""
    pick = lambda i: F.element_at(F.array(*[F.lit(b) for b in choices]), (F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(len(choices))) + 1).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), pick)).otherwise(F.array().cast("array<int>"))


def resolve_budgets(given: Column, routed: Column, key: Column, n_input: Column, pad: bool = False, seed: int = 0) -> Column:
    """Budgets of input images 2..n: the given ones, else the router's if there are several images, else the fallback's.

    Too many are cut. Too few stay (the native driver then fails on the sample), or are padded from the fallback.
    """
    need = F.greatest(n_input - 1, F.lit(0))
    usual = fallback_budgets(key, need, seed)
    found = F.slice(F.coalesce(given, F.when(n_input > 1, routed), usual), F.lit(1), need)
    return F.concat(found, F.slice(usual, F.size(found) + 1, F.greatest(need - F.size(found), F.lit(0)))) if pad else found


def _with_first(budgets: Column, n: Column, first: int) -> Column:
    return F.when(n > 0, F.slice(F.concat(F.array(F.lit(first)), budgets), F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def render_prompt(prompt: Column, grids: Column, budgets: Column, first: int = FIRST_BUDGET) -> Column:
    """The prompt text: for each image its understanding pads and its budget pads between marks, then the text."""
    pads = F.zip_with(grids, _with_first(budgets, F.size(grids), first), lambda g, b: F.concat(
        F.lit(IMAGE_START), F.repeat(F.lit(IMAGE_PAD), F.floor(g["h"] * g["w"] / 4).cast("int")), F.lit(IMAGE_END),
        F.lit(IMAGE_START), F.repeat(F.lit(BUDGET_PAD), b), F.lit(IMAGE_END)))
    return F.concat(F.lit(USER), F.coalesce(F.array_join(pads, ""), F.lit("")), prompt, F.lit(ASSISTANT))


def fill_placeholders(text: Column, counts: Column, mark: str = IMAGE_PAD) -> Column:
    """The k-th mark of a text repeated counts[k] times; marks beyond the counts stay."""
    parts = F.split(text, "\\Q" + mark + "\\E")
    marks = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.repeat(F.lit(mark), F.coalesce(F.try_element_at(counts, i), F.lit(1))), p)))
    return F.array_join(marks, "")


def prompt_token_cost(grids: Column, budgets: Column, first: int = FIRST_BUDGET) -> Column:
    """Visual tokens of a prompt: (h * w) / 4 + budget + 4 marks for each image."""
    each = F.zip_with(grids, _with_first(budgets, F.size(grids), first), lambda g, b: F.floor(g["h"] * g["w"] / 4).cast("long") + b + 4)
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def record_flags(generated: Column, input_paths: Column, truth: Column, decode_error: Column) -> list[Column]:
    return [
        (F.coalesce(F.size(generated), F.lit(0)) > 0).alias("has_generated_image"), F.coalesce(F.size(input_paths), F.lit(0)).alias("input_image_count"),
        truth.isNotNull().alias("gt_available"), decode_error.isNotNull().alias("has_decode_error"),
    ]


def sample_checks(samples: DataFrame) -> DataFrame:
    """``samples`` with one boolean a rule: true where the sample breaks it.

    Reads num_tokens, input_image, output_image, output_text. Budgets may be an array or, as data sets bring them, JSON text, which must then be a list of
    whole numbers.
    """
    images = F.size("input_image") + F.size("output_image")
    marks = F.regexp_count("output_text", F.lit("\\Q" + IMAGE_START + "\\E"))
    text = samples.schema["num_tokens"].dataType == T.StringType()
    given = F.try_parse_json("num_tokens") if text else F.col("num_tokens")
    listed = F.schema_of_variant(given).isin("ARRAY<BIGINT>", "ARRAY<VOID>") if text else F.lit(True)
    budgets = F.when(listed, F.from_json("num_tokens", "array<int>")) if text else F.col("num_tokens")
    checked = samples.withColumn("_budgets", budgets)
    return checked.select(
        "*", F.col("num_tokens").isNull().alias("budgets_missing"),
        (F.col("num_tokens").isNotNull() & ~F.coalesce(listed, F.lit(False))).alias("budgets_not_a_list"),
        F.coalesce(~F.forall("_budgets", is_perfect_square), F.lit(False)).alias("budget_not_square"),
        F.coalesce(F.size("_budgets") != images, F.lit(False)).alias("image_count_differs"),
        F.coalesce(F.try_element_at("_budgets", F.lit(1)) != FIRST_BUDGET, F.lit(False)).alias("first_budget_differs"),
        F.coalesce(marks != F.size("output_image"), F.lit(False)).alias("placeholder_count_differs"),
    ).drop("_budgets")


RULES = ("budgets_missing", "budgets_not_a_list", "budget_not_square", "image_count_differs", "first_budget_differs", "placeholder_count_differs")


def validate_samples(samples: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """(rule, violations) over all samples. With the interval table that gave the budgets, the rule ``scheme_rises`` counts its schemes
    whose budgets rise with similarity."""
    flags = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("broken")) for r in RULES])).alias("f")
    found = sample_checks(samples).select(flags).groupBy("f.rule").agg(F.count_if(F.col("f.broken")).alias("violations"))
    if intervals is None:
        return found
    rising = intervals.select("scheme").distinct().join(monotone_schemes(intervals), "scheme", "left_anti")
    return found.unionByName(rising.agg(F.lit("scheme_rises").alias("rule"), F.count("*").alias("violations")))


def assemble_chain(first: Column, rest: Column, rest_counts: Column, generated: Column, strict: bool = True) -> Column:
    """struct(first, later, n_images, counts): input and generated codes as one chain; empty generated images are left out.

    With input codes all generated images come later; without, the first generated one leads. No codes at all: an error, or with
    ``strict=False`` null.
    """
    made = F.filter(F.coalesce(generated, F.array().cast("array<array<int>>")), lambda g: F.size(g) > 0)
    given = F.coalesce(F.size(first), F.lit(0)) > 0
    none = F.array().cast("array<int>")
    has_rest = F.coalesce(F.size(rest), F.lit(0)) > 0
    tail = F.slice(made, F.lit(2), F.greatest(F.size(made) - 1, F.lit(0)))
    sizes = lambda a: F.transform(a, lambda g: F.size(g))
    with_input = F.struct(first.alias("first"), F.concat(F.when(has_rest, rest).otherwise(none), F.flatten(made)).alias("later"),
                          (F.when(has_rest, F.size(rest_counts)).otherwise(F.lit(0)) + F.size(made) + 1).alias("n_images"), F.concat(F.when(has_rest, rest_counts).otherwise(none), sizes(made)).alias("counts"))
    without = F.struct(F.try_element_at(made, F.lit(1)).alias("first"), F.flatten(tail).alias("later"), F.size(made).alias("n_images"), sizes(tail).alias("counts"))
    chain = F.when(given, with_input).when(F.size(made) > 0, without)
    return chain.otherwise(F.raise_error(F.lit("no codes to decode")).cast("struct<first:array<int>,later:array<int>,n_images:int,counts:array<int>>")) if strict else chain


def batch_generate(samples: DataFrame, model: Callable[[], Callable[[dict], dict]], out_schema: T.StructType) -> DataFrame:
    """``samples`` with what a user's model makes of each row, and ``_error``.

    ``model`` is called once a task and returns a function from a row (as a dict) to the values of ``out_schema``. An exception
    of a row is recorded and its values stay null; other rows go on.
    """
    fields = [f.name for f in out_schema.fields]
    schema = T.StructType([*samples.schema.fields, *out_schema.fields, T.StructField("_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = model()
        for b in batches:
            made = []
            for row in b.to_dict("records"):
                try:
                    got = generate(row)
                    made.append([*(got.get(f) for f in fields), None])
                except Exception as e:  # a user's model may raise anything; the row carries it
                    made.append([*[None] * len(fields), f"{type(e).__name__}: {e}"])
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(made, columns=[*fields, "_error"])], axis=1)

    return samples.mapInPandas(run, schema)
