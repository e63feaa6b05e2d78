"""Text of model outputs and names made from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ANSWER = r"\n\nFinal Answer:([\s\S]*)"
SPECIAL = r"<\|[^|>]*\|>"
NO_NAME = "unknown_benchmark"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def final_answer(text: Column) -> Column:
    """What follows the first ``Final Answer:`` after an empty line, stripped; null without one, empty if blank."""
    return F.when(F.contains(text, F.lit("\n\nFinal Answer:")), strip(F.regexp_extract(text, ANSWER, 1)))


def strip_special_tokens(text: Column, keep: bool = False) -> Column:
    """Decoded text without its ``<|...|>`` marks, or unchanged."""
    return text if keep else F.regexp_replace(text, SPECIAL, "")


def safe_name(name: Column) -> Column:
    """A folder name: other characters than letters, digits, ``-_.`` become ``_``; 120 at most; blank or null has a fixed name."""
    cleaned = F.substring(F.regexp_replace(strip(name), r"[^\p{L}\p{N}._-]", "_"), 1, 120)
    return F.when(F.coalesce(strip(name), F.lit("")) == "", F.lit(NO_NAME)).otherwise(cleaned)


def output_path(root: str, benchmark: Column, index: Column, rank: Column | None = None, pid: Column | None = None) -> Column:
    """The picture file of a sample; with ``rank`` and ``pid`` in the form of the benchmark adapter, whose processes count alone."""
    name = F.format_string("/sample_%06d.png", index.cast("long")) if rank is None else F.format_string("/sample_%08d_rank%d_pid%d.png", index.cast("long"), rank.cast("long"), pid.cast("long"))
    return F.concat(F.lit(root.rstrip("/") + "/"), safe_name(benchmark), name)
