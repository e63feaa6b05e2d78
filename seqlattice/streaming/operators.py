"""Streaming forms: extraction, merging, run-log counts, and budgets of growing sequences."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seqlattice.functions import images as im
from seqlattice.operators.budgets import FIRST_BUDGET, Rule, next_state
from seqlattice.operators.merging import merge_budgets, sample_paths


def stream_extract(samples: DataFrame, on_missing: str = "skip") -> DataFrame:
    """(id, paths) of each message sample, as it comes."""
    paths = im.resolve_images(im.image_tokens(F.col("messages")), im.image_map(F.col("input_images"), F.col("output_images")), on_missing)
    return samples.select("id", paths.alias("paths"))


def stream_merge_budgets(samples: DataFrame, budgets: DataFrame) -> DataFrame:
    """A stream of samples against a table of budgets (one row a sequence)."""
    return merge_budgets(sample_paths(samples), budgets)


def run_window(ts: Column, length: str = "1 hour", slide: str | None = None, session: str | None = None) -> Column:
    if session:
        return F.session_window(ts, session)
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def stream_run_log(records: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str | None = None, session: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Records and errors by window and benchmark.

    As a stream: a window is given out once the watermark, ``delay`` behind the newest record of the batches so far, has passed its end. A record is
    dropped as late if its window had ended by the watermark of the batch before, so one that comes with the batch that moves the watermark on still counts.
    """
    late = records.withWatermark(ts, delay) if records.isStreaming else records
    counted = late.groupBy(run_window(F.col(ts), length, slide, session).alias("w"), "benchmark").agg(F.count("*").alias("records"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "benchmark", "records", "errors")


def next_budget(sims: list[float], budgets: list[int], rule: Rule) -> int:
    """The budget of a new state from its similarities to the earlier ones: in full what ``budgets.next_state`` does with sums."""
    weights = [rule.alpha ** (len(budgets) - 1 - j) * b for j, b in enumerate(budgets)]
    den = sum(weights)
    mean = sum(s * w for s, w in zip(sims, weights)) / den if den else 0.0
    for i, (left, right, budget) in enumerate(rule.intervals):
        if left <= mean and (mean < right or i == len(rule.intervals) - 1 and mean == right):
            return budget
    return rule.intervals[0][2] if mean < rule.intervals[0][0] else rule.intervals[-1][2]


class Allocate(StatefulProcessor):
    """Budgets of one sequence's new states. The state is the weighted sum of the unit vectors so far and that of their weights, as in
    ``budgets.next_state``, so it is read and written whole with each batch and is as large after a thousand states as after one."""

    def __init__(self, rule: Rule, first: int, pos: str, vector: str, idle_ms: int | None) -> None:
        self.rule, self.first, self.pos, self.vector, self.idle_ms = rule, first, pos, vector, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "vector array<double>, weight double", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.past.get()
        past, weight = (np.asarray(kept[0], np.float64), kept[1]) if kept else (None, 0.0)
        out = []
        for p, v in sorted(((r[self.pos], np.asarray(r[self.vector], np.float64)) for r in rows), key=itemgetter(0)):
            budget, past, weight = next_state(v, past, weight, self.rule, self.first)
            out.append(Row(seq_id=key[0], pos=p, num_tokens=budget))
        self.past.update((past.tolist(), weight))
        yield from out

    def close(self) -> None:
        pass


#: The state store that the processor's state needs: a setting of the session that runs the stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_allocate(states: DataFrame, rule: Rule, idle: str | None = None, first: int = FIRST_BUDGET, seq: str = "seq_id", pos: str = "pos", vector: str = "vector") -> DataFrame:
    """(seq, pos, num_tokens) of each new state of each sequence. States must come in order of ``pos`` between batches.

    State kept a sequence: one vector and one number, dropped ``idle`` of processing time after the sequence's last batch. With ``idle`` a
    query never runs out of batches, so leave it out where the stream is to end with its data. Needs ``STATE_STORE`` in the session.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = states.select(F.col(seq).cast("long").alias("seq_id"), F.col(pos).cast("long").alias("pos"), F.col(vector).cast("array<double>").alias("vector"))
    # by rows: data frames would cost more for each sequence than the states themselves
    return rows.groupBy("seq_id").transformWithState(
        Allocate(rule, first, "pos", "vector", idle_ms), "seq_id long, pos long, num_tokens int", "Append", "ProcessingTime" if idle else "None")
