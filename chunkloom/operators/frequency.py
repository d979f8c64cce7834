"""The frequency index: a bounded set of frequent fingerprints in front of an exact outer index."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.digests import SKETCH_WIDTH
from chunkloom.operators.ordered import ordered_fold
from chunkloom.operators.sketches import running_least
from chunkloom.sources.store import materialise


class TopSet:
    """The k fingerprints with the greatest frequencies so far. A full set admits a frequency that isn't below its least,
    and then drops its least (of equals the one that came first)."""

    def __init__(self, k: int, gate: str = "full"):
        self.k, self.gate = k, gate
        self.held: dict[str, tuple[int, int]] = {}
        self.heap: list[tuple[int, int, str]] = []
        self.clock = 0

    def _least(self) -> int:
        while self.heap and self.held.get(self.heap[0][2]) != self.heap[0][:2]:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else 0

    def least(self) -> int:
        """What a frequency must reach for a lookup to be worth while. gate 'full': nothing until the set is full;
        'any': the least frequency held, from the first one on."""
        return self._least() if len(self.held) >= self.k or self.gate == "any" else 0

    def _put(self, fp: str, freq: int, came: int) -> None:
        self.held[fp] = (freq, came)
        heapq.heappush(self.heap, (freq, came, fp))
        if len(self.heap) > 2 * len(self.held) + 64:  # entries that later frequencies have replaced
            self.heap = [(*v, f) for f, v in self.held.items()]
            heapq.heapify(self.heap)

    def offer(self, fp: str, freq: int) -> None:
        if fp in self.held:
            if self.gate == "any" or len(self.held) < self.k or freq >= self._least():
                self._put(fp, freq, self.held[fp][1])
            return
        if len(self.held) >= self.k:
            if freq < self._least():
                return
            self._least()
            del self.held[heapq.heappop(self.heap)[2]]
        self.clock += 1
        self._put(fp, freq, self.clock)


def replay(chunks: DataFrame, k: int, batch: int = 128, width: int = SKETCH_WIDTH, gate: str = "full") -> DataFrame:
    """batch, fp, n (its chunks there), est, served: where the batch's first chunk of a fingerprint was decided, `inside` by the
    set or `outer` by the index behind it. chunks: seq (1, 2, ...), fp.

    Estimates and in-batch counts are windows and aggregations over all data (see sketches); estimates are written once, so
    that the rows of sketch cells are gone before the rest. What is left, a row for each
    batch and fingerprint, has an order by definition and is streamed through one task that holds k fingerprints.
    """
    per_batch = chunks.groupBy(F.floor((F.col("seq") - 1) / batch).cast("long").alias("batch"), "fp").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.max("seq").alias("last"))
    est = materialise(running_least(chunks, width))
    rows = per_batch.join(est.withColumnRenamed("seq", "last"), "last").select(F.lit(0).alias("all"), "batch", "seq", "fp", "n", "est")

    class State:
        def __init__(self):
            self.top, self.batch, self.pending = TopSet(k, gate), None, []
            self.bar = 0

        def turn(self, batch: int) -> None:
            if batch != self.batch:
                for fp, freq in self.pending:
                    self.top.offer(fp, freq)
                self.pending, self.batch, self.bar = [], batch, 0
                self.bar = self.top.least()

    def step(state: State, pdf: pd.DataFrame) -> pd.DataFrame:
        served = []
        for b, fp, est in zip(pdf["batch"].tolist(), pdf["fp"].tolist(), pdf["est"].tolist(), strict=True):
            state.turn(b)
            served.append("inside" if est >= state.bar and fp in state.top.held else "outer")
            state.pending.append((fp, est))
        return pdf[["batch", "fp", "n", "est"]].assign(served=served)

    return ordered_fold(rows, ["all"], ["batch", "seq"], State, step, "batch long, fp string, n long, est long, served string")


def dedup_report(chunks: DataFrame, replayed: DataFrame) -> DataFrame:
    """One row: logical and unique chunks and bytes, and where duplicates were found."""
    firsts = replayed.groupBy("fp").agg(F.min("batch").alias("since"))
    x = replayed.join(firsts, "fp")
    inside = F.sum(F.when(F.col("served") == "inside", 1).otherwise(0)).alias("inside_probes")
    outer = F.sum(F.when(F.col("served") == "outer", 1).otherwise(0)).alias("outer_probes")
    found = F.sum(F.when((F.col("served") == "outer") & (F.col("batch") > F.col("since")), 1).otherwise(0)).alias("outer_duplicates")
    return x.agg(F.sum("n").alias("logical_chunks"), F.countDistinct("fp").alias("unique_chunks"), inside, outer, found, F.sum(F.col("n") - 1).alias("batch_duplicates"))


def observed(replayed: DataFrame) -> DataFrame:
    """fp, freq: how often the outer index saw each fingerprint."""
    return replayed.filter("served = 'outer'").groupBy("fp").agg(F.count(F.lit(1)).alias("freq"))
