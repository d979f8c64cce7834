"""Incremental deduplication over streams: batches are joined with snapshot tables, and checkpoints replace saved state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.dedup import new_chunks
from chunkloom.sources.store import Store


def exact_sink(store: Store):
    """For foreachBatch: adds to the table `index` what it hasn't. A batch that is run again (after a failure) finds its own
    chunks there and adds nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        index = store.read("index")
        chunks = batch.select("seq", "fp", "size")
        fresh = new_chunks(chunks, index, "fp", "seq", "size") if index is not None else chunks.groupBy("fp").agg(F.min("seq").alias("seq"), F.min_by("size", "seq").alias("size"))
        store.append("index", fresh.select("fp", "seq", "size"))

    return run


def dedup_stream(chunks: DataFrame, store: Store, checkpoint: str):
    """Starts the query; it ends when all input at hand is read."""
    return chunks.writeStream.foreachBatch(exact_sink(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_stream(chunks: DataFrame) -> DataFrame:
    """A stream of first occurrences, with Spark's own keyed state (a key is kept for good)."""
    return chunks.dropDuplicates(["fp"])


def windowed_counts(chunks: DataFrame, ts: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Frequencies by event-time window, with late data up to a watermark."""
    return chunks.withWatermark(ts, late).groupBy(F.window(ts, width), "fp").agg(F.count(F.lit(1)).alias("freq"))


def running_frequency_stream(chunks: DataFrame) -> DataFrame:
    """fp, batch_n, freq: with each micro-batch, how often a fingerprint came in it and so far; its state is one number a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = sum(len(b) for b in batches)
        total = (state.get[0] if state.exists else 0) + n
        state.update((total,))
        yield pd.DataFrame({"fp": [key[0]], "batch_n": [n], "freq": [total]})

    return chunks.groupBy("fp").applyInPandasWithState(step, "fp string, batch_n long, freq long", "n long", "update", "NoTimeout")
