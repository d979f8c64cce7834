"""Storage-efficiency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """logical_chunks, logical_size, unique_chunks, unique_size, dedup_ratio for each group. Duplicates are summed before
    the shuffle, so the second step has a row for each group and fingerprint."""
    once = chunks.groupBy(*by, "fp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("size").alias("one"))
    out = once.groupBy(*by).agg(F.sum("n").alias("logical_chunks"), F.sum("s").alias("logical_size"), F.count(F.lit(1)).alias("unique_chunks"), F.sum("one").alias("unique_size"))
    return out.withColumn("dedup_ratio", F.round(F.col("logical_size") / F.col("unique_size"), 9))


def cumulative(chunks: DataFrame, snapshot: str) -> DataFrame:
    """A row for each snapshot, in order, with what has been stored up to it: a chunk is new in the first snapshot that has
    it. The running sums are over snapshots."""
    logical = chunks.groupBy(snapshot).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    new = chunks.groupBy("fp").agg(F.min(snapshot).alias(snapshot), F.min("size").alias("size")).groupBy(snapshot).agg(F.count(F.lit(1)).alias("un"), F.sum("size").alias("us"))
    w = Window.orderBy(snapshot).rowsBetween(Window.unboundedPreceding, 0)
    x = logical.join(new, snapshot, "left")
    return x.select(
        snapshot, F.sum("n").over(w).alias("logical_chunks"), F.sum("s").over(w).alias("logical_size"), F.sum(F.coalesce("un", F.lit(0))).over(w).alias("unique_chunks"), F.sum(F.coalesce("us", F.lit(0))).over(w).alias("unique_size")
    )


def ratios(logical: Column, unique: Column, compressed: Column) -> tuple[Column, Column]:
    """(logical / unique, logical / compressed)"""
    return logical / unique, logical / compressed


def throughput(n_bytes: int, seconds: float) -> float:
    """MiB a second."""
    return n_bytes / (1 << 20) / seconds
