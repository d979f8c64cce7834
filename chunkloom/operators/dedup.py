"""Exact deduplication: what is new against an index, and the first of equals within an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen(chunks: DataFrame, key: str = "fp", order: str = "seq", *extra: str) -> DataFrame:
    """One row for each key: its first row's `order` and extra columns. An aggregation with partial results before the
    shuffle, so a key that many rows share isn't gathered anywhere."""
    packed = F.min_by(F.struct(*extra), order).alias("_first") if extra else F.count(F.lit(1)).alias("_n")
    out = chunks.groupBy(key).agg(F.min(order).alias(order), packed)
    return out.select(key, order, *([f"_first.{e}" for e in extra]))


def mark_first(chunks: DataFrame, key: str = "fp", order: str = "seq") -> DataFrame:
    """All rows with is_first: whether no earlier row has the same key."""
    firsts = chunks.groupBy(key).agg(F.min(order).alias("_first"))
    return chunks.join(firsts, key).withColumn("is_first", F.col(order) == F.col("_first")).drop("_first")


def new_chunks(chunks: DataFrame, index: DataFrame, key: str = "fp", order: str = "seq", *extra: str) -> DataFrame:
    """First rows of the keys that the index hasn't: duplicates go before the join, so it moves one row for each key."""
    return first_seen(chunks, key, order, *extra).join(index.select(key), key, "left_anti")


def known_chunks(chunks: DataFrame, index: DataFrame, key: str = "fp") -> DataFrame:
    return chunks.join(index.select(key), key, "left_semi")


def probe(chunks: DataFrame, index: DataFrame, key: str = "fp") -> DataFrame:
    """All chunks with is_known: whether the index has their key."""
    return chunks.join(index.select(key, F.lit(True).alias("_k")), key, "left").withColumn("is_known", F.col("_k").isNotNull()).drop("_k")


def grow_index(index: DataFrame | None, fresh: DataFrame) -> DataFrame:
    return fresh if index is None else index.unionByName(fresh.select(*index.columns))


def batch_flags(chunks: DataFrame, batch: int, index: DataFrame | None = None, key: str = "fp", order: str = "seq") -> DataFrame:
    """All rows with batch and flag: UNIQUE or DUPLICATE for the first of a key in its batch (by whether an earlier batch
    or the index has it), TMP_UNIQUE or TMP_DUPLICATE for its repeats there. Windows are within a batch."""
    x = chunks.withColumn("batch", F.floor((F.col(order) - 1) / batch).cast("long"))
    firsts = x.groupBy(key).agg(F.min("batch").alias("_since"))
    if index is not None:
        firsts = firsts.join(index.select(key, F.lit(-1).alias("_old")), key, "left").select(key, F.coalesce("_old", "_since").alias("_since"))
    rank = F.row_number().over(Window.partitionBy("batch", key).orderBy(order))
    known = F.when(F.col("_since") < F.col("batch"), "DUPLICATE").otherwise("UNIQUE")
    return x.withColumn("_rank", rank).join(firsts, key).withColumn("flag", F.when(F.col("_rank") == 1, known).otherwise(F.concat(F.lit("TMP_"), known))).drop("_rank", "_since")


def batch_sets(chunks: DataFrame, batch: int, key: str = "fp", order: str = "seq") -> DataFrame:
    """The distinct keys of each batch."""
    return chunks.select(F.floor((F.col(order) - 1) / batch).cast("long").alias("batch"), key).distinct()
