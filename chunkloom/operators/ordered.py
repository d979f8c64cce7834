"""Order-dependent building blocks that keep no unbounded group in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.store import materialise


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, finish: Callable[[object, tuple], pd.DataFrame] | None = None) -> DataFrame:
    """Runs step(state, rows) over the rows of each key in order and returns what the steps return.

    Rows are hashed by key and sorted inside partitions, and then streamed in Arrow batches: a key's rows come in one or
    more pieces with its state carried between them, so the memory needed is that of a batch, however long the key's
    history. finish(state, key) may add rows after a key's last piece. Keys run in parallel; one key is sequential by nature.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            marks = pd.MultiIndex.from_frame(pdf[keys]) if len(keys) > 1 else pd.Index(pdf[keys[0]])
            codes = pd.factorize(marks, use_na_sentinel=False)[0]
            edges = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1]), len(codes)]
            for a, b in zip(edges, edges[1:]):
                key = tuple(pdf[keys].iloc[a].tolist())
                if at is None or repr(key) != repr(at):
                    if at is not None and finish:
                        yield finish(state, at)
                    at, state = key, start()
                yield step(state, pdf.iloc[a:b].reset_index(drop=True))
        if at is not None and finish:
            yield finish(state, at)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def running_count(df: DataFrame, keys: list[str], order: str, block: Column, name: str = "running") -> DataFrame:
    """How many rows of the same key stand up to and including each row.

    A plain window would put all rows of a frequent key into one task. Here the order is cut into blocks (an expression that
    never falls as `order` rises): counts of (key, block) are summed before the shuffle, their running sums are over blocks,
    and the window over rows is within a key's block.
    """
    x = df.withColumn("_block", block)
    sums = x.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)))
    return x.join(sums.select(*keys, "_block", before.alias("_before")), [*keys, "_block"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside", "_n")


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("again"), key)


def numbered_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a long `name` in place of `key`, equal where the key is and different where it differs: a hash, if no two keys
    share it (as another hash tells), else the keys' own numbers. What is read twice is written once."""
    a, b = _hashes(F.col(key))
    hashed = materialise(df.select(*(c for c in df.columns if c != key), a.alias(name), b.alias("_b")))
    if not hashed.select(name, "_b").distinct().groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        return hashed.drop("_b")
    return df.join(dense_sequence(df.select(key).distinct(), [key], name), key).drop(key)


def dense_sequence(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Numbers rows 1, 2, ... in the given order: range partitions are sorted and numbered on their own and shifted by the
    counts of those before them, so no task sees all rows. They are written once, with a row's partition and place in it
    (what monotonically_increasing_id is made of), so that no shuffle more is needed and both reads see the same ones."""
    parts = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_inside", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    shift = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_shift"))
    numbered = parts.join(F.broadcast(shift), "_part").withColumn(name, F.col("_inside") + F.col("_shift") + 1)
    return numbered.drop("_part", "_shift", "_inside", "_at")
