"""Deterministic test data: Zipf traces, random draws, and bytes that compress at a given ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions.digests import unit_interval


def zipf_trace(spark: SparkSession, unique: int, factor: int, s: float, seed: str = "zipf", size: int = 8192) -> DataFrame:
    """seq, fp, size: every fingerprint once, then (factor - 1) x unique draws of rank r with weight r^-s. A draw is a hash
    of its number, looked up in the cumulative weights: ranks are cut at whole parts of the cumulative weight, so the
    lookup is an equi-join on the part and a comparison within it."""
    ranks = spark.range(1, unique + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-s)).alias("w"))
    x = ranks.withColumn("upto", F.sum("w").over(Window.orderBy("rank"))).withColumn("all", F.sum("w").over(Window.partitionBy()))
    cells = max(1, unique)
    x = x.select("rank", (F.col("upto") / F.col("all")).alias("hi"), ((F.col("upto") - F.col("w")) / F.col("all")).alias("lo"))
    x = x.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells - 1e-9).cast("int"), F.floor(F.col("hi") * cells + 1e-9).cast("int"))))
    draws = spark.range(unique + 1, unique * factor + 1).select(F.col("id").alias("seq"), unit_interval(F.lit(seed), F.col("id")).alias("u"))
    hit = draws.withColumn("cell", F.floor(F.col("u") * cells).cast("int")).join(x, "cell").filter("u >= lo and u < hi")
    every = hit.groupBy("seq").agg(F.min("rank").alias("rank")).unionByName(spark.range(1, unique + 1).select(F.col("id").alias("seq"), F.col("id").alias("rank")))
    return every.select("seq", F.sha2(F.concat_ws("|", F.lit(seed), F.col("rank").cast("string")), 256).alias("fp"), F.lit(size).alias("size"))


def uniform(low: float, high: float, *parts: Column) -> Column:
    return unit_interval(*parts) * (high - low) + low


def normal(mean: float, spread: float, *parts: Column) -> Column:
    """Box-Muller on two draws."""
    u, v = unit_interval(F.lit("u"), *parts), unit_interval(F.lit("v"), *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v) * spread + mean


def geometric(p: float, *parts: Column) -> Column:
    """Failures before the first success."""
    return F.floor(F.log(1 - unit_interval(*parts)) / float(np.log1p(-p))).cast("long")


def poisson(rate: float, *parts: Column, most: int = 200) -> Column:
    """By inversion of the cumulative probabilities, up to `most`."""
    k = np.arange(most)
    upto = np.cumsum(np.exp(-rate + k * np.log(rate) - np.concatenate(([0], np.cumsum(np.log(np.maximum(k[1:], 1)))))))
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in upto if c < 1 - 1e-12)), lambda c: c <= unit_interval(*parts))).cast("long")


def compressible(size: int, ratio: float, seed: int) -> bytes:
    """Bytes that a dictionary coder shrinks by about `ratio`: random literals, and copies of what came before."""
    rng = np.random.default_rng(seed)
    out = bytearray(rng.integers(0, 256, min(size, 64), np.uint8).tobytes())
    while len(out) < size:
        n = int(rng.integers(16, 64))
        if rng.random() < 1 / ratio:
            out += rng.integers(0, 256, n, np.uint8).tobytes()
        else:
            at = int(rng.integers(0, max(1, len(out) - n)))
            out += out[at : at + n]
    return bytes(out[:size])


def chunk_content(trace: DataFrame, ratio: float = 2.0, spread: float = 0.25, seed: int = 1) -> DataFrame:
    """trace (fp, size, ...) with data: content of the chunk's size whose ratio is drawn from its fingerprint, with the
    fingerprint written over its beginning, so that equal (fp, size) have equal content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = []
            for fp, size in zip(pdf["fp"], pdf["size"], strict=True):
                own = int(fp[:12], 16)
                r = max(1.01, np.random.default_rng(own).normal(ratio, spread))
                raw = bytes.fromhex(fp)
                data.append((raw + compressible(int(size), r, own ^ seed)[len(raw) :])[: int(size)])
            yield pdf.assign(data=data)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trace.schema)
    return trace.mapInPandas(run, f"{fields}, data binary")
