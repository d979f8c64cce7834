"""Count-min sketches as tables: a cell is a row (row, pos, cnt), so a sketch is one aggregation and merging is a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.digests import SKETCH_DEPTH, SKETCH_WIDTH, sketch_position
from chunkloom.functions.murmur import murmur32, murmur128
from chunkloom.operators.ordered import running_count


def positions(fp: Column, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH, scheme: str = "digest") -> Column:
    """Array of (row, pos). digest: words of the SHA-256 fingerprint; murmur: MurmurHash3 of the bytes with seeds 0,
    1, ...; murmur128: words of one 128-bit MurmurHash3 (its bytes in the order of its 64-bit halves, little-endian)."""
    if scheme == "murmur128":
        halves = murmur128(F.unhex(fp))
        pos = [(F.conv(F.substring(halves, at, 8), 16, 10).cast("long") % width).cast("int") for at in (9, 1, 25, 17)[:depth]]
    else:
        pos = [sketch_position(fp, r, width) if scheme == "digest" else (murmur32(F.unhex(fp), r) % width).cast("int") for r in range(depth)]
    return F.array(*(F.struct(F.lit(r).alias("row"), p.alias("pos")) for r, p in enumerate(pos)))


def cells(chunks: DataFrame, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH, scheme: str = "digest") -> DataFrame:
    """The sketch of a column fp. Chunks are counted by fingerprint first, so positions are derived once for each."""
    counted = chunks.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("n", F.explode(positions(F.col("fp"), width, depth, scheme)).alias("c")).groupBy("c.row", "c.pos").agg(F.sum("n").alias("cnt"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "pos").agg(F.sum("cnt").alias("cnt"))


def estimates(fps: DataFrame, sketch: DataFrame, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH, scheme: str = "digest") -> DataFrame:
    """fp, est for each distinct fp. A sketch has at most width x depth cells."""
    at = fps.select("fp").distinct().select("fp", F.explode(positions(F.col("fp"), width, depth, scheme)).alias("c")).select("fp", "c.row", "c.pos")
    return at.join(sketch, ["row", "pos"], "left").groupBy("fp").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("est"))


def first_row(sketch: DataFrame) -> DataFrame:
    return sketch.filter("row = 0").select("pos", "cnt")


def total(sketch: DataFrame) -> DataFrame:
    return sketch.filter("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def running_estimates(chunks: DataFrame, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH, block: int = 4096) -> DataFrame:
    """seq, fp, est: each chunk's estimate just after its own insertion, with no sketch being updated: the running count of
    each cell, and the least over rows."""
    cell = chunks.select("seq", "fp", F.explode(positions(F.col("fp"), width, depth)).alias("c")).select("seq", "fp", "c.row", "c.pos")
    counted = running_count(cell, ["row", "pos"], "seq", F.floor((F.col("seq") - 1) / block))
    return counted.groupBy("seq").agg(F.first("fp").alias("fp"), F.min("running").alias("est"))


def running_least(chunks: DataFrame, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH, block: int = 4096) -> DataFrame:
    """seq, est: running_estimates without fingerprints, which the rows of cells needn't carry."""
    cell = chunks.select("seq", F.explode(positions(F.col("fp"), width, depth)).alias("c")).select("seq", "c.row", "c.pos")
    return running_count(cell, ["row", "pos"], "seq", F.floor((F.col("seq") - 1) / block)).groupBy("seq").agg(F.min("running").alias("est"))


def batch_latest(estimated: DataFrame, batch: int) -> DataFrame:
    """batch, fp, est: the estimate at a fingerprint's last occurrence in each batch."""
    return estimated.groupBy(F.floor((F.col("seq") - 1) / batch).cast("long").alias("batch"), "fp").agg(F.max_by("est", "seq").alias("est"))


def top_k(estimated: DataFrame, k: int) -> DataFrame:
    """The k fingerprints with the greatest estimates; ties go to the smaller fingerprint. Partial limits, no global sort."""
    return estimated.orderBy(F.desc("est"), "fp").limit(k)


def heavy_hitters(chunks: DataFrame, k: int) -> DataFrame:
    """fp, cnt, rank of the k most frequent, counted exactly."""
    counted = chunks.groupBy("fp").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "fp").limit(k)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "fp")))  # k rows
