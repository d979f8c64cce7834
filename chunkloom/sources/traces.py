"""Scans of files and fingerprint traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.ordered import dense_sequence


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id (path), size, data of every file under a path or glob; list with `.drop("data")` to read no content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_id"), F.col("length").alias("size"), F.col("content").alias("data"))


def parse_trace(lines: Column, fp_bytes: int = 6, most: int = 16_384) -> Column:
    """Struct (fp, size) of a trace line: fp_bytes hex bytes and a decimal size, parted by colons or blanks; the rest of
    the line is ignored, sizes are clamped, and lines without as much are null."""
    parts = F.split(F.trim(lines), r"[:\t\n ]+")
    parsed = F.struct(F.lower(F.array_join(F.slice(parts, 1, fp_bytes), "")).alias("fp"), F.least(F.try_element_at(parts, F.lit(fp_bytes + 1)).try_cast("int"), F.lit(most)).alias("size"))
    shaped = lines.rlike(r"^\s*[0-9A-Fa-f]{1,2}" + r"[:\t ]+[0-9A-Fa-f]{1,2}" * (fp_bytes - 1) + r"[:\t ]+\d")
    return F.when(shaped, parsed)


def read_trace(spark: SparkSession, paths: str | list[str], fp_bytes: int = 6, most: int = 16_384) -> DataFrame:
    """seq, fp, size of text traces. Several paths are concatenated in the order given; a last line without a newline
    counts, and blank lines are passed over."""
    named = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, p in enumerate(named):
        part = spark.read.text(p).select(F.lit(i).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), parse_trace(F.col("value"), fp_bytes, most).alias("t"))
        out = part if out is None else out.unionByName(part)
    kept = out.filter("t is not null").select("part", "file", "start", "line", "t.fp", "t.size")
    return dense_sequence(kept, ["part", "file", "start", "line"]).select("seq", "fp", "size")


def format_trace(fp: Column, size: Column, fp_bytes: int = 6) -> Column:
    """A trace line, the inverse of parse_trace."""
    pairs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(fp_bytes - 1)), lambda i: F.substr(fp, i * 2 + 1, F.lit(2))), ":")
    return F.concat_ws("\t", pairs, size.cast("string"), F.lit("10"))


def concatenate(traces: list[DataFrame]) -> DataFrame:
    """Traces one after the other, numbered through."""
    out = None
    for i, t in enumerate(traces):
        part = t.withColumn("_trace", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return dense_sequence(out.withColumnRenamed("seq", "_seq"), ["_trace", "_seq"]).drop("_trace", "_seq")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, fp, size: the events in order, one fingerprint for each user and kind of event."""
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256).alias("fp"), (F.col("user_id") % 4096 + 4096).cast("int").alias("size"))


def file_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, seq, fp, size: a file for each supplier, whose chunks are the parts in the order of their sales."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("file_id"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("seq"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("fp"), (F.col("l_quantity") * 100).cast("int").alias("size"))
