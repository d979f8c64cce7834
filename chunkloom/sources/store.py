"""Tables that outlive a plan: snapshots of indexes, recipes, containers and statistics, all Parquet."""

from __future__ import annotations

import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset,
    a temporary one if this is a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="chunkloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _once(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once and reads it again, which also ends its lineage. Its plan's shuffle files go as soon as it is written."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/made-{uuid.uuid4().hex}"
    with _once(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised df, which can't be read any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("made-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """Named tables under one root. A table is either replaced (each write is a version v1, v2, ... in a folder of its own,
    and the last is read) or appended to (each write adds a part a1, a2, ... and all are read, so an append costs what it
    adds). Folders without Spark's success mark, left by failed writes, are never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, name: str, kind: str = "v") -> list[int]:
        top = self._path(f"{self.root}/{name}")
        if not self._fs.exists(top):
            return []
        done = [s.getPath() for s in self._fs.listStatus(top) if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[0] == kind)

    def _add(self, name: str, kind: str, df: DataFrame, partition_by: tuple[str, ...]) -> int:
        number = (self.versions(name, kind) or [0])[-1] + 1
        with _once(self.spark):
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/{kind}{number}")
        return number

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        return self._add(name, "v", df, partition_by)

    def append(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        return self._add(name, "a", df, partition_by)

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        whole, folders = self.versions(name), self._parts(name)
        if folders and version is None:
            return self.spark.read.parquet(*(f"{self.root}/{name}/{f}" for f in folders))
        return self.spark.read.parquet(f"{self.root}/{name}/v{version or whole[-1]}") if whole else None

    def _parts(self, name: str) -> list[str]:
        """Folders that make up an appended table: the last compaction c<n>, in place of parts up to n, and the parts after it."""
        last = (self.versions(name, "c") or [0])[-1]
        return [f"c{last}"] * (last > 0) + [f"a{n}" for n in self.versions(name, "a") if n > last]

    def compact(self, name: str, files: int = 8) -> None:
        """Writes an appended table's parts as one, and deletes what that replaces. Readers see either the old folders or the new
        one: it counts once it is complete."""
        parts, old = self.versions(name, "a"), self._parts(name)
        if len(old) > 1:
            self.read(name).coalesce(files).write.mode("overwrite").parquet(f"{self.root}/{name}/c{parts[-1]}")
            for f in old:
                if f != f"a{parts[-1]}":  # the last number stays taken
                    self._fs.delete(self._path(f"{self.root}/{name}/{f}"), True)

    def drop(self) -> None:
        """Deletes the store."""
        self._fs.delete(self._path(self.root), True)

    def keep_last(self, name: str, n: int = 2) -> None:
        """Deletes all but the last n versions of a replaced table."""
        for v in self.versions(name)[:-n]:
            self._fs.delete(self._path(f"{self.root}/{name}/v{v}"), True)


def upsert(old: DataFrame | None, new: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last write wins: for each key the value with the greatest order."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def lookup(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows of keys, with the index's columns (null where it has no such key)."""
    return keys.join(index, key, "left")


@dataclass(frozen=True)
class Config:
    """Sizes and names that a run uses; read from JSON (flat, or grouped one level deep)."""

    min_chunk: int = 4096
    avg_chunk: int = 8192
    max_chunk: int = 16_384
    segment_min: int = 5 << 20
    segment_max: int = 20 << 20
    segment_divisor: int = 640
    segment_pattern: int = 1
    segment_chunks: int = 5120
    container: int = 4 << 20
    top_k: int = 512 * 1024
    sketch_width: int = 262_144
    batch: int = 128
    champions: int = 10
    manifests_per_hook: int = 10
    hook_bits: int = 6
    secret: str = "chunkloom"

    @classmethod
    def read(cls, text: str) -> Config:
        raw = json.loads(text)
        flat = {k: v for g in raw.values() if isinstance(g, dict) for k, v in g.items()} | {k: v for k, v in raw.items() if not isinstance(v, dict)}
        return cls(**{f.name: flat[f.name] for f in fields(cls) if f.name in flat})


def write_statistics(df: DataFrame, path: str) -> None:
    """Statistics of runs as CSV with a header, appended."""
    df.write.mode("append").option("header", True).csv(path)


def carry_over(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """Cumulative counters: the sums of a snapshot's and a run's."""
    both = now if before is None else before.unionByName(now)
    return both.agg(*(F.sum(c).alias(c) for c in now.columns))
