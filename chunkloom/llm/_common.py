"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between the JVM and a worker, where the session names no bound. Spark's own 64 MiB are held
#: several times over by each task: in the JVM's buffers, in the worker's batch and as its Python strings.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a new temporary one if this is a single
    machine (tests); a cluster whose executors couldn't see such a folder is told so."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor costs a read."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(id_col: str, modulus: int):
    """crc32 of the id as decimal text, modulo: the folds that the contracts name (null id: null)."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, made longer where the columns `taken` have them already (whatever their case)."""
    out, used = [], {t.lower() for t in taken}
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have at most `most` characters together, or one text that has more."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends rows to workers in batches of BATCH_BYTES (a longer row is a batch of its own), unless it names a bound itself."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives the memory that it has freed back to the system when its task ends: workers outlive their tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied
