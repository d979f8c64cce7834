"""Containers, recipes and restoring: where stored chunks lie and how files come back from them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.codec import compress, decompress

CONTAINER, IV = 4 << 20, 16


def pack(stored: DataFrame, capacity: int = CONTAINER, overhead: int = IV) -> DataFrame:
    """stored (writer, seq, length, ...) with container and offset: a writer's chunks fill a container in order until one
    would reach its capacity. Writers pack in parallel, and many small ones cost no more than a large one; container names come from writer and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, used, begun = None, 0, 0, False
        for batch in batches:
            numbers, offsets = [], []
            for w, n in zip(batch.column("writer").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if w != writer or not begun:
                    writer, number, used, begun = w, 0, 0, True
                elif overhead + n + used >= capacity and used:
                    number, used = number + 1, 0
                numbers.append(number)
                offsets.append(used)
                used += overhead + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "number", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    out = stored.repartition("writer").sortWithinPartitions("writer", "seq").mapInArrow(run, f"{fields}, number long, offset long")
    return out.withColumn("container", F.concat_ws("-", F.col("writer").cast("string"), F.lpad(F.col("number").cast("string"), 8, "0"))).drop("number")


def recipes(chunks: DataFrame, addresses: DataFrame) -> DataFrame:
    """file_id, seq, container, offset, length for every chunk of every file, from its fingerprint's address."""
    return chunks.select("file_id", "seq", "fp").join(addresses.select("fp", "container", "offset", "length"), "fp").select("file_id", "seq", "container", "offset", "length")


def recipe_heads(chunks: DataFrame) -> DataFrame:
    """file_id, file_size, chunk_num"""
    return chunks.groupBy("file_id").agg(F.sum("size").alias("file_size"), F.count(F.lit(1)).alias("chunk_num"))


def containers(packed: DataFrame, overhead: int = IV) -> DataFrame:
    """container, size, body: stored chunks in the order of their offsets, each after room for its IV. A container is
    bounded by its capacity."""
    parts = packed.select("container", "offset", F.concat(F.unhex(F.lit("00" * overhead)), F.col("stored")).alias("part"))
    return parts.groupBy("container").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY offset)").alias("body")).select("container", F.length("body").alias("size"), "body")


def compressed(unique: DataFrame) -> DataFrame:
    """unique (…, data) with stored, is_compressed and length in place of data."""
    x = unique.withColumn("_c", compress(F.col("data").cast("binary")))
    return x.select(*(c for c in unique.columns if c != "data"), F.col("_c.stored").alias("stored"), F.col("_c.is_compressed").alias("is_compressed"), F.length("_c.stored").alias("length"))


def read_chunks(recipe: DataFrame, boxes: DataFrame, flags: DataFrame, overhead: int = IV) -> DataFrame:
    """file_id, seq, data: recipe entries joined with containers, sliced and decompressed. flags: container, offset,
    is_compressed. A container is joined once, with the list of its distinct addresses that the recipes name (as many as its
    capacity holds), and sliced there: its body goes neither with each chunk nor to Python."""
    address = F.struct("offset", "length", "is_compressed")
    wanted = recipe.select("container", "offset", "length").distinct().join(flags.select("container", "offset", "is_compressed"), ["container", "offset"])
    listed = boxes.select("container", "body").join(wanted.groupBy("container").agg(F.collect_set(address).alias("addresses")), "container")

    def cut(a):
        stored = F.substr(F.col("body"), (a["offset"] + overhead + 1).cast("int"), a["length"].cast("int"))
        return F.struct(a["offset"].alias("offset"), a["is_compressed"].alias("is_compressed"), stored.alias("stored"))

    sliced = listed.select("container", F.explode(F.transform("addresses", cut)).alias("c"))
    chunks = sliced.select("container", "c.offset", decompress(F.col("c.stored"), F.col("c.is_compressed")).alias("data"))
    return recipe.join(chunks, ["container", "offset"]).select("file_id", "seq", "data")


def restore(pieces: DataFrame) -> DataFrame:
    """file_id, data: a file's chunks joined in order, each copied once; a row is a whole file."""
    return pieces.groupBy("file_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY seq)").alias("data"))


def write_files(restored: DataFrame, root: str, suffix: str = "-d") -> int:
    """Writes each row (file_id, data) as a file of its own under root, a folder that all executors reach (any URI that Arrow
    knows); returns how many. A file gets its name when it is whole, so a task that runs again leaves no half of one."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root)
        for pdf in batches:
            for name, data in zip(pdf["file_id"].astype(str), pdf["data"], strict=True):
                path = f"{top}/{quote(name, safe='')}{suffix}"
                store.create_dir(top, recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data if data is not None else b"")
                store.move(part, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    return restored.select("file_id", "data").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
