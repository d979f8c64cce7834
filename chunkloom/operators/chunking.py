"""Content to chunks: fixed-size and content-defined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_chunks(files: DataFrame, size: int, id_col: str = "file_id", data_col: str = "data", block: int | None = None) -> DataFrame:
    """file_id, seq, offset, size, data: cuts every `size` bytes (characters, if data is a string); the tail is kept.
    With a block, cuts start anew at each block, as if files were read in pieces of that length."""
    data = F.col(data_col)
    if block is None:
        pieces = F.expr(f"transform(sequence(0, greatest(0, (length(`{data_col}`) - 1) div {size})), i -> cast(i * {size} as int))")
    else:
        pieces = F.expr(f"flatten(transform(sequence(0, greatest(0, (length(`{data_col}`) - 1) div {block})), b -> transform(sequence(0, (least({block}, length(`{data_col}`) - b * {block}) - 1) div {size}), i -> cast(b * {block} + i * {size} as int))))")
    some = files.filter(F.length(data) > 0).select(F.col(id_col).alias("file_id"), data.alias("_whole"), F.posexplode(pieces).alias("seq", "offset"))
    end = F.col("offset") + size if block is None else F.least(F.col("offset") + size, (F.floor(F.col("offset") / block) + 1) * block)
    cut = F.substr(F.col("_whole"), F.col("offset") + 1, (end - F.col("offset")).cast("int"))
    return some.select("file_id", F.col("seq").cast("long").alias("seq"), F.col("offset").cast("long").alias("offset"), cut.alias("data")).select("file_id", "seq", "offset", F.length("data").alias("size"), "data")


def gear_table(seed: int = 2022) -> np.ndarray:
    """256 random 32-bit values, one for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


class ContentCutter:
    """Gear-hash cut points between a least and a greatest size, with a strict mask before the normal size and a loose one after.

    The hash at a byte is the sum of the gear values of it and the 31 bytes before, each shifted by its distance, in 32
    bits. It doesn't depend on where a chunk began, so numpy finds it for all bytes in five doubling steps, and cutting is
    a walk over the few bytes whose hash passes a mask.
    """

    def __init__(self, least: int = 4096, average: int = 8192, most: int = 16_384, seed: int = 2022):
        self.least, self.average, self.most = least, average, most
        # with the default sizes the normal size lies below the least size, so that the loose mask decides all cuts
        self.normal = max(0, average - min(average, least + -(-least // 2)))
        bits = round(np.log2(average))
        self.strict, self.loose = (np.uint32(((1 << b) - 1) << (32 - b)) for b in (bits + 1, bits - 1))
        self.gear = gear_table(seed)

    def hashes(self, data: bytes) -> np.ndarray:
        h = self.gear[np.frombuffer(data, np.uint8)]
        for reach in (1, 2, 4, 8, 16):
            h[reach:] += h[:-reach] << np.uint32(reach)
        return h

    def cuts(self, data: bytes) -> list[tuple[int, int]]:
        """(offset, length) of each chunk; no least size holds for the last."""
        h = self.hashes(data)
        strict, loose = np.flatnonzero((h & self.strict) == 0), np.flatnonzero((h & self.loose) == 0)
        out, at = [], 0
        while at < len(data):
            end = min(at + self.most, len(data))
            for marks, a, b in ((strict, at + self.least, at + self.normal), (loose, at + max(self.least, self.normal, 1), end)):
                i = np.searchsorted(marks, a)
                if i < len(marks) and marks[i] < min(b, end):
                    end = int(marks[i])
                    break
            out.append((at, end - at))
            at = end
        return out


def content_chunks(files: DataFrame, cutter: ContentCutter | None = None, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, seq, offset, size, data by content-defined cut points."""
    cutter = cutter or ContentCutter()
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, data in zip(pdf["file_id"], pdf["data"], strict=True):
                if data is not None and len(data):
                    cuts = cutter.cuts(bytes(data))
                    yield pd.DataFrame({"file_id": [i] * len(cuts), "seq": range(len(cuts)), "offset": [a for a, _ in cuts], "size": [n for _, n in cuts], "data": [data[a : a + n] for a, n in cuts]})

    return files.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data")).mapInPandas(run, f"file_id {kind}, seq long, offset long, size int, data binary")
