"""Chunk compression with a fallback for what doesn't shrink. zlib stands in for byte-oriented fast codecs: sizes are those
of zlib level 1, and a flag says how a chunk is stored, so stored bytes are never guessed to be compressed or raw."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL = 1


def pack_bytes(raw: bytes | None) -> tuple[bytes | None, bool]:
    if raw is None:
        return None, False
    small = zlib.compress(raw, LEVEL)
    return (small, True) if len(small) < len(raw) else (raw, False)


def compress(raw: Column) -> Column:
    """Struct (stored, is_compressed) of a binary column."""

    @F.pandas_udf("stored binary, is_compressed boolean")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pack_bytes(r) for r in raw], columns=["stored", "is_compressed"])

    return run(raw)


def decompress(stored: Column, is_compressed: Column) -> Column:
    @F.pandas_udf("binary")
    def run(stored: pd.Series, is_compressed: pd.Series) -> pd.Series:
        return pd.Series([zlib.decompress(s) if s is not None and c else s for s, c in zip(stored, is_compressed, strict=True)], dtype=object)

    return run(stored, is_compressed)
