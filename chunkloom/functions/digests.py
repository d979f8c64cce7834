"""Fingerprints and values derived from them, as Spark expressions. A fingerprint is a hex digest string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_PATTERN_BITS = 6
SKETCH_WIDTH, SKETCH_DEPTH = 262_144, 4


def fingerprint(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of content (string or binary): sha256, sha1 or md5."""
    return {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}[algorithm](content)


def byte_at(fp: Column, i: Column | int) -> Column:
    start = F.lit(2) * i + 1 if isinstance(i, Column) else F.lit(2 * i + 1)
    return F.conv(F.substr(fp, start, F.lit(2)), 16, 10).cast("int")


def byte_sum(fp: Column) -> Column:
    """Sum of a digest's bytes."""
    values = F.transform(F.sequence(F.lit(0), (F.length(fp) / 2).cast("int") - 1), lambda i: byte_at(fp, i))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def is_hook(fp: Column, bits: int = SHORT_PATTERN_BITS) -> Column:
    """Whether a digest's leading `bits` (at most 8) are zero: a content-defined sample of one in 2^bits."""
    return byte_at(fp, 0) < (1 << (8 - bits))


def little_endian_word(fp: Column, i: int) -> Column:
    """The i-th 32-bit little-endian word of a digest, as a long."""
    at = 8 * i
    swapped = F.concat(*(F.substring(fp, at + k, 2) for k in (7, 5, 3, 1)))
    return F.conv(swapped, 16, 10).cast("long")


def sketch_position(fp: Column, row: int, width: int = SKETCH_WIDTH) -> Column:
    """Column of a count-min sketch row: words of the fingerprint serve as independent hashes."""
    return (little_endian_word(fp, row) % width).cast("int")


def unit_interval(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on its parts only: the digest's first 32 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def file_id(name: Column, client: Column) -> Column:
    """Name space of a file: the same name under two clients gives two ids."""
    return F.sha2(F.concat_ws("/", client.cast("string"), name), 256)


def list_digest(sizes_and_fps: Column) -> Column:
    """Digest of an ordered array of (size, fp): equal for equal lists."""
    return F.sha2(F.array_join(F.transform(sizes_and_fps, lambda x: F.concat_ws(":", x["size"].cast("string"), x["fp"])), ","), 256)


def clamp_size(size: Column, most: int = 16_384) -> Column:
    return F.least(size, F.lit(most))
