"""MurmurHash3 (x86, 32 and 128 bits, and x64, 128 bits) of binary columns, by the published algorithm.

Spark's hash() is a relative with another treatment of trailing bytes and a fixed seed, so it can't stand in. Keys of equal
length are hashed together in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm.
_X86 = (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35)
_X86_128 = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
_X86_128_ADD = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
_X86_128_TURNS = ((15, 19), (16, 17), (17, 15), (18, 13))
_X64 = (0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729, 0x38495AB5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return (x << x.dtype.type(r)) | (x >> x.dtype.type(bits - r))


def _words(keys: np.ndarray, kind: str) -> np.ndarray:
    """Keys (a row of bytes each), padded with zeros to whole words."""
    size = np.dtype(kind).itemsize
    wide = np.zeros((len(keys), -(-keys.shape[1] // size) * size), np.uint8)
    wide[:, : keys.shape[1]] = keys
    return wide.view(kind)


def murmur3_32(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    n, u = keys.shape[1], np.uint32
    c1, c2, add, f1, f2 = map(u, _X86)
    h = np.full(len(keys), seed, u)
    with np.errstate(over="ignore"):
        for i, k in enumerate(_words(keys, "<u4").T if n else []):
            h ^= _turn(k * c1, 15) * c2
            if (i + 1) * 4 <= n:
                h = _turn(h, 13) * u(5) + add
        h ^= u(n)
        h = (h ^ (h >> u(16))) * f1
        h = (h ^ (h >> u(13))) * f2
    return h ^ (h >> u(16))


def murmur3_128(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """Two 64-bit halves a row."""
    n, u = keys.shape[1], np.uint64
    c1, c2, a1, a2, f1, f2 = map(u, _X64)
    w = _words(keys, "<u8") if n else np.zeros((len(keys), 0), u)
    h1, h2 = np.full(len(keys), seed, u), np.full(len(keys), seed, u)
    with np.errstate(over="ignore"):
        for at in range(0, w.shape[1], 2):
            whole = (at + 2) * 8 <= n
            k1 = _turn(w[:, at] * c1, 31) * c2
            k2 = _turn(w[:, at + 1] * c2, 33) * c1 if at + 1 < w.shape[1] else None
            h1 = h1 ^ k1
            if whole:
                h1 = (_turn(h1, 27) + h2) * u(5) + a1
            if k2 is not None:
                h2 = h2 ^ k2
            if whole:
                h2 = (_turn(h2, 31) + h1) * u(5) + a2
        h1, h2 = h1 ^ u(n), h2 ^ u(n)
        h1 = h1 + h2
        h2 = h2 + h1

        def final(h: np.ndarray) -> np.ndarray:
            h = (h ^ (h >> u(33))) * f1
            h = (h ^ (h >> u(33))) * f2
            return h ^ (h >> u(33))

        h1, h2 = final(h1), final(h2)
        h1 = h1 + h2
        h2 = h2 + h1
    return np.stack([h1, h2], axis=1)


def murmur3_x86_128(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """Four 32-bit words a row. Lane i takes every fourth word; a lane's word is mixed in before the next lane's is."""
    n, u = keys.shape[1], np.uint32
    c, add, f1, f2 = [u(x) for x in _X86_128], [u(x) for x in _X86_128_ADD], u(_X86[3]), u(_X86[4])
    w = _words(keys, "<u4") if n else np.zeros((len(keys), 0), u)
    h = [np.full(len(keys), seed, u) for _ in c]

    def total() -> None:
        h[0] = h[0] + h[1] + h[2] + h[3]
        h[1:] = [x + h[0] for x in h[1:]]

    with np.errstate(over="ignore"):
        for at in range(w.shape[1]):
            i, (turn_word, turn_lane) = at % 4, _X86_128_TURNS[at % 4]
            h[i] = h[i] ^ _turn(w[:, at] * c[i], turn_word) * c[(i + 1) % 4]
            if (at // 4 + 1) * 16 <= n:
                h[i] = (_turn(h[i], turn_lane) + h[(i + 1) % 4]) * u(5) + add[i]
        h = [x ^ u(n) for x in h]
        total()
        for shift, factor in ((16, f1), (13, f2)):
            h = [(x ^ (x >> u(shift))) * factor for x in h]
        h = [x ^ (x >> u(16)) for x in h]
        total()
    return np.stack(h, axis=1)


def _by_length(keys: pd.Series, hashed) -> list:
    out: list = [None] * len(keys)
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        if k is not None:
            groups.setdefault(len(k), []).append(i)
    for n, at in groups.items():
        rows = np.frombuffer(b"".join(keys.iloc[i] for i in at), np.uint8).reshape(len(at), n)
        for i, h in zip(at, hashed(rows), strict=True):
            out[i] = h
    return out


def murmur32(content: Column, seed: int = 0) -> Column:
    """Unsigned 32-bit hash as a long; null for null."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(_by_length(keys, lambda rows: murmur3_32(rows, seed).astype(np.int64).tolist()), dtype="Int64")

    return run(content)


def murmur128(content: Column, seed: int = 0, x86: bool = False) -> Column:
    """Hex string of the two halves (x86: of the four words); null for null."""

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        hashed, digits = (murmur3_x86_128, 8) if x86 else (murmur3_128, 16)
        return pd.Series(_by_length(keys, lambda rows: ["".join(f"{int(w):0{digits}x}" for w in r) for r in hashed(rows, seed)]), dtype=object)

    return run(content)
