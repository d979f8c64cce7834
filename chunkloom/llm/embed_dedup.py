"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated at random and kept as the signs of its coordinates (a bit each), with the correction factor
c = <o, o'>, where o' is the unit vector of those signs. For any unit vector q, a = <o', q> gives the unbiased estimate
a / c of <o, q>; and since o is c o' plus a part of length sqrt(1 - c^2) at right angles to o', the estimate's bounds are
c a -+ sqrt((1 - c^2)(1 - a^2)). These bounds hold always, not just with high probability: no link is lost.

Equal vectors of a label are one class, whose vector is kept once. A class has its bit code with its correction factor, and
for its part as a query its rotated vector in a byte for each coordinate, with the length of what that rounding lost. The
codes of a label meet in blocks of BLOCK classes, every pair of blocks in a task of its own, and only they are sent there
(about 1.1 bytes a dimension). What comes back are the classes with a pair whose upper bound reaches the threshold; only
their vectors are sent, to be compared exactly in double precision. No pair is written: each pair of blocks gives its
classes their numbers of links and a root in a spanning forest of the links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label or
id, link with nothing (0 links, own component, kept); vectors of different lengths don't link; rows that repeat an id are
vectors of their own, which link like others, and the components of an id's rows are one; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import cut, table, tidy
from chunkloom.llm.graphs import connected_components
from chunkloom.llm.ngram_join import roots

THRESHOLD, BLOCK = 0.93, 1024
#: Rows of a block that are compared at a time, and what single precision may add to a bound.
TILE, MARGIN = 512, 1e-4


def clean(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Rotation:
    """A random rotation of `dim` dimensions, the same in every task."""

    def __init__(self, dim: int, seed: int = 23):
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        self.matrix = (q * np.sign(np.diag(r))).astype(np.float32)

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sign bits, packed; correction factors)"""
        x = unit.astype(np.float32) @ self.matrix
        return np.packbits(x >= 0, axis=1), np.abs(x).sum(axis=1) / np.sqrt(np.float32(x.shape[1]))


def upper_bounds(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of coded unit vectors with rotated unit queries, queries along rows. Queries may
    be rounded: `lost` is the length of what each has lost."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    near = queries @ signs.T / np.sqrt(np.float32(dim))
    # c a + sqrt((1 - c^2)(1 - a^2)) rises up to a = c and falls beyond: its largest value between a - lost and a + lost
    a = np.clip(np.clip(factors[None, :], near - lost[:, None], near + lost[:, None]), -1, 1)
    return a * factors + np.sqrt(np.maximum(0, 1 - factors**2) * (1 - a * a))


def rounded(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a byte for each coordinate, steps, lengths of what rounding lost)"""
    step = np.maximum(np.abs(queries).max(axis=1), 1e-30) / 127
    q = np.rint(queries / step[:, None])
    lost = np.sqrt(((queries - q * step[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), step.astype(np.float32), lost.astype(np.float32)


def estimates(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded unit vectors with rotated unit queries, queries along rows."""
    signs = np.unpackbits(codes, axis=1, count=queries.shape[1]).astype(np.float32) * 2 - 1
    return queries @ signs.T / np.sqrt(np.float32(queries.shape[1])) / factors


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs first x second of rows of x (as a matrix) have a cosine >= threshold, in double precision. A
    matrix product finds the pairs near the threshold; they are decided by one plain sum, the same in every task."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norms = np.sqrt((x * x).sum(axis=1))
    unit = x / norms[:, None]
    near = unit[first] @ unit[second].T
    out = near >= threshold
    i, j = np.nonzero(np.abs(near - threshold) < 1e-9)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[a, b] = (x[first[a]] * x[second[b]]).sum(axis=1) / (norms[first[a]] * norms[second[b]]) >= threshold
    return out


def coded(classes: DataFrame) -> DataFrame:
    """classes with code, factor, query, step and lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotations: dict[int, Rotation] = {}
        for pdf in batches:
            for dim, g in pdf.groupby("dim", sort=False):
                rotation = rotations.setdefault(int(dim), Rotation(int(dim))) if int(dim) not in rotations else rotations[int(dim)]
                unit = unit_rows(np.stack(g["x"].to_numpy()).astype(np.float64))
                codes, factors = rotation.codes(unit)
                query, step, lost = rounded(unit @ rotation.matrix.astype(np.float64))
                yield g.drop(columns="x").assign(code=[c.tobytes() for c in codes], factor=factors.astype(np.float32), query=[q.tobytes() for q in query], step=step, lost=lost)

    return classes.mapInPandas(tidy(run), "k long, label string, dim int, block long, blocks long, code binary, factor float, query binary, step float, lost float")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero((pdf["block"] == pdf["lo"]).to_numpy())
    return first, first if pdf["lo"].iat[0] == pdf["hi"].iat[0] else np.flatnonzero((pdf["block"] == pdf["hi"]).to_numpy())


def _open(threshold: float):
    """The classes of a pair of blocks that have a pair which the codes don't settle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable", ignore_index=True)
        dim = int(pdf["dim"].iat[0])
        codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
        queries = np.frombuffer(b"".join(pdf["query"]), np.int8).reshape(len(pdf), dim) * pdf["step"].to_numpy(np.float32)[:, None]
        factors, lost = pdf["factor"].to_numpy(np.float32), pdf["lost"].to_numpy(np.float32)
        first, second = _sides(pdf)
        live = np.zeros(len(pdf), bool)
        for at in range(0, len(first), TILE):
            rows = first[at : at + TILE]
            near = upper_bounds(codes[second], factors[second], queries[rows], lost[rows]) >= threshold - MARGIN
            near &= rows[:, None] != second[None, :]
            live[rows] |= near.any(axis=1)
            live[second] |= near.any(axis=0)
        return pdf.loc[live, ["k", "lo", "hi", "block"]]

    return run


def _exact(threshold: float):
    """Links and roots of the classes of a pair of blocks, from their vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable", ignore_index=True)
        x, k, n = np.stack(pdf["x"].to_numpy()).astype(np.float64), pdf["k"].to_numpy(), pdf["n"].to_numpy()
        first, second = _sides(pdf)
        linked = np.zeros((len(k), len(k)), bool)
        linked[np.ix_(first, second)] = linked_pairs(x, first, second, threshold)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        links, root = linked @ n, roots(linked)
        return pd.DataFrame({"k": k, "links": links, "root": k[root]})[links > 0]

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("v"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).cast("string").alias("label"))
    good = rows.filter(clean(F.col("x")) & F.col("label").isNotNull() & F.col("v").isNotNull())
    keyed = good.select("v", "label", "x", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2"))
    classes = keyed.groupBy("label", "k1", "k2").agg(F.first("x").alias("x"), F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("dim", F.size("x")).withColumn("k", F.monotonically_increasing_id()))
    # a row per label; the join's large side is split where a label is hot
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocked = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("k1", "k2"), "blocks"))
    codes = cut(coded(blocked.select("k", "label", "dim", "block", "blocks", "x")))
    dealt = codes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    # the label goes with the classes that come back, for blocks are numbered label by label
    met = dealt.select("k", "label", "dim", "lo", "hi", "block", "code", "factor", "query", "step", "lost").groupBy("label", "dim", "lo", "hi").applyInPandas(_open(threshold), "k long, lo long, hi long, block long")
    wanted = cut(met).join(classes.select("k", "label", "dim", "x", "n"), "k")
    found = cut(wanted.groupBy("label", "dim", "lo", "hi").applyInPandas(_exact(threshold), "k long, links long, root long"))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    info = classes.select("label", "k1", "k2", "k", "n", "least").join(links, "k", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    least = classes.select("k", "least")
    named = found.select("k", F.col("root")).join(least, "k").select("root", F.col("least").alias("a")).join(least.toDF("root", "b"), "root").select("a", "b")
    members = keyed.drop("x").join(info.select("label", "k1", "k2", "links", "least", "n"), ["label", "k1", "k2"])
    equal = members.filter("n > 1").select(F.col("v").alias("a"), F.col("least").alias("b"))
    comps = connected_components(named.unionByName(equal))
    own = members.select("v", "links").unionByName(rows.filter(~(clean(F.col("x")) & F.col("label").isNotNull() & F.col("v").isNotNull())).select("v", F.lit(0).cast("long").alias("links")))
    out = own.join(comps, "v", "left").select(F.col("v").alias(id_col), F.col("links").alias("n_links"), F.coalesce("component", "v").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
