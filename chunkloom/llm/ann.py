"""Approximate nearest neighbours with learned partitions.

On a bounded sample the exact neighbour graph is built and cut into balanced parts (nodes move to the part that holds
most of their neighbours, within a capacity); a small classifier learns each vector's distribution over the parts of its
neighbours. Every row is indexed under its most probable part; a query visits its most probable parts, as many as gave
the target recall on rows of the sample that the router wasn't fitted to, and is compared there with every row, in blocks,
in double precision. A query that finds fewer rows than it asks for visits all parts.

Fitted on at most SAMPLE rows, or PER_PART for each part if that is more: different ones, drawn by a hash of id and vector.
The number of parts grows with the root of the number of rows, from PARTS to MOST_PARTS. Every row is indexed and no part
has a cap.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; those whose
length isn't the sample's most frequent are compared with all of their own length; ties go to the smaller id; rows that repeat an id are all candidates of other
queries, and none of a query of that id; a query id that stands several times is one query, of its smallest vector (in
the order of arrays); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import cut, table, tidy
from chunkloom.llm.embed_dedup import clean

SAMPLE, PARTS, NEIGHBOURS, HIDDEN = 4096, 16, 20, 64
MOST_PARTS, PER_PART = 256, 64
TARGET = 0.97
ITEMS, QUERIES = 8192, 1024
#: One in so many rows of the sample is held out of the fit, to choose the number of parts visited.
HELD_OUT = 8


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 31, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each node: seeded by capacity-bound nearest centres, then nodes move to where most of their neighbours are."""
    rng = np.random.default_rng(seed)
    n, room = len(x), int(np.ceil(len(x) / parts * slack))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        s = x @ centres.T
        part, held = np.full(n, -1), np.zeros(parts, int)
        for i in np.argsort(-s.max(axis=1), kind="stable"):
            for p in np.argsort(-s[i], kind="stable"):
                if held[p] < room:
                    part[i], held[p] = p, held[p] + 1
                    break
        centres = np.stack([x[part == p].mean(axis=0) if held[p] else x[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near = [set(r) for r in graph.tolist()]
    for i, r in enumerate(graph.tolist()):
        for j in r:
            near[j].add(i)
    near = [np.fromiter(s, int) for s in near]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[i]], minlength=parts)
            votes[held >= room] = -1
            votes[part[i]] = max(votes[part[i]], np.count_nonzero(part[near[i]] == part[i]))
            p = int(votes.argmax())
            if p != part[i] and votes[p] > votes[part[i]]:
                held[part[i]] -= 1
                held[p] += 1
                part[i], moved = p, moved + 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer that gives a vector's distribution over parts, and the number of parts to visit."""

    def __init__(self, x: np.ndarray, parts: int = PARTS, target: float = TARGET, seed: int = 37):
        rng = np.random.default_rng(seed)
        self.dim, self.parts, self.probes = x.shape[1], 1, 1
        self.w = None
        if len(x) < 4 * parts:
            return
        self.parts = parts
        every, held = x, rng.permutation(len(x))[: len(x) // HELD_OUT]
        x = np.delete(every, held, axis=0)
        graph = neighbour_graph(x, NEIGHBOURS)
        part = balanced_parts(x, graph, parts)
        goal = np.stack([np.bincount(row, minlength=parts) for row in part[graph]]) + 4 * np.eye(parts)[part]
        goal = goal / goal.sum(axis=1, keepdims=True)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        m, s = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
        self.scale = 1 / max(1e-12, float(np.sqrt((x * x).sum(axis=1).mean() / x.shape[1])))
        z = x * self.scale
        for step in range(1, 801):
            i = rng.integers(0, len(z), 256)
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            d = (self._soft(h @ p[2] + p[3]) - goal[i]) / len(i)
            dh = d @ p[2].T * (h > 0)
            for k, g in enumerate((z[i].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= 0.01 * (1 - step / 801) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.w = p
        order = self.order(every)
        place = np.empty_like(order[held])
        np.put_along_axis(place, order[held], np.broadcast_to(np.arange(parts), place.shape), axis=1)
        needed = np.take_along_axis(place, order[:, 0][neighbour_graph(every, NEIGHBOURS)[held]], axis=1)  # at which visit each true neighbour is met
        self.recall = [(needed < k).mean() for k in range(1, parts + 1)]
        self.probes = next((k for k, r in enumerate(self.recall, 1) if r >= target), parts)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability."""
        if self.w is None:
            return np.zeros((len(x), 1), int)
        h = np.maximum(x * self.scale @ self.w[0] + self.w[1], 0)
        return np.argsort(-(h @ self.w[2] + self.w[3]), axis=1, kind="stable")


def parts_for(n: int) -> int:
    """The number of parts for n rows: a power of two near sqrt(n) / 16, between PARTS and MOST_PARTS."""
    return min(MOST_PARTS, max(PARTS, 1 << round(math.log2(max(1.0, math.sqrt(n) / 16)))))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int | None = None, target: float = TARGET) -> Router | None:
    good = vectors.select(F.col(id_col).alias("v"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.col("v").isNotNull() & clean(F.col("x")))
    n = good.count()
    parts = parts or parts_for(n)
    most = max(sample, PER_PART * parts)
    draw = F.pmod(F.xxhash64(F.lit(41), "v", "x"), F.lit(1 << 30))
    # equal rows are drawn together and count once; the limit is exact, whatever the rate lets through
    drawn = good.filter(draw < min(1.0, 1.1 * most / max(1, n)) * (1 << 30)).distinct().orderBy(draw, "v", "x").limit(most).collect()
    if not drawn:
        return None
    dims = pd.Series([len(r["x"]) for r in drawn])
    dim = int(dims.mode().iat[0])
    return Router(np.array([r["x"] for r in sorted(drawn) if len(r["x"]) == dim]), parts, target)


def routed(vectors: DataFrame, router: Router, k: int) -> DataFrame:
    """v, x, part: each row under its k most probable parts. Each other length than the router's is a part of its own."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                order = shared.value.order(np.stack(pdf["x"].to_numpy()))[:, :k]
                pdf = pdf.loc[pdf.index.repeat(order.shape[1])].assign(part=order.ravel())
            else:
                pdf = pdf.assign(part=0)
            yield pdf

    by_router = vectors.filter(F.size("x") == router.dim).select("v", "x").mapInPandas(tidy(run), f"v {vectors.schema['v'].dataType.simpleString()}, x array<double>, part long")
    return by_router.unionByName(vectors.filter(F.size("x") != router.dim).select("v", "x", (-F.size("x")).cast("long").alias("part")))


def _nearest(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        items, queries = pdf[~asks], pdf[asks]
        if not len(items) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = np.stack(items["x"].to_numpy()), np.stack(queries["x"].to_numpy())
        ids, names, out = items["v"].to_numpy(), queries["v"].to_numpy(), []
        for at in range(0, len(y), 128):
            s = y[at : at + 128] @ x.T
            s[names[at : at + 128, None] == ids[None, :]] = -np.inf
            few = min(k, len(ids))
            edge = np.partition(s, len(ids) - few, axis=1)[:, len(ids) - few]
            for r in range(len(s)):
                near = np.flatnonzero((s[r] >= edge[r] - 1e-9 * (1 + abs(edge[r]))) & (s[r] > -np.inf))
                exact = (x[near] * y[at + r]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                best = np.lexsort((ids[near], -exact))[:few]
                out.append(pd.DataFrame({"query_id": names[at + r], "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def _found(items: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest of the rows in the parts that it is routed to."""
    # a row per part (at most PARTS, and one for each other length): sizes in blocks
    sizes = F.broadcast(items.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ITEMS).alias("vbs")).join(asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("qbs")), "part"))
    a = items.join(sizes, "part").withColumn("vb", F.pmod(F.xxhash64("v", "x"), "vbs")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)))
    b = asked.join(sizes, "part").withColumn("qb", F.pmod(F.xxhash64("v"), "qbs")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vbs") - 1)))
    dealt = a.select("part", "vb", "qb", "v", "x", F.lit(False).alias("asks")).unionByName(b.select("part", "vb", "qb", "v", "x", F.lit(True).alias("asks")))
    kind = items.schema["v"].dataType.simpleString()
    found = dealt.groupBy("part", "vb", "qb").applyInPandas(_nearest(k), f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, router: Router, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest of the rows in the parts that it visits; of all rows of
    its length where those parts hold fewer than k others."""
    usable = lambda df: df.select(F.col(id_col).alias("v"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.col("v").isNotNull() & clean(F.col("x")))
    wanted = usable(queries).groupBy("v").agg(F.min("x").alias("x"))
    items, asked = cut(routed(usable(vectors), router, 1)), cut(routed(wanted, router, router.probes))
    found = _found(items, asked, k)
    if router.probes >= router.parts:
        return found
    found = cut(found)
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("v"))
    few = cut(asked.select("v").distinct().join(full, "v", "left_anti"))
    if few.isEmpty():
        return found
    again = routed(wanted.join(few, "v", "left_semi"), router, router.parts)
    return found.join(few, F.col("query_id") == F.col("v"), "left_anti").unionByName(_found(items, cut(again), k))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    router = train(vectors) or Router(np.zeros((0, 1)))
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), router)
