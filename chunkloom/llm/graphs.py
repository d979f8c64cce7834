"""Connected components over an edge table, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) for every end of edges (a, b); component is the smallest vertex reachable.

    In each round every vertex is named after the one with the smallest hash among itself and its neighbours, and the edges
    are renamed: those between equal names go, equal ones become one, and an edge joins each name with that name's own new
    name. The first two rounds go by the vertices themselves, which settles stars around a smallest vertex; then the hashes
    are others in each round, so the order of names along a path doesn't matter and about half of the vertices go (a chain
    of n takes some log2 n rounds). A round works on the few edges that the last one left, until none is
    left; then each component takes its smallest vertex. Names and edges are tables in the shared folder; a lost executor
    costs a read. Null ends are ignored; an empty edge table gives an empty result.
    """
    left = cut(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, turn = None, 0
    while labels is None or not left.isEmpty():
        turn += 1
        drawn = lambda c: F.struct((F.lit(0).cast("long") if turn <= 2 else F.xxhash64(F.lit(turn), c)).alias("h"), F.col(c).alias("w"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("v"), drawn("b").alias("n")).unionByName(left.select(F.col("b").alias("v"), drawn("a").alias("n")))
        names = cut(ends.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("n", drawn("v"))["w"].alias("name")))
        if labels is None:
            labels = names.select("v", F.col("name").alias("component"))
        else:
            new = names.select(F.col("v").alias("component"), "name")
            labels = cut(labels.join(new, "component", "left").select("v", F.coalesce("name", "component").alias("component")))
        of_a, of_b = names.toDF("a", "x"), names.toDF("b", "y")
        renamed = left.join(of_a, "a").join(of_b, "b").select("x", "y")
        up = names.filter("v <> name").select(F.col("name").alias("v")).distinct().join(names, "v").select(F.col("v").alias("x"), F.col("name").alias("y"))
        left = cut(renamed.unionByName(up).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    smallest = labels.groupBy("component").agg(F.min("v").alias("least"))
    return cut(labels.join(smallest, "component").select("v", F.col("least").alias("component")))
