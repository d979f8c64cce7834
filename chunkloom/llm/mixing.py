"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, target / source size. Its whole part is
taken; the fractional parts meet in pairs, and each meeting moves mass (words, so that copies x size is conserved) at
random from one to the other until one of them is integral. Meetings change neither the expected copies of a document nor
the words of a source. They run in chunks of a source and then over the chunks' residuals, in a tree whose nodes hold at
most FAN_IN residuals, so no task sees a whole source. One fraction of a source is left at the root, which is rounded at
random; documents of that node are then turned over, always the one that makes up for it best, until none does, so for
these few documents the expected copies hold only nearly.

Defined results: null text and empty text have size 0 and are taken 0 words; a null source is a source of its own (last
in order); rows that repeat an id, source, size and text hash are one unit with that many rows, and each row gets the same copies;
an empty table gives an empty result; an all-empty corpus has targets 0; very long texts are counted whole; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import cut, free_names, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents in a chunk (a leaf of the tree), and residuals in a node above.
CHUNK = 4096
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n, source_size -> also target and rate. One row per source; the windows are over sources, not documents.

    Resharing the excess until none is above is a water level: target = least(most x size, level x weight). With sources
    in the order of most x size / weight, the level is that of the first source that it doesn't fill.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    x = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    target = F.when(full, F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") == 0, 0.0).when(full, F.lit(float(most))).otherwise(target / F.col("source_size"))
    return x.select("source", "n", "source_size", target.alias("target"), rate.alias("rate"))


def _fold(mass: np.ndarray, room: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of masses 0 <= mass <= room, in order; at most one entry stays strictly between."""
    mass, room = mass.tolist(), room.tolist()
    carry = -1
    for i, u in enumerate(draws.tolist()):
        if not 0.0 < mass[i] < room[i]:
            continue
        if carry < 0:
            carry = i
            continue
        a, b = mass[carry], mass[i]
        up, down = min(room[carry] - a, b), min(a, room[i] - b)  # what may move to the carried one, and from it
        if u * (up + down) < down:
            a, b = (room[carry] if up == room[carry] - a else a + up), (0.0 if up == b else b - up)
        else:
            a, b = (0.0 if down == a else a - down), (room[i] if down == room[i] - b else b + down)
        mass[carry], mass[i] = a, b
        inside_a, inside_b = 0.0 < a < room[carry], 0.0 < b < room[i]
        carry = carry if inside_a else i if inside_b else -1
    return np.array(mass)


def _settle(mass: np.ndarray, room: np.ndarray, draw: float) -> np.ndarray:
    """Rounds the last fraction at random, and turns documents over, always the one that makes up best for what this added
    or took, until none brings the sum nearer."""
    inside = np.flatnonzero((mass > 0) & (mass < room))
    if not len(inside):
        return mass
    (i,) = inside
    up = draw * room[i] < mass[i]
    off = room[i] - mass[i] if up else -mass[i]
    mass[i] = room[i] if up else 0.0
    turned = np.where(mass > 0, -room, room)
    while len(turned):
        j = int(np.argmin(np.abs(off + turned)))
        if abs(off + turned[j]) >= abs(off):
            break
        off += turned[j]
        mass[j], turned[j] = room[j] - mass[j], -turned[j]
    return mass


def _round_node(pdf: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    # large documents meet first, so that what stays fractional is small
    pdf = pdf.sort_values(["_m_room", "_m_id", "_m_hash"], kind="stable", na_position="last", ignore_index=True, ascending=[False, True, True])
    name = f"{seed}|{level}|{pdf['_m_source'].iat[0]}|{pdf['_m_node'].iat[0]}"
    draws = np.random.default_rng(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")).random(len(pdf) + 1)
    room = pdf["_m_room"].to_numpy(float)
    mass = _fold(pdf["_m_mass"].to_numpy(float), room, draws[:-1])
    return pdf.assign(_m_mass=_settle(mass, room, draws[-1]) if last else mass)


def _node_rounder(seed: int, level: int, last: bool):
    return lambda pdf: _round_node(pdf, seed, level, last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per unit: _m_id, _m_source, _m_hash (of the text), _m_rows, size, source_size, target, copies."""
    narrow = docs.select(F.col(id_col).cast("string").alias("_m_id"), F.col(source_col).alias("_m_source"), F.xxhash64(text_col).alias("_m_hash"), n_words(F.col(text_col)).alias("_m_size"))
    units = cut(narrow.groupBy("_m_id", "_m_source", "_m_hash", "_m_size").agg(F.count(F.lit(1)).alias("_m_rows")))
    sizes = units.groupBy(F.col("_m_source").alias("source")).agg(F.sum("_m_rows").alias("n"), F.sum(F.col("_m_size") * F.col("_m_rows")).alias("source_size"))
    plan = cut(targets(sizes, weights, share, most))
    most_n = plan.agg(F.max("n")).head()[0] or 0
    # the plan has a row per source; the join's large side is split where a source is hot
    x = units.join(plan, units["_m_source"].eqNullSafe(plan["source"]), "left").withColumn("_m_whole", F.floor("rate"))
    x = x.withColumn("_m_room", (F.col("_m_size") * F.col("_m_rows")).cast("double")).withColumn("_m_mass", F.col("_m_room") * (F.col("rate") - F.col("_m_whole")))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1))
    x = x.withColumn("_m_node", F.pmod(F.xxhash64(F.lit(seed), "_m_id", "_m_hash"), chunks)).drop("source", "n", "rate")
    levels = 1 + math.ceil(math.log(max(1, math.ceil(most_n / CHUNK)), FAN_IN) - 1e-9)
    undecided, done = x, []
    for level in range(levels):
        out = cut(undecided.groupBy("_m_source", "_m_node").applyInPandas(_node_rounder(seed, level, level == levels - 1), undecided.schema))
        inside = (F.col("_m_mass") > 0) & (F.col("_m_mass") < F.col("_m_room"))
        done.append(out.filter(~inside))
        undecided = out.filter(inside).withColumn("_m_node", F.floor(F.col("_m_node") / FAN_IN))
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    copies = F.col("_m_whole") + F.when((F.col("_m_mass") >= F.col("_m_room")) & (F.col("_m_room") > 0), 1).otherwise(0)
    return rounded.select(F.col("_m_id").cast(docs.schema[id_col].dataType).alias("_m_id"), "_m_source", "_m_hash", "_m_rows", F.col("_m_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """docs, each row as often as the mix takes it (dropped where that is never); rows without words are kept once."""
    own_id, source, hashed, key, copies, copy = free_names(docs.columns, "m_id", "m_source", "m_hash", "m_key", "m_copies", "m_copy")
    taken = mix(docs, id_col, text_col, source_col, seed).select("_m_id", "_m_source", "_m_hash", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")).toDF(own_id, source, hashed, copies)
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    on = keyed[id_col].eqNullSafe(F.col(own_id)) & keyed[source_col].eqNullSafe(F.col(source)) & (F.col(key) == F.col(hashed))
    return keyed.join(taken.filter(F.col(copies) > 0), on).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents."""
    units = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = units.withColumn("_m_row", F.explode(F.sequence(F.lit(1), F.col("_m_rows").cast("int"))))
    return rows.select(F.col("_m_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
