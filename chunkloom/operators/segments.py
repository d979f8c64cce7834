"""Segments: runs of consecutive chunks that end where sizes or content say so, and indexes over them."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.digests import byte_sum, is_hook, list_digest
from chunkloom.operators.ordered import numbered_keys
from chunkloom.sources.store import materialise


@dataclass(frozen=True)
class SegmentRule:
    """A segment ends before the chunk that would make it too long (chunks or bytes), or that comes when it has the least
    size and the chunk's digest value has the pattern; that chunk begins the next segment."""

    least: int = 5 << 20
    most: int = 20 << 20
    chunks: int = 5120
    divisor: int = 640
    pattern: int = 1


def _digest_values(fps: pa.Array) -> np.ndarray:
    """Sums of the digests' bytes (as functions.digests.byte_sum), for a batch at a time."""
    every = fps.to_pylist()
    if len({len(f) for f in every}) == 1:
        return np.frombuffer(bytes.fromhex("".join(every)), np.uint8).reshape(len(every), -1).sum(axis=1, dtype=np.int32)
    return np.array([sum(bytes.fromhex(f)) for f in every], np.int32)


def content_segments(chunks: DataFrame, rule: SegmentRule = SegmentRule()) -> DataFrame:
    """chunks (file_id, seq, fp, size) with value and segment, numbered from 0 in each file. Many small files cost no more
    than a large one: a batch is walked as it comes, and its columns are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, segment, count, total, begun = None, 0, 0, 0, False
        for batch in batches:
            values, out = _digest_values(batch.column("fp")), []
            fits = (values % rule.divisor == rule.pattern).tolist()
            for f, size, fit in zip(batch.column("file_id").to_pylist(), batch.column("size").to_pylist(), fits, strict=True):
                if f != file or not begun:
                    file, segment, count, total, begun = f, 0, 0, 0, True
                elif count + 1 > rule.chunks or total + size > rule.most or total + size >= rule.least and fit:
                    segment, count, total = segment + 1, 0, 0
                count, total = count + 1, total + size
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int32()), pa.array(out, pa.int64())], names=[*batch.schema.names, "value", "segment"])

    kind = chunks.schema["file_id"].dataType.simpleString()
    x = chunks.select("file_id", F.col("seq").cast("long").alias("seq"), "fp", F.col("size").cast("int").alias("size"))
    ordered = x.repartition("file_id").sortWithinPartitions("file_id", "seq")
    return ordered.mapInArrow(run, f"file_id {kind}, seq long, fp string, size int, value int, segment long")


def fixed_segments(chunks: DataFrame, n: int) -> DataFrame:
    """chunks with value and segment, n chunks each, by the dense number `seq` (from 1) in the file."""
    return chunks.withColumn("value", byte_sum(F.col("fp"))).withColumn("segment", F.floor((F.col("seq") - 1) / n).cast("long"))


def summaries(segmented: DataFrame) -> DataFrame:
    """A row per segment: chunk_num, seg_size, min_fp (of the least digest value, the first of equals) and seg_hash (of its
    ordered sizes and fingerprints). A segment's chunks are bounded by its rule."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "size", "fp")))
    return segmented.groupBy("file_id", "segment").agg(
        F.count(F.lit(1)).alias("chunk_num"), F.sum("size").alias("seg_size"), F.min("seq").alias("first_seq"), F.min_by("fp", F.struct("value", "seq")).alias("min_fp"), list_digest(listed).alias("seg_hash")
    )


def similarity_index(segmented: DataFrame, order: tuple[str, ...] = ("file_id", "segment")) -> tuple[DataFrame, DataFrame]:
    """Similarity-based deduplication (a bin for each least fingerprint): (segments with kind and bin; chunks kept).

    Within a bin every lookup and insert touches that bin only, so a chunk is unique if it is the first of (bin, fp), and a
    segment is `unique` if it is its bin's first, `duplicate` if its hash is the first one's, else `different`. Aggregations
    on (bin) and (bin, fp) say so, with no replay. The segments, which both read, are written once.
    """
    segmented = materialise(segmented)
    s = summaries(segmented)
    at = F.struct(*order)
    firsts = s.groupBy("min_fp").agg(F.min(at).alias("first"), F.min_by("seg_hash", at).alias("first_hash"))
    kind = F.when(F.struct(*order) == F.col("first"), "unique").when(F.col("seg_hash") == F.col("first_hash"), "duplicate").otherwise("different")
    segments = s.join(firsts, "min_fp").withColumn("kind", kind).drop("first", "first_hash")
    binned = segmented.join(s.select("file_id", "segment", "min_fp"), ["file_id", "segment"])
    kept = binned.groupBy("min_fp", "fp").agg(F.min_by("size", F.struct(*order, "seq")).alias("size"), F.min(F.struct(*order, "seq")).alias("first"))
    return segments, kept


def hooks(segmented: DataFrame, bits: int = 6) -> DataFrame:
    """Distinct (file_id, segment, hook): the sampled fingerprints of each segment."""
    return segmented.filter(is_hook(F.col("fp"), bits)).select("file_id", "segment", F.col("fp").alias("hook")).distinct()


def hook_index(manifest_hooks: DataFrame, keep: int = 10) -> DataFrame:
    """hook, manifest: for each hook its `keep` newest manifests (greatest numbers)."""
    rank = F.row_number().over(Window.partitionBy("hook").orderBy(F.desc("manifest")))
    return manifest_hooks.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("rank")


def manifest_candidates(segment_hooks: DataFrame, index: DataFrame) -> DataFrame:
    """file_id, segment, manifest, hits: how many of a segment's hooks each manifest has."""
    return segment_hooks.join(index, "hook").groupBy("file_id", "segment", "manifest").agg(F.count(F.lit(1)).alias("hits"))


def champions(candidates: DataFrame, n: int = 10) -> DataFrame:
    """Each segment's n manifests with the most hits; ties go to the older manifest."""
    rank = F.row_number().over(Window.partitionBy("file_id", "segment").orderBy(F.desc("hits"), "manifest"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= n)


def locality_decisions(segmented: DataFrame, n_champions: int = 10, per_hook: int = 10, bits: int = 6) -> DataFrame:
    """Locality-based deduplication, a row for each segment: file_id, segment, is_unique (an array, in the order of its chunks)
    and manifest (the number of the one it made, or -1).

    Segments come in the order of file_id and segment. A segment's hooks name candidate manifests, its best ones are the
    champions, and its chunks are looked up in these only; a segment with a unique chunk makes a new manifest. What a
    segment finds depends on all before it, so this is one sequential task by definition. It gets a row for each segment,
    with numbers in place of fingerprints, and holds only manifests that a hook still names (8 bytes a fingerprint).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        manifests: dict[int, array] = {}
        named: dict[int, int] = {}  # by how many hooks
        index: dict[int, list[int]] = {}
        made = 0
        for batch in batches:
            numbers, flags = [], []
            lists = {c: (batch.column(c).values.to_pylist(), batch.column(c).offsets.to_pylist()) for c in ("ids", "hooks")}
            (ids, at), (hook_ids, hook_at) = lists["ids"], lists["hooks"]
            for i in range(batch.num_rows):
                fps, sampled = ids[at[i] : at[i + 1]], hook_ids[hook_at[i] : hook_at[i + 1]]
                hits: dict[int, int] = {}
                for h in sampled:
                    for m in index.get(h, ()):
                        hits[m] = hits.get(m, 0) + 1
                seen = set(fps)
                fresh = seen.difference(*(manifests[m] for m in sorted(hits, key=lambda m: (-hits[m], m))[:n_champions]))
                number = -1
                if fresh:
                    number, made = made, made + 1
                    if sampled:
                        manifests[number], named[number] = array("q", seen), len(sampled)
                    for h in sampled:
                        newest = index.setdefault(h, [])
                        newest.append(number)
                        if len(newest) > per_hook:
                            old = newest.pop(0)
                            named[old] -= 1
                            if not named[old]:
                                del named[old], manifests[old]
                numbers.append(number)
                for f in fps:
                    flags.append(f in fresh)
                    fresh.discard(f)
            unique = pa.ListArray.from_arrays(pa.array([o - at[0] for o in at], pa.int32()), pa.array(flags, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("segment"), unique, pa.array(numbers, pa.int64())], names=["file_id", "segment", "is_unique", "manifest"])

    kind = segmented.schema["file_id"].dataType.simpleString()
    x = numbered_keys(segmented.select("file_id", "segment", "seq", "fp", is_hook(F.col("fp"), bits).alias("hook")), "fp", "id")
    listed = x.groupBy("file_id", "segment").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "hook"))).alias("c"))
    rows = listed.select(F.lit(0).alias("all"), "file_id", "segment", F.col("c.id").alias("ids"), F.array_distinct(F.filter("c", lambda c: c["hook"])["id"]).alias("hooks"))
    ordered = rows.repartition("all").sortWithinPartitions("file_id", "segment")
    return ordered.mapInArrow(run, f"file_id {kind}, segment long, is_unique array<boolean>, manifest long")


def locality_index(segmented: DataFrame, n_champions: int = 10, per_hook: int = 10, bits: int = 6) -> DataFrame:
    """What locality_decisions decides, for each chunk: chunks with is_unique, is_new_manifest and manifest."""
    segmented = materialise(segmented.select("file_id", "segment", F.col("seq").cast("long").alias("seq"), "fp", F.col("size").cast("int").alias("size")))
    decided = locality_decisions(segmented, n_champions, per_hook, bits)
    listed = segmented.groupBy("file_id", "segment").agg(F.array_sort(F.collect_list(F.struct("seq", "fp", "size"))).alias("c"))
    each = listed.join(decided, ["file_id", "segment"]).select("file_id", "segment", "manifest", F.explode(F.arrays_zip("c", "is_unique")).alias("x"))
    return each.select("file_id", "segment", "x.c.seq", "x.c.fp", "x.c.size", "x.is_unique", (F.col("manifest") >= 0).alias("is_new_manifest"), "manifest")
