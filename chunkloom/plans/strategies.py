"""Index strategies by name: each takes chunks (file_id, seq, fp, size) and decides which of them are stored."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.digests import SKETCH_WIDTH
from chunkloom.operators import dedup, frequency, segments
from chunkloom.operators.ordered import dense_sequence
from chunkloom.sources.store import Config


class IndexStrategy(Protocol):
    """apply gives the chunks to store: fp, size, seq and owner (file_id) of each stored copy."""

    def apply(self, chunks: DataFrame) -> DataFrame: ...


REGISTRY: dict[str, Callable[..., IndexStrategy]] = {}


def register(name: str):
    def add(cls):
        REGISTRY[name] = cls
        return cls

    return add


@register("exact")
class Exact:
    """One copy of each fingerprint: also what the outer index behind a frequency set keeps."""

    def __init__(self, index: DataFrame | None = None):
        self.index = index

    def apply(self, chunks: DataFrame) -> DataFrame:
        at = chunks.withColumn("at", F.struct("file_id", "seq"))
        kept = dedup.first_seen(at, "fp", "at", "size")
        if self.index is not None:
            kept = kept.join(self.index.select("fp"), "fp", "left_anti")
        return kept.select("fp", "size", "at.file_id", "at.seq")


@register("frequency")
class Frequency:
    """One copy of each fingerprint, decided by a bounded set of the most frequent ones and by the exact index behind it: a
    chunk is stored where the outer index is asked for its fingerprint for the first time and doesn't know it."""

    def __init__(self, k: int = 512 * 1024, batch: int = 128, width: int = SKETCH_WIDTH, gate: str = "full", index: DataFrame | None = None):
        self.k, self.batch, self.width, self.gate, self.index = k, batch, width, gate, index

    def replayed(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks numbered in the order of files and positions, the replay of their batches)"""
        numbered = dense_sequence(chunks.select("file_id", F.col("seq").alias("position"), "fp", "size"), ["file_id", "position"], "seq")
        return numbered, frequency.replay(numbered, self.k, self.batch, self.width, self.gate)

    def apply(self, chunks: DataFrame) -> DataFrame:
        numbered, replayed = self.replayed(chunks)
        asked = replayed.filter("served = 'outer'").groupBy("fp").agg(F.min("batch").alias("batch"))
        if self.index is not None:
            asked = asked.join(self.index.select("fp"), "fp", "left_anti")
        at = numbered.withColumn("batch", F.floor((F.col("seq") - 1) / self.batch).cast("long")).join(asked, ["fp", "batch"])
        first = at.groupBy("fp").agg(F.min_by(F.struct("size", "file_id", "position"), "seq").alias("c"))
        return first.select("fp", "c.size", "c.file_id", F.col("c.position").alias("seq"))


@register("similarity")
class Similarity:
    """One copy for each bin."""

    def __init__(self, rule: segments.SegmentRule = segments.SegmentRule()):
        self.rule = rule

    def apply(self, chunks: DataFrame) -> DataFrame:
        _, kept = segments.similarity_index(segments.content_segments(chunks, self.rule))
        return kept.select("fp", "size", "first.file_id", "first.seq")


@register("locality")
class Locality:
    """One copy for each set of champions that hasn't it."""

    def __init__(self, rule: segments.SegmentRule = segments.SegmentRule(), champions: int = 10, per_hook: int = 10, bits: int = 6):
        self.rule, self.champions, self.per_hook, self.bits = rule, champions, per_hook, bits

    def apply(self, chunks: DataFrame) -> DataFrame:
        found = segments.locality_index(segments.content_segments(chunks, self.rule), self.champions, self.per_hook, bits=self.bits)
        return found.filter("is_unique").select("fp", "size", "file_id", "seq")


def strategy(name: str, **options) -> IndexStrategy:
    return REGISTRY[name](**options)


def configured(name: str, config: Config, index: DataFrame | None = None) -> IndexStrategy:
    """The strategy with the sizes of a configuration. index: what is stored already, which exact indexes ask."""
    rule = segments.SegmentRule(config.segment_min, config.segment_max, config.segment_chunks, config.segment_divisor, config.segment_pattern)
    options = {
        "exact": {"index": index},
        "frequency": {"k": config.top_k, "batch": config.batch, "width": config.sketch_width, "index": index},
        "similarity": {"rule": rule},
        "locality": {"rule": rule, "champions": config.champions, "per_hook": config.manifests_per_hook, "bits": config.hook_bits},
    }[name]
    return strategy(name, **options)
