"""Registered queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import ciphers, digests
from chunkloom.functions.codec import compress, decompress
from chunkloom.functions.murmur import murmur32, murmur128
from chunkloom.operators import chunking, dedup, frequency, generate, leakage, ordered, schemes, segments, sketches, statistics, storage
from chunkloom.plans import lifecycle
from chunkloom.plans.strategies import strategy
from chunkloom.sources import traces
from chunkloom.sources.store import Config, Store, carry_over, discard, lookup, materialise, shared_dir, upsert
from chunkloom.streaming.incremental import dedup_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WIDTH = 4096
CONFIG = Config(top_k=256, sketch_width=4096, segment_min=20_000, segment_max=80_000, segment_chunks=40, segment_divisor=8, hook_bits=4)
RULE = segments.SegmentRule(least=20_000, most=80_000, chunks=40, divisor=8, pattern=1)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return traces.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("data"), "source", "lang")


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = traces.table(spark, d, "documents").filter("text is not null")
    return x.select("doc_id", "source", "lang", F.sha2("text", 256).alias("fp"), F.octet_length("text").cast("long").alias("size"))


def doc_trace(spark: SparkSession, d: str) -> DataFrame:
    return doc_chunks(spark, d).select(F.col("doc_id").alias("seq"), "fp", F.col("size").cast("int").alias("size"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """An index of the documents that have a label."""
    named = traces.table(spark, d, "labels").select(F.col("doc_id").alias("seq")).distinct()
    return dedup.first_seen(doc_trace(spark, d).join(named, "seq", "left_semi"), "fp", "seq", "size")


# scans and sinks


@query
def file_scan(spark, d):
    """The files of several tables of a folder as binary rows."""
    f = traces.read_files(spark, f"{d}/{{region,nation,supplier,customer,part}}.parquet")
    return f.agg(F.count(F.lit(1)).alias("n_files"), F.min(F.expr("size = length(data)")).alias("whole"))


@query
def trace_parse(spark, d):
    t = traces.event_trace(spark, d)
    lines = t.select("seq", traces.format_trace(F.col("fp"), F.col("size") * 3).alias("line"))
    return lines.select("seq", traces.parse_trace(F.col("line")).alias("t")).select("seq", "t.fp", "t.size")


@query
def trace_parse_short(spark, d):
    t = traces.event_trace(spark, d)
    lines = t.select("seq", traces.format_trace(F.col("fp"), F.col("size"), 5).alias("line"))
    return lines.select("seq", traces.parse_trace(F.col("line"), 5).alias("t")).select("seq", "t.fp", "t.size")


@query
def trace_concat(spark, d):
    return traces.concatenate([traces.event_trace(spark, d), doc_trace(spark, d)]).select("seq", "fp", "size")


@query
def dense_numbers(spark, d):
    x = traces.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return ordered.dense_sequence(x, ["l_orderkey", "l_linenumber"])


@query
def recipe_heads(spark, d):
    return storage.recipe_heads(traces.file_trace(spark, d))


@query
def store_round_trip(spark, d):
    """Ingest of all documents, then of all benchmark texts, and the restored files' digests."""
    store = _filled(spark, d)
    return lifecycle.restore(store).select("file_id", F.sha2("data", 256).alias("digest"), F.length("data").cast("long").alias("size"))


@query
def ingest_statistics(spark, d):
    """Cumulative statistics after two runs."""
    return _filled(spark, d).read("statistics").select("logical_chunks", "logical_size", "unique_chunks", "unique_size")


@query
def ingest_by_strategy(spark, d):
    """Each strategy ingests the same files: chunks, what is stored of them, and whether the files come back."""
    files, out = docs(spark, d).select("file_id", "data").filter("data <> ''"), None
    for name in ("exact", "frequency", "similarity", "locality"):
        store = _store(spark)
        lifecycle.ingest(store, files, chunk_size=512, capacity=1 << 16, index=name, config=CONFIG)
        back = lifecycle.restore(store).join(files.withColumnRenamed("data", "was"), "file_id")
        same = back.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("data") == F.col("was").cast("binary")).alias("equal_files"))
        counts = store.read("statistics").select("logical_chunks", F.when(F.lit(name in ("exact", "frequency")), F.col("unique_chunks")).alias("stored_chunks"))
        one = materialise(store.read("index").agg(F.lit(name).alias("strategy"), F.countDistinct("fp").alias("different_chunks")).crossJoin(counts).crossJoin(same))
        store.drop()
        out = one if out is None else out.unionByName(one)
    return out


@query
def scheme_round_trip(spark, d):
    """Under each scheme the files are encrypted, deduplicated, and put together again by their key recipes: one scheme after
    the other, so that what one moves is gone before the next."""
    chunks = chunking.fixed_chunks(docs(spark, d).select("file_id", F.col("data").cast("binary").alias("data")).filter("length(data) > 0"), 512)
    chunks = chunks.select("file_id", "seq", "data", F.sha2("data", 256).alias("fp"), (F.col("file_id") % 2).alias("state"))
    out = None
    for s in ("plain", "convergent", "server_aided", "tunable"):
        stored, recipe = lifecycle.upload(chunks, s)
        counted = recipe.agg(F.lit(s).alias("scheme"), F.countDistinct("cipher_fp").alias("stored"))  # of `stored`, without encrypting again
        one = materialise(lifecycle.download(stored, recipe, s).select("file_id", F.sha2("data", 256).alias("digest")).crossJoin(counted))
        discard(recipe)
        out = one if out is None else out.unionByName(one)
    return out


def _store(spark: SparkSession) -> Store:
    import uuid

    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _filled(spark: SparkSession, d: str) -> Store:
    store = _store(spark)
    first = docs(spark, d).select(F.concat(F.lit("d"), F.col("file_id").cast("string")).alias("file_id"), "data")
    second = traces.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("file_id"), F.coalesce("text", F.lit("")).alias("data"))
    for files in (first, second):
        lifecycle.ingest(store, files.filter("data <> ''"), chunk_size=1024, capacity=1 << 16)
    return store


@query
def statistics_carry_over(spark, d):
    pages = traces.table(spark, d, "pages").filter("html is not null").select(F.sha2("html", 256).alias("fp"), F.octet_length("html").cast("long").alias("size"))
    return carry_over(statistics.totals(doc_chunks(spark, d)).drop("dedup_ratio"), statistics.totals(pages).drop("dedup_ratio"))


@query
def kv_latest(spark, d):
    old = traces.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(-1).cast("long").alias("at"))
    new = traces.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))
    return upsert(old, new, "key", "value", "at").select("key", "value")


@query
def kv_lookup(spark, d):
    e = traces.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))
    index = upsert(None, e, "key", "value", "at")
    return lookup(index.select("key", "value"), traces.table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "key")


# chunking and fingerprints


@query
def fixed_size_chunks(spark, d):
    return chunking.fixed_chunks(docs(spark, d), 512).select("file_id", "seq", "offset", "size", F.sha2("data", 256).alias("fp"))


@query
def fixed_size_chunks_blocks(spark, d):
    return chunking.fixed_chunks(docs(spark, d), 300, block=1000).select("file_id", "seq", "offset", "size", F.md5("data").alias("fp"))


@query
def content_chunk_totals(spark, d):
    """Content-defined chunks: they add up to their file, and all but the last keep the least and greatest sizes."""
    c = chunking.content_chunks(docs(spark, d), chunking.ContentCutter(256, 512, 1024))
    last = c.groupBy("file_id").agg(F.max("seq").alias("last"))
    x = c.join(last, "file_id")
    return x.groupBy("file_id").agg(F.sum("size").cast("long").alias("total"), F.min((F.col("size") <= 1024) & ((F.col("seq") == F.col("last")) | (F.col("size") >= 256))).alias("in_bounds"))


@query
def content_chunk_restore(spark, d):
    c = chunking.content_chunks(docs(spark, d), chunking.ContentCutter(256, 512, 1024))
    return storage.restore(c.select("file_id", "seq", "data")).select("file_id", F.sha2("data", 256).alias("digest"))


@query
def content_chunks_all(spark, d):
    c = chunking.content_chunks(traces.table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("data")))
    return c.select("file_id", "seq", "offset", "size", F.sha2("data", 256).alias("fp"))


@query
def fingerprints(spark, d):
    t = F.col("data")
    return docs(spark, d).select("file_id", *(digests.fingerprint(t, a).alias(a) for a in ("sha256", "sha1", "md5")))


@query
def hash_value_sum(spark, d):
    return doc_chunks(spark, d).select("doc_id", digests.byte_sum(F.col("fp")).alias("value"))


@query
def hook_sample(spark, d):
    return traces.event_trace(spark, d).filter(digests.is_hook(F.col("fp"))).select("seq", "fp")


@query
def size_clamp(spark, d):
    return doc_chunks(spark, d).select("doc_id", digests.clamp_size(F.col("size"), 1000).alias("size"))


@query
def file_ids(spark, d):
    return docs(spark, d).select("file_id", digests.file_id(F.col("file_id").cast("string"), F.col("lang")).alias("name_id"))


@query
def murmur_hashes(spark, d):
    x = traces.event_trace(spark, d).select("fp").distinct()
    return x.select("fp", murmur32(F.unhex("fp"), 1).alias("h32"), murmur128(F.unhex("fp"), 1).alias("h128"), murmur128(F.unhex("fp"), 1, x86=True).alias("h128_x86"))


@query
def compression_round_trip(spark, d):
    x = docs(spark, d).select("file_id", F.col("data").cast("binary").alias("raw")).withColumn("c", compress(F.col("raw")))
    back = decompress(F.col("c.stored"), F.col("c.is_compressed"))
    return x.select("file_id", (F.length("c.stored") <= F.length("raw")).alias("no_larger"), F.sha2(back, 256).alias("digest"))


@query
def encryption_round_trip(spark, d):
    x = docs(spark, d).select("file_id", F.col("data").cast("binary").alias("raw")).withColumn("key", ciphers.convergent_key(F.col("raw")))
    x = x.withColumn("fresh", ciphers.encrypt(F.col("raw"), F.col("key"))).withColumn("fixed", ciphers.deterministic_encrypt(F.col("raw"), F.col("key")))
    return x.select("file_id", F.length("fresh").cast("long").alias("size"), F.sha2(ciphers.decrypt(F.col("fresh"), F.col("key")), 256).alias("a"), F.sha2(ciphers.decrypt(F.col("fixed"), F.col("key")), 256).alias("b"))


# exact deduplication


@query
def first_seen_chunks(spark, d):
    return dedup.first_seen(traces.event_trace(spark, d), "fp", "seq", "size")


@query
def first_flags(spark, d):
    return dedup.mark_first(traces.event_trace(spark, d)).select("seq", "is_first")


@query
def anti_join_new_chunks(spark, d):
    return dedup.new_chunks(doc_trace(spark, d), _labelled(spark, d), "fp", "seq", "size")


@query
def semi_join_known_chunks(spark, d):
    return dedup.known_chunks(doc_trace(spark, d), _labelled(spark, d)).select("seq", "fp")


@query
def outer_index_probe(spark, d):
    """The index is outside the trusted side, and sees keyed images of fingerprints only."""
    hidden = lambda df: df.withColumn("fp", ciphers.index_key(F.col("fp"), "s"))
    return dedup.probe(hidden(doc_trace(spark, d)), hidden(_labelled(spark, d))).select("seq", "fp", "is_known")


@query
def index_union(spark, d):
    index = _labelled(spark, d)
    return dedup.grow_index(index, dedup.new_chunks(doc_trace(spark, d), index, "fp", "seq", "size"))


@query
def batch_dup_flags(spark, d):
    return dedup.batch_flags(traces.event_trace(spark, d), 128).select("seq", "batch", "flag")


@query
def batch_key_sets(spark, d):
    return dedup.batch_sets(traces.event_trace(spark, d), 128)


@query
def streaming_exact_dedup(spark, d):
    """Exact deduplication of a stream of Parquet files against a growing snapshot."""
    import uuid

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    traces.event_trace(spark, d).repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("seq long, fp string, size int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    store = Store(spark, f"{root}/store")
    dedup_stream(stream, store, f"{root}/checkpoint").awaitTermination()
    return store.read("index").select("fp", "size")


# frequencies, sketches, leakage


@query
def chunk_frequency(spark, d):
    return leakage.frequencies(traces.event_trace(spark, d))


@query
def frequencies_ascending(spark, d):
    return leakage.frequencies(traces.event_trace(spark, d)).select("freq").orderBy("freq")


@query
def freq_of_freq(spark, d):
    return leakage.spectrum(leakage.frequencies(traces.event_trace(spark, d)))


@query
def kld_plain(spark, d):
    return leakage.divergence(leakage.frequencies(doc_chunks(spark, d)))


@query
def kld_by_source(spark, d):
    return leakage.divergence(leakage.frequencies(doc_chunks(spark, d), "source", "fp"), ("source",))


@query
def kld_trace(spark, d):
    return leakage.divergence(leakage.frequencies(traces.file_trace(spark, d)))


@query
def cms_cells(spark, d):
    return sketches.cells(traces.event_trace(spark, d), WIDTH)


@query
def cms_merged(spark, d):
    return sketches.merge(sketches.cells(traces.event_trace(spark, d), WIDTH), sketches.cells(traces.file_trace(spark, d), WIDTH))


@query
def cms_estimate(spark, d):
    t = traces.event_trace(spark, d)
    return sketches.estimates(t, sketches.cells(t, 512), 512)


@query
def cms_murmur_cells(spark, d):
    return sketches.cells(traces.event_trace(spark, d), WIDTH, scheme="murmur")


@query
def cms_murmur128_cells(spark, d):
    return sketches.cells(traces.event_trace(spark, d), WIDTH, scheme="murmur128")


@query
def cms_first_row(spark, d):
    return sketches.first_row(sketches.cells(traces.event_trace(spark, d), WIDTH))


@query
def cms_total(spark, d):
    return sketches.total(sketches.cells(traces.event_trace(spark, d), WIDTH))


@query
def cms_running_estimate(spark, d):
    return sketches.running_estimates(traces.event_trace(spark, d), 512)


@query
def batch_latest_freq(spark, d):
    return sketches.batch_latest(sketches.running_estimates(traces.event_trace(spark, d), 512), 128)


@query
def topk_chunks(spark, d):
    """A top-100 report."""
    return sketches.heavy_hitters(traces.event_trace(spark, d), 100)


@query
def topk_by_estimate(spark, d):
    t = traces.event_trace(spark, d)
    return sketches.top_k(sketches.estimates(t, sketches.cells(t, 512), 512), 50)


@query
def solver_threshold(spark, d):
    return leakage.blowup_threshold(leakage.frequencies(traces.file_trace(spark, d)))


@query
def solver_threshold_sketch(spark, d):
    return leakage.blowup_threshold(sketches.first_row(sketches.cells(traces.event_trace(spark, d), 512)).select(F.col("cnt").alias("freq")), 1.3)


@query
def tunable_state_counts(spark, d):
    return leakage.frequencies(leakage.spread_states(traces.event_trace(spark, d), 5, 512), "fp", "state")


@query
def tunable_kld(spark, d):
    return leakage.divergence(leakage.frequencies(leakage.spread_states(traces.event_trace(spark, d), 5, 512), "fp", "state"))


@query
def tunable_leakage(spark, d):
    return leakage.tunable_leakage(traces.event_trace(spark, d), 1.15, 512)


@query
def frequency_replay(spark, d):
    """Where each batch's fingerprints were decided, with a set of 64."""
    return frequency.replay(traces.event_trace(spark, d), 64, 128, 512)


@query
def frequency_replay_per_chunk(spark, d):
    """Batches of one chunk."""
    return frequency.replay(traces.event_trace(spark, d), 64, 1, 512)


@query
def frequency_totals(spark, d):
    """How many probes the set and the index behind it served."""
    return frequency.dedup_report(traces.event_trace(spark, d), frequency.replay(traces.event_trace(spark, d), 64, 128, 512))


@query
def frequency_leakage(spark, d):
    return lifecycle.analyse(traces.event_trace(spark, d), 64, 128, 512)


@query
def frequency_leakage_large_set(spark, d):
    """A set that holds every fingerprint: the index behind it sees each once, and shows nothing."""
    return lifecycle.analyse(traces.event_trace(spark, d), 10_000_000, 128, 512)


# segments


@query
def segment_min_fp(spark, d):
    t = traces.event_trace(spark, d).withColumn("file_id", F.lit(0))
    return segments.summaries(segments.fixed_segments(t, 64)).select("segment", "chunk_num", "seg_size", "min_fp", "seg_hash")


@query
def content_segment_summaries(spark, d):
    return segments.summaries(segments.content_segments(traces.file_trace(spark, d), RULE)).select("file_id", "segment", "chunk_num", "seg_size", "first_seq", "min_fp", "seg_hash")


@query
def similarity_segments(spark, d):
    s, _ = segments.similarity_index(segments.content_segments(traces.file_trace(spark, d), RULE))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("chunk_num").alias("n_chunks"))


@query
def similarity_dedup_stats(spark, d):
    _, kept = segments.similarity_index(segments.content_segments(traces.file_trace(spark, d), RULE))
    return kept.agg(F.count(F.lit(1)).alias("stored_chunks"), F.sum("size").alias("stored_size"), F.countDistinct("fp").alias("unique_chunks"))


def _hooks(spark, d):
    t = traces.event_trace(spark, d).withColumn("file_id", F.lit(0))
    h = segments.hooks(segments.fixed_segments(t, 64), 4)
    return h, segments.hook_index(h.select("hook", F.col("segment").alias("manifest")), 5)


@query
def hook_fifo_cap(spark, d):
    return _hooks(spark, d)[1]


@query
def hook_manifest_candidates(spark, d):
    return segments.manifest_candidates(*_hooks(spark, d)).select("segment", "manifest", "hits")


@query
def champion_top10(spark, d):
    return segments.champions(segments.manifest_candidates(*_hooks(spark, d))).select("segment", "manifest", "hits", "rank")


@query
def locality_dedup(spark, d):
    x = segments.locality_decisions(segments.content_segments(traces.file_trace(spark, d), RULE), bits=4)
    return x.groupBy("file_id").agg(
        F.sum(F.size("is_unique").cast("long")).alias("chunks"), F.sum(F.size(F.filter("is_unique", lambda u: u)).cast("long")).alias("stored"), F.countDistinct(F.when(F.col("manifest") >= 0, F.col("manifest"))).alias("manifests")
    )


@query
def strategy_totals(spark, d):
    """Chunks that each strategy stores."""
    t = traces.file_trace(spark, d)
    out = None
    for name, options in (("exact", {}), ("frequency", {"k": 64, "width": 4096}), ("similarity", {"rule": RULE})):
        one = strategy(name, **options).apply(t).agg(F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("stored"), F.countDistinct("fp").alias("unique"))
        out = one if out is None else out.unionByName(one)
    return out


# storage


@query
def container_packing(spark, d):
    x = doc_chunks(spark, d).select(F.col("source").alias("writer"), F.col("doc_id").alias("seq"), F.col("size").alias("length"))
    return storage.pack(x, 1 << 16)


@query
def recipe_restore_lengths(spark, d):
    t = traces.file_trace(spark, d)
    first = dedup.first_seen(t, "fp", "seq", "size").select("fp", F.lit(0).alias("writer"), "seq", F.col("size").alias("length"))
    addresses = first.withColumn("container", F.substring("fp", 1, 2)).withColumn("offset", F.lit(0))
    return storage.recipes(t, addresses).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunk_num"), F.sum("length").alias("length"))


@query
def chunk_recipes(spark, d):
    t = traces.file_trace(spark, d)
    first = dedup.first_seen(t, "fp", "seq", "size").select("fp", F.substring("fp", 1, 4).alias("container"), F.col("seq").alias("offset"), F.col("size").alias("length"))
    return storage.recipes(t, first)


# reports and schemes


@query
def dedup_stats(spark, d):
    return statistics.totals(doc_chunks(spark, d))


@query
def dedup_ratio_by_source(spark, d):
    return statistics.totals(doc_chunks(spark, d), ("source",))


@query
def cumulative_snapshot_stats(spark, d):
    return statistics.cumulative(doc_chunks(spark, d), "source")


@query
def compression_ratios(spark, d):
    x = docs(spark, d).filter("data <> ''").select("data", F.sha2("data", 256).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.first("data").alias("data"))
    x = x.withColumn("c", F.length(compress(F.col("data").cast("binary"))["stored"])).withColumn("size", F.octet_length("data"))
    a, b = statistics.ratios(F.sum(F.col("n") * F.col("size")), F.sum("size"), F.sum("c"))
    return x.agg(F.round(a, 9).alias("dedup_ratio"), (b >= a).alias("compression_helps"))


@query
def key_metadata_overhead(spark, d):
    s = statistics.totals(doc_chunks(spark, d), ("source",))
    a, b = schemes.metadata_overhead(F.col("logical_chunks"), F.col("unique_chunks"))
    return s.select("source", a.alias("shared_keys"), b.alias("own_keys"))


@query
def content_keys(spark, d):
    out, names = doc_chunks(spark, d).select("doc_id", "fp", F.lit(3).alias("state")), ("plain", "convergent", "server_aided", "tunable")
    for s in names:
        out = schemes.keys(out, s).withColumnRenamed("key", s)
    return out.select("doc_id", *names)


@query
def scheme_comparison(spark, d):
    return lifecycle.compare_schemes(traces.event_trace(spark, d), 5, 512)


@query
def cipher_fingerprints(spark, d):
    """Equal contents keep equal ciphertexts under content-derived keys."""
    x = docs(spark, d).withColumn("fp", F.sha2("data", 256)).withColumn("seq", F.lit(0))
    c = schemes.cipher_chunks(schemes.keys(x, "convergent"), "convergent")
    return c.agg(F.countDistinct("cipher_fp").alias("ciphers"), F.countDistinct("fp").alias("contents"))


@query
def key_recipe_restore(spark, d):
    x = docs(spark, d).withColumn("fp", F.sha2("data", 256)).withColumn("seq", F.lit(0))
    c = schemes.cipher_chunks(schemes.keys(x, "server_aided"), "server_aided")
    return schemes.open_chunks(c.select("file_id", "seq", "cipher"), schemes.key_recipes(c), "server_aided").select("file_id", F.sha2("data", 256).alias("digest"))


@query
def cipher_index(spark, d):
    """The plain index of the schemes: on digests of what is stored."""
    x = docs(spark, d).withColumn("fp", F.sha2("data", 256)).withColumn("seq", F.col("file_id"))
    c = schemes.cipher_chunks(schemes.keys(x, "convergent"), "convergent")
    return dedup.first_seen(c, "cipher_fp", "seq").select("seq")


# generators


@query
def zipf_trace(spark, d):
    return generate.zipf_trace(spark, 200, 5, 0.9).select("seq", "fp", "size")


@query
def random_draws(spark, d):
    e = traces.table(spark, d, "events").select("event_id")
    i = F.col("event_id")
    return e.select("event_id", F.round(generate.uniform(2, 5, i), 9).alias("uniform"), generate.geometric(0.2, i).alias("geometric"))


@query
def random_draws_others(spark, d):
    i = F.col("event_id")
    return traces.table(spark, d, "events").select("event_id", F.round(generate.normal(2.0, 0.25, i), 9).alias("normal"), generate.poisson(3.0, i).alias("poisson"))


@query
def synthetic_content(spark, d):
    t = traces.event_trace(spark, d).groupBy("fp").agg(F.min("size").alias("size"))
    return generate.chunk_content(t).select("fp", F.length("data").alias("size"), F.lower(F.hex(F.substring("data", 1, 32))).alias("head"))
