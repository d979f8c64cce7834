"""Ingest, restore and leakage analysis from end to end, over a store of snapshot tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import chunking, frequency, leakage, schemes, statistics, storage
from chunkloom.plans.strategies import configured
from chunkloom.sources.store import Config, Store, carry_over, discard, materialise, write_statistics


def ingest(store: Store, files: DataFrame, chunk_size: int | None = None, cutter: chunking.ContentCutter | None = None, capacity: int | None = None, index: str = "exact", config: Config | None = None) -> DataFrame:
    """files (file_id, data): chunks, lets the index strategy named by `index` choose the copies to store, packs them, and
    writes containers, recipes, the index, statistics and a line of the log. Returns the run's statistics (one row).

    Sizes come from `config` unless they are given. Exact and frequency indexes know what earlier runs stored; similarity
    and locality decide within a run, and store what their bins and champions miss. Content leaves the plan after the copies
    are chosen: shuffles of all chunks carry fingerprints and sizes only.
    """
    began, config = time.monotonic(), config or Config()
    cutter = cutter or chunking.ContentCutter(config.min_chunk, config.avg_chunk, config.max_chunk)
    cut = chunking.fixed_chunks(files.withColumn("data", F.col("data").cast("binary")), chunk_size) if chunk_size else chunking.content_chunks(files, cutter)
    listed = materialise(cut.withColumn("fp", F.sha2("data", 256)))
    chunks = listed.select("file_id", "seq", "size", "fp")
    fresh = configured(index, config, store.read("index")).apply(chunks).select("file_id", "seq", "fp")
    content = listed.select("file_id", "seq", "size", "data").join(fresh, ["file_id", "seq"])
    run = len(store.versions("index", "a"))
    stored = storage.compressed(content).withColumn("writer", F.concat_ws(":", F.lit(str(run)), F.col("file_id").cast("string")))
    packed = materialise(storage.pack(stored, capacity or config.container))
    store.append("containers", storage.containers(packed))
    store.append("index", packed.select("fp", "container", "offset", "length", "is_compressed", "size"))
    # a strategy may store several copies of a chunk; its recipes all point to one
    addresses = store.read("index").groupBy("fp").agg(F.min(F.struct("container", "offset", "length")).alias("a")).select("fp", "a.*")
    store.append("recipes", storage.recipes(chunks, addresses))
    stats = chunks.agg(F.count(F.lit(1)).alias("logical_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("logical_size")).crossJoin(
        packed.agg(F.count(F.lit(1)).alias("unique_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("unique_size"), F.coalesce(F.sum("length"), F.lit(0)).alias("compressed_size"))
    )
    stats = materialise(stats)
    for made in (listed, packed):  # content that the containers have now
        discard(made)
    store.write("statistics", materialise(carry_over(store.read("statistics"), stats)))
    seconds = time.monotonic() - began
    speed = statistics.throughput(stats.first()["logical_size"], seconds)
    write_statistics(stats.select(F.lit(run).alias("run"), F.lit("upload").alias("opt"), "*", F.lit(seconds).alias("seconds"), F.lit(speed).alias("mib_per_second")), f"{store.root}/log")
    return stats


def restore(store: Store, file_ids: DataFrame | None = None) -> DataFrame:
    """file_id, data of the files asked for (all, if none are)."""
    recipe = store.read("recipes")
    if file_ids is not None:
        recipe = recipe.join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
    return storage.restore(storage.read_chunks(recipe, store.read("containers"), store.read("index")))


def restore_files(store: Store, root: str, file_ids: DataFrame | None = None) -> int:
    """Restores files as files under root; returns how many there are."""
    return storage.write_files(restore(store, file_ids), root)


def upload(chunks: DataFrame, scheme: str, secret: str = "chunkloom") -> tuple[DataFrame, DataFrame]:
    """Encrypts, then deduplicates: (stored ciphertexts: cipher_fp, cipher; key recipes: file_id, seq, key, cipher_fp) of
    chunks (file_id, seq, fp, data) under a scheme (the tunable one needs a column state).

    Only the recipes are written. Equal ciphertexts meet as data and key, which compress in a shuffle, and one of them is
    encrypted where they meet; chunks must come out alike each time they are read, as encryption here does."""
    ciphered = schemes.cipher_chunks(schemes.keys(chunks, scheme, secret), scheme)
    recipe = materialise(schemes.key_recipes(ciphered))
    kept = ciphered.groupBy("cipher_fp").agg(F.first(F.struct("data", "key")).alias("c"))
    return kept.select("cipher_fp", schemes.ciphertext(F.col("c.data"), F.col("c.key"), scheme).alias("cipher")), recipe


def download(stored: DataFrame, key_recipe: DataFrame, scheme: str) -> DataFrame:
    """file_id, data: files put together from stored ciphertexts by their key recipes. A recipe's entry brings its key to the
    ciphertext, so content is moved once more only, opened, to its file."""
    placed = key_recipe.select("file_id", "seq", "key", "cipher_fp").join(stored.select("cipher_fp", "cipher"), "cipher_fp")
    return storage.restore(placed.select("file_id", "seq", schemes.opened(scheme).alias("data")))


def analyse(chunks: DataFrame, k: int, batch: int = 128, width: int = 262_144, gate: str = "full") -> DataFrame:
    """One row: divergence of the plain frequencies, and of those that the index behind a frequency set of k sees."""
    seen = frequency.observed(frequency.replay(chunks, k, batch, width, gate))
    plain = leakage.divergence(leakage.frequencies(chunks)).select(F.col("logical"), F.col("distinct"), F.col("kld").alias("plain_kld"))
    return plain.crossJoin(leakage.divergence(seen).select(F.col("logical").alias("observed"), F.col("kld").alias("cipher_kld")))


def compare_schemes(chunks: DataFrame, t: int = 5, width: int = 262_144) -> DataFrame:
    """scheme, unique_chunks, key_bytes: stored copies and key metadata under each scheme."""
    plain = statistics.totals(chunks.withColumn("size", F.lit(1))).select("logical_chunks", "unique_chunks")
    states = leakage.spread_states(chunks, t, width).select("fp", "state").distinct().agg(F.count(F.lit(1)).alias("tunable"))
    both = plain.crossJoin(states)
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.col("tunable" if s == "tunable" else "unique_chunks").alias("unique_chunks"), (F.lit(0) if s == "plain" else F.col("logical_chunks") * 32).alias("key_bytes")) for s in ("plain", "convergent", "server_aided", "tunable"))))
    return both.select(rows.alias("r")).select("r.*")
