"""Operators against plain restatements of their definitions, on small data."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions.murmur import murmur3_32, murmur3_128, murmur3_x86_128
from chunkloom.operators import chunking, dedup, frequency, generate, leakage, ordered, segments, sketches, storage
from chunkloom.plans import lifecycle
from chunkloom.sources import store as stores
from chunkloom.sources import traces


def sha(x) -> str:
    return hashlib.sha256(str(x).encode()).hexdigest()


def draws(seed, most, n):
    rng = random.Random(seed)
    return [rng.randint(0, most) for _ in range(n)]


def trace(spark, items):
    return spark.createDataFrame([(i + 1, sha(x), 100) for i, x in enumerate(items)], "seq long, fp string, size int")


def test_small_trace_entropy(spark):
    r = leakage.divergence(leakage.frequencies(trace(spark, "aabacb"))).head()
    assert (r["logical"], r["distinct"]) == (6, 3)
    assert r["entropy"] == pytest.approx(1.459148, abs=1e-6)
    assert r["kld"] == pytest.approx(0.125815, abs=1e-6)


def test_uniform_and_single_frequencies_show_nothing(spark):
    assert leakage.divergence(leakage.frequencies(trace(spark, "abcd"))).head()["kld"] == pytest.approx(0, abs=1e-9)
    assert leakage.divergence(leakage.frequencies(trace(spark, "aaaa"))).head()["kld"] == pytest.approx(0, abs=1e-9)


def test_batch_flags(spark):
    rows = dedup.batch_flags(trace(spark, "aabacb"), 3).orderBy("seq").collect()
    assert [r["flag"] for r in rows] == ["UNIQUE", "TMP_UNIQUE", "UNIQUE", "DUPLICATE", "UNIQUE", "DUPLICATE"]


def literal_solver(freqs, blowup):
    f = sorted(freqs)
    n, total = len(f), sum(f)
    e = math.ceil(n * blowup - 1e-9)
    if f[0] >= total / e:
        return 1
    prefix = 0
    for i, x in enumerate(f):
        if i >= 1 and e > i and x * (e - i) >= total - prefix:
            return math.ceil(max(1, (total - prefix) / (e - i)))
        prefix += x
    return 1


@pytest.mark.parametrize("freqs", [[1, 1, 1], [5], [1, 1, 1, 1, 50], [1, 2, 3, 4, 5, 6, 7, 8], [3, 3, 3, 9, 9, 9, 100], [2] * 10 + [7] * 3])
def test_solver(spark, freqs):
    df = spark.createDataFrame([(f,) for f in freqs], "freq long")
    assert leakage.blowup_threshold(df).head()["t"] == literal_solver(freqs, 1.15)


def test_sketch_never_underestimates_and_merges(spark):
    items = draws(3, 60, 500)
    t = trace(spark, items)
    whole = sketches.cells(t, 16)
    est = {r["fp"]: r["est"] for r in sketches.estimates(t, whole, 16).collect()}
    true = Counter(sha(x) for x in items)
    assert all(est[k] >= n for k, n in true.items()) and any(est[k] > n for k, n in true.items())
    merged = sketches.merge(sketches.cells(t.filter("seq <= 200"), 16), sketches.cells(t.filter("seq > 200"), 16))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def position(fp, row, width):
    return int.from_bytes(bytes.fromhex(fp)[4 * row : 4 * row + 4], "little") % width


def test_running_estimates_do_not_depend_on_blocks(spark):
    items = draws(5, 30, 300)
    cells, expected = Counter(), []
    for x in items:
        at = [(r, position(sha(x), r, 8)) for r in range(4)]
        cells.update(at)
        expected.append(min(cells[a] for a in at))
    for block in (1, 7, 1000):
        rows = sketches.running_estimates(trace(spark, items), 8, block=block).orderBy("seq").collect()
        assert [r["est"] for r in rows] == expected


def replay_plainly(items, k, batch, width, gate):
    """The definition, chunk by chunk: batches, a sketch, a list searched for its least."""
    cells, held, came, out = Counter(), {}, {}, []
    clock = 0
    for start in range(0, len(items), batch):
        part = [sha(x) for x in items[start : start + batch]]
        est = {}
        for fp in part:
            at = [(r, position(fp, r, width)) for r in range(4)]
            cells.update(at)
            est[fp] = min(cells[a] for a in at)
        least = min(held.values(), default=0) if len(held) >= k or gate == "any" else 0
        for fp in dict.fromkeys(part):
            out.append((start // batch, fp, part.count(fp), est[fp], "inside" if est[fp] >= least and fp in held else "outer"))
        for fp in dict.fromkeys(part):
            freq = est[fp]
            low = min(held.values(), default=0)
            if fp in held:
                if gate == "any" or len(held) < k or freq >= low:
                    held[fp] = freq
                continue
            if len(held) >= k:
                if freq < low:
                    continue
                gone = min(held, key=lambda f: (held[f], came[f]))
                del held[gone]
            clock += 1
            held[fp], came[fp] = freq, clock
    return out


@pytest.mark.parametrize(("k", "batch", "gate"), [(1, 4, "full"), (5, 8, "full"), (5, 8, "any"), (3, 1, "full"), (1000, 16, "full")])
def test_frequency_replay(spark, k, batch, gate):
    rng = random.Random(k * 100 + batch)
    items = [min(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(400)]
    rows = frequency.replay(trace(spark, items), k, batch, 64, gate).collect()
    assert sorted(map(tuple, rows)) == sorted(replay_plainly(items, k, batch, 64, gate))


def test_set_that_holds_everything_shows_nothing(spark):
    items = draws(1, 20, 200)
    r = lifecycle.analyse(trace(spark, items), 10_000, 16, 64).head()
    assert r["observed"] == r["distinct"] == len(set(items)) and r["cipher_kld"] == pytest.approx(0, abs=1e-9)


def test_segment_edges(spark):
    rule = segments.SegmentRule(least=100, most=300, chunks=4, divisor=2, pattern=0)
    rng = random.Random(9)
    rows = [(f, i, sha((f, rng.random())), rng.choice([10, 60, 150])) for f in range(3) for i in range(60)]
    got = {(r["file_id"], r["seq"]): r["segment"] for r in segments.content_segments(spark.createDataFrame(rows, "file_id int, seq long, fp string, size int"), rule).collect()}
    for f in range(3):
        number = count = total = 0
        for _, i, fp, size in (r for r in rows if r[0] == f):
            value = sum(bytes.fromhex(fp))
            if count and (count + 1 > 4 or total + size > 300 or total + size >= 100 and value % 2 == 0):
                number, count, total = number + 1, 0, 0
            count, total = count + 1, total + size
            assert got[f, i] == number


def locality_plainly(rows, champions, per_hook, bits):
    manifests, hooks, out = [], {}, {}
    for key in sorted({(r[0], r[1]) for r in rows}):
        part = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        own = list(dict.fromkeys(r[3] for r in part if bytes.fromhex(r[3])[0] < 1 << (8 - bits)))
        hits = Counter(m for h in own for m in hooks.get(h, []))
        best = sorted(hits, key=lambda m: (-hits[m], m))[:champions]
        known = set().union(*(manifests[m] for m in best)) if best else set()
        seen, fresh = set(), False
        for r in part:
            unique = r[3] not in known and r[3] not in seen
            seen.add(r[3])
            fresh |= unique
            out[r[0], r[1], r[2]] = unique
        if fresh:
            manifests.append(seen)
            for h in own:
                hooks[h] = (hooks.get(h, []) + [len(manifests) - 1])[-per_hook:]
    return out


def test_locality_replay(spark):
    rng = random.Random(2)
    rows = [(f, i // 6, i, sha(rng.randint(0, 80)), 10) for f in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "file_id int, segment long, seq long, fp string, size int")
    got = {(r["file_id"], r["segment"], r["seq"]): r["is_unique"] for r in segments.locality_index(df, 2, 3, 2).collect()}
    assert got == locality_plainly(rows, 2, 3, 2)


def test_similarity_stores_no_less_than_exact(spark, sf):
    t = traces.file_trace(spark, sf)
    _, kept = segments.similarity_index(segments.content_segments(t, segments.SegmentRule(20_000, 80_000, 40, 8, 1)))
    assert kept.count() >= t.select("fp").distinct().count() == kept.select("fp").distinct().count()


def test_container_edges(spark):
    lengths = [84, 83, 85, 10, 200, 1]
    df = spark.createDataFrame([("w", i, n) for i, n in enumerate(lengths)], "writer string, seq long, length long")
    rows = storage.pack(df, 200).orderBy("seq").collect()
    assert [(r["container"][-1], r["offset"]) for r in rows] == [("0", 0), ("0", 100), ("1", 0), ("1", 101), ("2", 0), ("3", 0)]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([(16, 64, 256), (4, 8, 8), (1, 32, 1000)]))
def test_content_cuts_are_a_partition(data, sizes):
    cutter = chunking.ContentCutter(*sizes)
    cuts = cutter.cuts(data)
    assert b"".join(data[a : a + n] for a, n in cuts) == data
    assert all(n <= sizes[2] for _, n in cuts) and all(n >= sizes[0] for _, n in cuts[:-1])


@settings(max_examples=20, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_gear_hash_is_that_of_the_last_32_bytes(data):
    cutter = chunking.ContentCutter()
    h = cutter.hashes(data)
    for i in range(len(data)):
        assert int(h[i]) == sum(int(cutter.gear[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF


def test_zeros_and_shared_content():
    cutter = chunking.ContentCutter(64, 128, 512)
    assert cutter.cuts(b"") == [] and cutter.cuts(b"abc") == [(0, 3)]
    body = np.random.default_rng(0).bytes(20_000)
    a, b = ({body2[s : s + n] for s, n in cutter.cuts(body2)} for body2 in (body, b"prefix" + body))
    assert len(a & b) > 0.8 * len(a)


def test_murmur_published_values():
    """Known hashes of the published algorithm."""
    one = lambda s: np.frombuffer(s, np.uint8).reshape(1, -1)
    assert int(murmur3_32(one(b"hello"), 0)[0]) == 0x248BFA47
    assert int(murmur3_32(one(b"hello, world"), 0)[0]) == 0x149BBB7F
    assert int(murmur3_32(np.zeros((1, 0), np.uint8), 1)[0]) == 0x514E28B7
    assert f"{int(murmur3_128(one(b'hello'), 0)[0, 0]):016x}{int(murmur3_128(one(b'hello'), 0)[0, 1]):016x}" == "cbd8a7b341bd9b025b1e906a48ae1d19"


@pytest.mark.parametrize("hashed, kind, expected", [(murmur3_32, "<u4", 0xB0F57EE3), (murmur3_x86_128, "<u4", 0xB3ECE62A), (murmur3_128, "<u8", 0x6384BA69)])
def test_murmur_published_verification(hashed, kind, expected):
    """The algorithm's published verification codes, a hash of hashes of all lengths up to 255."""
    all_hashes = b"".join(hashed(np.arange(n, dtype=np.uint8).reshape(1, -1), 256 - n).astype(kind).tobytes() for n in range(256))
    last = hashed(np.frombuffer(all_hashes, np.uint8).reshape(1, -1), 0).astype(kind).tobytes()
    assert int.from_bytes(last[:4], "little") == expected


@pytest.mark.parametrize("ratio", [1.5, 2.0, 4.0])
def test_generated_content_shrinks_by_about_its_ratio(ratio):
    raw = b"".join(generate.compressible(1 << 15, ratio, seed) for seed in range(8))
    assert len(raw) == 8 << 15 and generate.compressible(999, ratio, 3) == generate.compressible(999, ratio, 3)
    got = len(raw) / len(zlib.compress(raw, 1))
    assert 0.6 * ratio < got < 1.4 * ratio


def test_trace_files(spark, tmp_path):
    (tmp_path / "a").write_text("AB:01:ff:10:22:9c\t\t8192\t\t10\n\nab:01:ff:10:22:9d 99999 1\n")
    (tmp_path / "b").write_text("0b:01:ff:10:22:9c\t4096")
    rows = traces.read_trace(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [(1, "ab01ff10229c", 8192), (2, "ab01ff10229d", 16384), (3, "0b01ff10229c", 4096)]
    (tmp_path / "c").write_text("ab:01:ff:10:22\t\t4096\n")
    assert traces.read_trace(spark, str(tmp_path / "c"), 5).head()["fp"] == "ab01ff1022"


def test_ingest_restore_and_second_run_stores_nothing(spark, tmp_path):
    body = [bytes(generate.compressible(3000, 2.0, s)) for s in (1, 2)]
    files = spark.createDataFrame([("x", bytearray(body[0] + body[1])), ("y", bytearray(body[1] + body[0])), ("z", bytearray(b"q"))], "file_id string, data binary")
    s = stores.Store(spark, f"file://{tmp_path}/store")
    first = lifecycle.ingest(s, files, chunk_size=100, capacity=1000).head()
    again = lifecycle.ingest(s, files.withColumn("file_id", F.concat("file_id", F.lit("2"))), chunk_size=100, capacity=1000).head()
    assert first["logical_size"] == 12_001 and first["compressed_size"] <= first["unique_size"] == 6001
    assert again["unique_chunks"] == 0 and again["logical_chunks"] == first["logical_chunks"]
    total = s.read("statistics").head()
    assert total["logical_size"] == 24_002 and total["unique_size"] == 6001
    back = {r["file_id"]: bytes(r["data"]) for r in lifecycle.restore(s).collect()}
    assert back["x"] == back["x2"] == body[0] + body[1] and back["y"] == body[1] + body[0] and back["z2"] == b"q"
    assert [r["file_id"] for r in lifecycle.restore(s, files.filter("file_id = 'z'")).collect()] == ["z"]
    assert s.read("containers").agg(F.max("size")).head()[0] < 1000 + 116


def test_content_defined_ingest(spark, tmp_path):
    data = np.random.default_rng(4).bytes(30_000)
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"head" + data))], "file_id int, data binary")
    s = stores.Store(spark, f"file://{tmp_path}/store")
    r = lifecycle.ingest(s, files, cutter=chunking.ContentCutter(256, 512, 1024)).head()
    assert r["unique_size"] < 0.7 * r["logical_size"]
    assert {q["file_id"]: bytes(q["data"]) for q in lifecycle.restore(s).collect()} == {1: data, 2: b"head" + data}


def test_ordered_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))

        def step(state, pdf):
            out = pdf["v"].cumsum() + state[0]
            state[0] = int(out.iloc[-1])
            return pdf.assign(total=out)

        rows = ordered.ordered_fold(df, ["k"], ["v"], lambda: [0], step, "k long, v long, total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r["total"] == sum(range(r["k"], r["v"] + 1, 3)) for r in rows) and len(rows) == 200


def test_running_count_and_dense_sequence(spark):
    df = spark.range(1, 301).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"))
    rows = ordered.running_count(df, ["k"], "seq", F.floor(F.col("seq") / 16)).collect()
    assert all(r["running"] == sum(1 for i in range(1, r["seq"] + 1) if (i % 3 > 0) == (r["k"] == "hot")) for r in rows)
    numbered = ordered.dense_sequence(df.select((F.col("seq") * 7 % 311).alias("x")), ["x"], "n").orderBy("x").collect()
    assert [r["n"] for r in numbered] == list(range(1, 301))


def test_key_value_store_and_config(spark):
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("b", "x", 2)], "k string, v string, at long")
    old = spark.createDataFrame([("a", "0", 2), ("c", "z", 0)], "k string, v string, at long")
    assert {r["k"]: r["v"] for r in stores.upsert(old, new, "k", "v", "at").collect()} == {"a": "2", "b": "x", "c": "z"}
    c = stores.Config.read('{"chunker": {"avg_chunk": 1024, "other": 1}, "top_k": 7}')
    assert (c.avg_chunk, c.top_k, c.container) == (1024, 7, 4 << 20)


def test_draws_have_their_distributions(spark):
    x = spark.range(20_000).select(generate.poisson(3.0, F.col("id")).alias("p"), generate.normal(2.0, 0.25, F.col("id")).alias("n"), generate.geometric(0.2, F.col("id")).alias("g"), generate.uniform(2, 5, F.col("id")).alias("u"))
    r = x.agg(F.avg("p"), F.var_pop("p"), F.avg("n"), F.stddev("n"), F.avg("g"), F.min("u"), F.max("u")).head()
    assert r[0] == pytest.approx(3, abs=0.1) and r[1] == pytest.approx(3, abs=0.2)
    assert r[2] == pytest.approx(2, abs=0.02) and r[3] == pytest.approx(0.25, abs=0.02)
    assert r[4] == pytest.approx(4, abs=0.15) and 2 <= r[5] < r[6] < 5


def test_streams(spark, tmp_path):
    from chunkloom.streaming import incremental

    spark.range(600).selectExpr("id + 1 as seq", "sha2(cast(id % 50 as string), 256) as fp", "cast(100 as int) as size", "timestamp_seconds(id) as ts").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, fp string, size int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", incremental.windowed_counts(stream, "ts"), "complete"), ("running", incremental.running_frequency_stream(stream), "update"), ("firsts", incremental.first_seen_stream(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.sql("select sum(freq) from counts").head()[0] == 600
    assert spark.sql("select fp, max(freq) f from running group by fp").filter("f <> 12").count() == 0
    assert spark.table("firsts").count() == 50


@pytest.mark.parametrize("index", ["exact", "frequency", "similarity", "locality"])
def test_ingest_by_every_strategy(spark, tmp_path, index):
    data = [np.random.default_rng(i % 3).bytes(3000) for i in range(5)]
    files = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "file_id int, data binary")
    s = stores.Store(spark, f"file://{tmp_path}/store")
    config = stores.Config(top_k=4, batch=8, sketch_width=64, segment_min=500, segment_max=2000, segment_chunks=10, segment_divisor=4, hook_bits=1, container=4000)
    r = lifecycle.ingest(s, files, chunk_size=100, index=index, config=config).head()
    assert r["logical_chunks"] == 150 and r["unique_chunks"] >= 90 and (index not in ("exact", "frequency") or r["unique_chunks"] == 90)
    assert {q["file_id"]: bytes(q["data"]) for q in lifecycle.restore(s).collect()} == dict(enumerate(data))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/store/log").head()["logical_chunks"] == "150"
    assert lifecycle.restore_files(s, f"file://{tmp_path}/out") == 5
    assert [(tmp_path / "out" / f"{i}-d").read_bytes() for i in range(5)] == data


def test_compaction_keeps_rows_and_numbers(spark, tmp_path):
    s = stores.Store(spark, f"file://{tmp_path}/store")
    for i in range(3):
        s.append("t", spark.range(i * 10, i * 10 + 10))
    s.compact("t")
    assert sorted(r["id"] for r in s.read("t").collect()) == list(range(30))
    assert s.append("t", spark.range(30, 40)) == 4
    s.compact("t")
    assert sorted(r["id"] for r in s.read("t").collect()) == list(range(40))


def test_top_set_holds_little_more_than_its_fingerprints():
    top = frequency.TopSet(10)
    for i in range(5000):
        top.offer(str(i % 7), i)
    assert len(top.held) == 7 and len(top.heap) <= 2 * 7 + 65


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_what_is_materialised_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    made = stores.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and made.count() == 7
    assert spark.conf.get(stores.CLEANUP) == "false"
    stores.discard(made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        made.count()


def test_upload_writes_recipes_only(spark):
    import glob
    import os

    data = [np.random.default_rng(i % 30).bytes(20_000) for i in range(40)]
    files = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "file_id int, data binary")
    chunks = chunking.fixed_chunks(files, 1000).select("file_id", "seq", "data", F.sha2("data", 256).alias("fp"), F.lit(0).alias("state"))
    shared = stores.shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{shared}/**/*.parquet", recursive=True))
    for scheme in ("plain", "convergent", "server_aided", "tunable"):
        was = size()
        stored, recipe = lifecycle.upload(chunks, scheme)
        assert size() - was < 200_000  # of 800,000 bytes of content
        assert stored.count() == 600
        assert {r["file_id"]: bytes(r["data"]) for r in lifecycle.download(stored, recipe, scheme).collect()} == dict(enumerate(data))


def test_many_small_files_cost_little(spark):
    """Folds walk batches instead of making a pandas frame for each of 20,000 files."""
    t = spark.range(40_000).select((F.col("id") % 20_000).alias("file_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("fp"), F.lit(10).alias("size"))
    segments.content_segments(t.limit(10)).count()
    began = time.time()
    assert segments.content_segments(t).agg(F.count("*"), F.max("segment")).head()[:] == (40_000, 0)
    packed = storage.pack(t.select(F.col("file_id").alias("writer"), "seq", F.col("size").alias("length")), 100)
    assert packed.agg(F.sum("offset")).head()[0] == 20_000 * 26
    assert time.time() - began < 20


def test_locality_decides_alike_when_hashes_clash(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f, i // 6, i, sha(rng.randint(0, 60)), 10) for f in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "file_id int, segment long, seq long, fp string, size int")
    expected = locality_plainly(rows, 2, 3, 2)
    real = ordered._hashes
    monkeypatch.setattr(ordered, "_hashes", lambda key: (real(key)[0] % 8, real(key)[1]))
    got = segments.locality_decisions(df, 2, 3, 2).collect()
    assert {(r["file_id"], r["segment"], 6 * r["segment"] + i): u for r in got for i, u in enumerate(r["is_unique"])} == expected


def test_ingest_keeps_no_copies_of_content(spark, tmp_path):
    import glob
    import os

    files = spark.createDataFrame([(i, bytearray(np.random.default_rng(i).bytes(50_000))) for i in range(10)], "file_id int, data binary")
    shared = stores.shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{shared}/made-*/*.parquet"))
    was, s = size(), stores.Store(spark, f"file://{tmp_path}/store")
    lifecycle.ingest(s, files, chunk_size=1000)
    assert size() - was < 100_000  # of 500,000 bytes of content
    s.drop()
    assert not (tmp_path / "store").exists()
