"""Long texts, hot ids and texts, clashing names, and plain versions of the learned operators."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import ann, graphs, html_main, langid, licenses, mixing, ngram_join, quality, secrets
from chunkloom.llm._common import BATCH_BYTES, in_small_batches
from chunkloom.llm.queries import queries

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def prose(n, seed=0):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_components_of_a_rising_chain_take_few_rounds(spark, monkeypatch):
    rounds, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: rounds.append(1) or cut(df))
    rows = graphs.connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")).collect()
    assert len(rows) == 301 and all(r["component"] == 0 for r in rows)
    assert len(rounds) / 3 <= 14


# language models


def kneser_ney_plainly(texts, order):
    """{n-gram: probability} by dictionaries, as the definition reads; texts are padded symbol lists."""
    grams = Counter(tuple(t[i - order + 1 : i + 1]) for t in texts for i in range(order - 1, len(t)))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])  # distinct left extensions
    symbols = len(counts[1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (2 + symbols)
        c = counts[k]
        few = [sum(1 for v in c.values() if v == j) for j in (1, 2)]
        d = few[0] / (few[0] + 2 * few[1]) if few[0] and few[1] else 0.5
        own = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        return max(c.get(gram, 0) - (d if gram in c else 0), 0) / sum(own) + d * len(own) / sum(own) * p(gram[1:])

    return p


def test_kneser_ney_like_dictionaries():
    texts = ["the cat sat on the mat", "a cat and the hat", "that is that"]
    models = langid.Models({"x": texts})
    padded = [[langid._PAD] * (langid.ORDER - 1) + [ord(c) for c in t] for t in texts]
    p = kneser_ney_plainly(padded, langid.ORDER)
    for text in ["the cat", "hat mat", "zebra that", "a"]:
        cols, _, _ = langid._grams([text])
        expected = [math.log(p(tuple(int(x) for x in col))) for col in cols.T]
        assert np.allclose(models._log_probs(cols)[:, 0], expected)
        h, n, _ = models.entropies([text])
        assert n[0] == len(text) and h[0, 0] == pytest.approx(-sum(expected) / len(text), rel=1e-5)


@pytest.mark.parametrize("size", [7, 100])
def test_long_texts_are_scored_in_pieces(monkeypatch, size):
    fitted = langid.Identifier({"a": [prose(40, i) for i in range(8)], "b": [prose(40, i)[::-1] for i in range(8)]})
    texts = [prose(60, 90), "  " + prose(30, 91) + "  \n 12 " + prose(5, 92) + " ", " " * 300, "1 2 3 " * 50 + "x"]
    whole = fitted.predict(texts)
    monkeypatch.setattr(langid, "SLICE", size)
    parts = fitted.predict(texts)
    assert whole["lang_pred"].tolist() == parts["lang_pred"].tolist()
    assert np.allclose(whole[["score", "entropy"]], parts[["score", "entropy"]], rtol=1e-5)


def test_training_texts_are_bounded(spark):
    hot = [("en", prose(100, 1))] * 2000
    rows = [*hot, *(("en", prose(100, i)) for i in range(2, 300)), *(("de", prose(50, i)) for i in range(300, 320)), (None, "x"), ("en", None), ("en", prose(20000, 5))]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for seed in range(6):
        out = langid.training_texts(df, "lang", "text", chars=5000, seed=seed)
        assert all(sum(map(len, v)) <= 5000 and len(set(v)) == len(v) for v in out.values())
    assert sum(map(len, langid.training_texts(df, "lang", "text", chars=10**6, total=20_000).get("en", []))) <= 10_000


# quality


def network_plainly(net, text):
    n = max(1, -(-len(text) // quality.BLOCK))
    data = text.ljust(n * quality.BLOCK, b"\0")
    tops = []
    for b in range(n):
        places = [at for at in range(b * quality.BLOCK, (b + 1) * quality.BLOCK, quality.STRIDE) if at + quality.WIDTH <= len(data)]
        tops.append([max(sum(float(net.p["filters"][w, data[at + w], f]) for w in range(quality.WIDTH)) for at in places) for f in range(quality.FILTERS)])
    chunks = [[math.tanh(max(a, b)) for a, b in zip(tops[i], tops[i + 1], strict=True)] for i in range(n - 1)] or [[math.tanh(a) for a in tops[0]]]
    x = [sum(c) / len(chunks) for c in zip(*chunks, strict=True)] + [max(c) for c in zip(*chunks, strict=True)]
    h = [math.tanh(sum(x[i] * float(net.p["hidden"][i, j]) for i in range(len(x))) + float(net.p["hidden_at"][j])) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(h, net.p["out"], strict=True)) - float(net.p["out_at"][0])))


def test_quality_like_plain_loops(monkeypatch):
    net, rng = quality.Network(), np.random.default_rng(2)
    texts = [b"", b"short", rng.bytes(128), rng.bytes(129), rng.bytes(700), prose(300).encode()]
    expected = [network_plainly(net, t) for t in texts]
    assert np.allclose(net.scores(texts), expected, atol=1e-5)
    monkeypatch.setattr(quality, "SLICE", 256)
    assert np.allclose(net.scores(texts), expected, atol=1e-5)  # long ones in pieces


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, prose(10, i)) for i in range(400)] + [(i, prose(10, i)) for i in range(2, 200)] + [(300, "y" * 50_000), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, i % 2) for i in range(50)] + [(i, i % 2) for i in range(2, 400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    for rows, size in ((40, 1 << 20), (1000, 9000)):
        out = quality.training_rows(docs, labels, "quality", "doc_id", "text", rows, size)
        assert 0 < len(out) <= rows and sum(len(t) for t, _ in out) <= size


# near-copies


def test_long_texts_have_the_shingles_of_the_whole(monkeypatch):
    texts = [prose(500, 3), prose(3, 4), "  " + "x" * 400 + " a b c d e f", "É " * 100 + prose(9, 5), " " * 300]
    whole = ngram_join.shingle_sets(texts)
    monkeypatch.setattr(ngram_join, "SLICE", 90)
    for t, s in zip(texts, whole, strict=True):
        if "x" * 400 not in t:  # a word of more than a slice is read in pieces
            assert np.array_equal(ngram_join.shingle_sets([t])[0], s)


def test_an_id_in_a_third_of_all_rows(spark):
    text = prose(80, 6)
    rows = [(1, text)] * 60 + [(1, prose(80, 7))] * 20 + [(2, text + " end")] + [(i, prose(30, i)) for i in range(3, 100)]
    out = defaultdict(set)
    for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert out[1] == {(1, 60), (1, 19)} and out[2] == {(1, 60)} and all(out[i] == {(i, 0)} for i in range(3, 100))


# clashing names


def test_columns_of_the_input_may_have_any_name(spark, docs_of):
    rows = [(i, prose(20, i % 7), "en", "ab"[i % 2], None) for i in range(30)]
    names = "_m_copies _m_key m_id m_copies _j_id j_id J_SET _s_id s_row s_spans s_found secrets score lang_pred held h_html path".split()
    docs = docs_of(rows)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    for out in (mixing.mixed_documents(docs), ngram_join.deduplicated(docs), secrets.redact(docs)):
        assert out.columns == docs.columns and out.count() > 0
        assert all(out.filter(F.col(n) != n).isEmpty() for n in ("_m_copies", "j_id", "s_found", "secrets"))
    assert secrets.scan(docs).count() == 30 and licenses.scan(docs, licenses.build(docs)).count() == 30
    assert langid.identify(docs, None, keep=("doc_id", "score", "s_row")).columns == ["doc_id", "s_row", "lang_pred", "score", "entropy", "rejected"]
    assert quality.score(docs, None, keep=("doc_id", "score")).columns == ["doc_id", "score"]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html"), "path", "h_html")
    assert html_main.main_text(pages, keep=("page_id", "path", "h_html")).columns == ["page_id", "h_html", "text", "path"]


# secrets


def test_redaction_of_very_many_secrets(docs_of):
    text = " ".join(f"é token: value{i:05d}x" for i in range(700))
    rows = [(1, text, "en", "a", None), (2, "password=AKIA" + "Q" * 20 + " end", "en", "b", None)]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(rows)).collect()}
    assert out[1] == " ".join(["é token: [SECRET]"] * 700) and out[2] == "password=[SECRET] end"


# neighbours


def test_repeated_queries_and_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(80)] + [(20, [float(v) for v in x[20]])] * 3 + [(40, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search(df, df.filter("vec_id % 20 = 0"), ann.train(df, sample=50)).collect()
    by = defaultdict(list)
    for r in out:
        by[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert set(by) == {0, 20, 40, 60}
    assert [k for k, _ in sorted(by[20])] == list(range(1, 21)) and len({v for _, v in by[20]}) == 20
    hot = spark.createDataFrame([(7, [float(i), 1.0]) for i in range(3000)], "vec_id long, embedding array<float>")
    assert ann.train(hot, sample=100, parts=1).dim == 2


def test_recall_of_the_query_on_all_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"] is not None}
    good = {i: x for i, x in v.items() if len(x) and np.isfinite(x).all() and x.any()}
    got = defaultdict(set)
    for r in queries()["op6_ann"](spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        best = sorted((i for i in good if i != q and len(good[i]) == len(good[q])), key=lambda i: (-(good[q] * good[i]).sum(), i))[:20]
        hit, total = hit + len(got[q] & set(best)), total + len(best)
    assert hit / total >= 0.9


# the pipeline


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty, sf):
    import corpus_pipeline

    for docs in (odd.unionByName(odd).withColumn("m_id", F.lit(1)), empty):
        seen = docs
        for name, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, sf)
            if name != "encoding":
                assert seen.columns == docs.columns
            seen = spark.createDataFrame(seen.collect(), seen.schema)
        if docs is empty:
            assert seen.count() == 0


def test_pipeline_mixes_and_encodes_like_plain_versions(spark, sf):
    import corpus_pipeline
    from test_joins_and_mixes import targets_plainly
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, own = defaultdict(int), {}
    for r in docs.collect():
        own[r["doc_id"]] = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"] or "") if w])
        sizes[r["source"]] += own[r["doc_id"]]
    mixed = stages["mixing"](spark, docs, sf).collect()
    copies, taken = Counter(r["doc_id"] for r in mixed), defaultdict(int)
    assert max(copies.values()) <= 2 and len({tuple(r) for r in mixed}) == len(copies)
    for r in mixed:
        taken[r["source"]] += own[r["doc_id"]]
    for s, t in targets_plainly(sizes).items():
        assert taken[s] == pytest.approx(t, rel=0.05, abs=20)
    library = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    library.no_truncation(), library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = stages["encoding"](spark, docs, sf).collect()
    assert len(rows) == len(texts) and all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows)


def test_batches_to_workers_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 24_000, numPartitions=2).select(F.col("id"), F.repeat(F.lit("word "), 400).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        rows = in_small_batches(docs).mapInArrow(size, "n long, size long").collect()
        assert sum(r["n"] for r in rows) == 24_000 and max(r["size"] for r in rows) < 2 * BATCH_BYTES
        spark.conf.set(name, "4096")
        in_small_batches(docs)
        assert spark.conf.get(name) == "4096"  # a session's own bound stays
        few = docs.limit(40)
        groups = ngram_join.jaccard_groups(few, "id")
        assert groups.filter("kept").count() == 1 and groups.agg(F.min("n_links")).first()[0] == 39
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
