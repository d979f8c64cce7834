"""Near-copies, vectors, mixing and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import ann, embed_dedup, graphs, mixing, ngram_join
from chunkloom.llm.queries import queries


def groups_plainly(texts, threshold=0.8):
    """{id: (smallest id of its component, links)} by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = {i: [j for j in ids if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in ids}
    root = {}
    for i in ids:
        if i not in root:
            front = [i]
            while front:
                x = front.pop()
                if x not in root:
                    root[x] = i
                    front += links[x]
    return {i: (root[i], len(links[i])) for i in ids}


def near_copies(seed, n_groups, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n_groups):
        base = [word() for _ in range(60)] + passage
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("seed", "n_groups", "size", "block", "small"), [(1, 30, 6, 256, 32), (2, 2, 80, 16, 4)])
def test_near_copies(spark, monkeypatch, seed, n_groups, size, block, small):
    """With small blocks and buckets, large groups meet in several pairs of blocks, and large buckets in stars."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    texts = near_copies(seed, n_groups, size)
    rows = ngram_join.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == groups_plainly(texts)


def test_near_copies_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    texts = near_copies(4, 10, 4)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = groups_plainly(texts)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_groups(df).collect()} == expected
    assert {r["doc_id"] for r in ngram_join.deduplicated(df).collect()} == {i for i, (c, _) in expected.items() if i == c}


def test_near_copies_of_rows_without_an_id(spark):
    words = [f"word{i}" for i in range(100)]
    text = " ".join(words)
    near, other = text + " end", " ".join(reversed(words))
    rows = [(7, text), (None, near), (None, near), (8, "quite another text of some words"), (None, other), (None, other + " end")]
    out = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(7, 7, 2, True), (None, 7, 2, False), (None, 7, 2, False), (8, 8, 0, True), (None, None, 1, True), (None, None, 1, True)]
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)


def test_near_copies_with_repeated_ids_leave_one_row_of_each_group(spark):
    text, other, third = (" ".join(f"{w}{i}" for i in range(100)) for w in ("a", "b", "c"))
    rows = [(1, text), (5, other), (5, text + " end"), (6, third), (6, third + " end"), (6, third.upper()), (7, ""), (7, other + " end"), (7, None), (7, "")]
    out = {tuple(r) for r in ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of_6 = {r for r in out if r[0] == 6}
    assert out - of_6 == {(1, text), (5, other), (7, ""), (7, None)} and len(of_6) == 1


def test_near_copies_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.jaccard_groups(odd).collect()]
    assert sorted(rows, key=repr) == sorted([(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 2, True), (4, 4, 2, True), (5, 4, 2, False), (None, None, 0, True), (6, 6, 0, True)], key=repr)
    kept = ngram_join.deduplicated(odd.withColumn("id", F.lit("theirs")))
    assert kept.columns == [*odd.columns, "id"] and kept.count() == 6
    assert ngram_join.jaccard_groups(empty).count() == 0 and ngram_join.deduplicated(empty).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert bands * rows <= ngram_join.MOST_HASHES and 1 - (1 - threshold**rows) ** bands >= recall


def test_shingles_in_batches_are_those_of_single_texts():
    texts = ["", "a b c d e f", "one", "x  y\tz\n w v", "É é ü ß o p q", "a b c d e a b c d e"]
    together = ngram_join.shingle_sets(texts)
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(ngram_join.shingle_sets([t])[0], s)
    assert [len(s) for s in together] == [0, 2, 1, 1, 3, 5]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 102), (None, 3), (200, 150), (200, 160)]
    rows = {r["v"]: r["component"] for r in graphs.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(rows[i] == 1 for i in range(1, 41)) and rows[101] == 100 and rows[160] == 150 and 102 not in rows
    assert graphs.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


NAN, INF = float("nan"), float("inf")
ODD_VECTORS = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [NAN] + [1.0] * 15, 1), (904, [INF] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0] * 16, None), (907, [1.0] * 16, 1), (907, [1.0] * 16, 1), (908, [2.0] * 16, 1), (909, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.25, 1.0], (n, 1))
    return [(i, [float(v) for v in np.float32(x[i])], int(i % 3)) for i in range(n)]


def vectors_plainly(rows):
    good = {i: (np.array(x, float), label) for i, x, label in rows}
    ids = sorted(good)
    cos = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    links = {i: [j for j in ids if j != i and good[i][1] == good[j][1] and cos(good[i][0], good[j][0]) >= 0.93] for i in ids}
    root = {}
    for i in ids:
        front = [i] if i not in root else []
        while front:
            x = front.pop()
            if x not in root:
                root[x] = i
                front += links[x]
    return {i: (len(links[i]), root[i]) for i in ids}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rows = clustered(300)
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == vectors_plainly(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_vector_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = embed_dedup.Rotation(64)
    codes, factors = r.codes(x)
    true = x[:50] @ x.T
    rotated = x[:50].astype(np.float32) @ r.matrix
    est = embed_dedup.estimates(codes, factors, rotated)
    exact = embed_dedup.upper_bounds(codes, factors, rotated, np.zeros(50, np.float32))
    q, step, lost = embed_dedup.rounded(rotated)
    upper = embed_dedup.upper_bounds(codes, factors, q * step[:, None], lost)
    assert (true <= exact + 1e-5).all() and (exact <= upper + 1e-5).all() and (upper - exact).max() < 0.03
    off = ~np.eye(50, 400, dtype=bool)
    assert abs((est - true)[off].mean()) < 0.005 and (upper[off] < 0.93).mean() > 0.9


def test_vectors_odd_rows(spark):
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(ODD_VECTORS, VECTORS)).collect()), key=repr)
    alone = [(i, 0, i) for i in (900, 901, 902, 903, 904, 905, 906, 909, None)]
    assert out == sorted([*alone, (907, 2, 907), (907, 2, 907), (908, 2, 907)], key=repr)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "ITEMS", 64)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rows = clustered(900, 5)
    rows += [(1000 + i, rows[40][1], 0) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, VECTORS)
    router = ann.train(df, parts=8)
    out = ann.search(df, df.filter("vec_id % 20 = 0"), router).collect()
    x = {i: np.array(v, float) for i, v, _ in rows}
    hit = total = 0
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append(r)
        assert r["score"] == (x[r["query_id"]] * x[r["vec_id"]]).sum()
    for q in [i for i in x if i % 20 == 0]:
        best = sorted((i for i in x if i != q), key=lambda i: (-(x[q] * x[i]).sum(), i))[:20]
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21)) and [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        hit += len({r["vec_id"] for r in got} & set(best))
        total += 20
    assert hit / total >= 0.9
    assert sorted(router.order(np.stack([x[1]]))[0].tolist()) == list(range(8))


def test_parts_are_balanced():
    x = np.array([v for _, v, _ in clustered(600, 6)])
    sizes = np.bincount(ann.balanced_parts(x, ann.neighbour_graph(x, 10), 8), minlength=8)
    assert sizes.max() <= math.ceil(600 / 8 * 1.1)


def test_neighbours_of_few_rows_in_a_part_and_of_other_lengths(spark):
    rows = clustered(200, 7)
    df = spark.createDataFrame(rows + [(1000 + i, [1.0, float(i), 2.0], 0) for i in range(30)], VECTORS)
    router = ann.train(df, parts=8, target=0.0)
    assert router.probes == 1 and router.dim == len(rows[0][1])
    by = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), router).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    asked = {r["vec_id"] for r in df.filter("vec_id % 20 = 0").collect()}
    assert set(by) == asked and all(len(v) == 20 for v in by.values())
    assert [v for _, v in sorted(by[1000])] == list(range(1001, 1021))
    assert [v for _, v in sorted(by[1020])] == list(range(1029, 1008, -1))[:9] + list(range(1019, 1008, -1))


def test_parts_visited_are_chosen_on_rows_held_out():
    """Of vectors without structure the fit knows nothing about others: the visits it chooses hold for new rows."""
    x = np.random.default_rng(8).normal(size=(1600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = ann.Router(x[:800], parts=8, target=0.9)
    order = router.order(x)
    near = ann.neighbour_graph(x, 20)[800:]
    met = (order[800:, None, : router.probes] == order[:, 0][near][:, :, None]).any(axis=2).mean()
    assert met >= 0.88


def test_neighbours_odd_rows(spark):
    df = spark.createDataFrame(ODD_VECTORS + [(920, [3.0] * 16, 1)], VECTORS)
    out = ann.search(df, df.filter("vec_id % 20 = 0"), ann.train(df)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(920, 1, 908), (920, 2, 906), (920, 3, 907), (920, 4, 907)]
    none = df.limit(0)
    assert ann.train(none) is None and ann.search(none, none, ann.Router(np.zeros((0, 1)))).count() == 0


def targets_plainly(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Reshares the excess, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 50, 400])), None, rng.choice(["a", "b", "ä", "c", None, "hot", "hot", "hot"]), None) for i in range(3000)]
    units = mixing.mix(docs_of(rows)).collect()
    assert sum(u["_m_rows"] for u in units) == 3000
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    expected = targets_plainly(sizes)
    for s in sizes:
        own = [u for u in units if u["_m_source"] == s]
        assert all(u["source_size"] == sizes[s] and u["target"] == pytest.approx(expected[s]) and u["copies"] <= 2 for u in own)
        assert sum(u["copies"] * u["size"] for u in own) == pytest.approx(expected[s], rel=0.002)
    assert set(map(tuple, units)) == set(map(tuple, mixing.mix(docs_of(rows).repartition(7)).collect()))  # reruns agree


def test_mixing_in_a_tree(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), None, "a" if i % 3 else "b", None) for i in range(1500)]
    units = mixing.mix(docs_of(rows)).collect()
    for s in "ab":
        own = [u for u in units if u["_m_source"] == s]
        assert sum(u["copies"] * u["size"] for u in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_pivotal_rounding_keeps_mass_and_means():
    rng = np.random.default_rng(0)
    room = rng.integers(1, 50, 30).astype(float)
    mass, sums = room * 0.3, np.zeros(30)
    for _ in range(4000):
        out = mixing._fold(mass, room, rng.random(30))
        assert out.sum() == pytest.approx(mass.sum()) and ((out > 0) & (out < room)).sum() <= 1
        sums += out
    assert np.allclose(sums / 4000 / room, 0.3, atol=0.04)


def test_mixing_odd_rows(odd, empty):
    units = mixing.mix(odd).collect()
    assert sum(u["_m_rows"] for u in units) == odd.count()
    assert all(u["size"] * u["copies"] == 0 for u in units if u["_m_id"] in (1, 2, 3))
    mixed = mixing.mixed_documents(odd.withColumn("size", F.lit("theirs")))
    assert mixed.columns == [*odd.columns, "size"]
    assert {r["doc_id"] for r in mixed.collect()} >= {1, 2, 3}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_big_ids_stay_whole(docs_of):
    rows = [(2**62 + 1, "a b c", None, "a", None), (None, "d e", None, "a", None)]
    assert {u["_m_id"] for u in mixing.mix(docs_of(rows)).collect()} == {2**62 + 1, None}


def test_op4_query(spark, sf):
    out = queries()["op4_mixing"](spark, sf).toPandas()
    by = out.groupby("doc_id").first()
    assert len(out) == len(by) == 200 and (out["taken"] <= 2 * out["size"]).all()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf)
        if name != "encoding":
            assert out.columns == docs.columns
        rows = out.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "quality":
            assert 0 < len(rows) < len(texts) and all(r["text"] == texts[r["doc_id"]] for r in rows)
            scored = ids
        elif name == "near_copies":
            plain = groups_plainly([(i, texts[i]) for i in scored])
            assert ids == {i for i, (c, _) in plain.items() if i == c} and len(rows) == len(ids)
        elif name == "secrets":
            assert len(rows) == seen.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert {r["doc_id"] for r in rows if r["text"] != texts[r["doc_id"]]} == {r["doc_id"] for r in rows if "[SECRET]" in r["text"]}
        elif name == "encoding":
            assert len(rows) == seen.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
        seen = spark.createDataFrame(rows, out.schema) if rows else out
