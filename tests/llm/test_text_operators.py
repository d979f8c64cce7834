"""Language, tokens, quality, licences, secrets, pages."""

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import bpe, html_main, langid, licenses, quality, secrets
from chunkloom.llm.queries import queries

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton.read(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


HARD = ["", "   ", "It's THE ΣΑΣ \x1c\x1d x́é ½ ² Ⅷ <|endoftext|>a<|startoftext|> <|foo|>", "aaaa aaaaaaa aaaaaaaaaaaaaaaaaa", "日本語 😀😀 don't'll", "\x00\x01​　b", "x" * 3000, "!!'s ''' 'd", "1234 5a6", "'s", "'", "'sx 'rex 'r 've'll", "<|endoftext|><|endoftext|>", "q" * 100 + "1" + "z" * 70, "S K İ i̇"]


@pytest.mark.parametrize("size", [500_000, 300])
def test_bpe_like_the_library(automaton, library, spark, sf, monkeypatch, size):
    """Also with slices so small that long texts are encoded in pieces."""
    monkeypatch.setattr(bpe, "SLICE", size)
    texts = HARD + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    encoder, at = bpe.Encoder(automaton, words=2000), 0
    counts, ids = encoder.encode(texts)
    whole, parts = ([b"".join(x).decode() for x in encoder.emitted(counts, ids, automaton.labels, block)] for block in (1 << 20, 1000))
    assert whole == parts
    for text, n, decoded in zip(texts, counts.tolist(), whole, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == expected
        assert decoded == library.decode(expected, skip_special_tokens=False) == encoder.decode(expected)
        at += n


def test_bpe_paths_of_few_and_many_words_agree(automaton):
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"aeinorstth"), rng.integers(1, 12))) for _ in range(300)]
    counts, ids = automaton.encode_words(pa.array(words, pa.binary()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [automaton.encode_long(w) for w in words]
    long = b"the cat sat on a mat".replace(b" ", b"") * 40
    assert automaton.encode_long(long, block=50) == automaton.encode_long(long)


def test_bpe_small_automaton_is_merging_by_rank():
    """All words over three letters, against merging the best-ranked pair until none is left."""
    import itertools

    merges = [("a", "a"), ("a", "b</w>"), ("aa", "a"), ("b", "a"), ("ba", "aa"), ("a", "c"), ("aa", "ac</w>"), ("a", "c</w>")]
    merges = [m for m in merges if m != ("aa", "ac</w>")]
    symbols = bpe.byte_symbols()
    vocab = {t: i for i, t in enumerate([*symbols, *(s + "</w>" for s in symbols), *dict.fromkeys(a + b for a, b in merges)])}
    auto = bpe.Automaton(vocab, merges, {})
    rank = {m: i for i, m in enumerate(merges)}
    for n in range(1, 8):
        for word in itertools.product("abc", repeat=n):
            parts = [*word[:-1], word[-1] + "</w>"]
            while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
                best = min(pairs)[0]
                i = 0
                while i < len(parts) - 1:
                    if rank.get((parts[i], parts[i + 1])) == best:
                        parts[i : i + 2] = [parts[i] + parts[i + 1]]
                    i += 1
            assert [auto.labels[t].as_py().decode().strip() for t in auto.encode_long("".join(word).encode())] == parts


def test_bpe_odd_rows(odd, empty):
    rows = bpe.encode_texts(odd, TOKENIZER, keep=("ids", "decoded")).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd.count()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, nothing, nothing) for r in rows if r["doc_id"] in (1, 2, 3))
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_texts(empty, TOKENIZER).count() == 0


def test_language_held_out_accuracy(spark, sf):
    out = queries()["op1_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).head()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_kneser_ney_sums_to_one():
    m = langid.Models({"a": ["the cat sat on the mat", "a cat"], "b": ["der hund und die katze"]})
    cols, _, _ = langid._grams(["the catx"])
    known = sorted({langid._PAD, langid._SPACE, *map(ord, "thecasonmdrukiz")})
    for lang in range(2):
        for position in (3, 6):
            grams = np.stack([np.concatenate([cols[1:, position], [s]]) for s in known]).T.astype(np.uint32)
            p = np.exp(m._log_probs(grams)[:, lang])
            assert 0.8 < p.sum() <= 1.0 + 1e-9  # the rest is for symbols never seen


def test_language_odd_rows(spark, odd, empty):
    fitted = langid.train(odd)
    rows = langid.identify(odd, fitted).collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == langid.UND and r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] in ("en", "de") for r in rows if r["doc_id"] not in (1, 2, 3))
    assert langid.train(empty) is None and langid.identify(empty, fitted).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {langid.UND}


def test_language_slices_agree(monkeypatch):
    i = langid.Identifier({"a": ["the cat sat on the mat"] * 6, "b": ["der hund und die katze"] * 6})
    texts = ["the mat", "", "die katze " * 50, "12", "mat"]
    whole = i.predict(texts)
    parts = [i.predict([t]).iloc[0].to_dict() for t in texts]
    assert whole["lang_pred"].tolist() == [p["lang_pred"] for p in parts]
    assert np.allclose(whole["entropy"], [p["entropy"] for p in parts])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = queries()["op8_quality"](spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    right = (out["predicted"] == out["quality"]).mean()
    assert right > 0.85 and out.loc[out["quality"] == 1, "predicted"].mean() > 0.9
    assert docs.count() == queries()["op8_quality"](spark, sf).count()


def test_quality_gradients():
    rng = np.random.default_rng(1)
    net = quality.Network()
    data, n = quality.blocks_of([rng.bytes(300), rng.bytes(20), b"", rng.bytes(700)])
    y = np.array([1, 0, 1, 0], np.float32)
    g = net.gradients(data, n, y)

    def loss():
        p = net.forward(data, n)[0].astype(float)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k in ("out", "hidden", "filters"):
        flat, gf = net.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in np.argsort(-np.abs(gf))[:5]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(gf[i], rel=0.15, abs=2e-4)


def test_quality_reads_every_byte_and_batches_agree():
    net = quality.Network(seed=2)
    long = b"a" * 5000
    a, b = net.scores([long + b"#$%&" * 40, long])
    assert a != b
    texts = [b"x" * k for k in (0, 1, 127, 128, 129, 256, 1000)]
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-6)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (1, None, 0), (77, 1, 1), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(odd, labels, steps=3)
    rows = quality.score(odd, net).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.accepted(odd.withColumn("score", F.lit("theirs")), net, threshold=0.0)
    assert kept.columns == [*odd.columns, "score"] and kept.count() == odd.count()
    assert quality.train(empty, labels.limit(0)) is None and quality.score(empty, None).count() == 0
    assert quality.train(odd, labels.filter("false")) is None


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def licences_plainly(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in places}))


def test_licences_longer_templates_like_brute_force():
    """Openings with some words lost, in corpora in which now these, now those words are rare."""
    rng = np.random.default_rng(3)
    for text, label, keys in licenses.TEMPLATES:
        seq = text.split()
        docs = [[w if rng.random() < 0.8 else "lost" for w in seq] for _ in range(60)] + [keys[0].split()] * 30 + [[w] for w in seq for _ in range(int(rng.integers(0, 40)))]
        for doc in docs[:60]:
            at = text.find(keys[0])
            if at >= 0:
                at = text[:at].count(" ")
                doc[at : at + len(keys[0].split())] = keys[0].split()
        coded = [[w.encode() for w in d] for d in docs]
        df = {w.encode(): sum(w.encode() in d for d in coded) for w in seq}
        index = licenses.Index(df, len(docs), (), ((text, label, keys),))
        weights = index.entries[0][6]
        for doc, words in zip(docs[:60], coded, strict=False):
            share = sum(x for w, v, x in zip(doc, seq, weights, strict=True) if w == v) / sum(weights)
            assert (label in index.scan(words)[1]) == (share >= licenses.LEAST and any(k in " ".join(doc) for k in keys))


CASES = [None, "", "Under the MIT License. under-the-mit\tlicense", "ÜNDER under the mit license", "cc by nc cc by nc", "Apache License, Version 2.0", "apache license version 22", "under the mit licenseé", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"]


def test_licences(spark, sf, docs_of, empty):
    docs = docs_of([(i, t, None, None, None) for i, t in enumerate(CASES)]).unionByName(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {r["doc_id"]: r for r in licenses.scan(docs, licenses.build(docs)).collect()}
    for i, r in rows.items():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licences_plainly(text[i])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert rows[8]["labels"] == "gpl-3" and rows[9]["labels"] == ""
    assert licenses.scan(empty, licenses.build(empty)).count() == 0


ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets_plainly(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [
    None, "", "token=abc", "secret=token:abcdefgh", "API_KEY: 'x1y2z3w4' apikey=abcdefg", "é AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 20, "f" * 24 + "g" + "0" * 23, "passWord = \"hunter22\"" * 3,
    "tokentoken==abcdef secret='", "a secret: " + "0123456789abcdef" * 3, " ".join(f"token=value{i:05d}" for i in range(700)), "😀 token=abcdef 😀 ghp_" + "a1B2" * 9,
]


def test_secrets(spark, docs_of, empty):
    docs = docs_of([(i, t, None, None, None) for i, t in enumerate(SECRETS)]).withColumn("secrets", F.lit("theirs"))
    rows = {r["doc_id"]: r["found"] for r in secrets.scan(docs, out_col="found").collect()}
    for i, t in enumerate(SECRETS):
        assert [(s["start"], s["kind"], s["end"]) for s in rows[i] if s["kind"] < 3] == secrets_plainly(t)
    assert [s["kind"] for s in rows[11]] == [0, 3]
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[2]["text"] == "token=abc" and clean[2]["secrets"] == "theirs" and clean[0]["text"] is None
    assert clean[9]["text"] == "a secret: [SECRET]" and "hunter22" not in clean[7]["text"] and clean[7]["text"].count("[SECRET]") == 3
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_secrets_that_many_owners_hold_are_examples(docs_of):
    docs = docs_of([(i, "password = changeme123", None, f"s{i % 6}", None) for i in range(12)] + [(99, "password = Xy77zz-only", None, "s1", None)])
    rows = {r["doc_id"]: r["secrets"][0] for r in secrets.scan(docs).collect()}
    assert (rows[0]["n_owners"], rows[0]["n_repos"], rows[0]["live"]) == (6, 12, False) and rows[99]["live"]
    assert {r["text"] for r in secrets.redact(docs).collect()} == {"password = changeme123", "password = [SECRET]"}


PAGE = """<html><head><title>T</title><script>var a="</p><article>x</article>"</script></head><body class="nav-open"><header><h1>Site</h1></header>
<nav><a href=x>Menu</a></nav><div id=main class="content-{n}"><h1>Title &amp; more {n}</h1><div class="cookie-notice">We use cookies</div>
<p>First paragraph with <a href=y>a link</a> in<br>it {n}.<p>Second &nbsp; paragraph.<ul><li>one<li>two</ul><form><input><p>submit</form></div>
<aside><p>side text of some length side text of some length</p></aside><div class="comments"><p>A comment of some length, too</p></div><footer>foot</footer></body>"""


def test_pages(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.replace("{n}", str(n))) for n in range(5)]
    rows += [(10, None, "<p>no host</p>"), (11, "http://h.example/x", None), (12, "http://h.example/y", ""), (13, "odd", "plain &lt;text&gt; 1 < 2"), (14, "http://H.example:80/z", "<p>another template</p>"), (None, "http://h.example/0", "<b>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_main.main_text(pages).collect()}
    for n in range(5):
        assert out[n]["text"] == f"Title & more {n}\nFirst paragraph with a link in it {n}.\nSecond paragraph.\none\ntwo"
        assert out[n]["path"] == "html>body.nav-open>div.content-#"
    assert out[10]["text"] == "no host" and out[11]["text"] == out[12]["text"] == "" and out[13]["text"] == "plain <text> 1 < 2"
    assert out[14]["text"] == "another template" and out[None]["text"] == "x"
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark, sf):
    import html

    rows = queries()["op5_html"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("markup", ["<" * 50, "<div" * 5, "</p></div>", "<p><p><p>a", "<script>x", "<!-- a", "<div>" * 3000 + "deep" + "</div>" * 3000, "<a<b>c", "&#0;&#x110000;&bogus;"])
def test_broken_markup(markup):
    text, _ = html_main.extract(markup, None)
    assert isinstance(text, str) and ("deep" in text) == ("deep" in markup)


def page_of(inner, n=0):
    return f"<html><body><nav><a href=x>Menu</a></nav>{inner}<footer>foot</footer></body></html>".replace("{n}", str(n))


LONG = "A paragraph of the article that is long enough to outweigh all that stands around it. " * 8
WHOLE_CONTAINERS = [
    (f"<article><h1>Headline</h1><p class=lead>The lead.</p><div class=body><p>{LONG}</p></div><section><p>A sibling section.</p></section></article>", ["Headline", "The lead.", LONG.strip(), "A sibling section."]),
    (f"<main><h1>Headline</h1><article><div class=text><p>{LONG}</p></div></article></main>", ["Headline", LONG.strip()]),
    (f"<div class=page><div class=head><h1><a href=x>Headline</a></h1></div><div class=story><p>{LONG}</p></div></div>", ["Headline", LONG.strip()]),
    (f"<div class=page><div class=story><p>{LONG}</p></div><div class=more><a href=x>One link</a> <a href=y>Another link</a></div></div>", [LONG.strip()]),
]


@pytest.mark.parametrize("inner, expected", WHOLE_CONTAINERS)
def test_pages_keep_headline_lead_and_siblings(inner, expected):
    assert html_main.extract(page_of(inner), None)[0].split("\n") == expected


def test_a_hosts_path_loses_no_text_of_a_page(spark):
    inner = f"<div class=a><article><h1>Headline</h1><div class=body><p>{LONG}</p></div></article></div>"
    odd = f"<div class=a><article><p>Short.</p></article></div><div class=b><p>{LONG}</p></div>"
    rows = [(n, f"http://h.example/{n}", page_of(inner)) for n in range(3)] + [(9, "http://h.example/9", page_of(odd))]
    out = {r["page_id"]: r["text"] for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {**dict.fromkeys(range(3), f"Headline\n{LONG.strip()}"), 9: f"Short.\n{LONG.strip()}"}


ARTICLE = f"<article><h1>Headline</h1><p>{LONG}</p></article>"
NAMED = [
    *((f"<div class='{c}'>{a}<div class=sidebar><p>aside text</p></div></div>", ["Headline", LONG.strip()]) for c in ("content-sidebar-wrap", "page has-sidebar", "site nav-closed", "page sidebar", "sidebar") for a in (ARTICLE, ARTICLE.replace("article>", "main>"))),
    *((f"<div class='{c}'><h1>Headline</h1><p>{LONG}</p><div class=sidebar><p>aside text</p></div></div><p>Other.</p>", ["Headline", LONG.strip(), "Other."]) for c in ("content-sidebar-wrap", "page has-sidebar", "site nav-closed")),
    (f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><p id=comment>It is known.</p><section id='sharing-and-share-prices'><p>Shares rose.</p></section></article>", [LONG.strip(), "Related work", "It is known.", "Shares rose."]),
    (f"<div class=widget><p>{LONG}</p></div>", [LONG.strip()]),
    (f"<article><p>Short.</p><div class='share-buttons'>Share</div></article><div id=comments class=comment-list><p>{LONG}</p></div><div class='related-posts'><article><p>Card.</p></article></div>", ["Short."]),
    (f"<div class=story><p>Short <span class=ad>ad</span>text.</p></div><div class=left-sidebar><p>{LONG}</p></div><div class=cookie-notice><p>{LONG}</p></div>", ["Short text."]),
]


@pytest.mark.parametrize("inner, expected", NAMED)
def test_names_put_furniture_outside_but_no_article(inner, expected):
    assert html_main.extract(page_of(inner), None)[0].split("\n") == expected


@pytest.mark.parametrize("markup", ["<a " * 350_000, '<a =">" ' * 130_000, "<a ='\" " * 130_000, "<b><div></div>" * 70_000, "<p>x" * 200_000, "<script " * 100_000, "<a x=" + "='" * 400_000])
def test_broken_pages_cost_their_length(markup):
    began = time.time()
    html_main.extract(markup, None)
    assert time.time() - began < 20


PHRASES = [
    ("<p>We have <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here.</p>", "We have x=2 here."),
    ("<p>An <svg><title>t</title><path d='x'/></svg>icon, a <script>s</script>script, a <select><option>1<option>2</select>choice.</p>", "An icon, a script, a choice."),
    ("<p title='a > b' data-class='sidebar'>A sign in a value.</p>", "A sign in a value."),
]


@pytest.mark.parametrize("inner, expected", PHRASES)
def test_what_stands_within_a_paragraph_does_not_end_it(inner, expected):
    assert html_main.extract(page_of(f"<article><p>{LONG}</p>{inner}</article>"), None)[0].split("\n") == [LONG.strip(), expected]


NOTICES = [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or later.", "gpl-3"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or later.", "gpl-2"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl-3"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("We talked about the GNU General Public License and its version 3 all day.", ""),
]


def test_usual_notices(docs_of):
    docs = docs_of([(n, f"A file. {text} More of it.") for n, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs, licenses.build(docs)).collect()}
    assert got == {n: label for n, (_, label) in enumerate(NOTICES)}
