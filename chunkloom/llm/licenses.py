"""License scans with a positional rare-token index.

A template is a sequence of words. The inverse document frequency of every template word is counted over the corpus; a
file is looked up by each template's rarest words only, so many that the rest of the template weighs too little to be
found without them, and only a file that holds one is searched further. There each
posting of a rare word, less its place in the template, proposes a start; the postings of the template's other words are
intersected with the starts by relative position, and weighted by frequency. A phrase template needs every word; a longer
template needs a share of its weight and, near the start, one of its mandatory key phrases word for word.

Defined results: null text is empty text (no words, no labels, score 0); overlapping places all count; repeated rows
each get their row; an empty table gives an empty result; files of any length are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import in_small_batches, table, tidy

#: Phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Added by the method: (template, label, mandatory key phrases). Openings of public licences and of usual notices.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3", ("gnu general public license version 3", "gnu gpl version 3")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gpl-2", ("version 2 of the license", "gnu general public license version 2")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gpl-3", ("version 3 of the license", "gnu general public license version 3")),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl-3", ("gnu affero general public license",)),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", ("gnu lesser general public license",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ("redistribution and use in source and binary forms",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("mozilla public license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ("permission is hereby granted free of charge",)),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", ("creative commons attribution 4 0 international", "creative commons attribution license")),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa", ("creative commons attribution sharealike",)),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", ("creative commons attribution noncommercial",)),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0", ("waived all copyright and related or neighboring rights",)),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2", ("apache license version 2 0",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", ("with or without fee is hereby granted",)),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", ("eclipse public license",)),
    ("distributed under the boost software license version 1 0", "bsl", ("boost software license version 1 0",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("unencumbered software released into the public domain",)),
)
#: Least share of a longer template's weight, rare words that look it up at least, and words that its place may be off by.
LEAST, LOOKUPS, SLACK = 0.7, 2, 3

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


def _seq(phrase: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in phrase.split())


class Index:
    """Templates with word weights and rarest words. df: documents that hold each template word, of n documents."""

    def __init__(self, df: dict[bytes, int], n: int, phrases=PHRASES, templates=TEMPLATES):
        idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1e-6
        self.entries = []
        for text, label, keys in (*((p, lab, (p,)) for p, lab in phrases), *templates):
            words = _seq(text)
            exact = keys == (text,)
            rare = sorted({w for w in words if df.get(w) or not exact}, key=lambda w: (-idf(w), w))
            rare = rare[: 1 if exact else self._lookups(rare, words, idf)]
            slots = sorted(range(len(words)), key=lambda i: (-idf(words[i]), i))
            if exact and any(not df.get(w) for w in words):
                rare = []  # a word that no document holds: the phrase stands nowhere
            self.entries.append((words, label, [_seq(k) for k in keys], exact, rare, slots, [idf(w) for w in words]))
        self.lookup = frozenset(w for e in self.entries for w in e[4])
        self.vocabulary = frozenset(w for e in self.entries for s in (e[0], *e[2]) for w in s)

    @staticmethod
    def _lookups(rare: list[bytes], words: tuple[bytes, ...], idf) -> int:
        """How many of the rare words look a template up: LOOKUPS at least, and so many that all others together weigh
        less than LEAST (by a margin for rounding)."""
        total = rest = sum(map(idf, words))
        for n, w in enumerate(rare):
            if n >= LOOKUPS and rest < (LEAST - 1e-6) * total:
                return n
            rest -= idf(w) * words.count(w)
        return len(rare)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(places of phrases: start, label; best share of weight for each label found)"""
        if self.lookup.isdisjoint(words):
            return [], {}
        postings: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                postings.setdefault(w, []).append(i)
        held = {w: set(p) for w, p in postings.items()}
        none: set[int] = set()
        places, found = [], {}
        for seq, label, keys, exact, rare, slots, weights in self.entries:
            starts = {p - i for r in rare for p in postings.get(r, ()) for i in range(len(seq)) if seq[i] == r}
            if exact:
                for i in slots:
                    at = held.get(seq[i], none)
                    starts = {s for s in starts if s + i in at}
                    if not starts:
                        break
                places += [(s, label) for s in starts]
                if starts:
                    found[label] = 1.0
                continue
            total = sum(weights)
            for s in starts:
                share = sum(weights[i] for i in slots if s + i in held.get(seq[i], none)) / total
                if share >= LEAST and share > found.get(label, 0.0) and self._verified(words, s, len(seq), keys):
                    found[label] = share
        return sorted(places), found

    @staticmethod
    def _verified(words: list[bytes], start: int, length: int, keys: list[tuple[bytes, ...]]) -> bool:
        near = words[max(0, start - SLACK) : start + length + SLACK]
        return any(tuple(near[i : i + len(k)]) == k for k in keys for i in range(len(near) - len(k) + 1))


def word_frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each template word, over all documents, and their number. Counted in each batch, then summed;
    the result has a row per template word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = dict.fromkeys(vocabulary, 0), 0
        for pdf in batches:
            n += len(pdf)
            for text in pdf[text_col].tolist():
                for w in vocabulary.intersection(words_of(text)):
                    df[w] += 1
        yield pd.DataFrame([("", n), *((w.decode(), k) for w, k in df.items())], columns=["word", "n"])

    rows = in_small_batches(docs.select(text_col)).mapInPandas(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def build(docs: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> Index:
    words = Index({}, 0, phrases, templates).vocabulary
    return Index(*word_frequencies(docs, text_col, words), phrases, templates)


def scan(docs: DataFrame, index: Index, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx = shared.value
        for pdf in batches:
            rows = []
            for text in pdf[text_col].tolist():
                words = words_of(text)
                places, found = idx.scan(words)
                at = [s for s, _ in places]
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in places})), ",".join(sorted(found)), max(found.values(), default=0.0)))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]).astype({"first_word": "Int64", "last_word": "Int64"})
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), out], axis=1)

    return in_small_batches(docs.select(*dict.fromkeys((*keep, text_col)))).mapInPandas(tidy(run), schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, build(docs))
