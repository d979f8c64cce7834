"""N-gram Jaccard self-join by MinHash banding.

Texts become sets of hashed five-word shingles (lower-cased words between white space); texts with equal sets are one
class, so exact copies are compared once. Signatures are cut into bands whose rows and number come from the threshold and
a target recall, and rows shuffle on band hashes:

* a bucket of at most SMALL classes gives its pairs (at most SMALL / 2 for each of its members); of these, pairs whose
  whole signatures leave no chance of the threshold (six standard deviations) go;
* a larger bucket gives only a star from each member to its smallest one.

The candidates' connected components are the unit of verification: the shingle sets of a component meet in blocks of
BLOCK classes, every pair of blocks in a task of its own, and every pair of classes in them is compared on full sets.
No pair is ever written: a block gives each class its number of links and its root in a spanning forest of the links.

Defined results: null text, empty text and white space have no shingle, link with nothing and are classes of their own;
a text of one to four words is one shingle; repeated rows are copies like others (each row gets a row); copies count as
links; a text that only rows without an id have links like others, and those rows take the smallest id of their class;
an empty table gives an empty result; columns besides id and text are ignored, whatever their names. A text longer than
SLICE characters is read in pieces that end with white space (a word of more than SLICE characters is read in pieces too,
each lower-cased by itself).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import cut, free_names, in_small_batches, slices, table, tidy
from chunkloom.llm.graphs import connected_components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 192
SMALL, BLOCK, PACK = 32, 256, 2000
#: Up to this many candidate classes (16 MB of ids), they are broadcast to the scan that fetches their texts; beyond, they are shuffled.
BROADCAST_ROWS = 500_000
#: Characters of text that are hashed at a time.
SLICE = 500_000
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = 0xFFFFFFFFFFFFFFFF


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which bands enough to find a pair at the threshold with this recall fit in `most` hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


_BLANK = re.compile(r"[\x20\x09-\x0D]")


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, bounds of each text's words); words are hashed together as differences of prefix sums."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b" " + b"".join(raw), np.uint8)
    space = _IS_SPACE[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    inverse = pow(_P, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(len(data), _P, np.uint64), np.full(len(data), inverse, np.uint64)
        up[0] = down[0] = 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.cumprod(up) * (data.astype(np.uint64) + np.uint64(1)))))
        word = _mix((sums[ends] - sums[starts]) * np.cumprod(down)[starts])
    return word, np.searchsorted(starts, np.cumsum([1, *map(len, raw)]))


def _gram_hashes(word: np.ndarray, words: int) -> np.ndarray:
    gram = np.zeros(max(0, len(word) - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            gram = gram * np.uint64(_Q) + word[k : k + len(gram)]
    return _mix(gram)


def _few_words(word: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    h = len(word)
    for w in word.tolist():
        h = (h * _Q + w) & _MASK
    return _mix(np.array([h], np.uint64)) if len(word) else np.zeros(0, np.uint64)


def _long_set(text: str, words: int) -> np.ndarray:
    """The shingles of one long text, piece by piece: the last words of a piece go before the next."""
    out, before, at, held = [], np.zeros(0, np.uint64), 0, 0
    while at < len(text):
        end = at + SLICE
        m = _BLANK.search(text, end, end + SLICE) if end < len(text) else None
        end = m.end() if m else end
        word = np.concatenate((before, _word_hashes([text[at:end]])[0]))
        out.append(np.unique(_gram_hashes(word, words)))
        held += len(out[-1])
        before = word[max(0, len(word) - words + 1) :]
        at = end
        if len(out) > 1 and held > 1 << 21:
            out = [np.unique(np.concatenate(out))]
            held = 0
    grams = np.unique(np.concatenate(out))
    return grams if len(grams) else _few_words(before)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        return [_long_set(texts[0], words)]
    word, bounds = _word_hashes(texts)
    gram = _gram_hashes(word, words)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(gram[a : b - words + 1]) if b - a >= words else _few_words(word[a:b]))
    return out


def set_name(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)

    def signature(self, s: np.ndarray) -> np.ndarray:
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(x), 512):
                np.minimum(low, (x[at : at + 512, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each band, which the band's number is part of."""
        h = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (len(signatures), self.bands))
        s = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            for r in range(self.rows):
                h = _mix(h * np.uint64(_P) + s[:, :, r])
        return h.view(np.int64)

    @staticmethod
    def short(signatures: np.ndarray) -> np.ndarray:
        """A byte of each hash, for estimates."""
        with np.errstate(over="ignore"):
            return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def signed(docs: DataFrame, id_col: str, text_col: str, minhash: MinHash, words: int) -> DataFrame:
    """id, set_id, bands, sig for each row; set_id is null where a text has no shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col].tolist()]
            for a, b in slices(texts, SLICE):
                sets = shingle_sets(texts[a:b], words)
                sigs = np.stack([minhash.signature(s) for s in sets])
                yield pd.DataFrame({"id": pdf[id_col].array[a:b], "set_id": [set_name(s) for s in sets], "bands": list(minhash.keys(sigs)), "sig": [x.tobytes() for x in minhash.short(sigs)]})

    return in_small_batches(docs.select(id_col, text_col)).mapInPandas(tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, set_id binary, bands array<long>, sig binary")


def _likely(threshold: float, hashes: int) -> float:
    """Least share of equal signature bytes that a pair at the threshold can show, six standard deviations down."""
    p = threshold + (1 - threshold) / 256
    return p - 6 * math.sqrt(p * (1 - p) / hashes)


def candidate_edges(reps: DataFrame, minhash: MinHash, threshold: float) -> DataFrame:
    members = reps.select("set_id", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("set_id").alias("center")).filter("c > 1")
    shared = cut(members.join(sizes, "key"))
    stars = shared.filter(F.col("c") > SMALL).select(F.col("center").alias("a"), F.col("set_id").alias("b")).distinct()
    small = shared.filter(F.col("c") <= SMALL)
    pairs = small.select("key", F.col("set_id").alias("a")).join(small.select("key", F.col("set_id").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    sig = reps.select("set_id", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    least, hashes = _likely(threshold, minhash.bands * minhash.rows), minhash.bands * minhash.rows

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, hashes) for c in ("sig_a", "sig_b"))
                pdf = pdf[(x == y).mean(axis=1) >= least]
            yield pdf[["a", "b"]]

    return both.mapInPandas(tidy(likely), "a binary, b binary").unionByName(stars)


def block_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs first x second (as a matrix) have Jaccard >= threshold on full sets."""
    sizes = np.array([len(s) for s in sets])
    codes, values = pd.factorize(np.concatenate(sets))
    of = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(codes, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    live = often[codes]
    col, of = number[codes[live]], of[live]
    order = np.argsort(col, kind="stable")
    col, of = col[order], of[order]
    common = np.zeros((len(first), len(second)), np.float32)
    width = 4096
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(col, (at, at + width))
        m = np.zeros((len(sets), min(width, int(often.sum()) - at)), np.float32)
        m[of[a:b], col[a:b] - at] = 1
        common += m[first] @ m[second].T
    union = sizes[first][:, None] + sizes[second][None, :] - common
    return common / union >= threshold


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row that it reaches."""
    n = len(linked)
    out = np.full(n, -1)
    for i in range(n):
        if out[i] < 0:
            out[i] = i
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (out < 0))
                out[front] = i
    return out


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), g in pdf.groupby(["comp", "lo", "hi"], sort=False):
            g = g.drop_duplicates("v").sort_values("v")
            sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
            n, block, v, rows = g["n"].to_numpy(), g["block"].to_numpy(), g["v"].tolist(), len(g)
            first = np.flatnonzero(block == lo)
            second = first if lo == hi else np.flatnonzero(block == hi)
            if not len(first) or not len(second):
                continue
            linked = np.zeros((rows, rows), bool)
            linked[np.ix_(first, second)] = block_links(sets, first, second, threshold)
            linked |= linked.T
            np.fill_diagonal(linked, False)
            links, root = linked @ n, roots(linked)
            out += [(v[i], int(links[i]), v[root[i]]) for i in np.flatnonzero(links)]
        return pd.DataFrame(out, columns=["v", "links", "root"])

    return run


def _groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The columns of jaccard_groups, with set_id and component (the class as a set_id; both null where a text has no shingle)."""
    minhash = MinHash(*choose_bands(threshold, recall))
    spark = docs.sparkSession
    rows = cut(signed(docs, id_col, text_col, minhash, words))
    reps = cut(rows.filter("set_id is not null").groupBy("set_id").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    comps = connected_components(candidate_edges(reps, minhash, threshold))
    blocks = comps.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    verts = cut(comps.join(blocks, "component").join(reps.select(F.col("set_id").alias("v"), "rep", "n"), "v").select("v", F.col("component").alias("comp"), "blocks", "n", F.col("rep").alias("id")))
    n_verts, n_nameless = verts.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = texts.join(F.broadcast(verts) if n_verts <= BROADCAST_ROWS else verts, "id")

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"].tolist()]
            for a, b in slices(texts, SLICE):
                sets = shingle_sets(texts[a:b], words)
                part = pdf.iloc[a:b].drop(columns=["id", "text"]).assign(shingles=[s.tobytes() for s in sets])
                yield part[[set_name(s) == v for s, v in zip(sets, part["v"], strict=True)]]  # an id may stand with several texts

    sets = in_small_batches(wanted).mapInPandas(tidy(with_sets), "v binary, comp binary, blocks long, n long, shingles binary")
    if n_nameless:  # texts that only rows without an id have are found by their sets

        def all_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = [t if isinstance(t, str) else "" for t in pdf["text"].tolist()]
                for a, b in slices(texts, SLICE):
                    of = [s for s in shingle_sets(texts[a:b], words) if len(s)]
                    yield pd.DataFrame({"v": [set_name(s) for s in of], "shingles": [s.tobytes() for s in of]})

        nameless = verts.filter("id is null").drop("id")
        found = texts.filter("id is null").select("text").mapInPandas(tidy(all_sets), "v binary, shingles binary").dropDuplicates(["v"])
        sets = sets.unionByName(found.join(F.broadcast(nameless) if n_nameless <= BROADCAST_ROWS else nameless, "v").select(*sets.columns))
    if not rows.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["v"])  # an id that stands often gives its set once for each partition, not for each row
    packs = max(1, math.ceil(n_verts / PACK))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("v"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.withColumn("g", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "lo", "hi")))
    found = cut(dealt.select("g", "v", "comp", "n", "shingles", "block", "lo", "hi").groupBy("g").applyInPandas(_verify(threshold), "v binary, links long, root binary"))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    info = reps.select(F.col("set_id").alias("v"), "rep", "n").join(links, "v", "left").join(classes, "v", "left").withColumn("component", F.coalesce("component", "v"))
    info = info.join(info.groupBy("component").agg(F.min("rep").alias("class_id")), "component")
    info = info.select(F.col("v").alias("set_id"), "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    some = rows.filter("set_id is not null").select("id", "set_id").join(info, "set_id").select("id", "class_id", "n_links", "set_id", "component")
    none = rows.filter("set_id is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "set_id", F.col("set_id").alias("component"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "set_id", "component")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: id, class_id (smallest id reachable by links), n_links (other rows linked directly),
    kept (the row with the smallest id; of repeated rows of that id, each)."""
    return _groups(docs, id_col, text_col, words, threshold, recall).drop("set_id", "component")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are near-copies of one with a smaller id; one row of each group stays. Where ids repeat,
    rows are told apart by their sets too: of near-copies with one id a row of the first set stays, with its first text;
    of rows without a shingle, those that repeat both id and text leave one."""
    own_id, own_set, kept_set, least = free_names(docs.columns, "j_id", "j_set", "j_kept", "j_text")
    groups = cut(_groups(docs, id_col, text_col))
    kept = groups.filter("kept")
    if groups.groupBy(id_col).count().filter("count > 1").isEmpty():
        ids = kept.select(F.col(id_col).alias(own_id))
        small = ids.count() <= BROADCAST_ROWS
        return docs.join(F.broadcast(ids) if small else ids, docs[id_col].eqNullSafe(F.col(own_id)), "left_semi")

    @F.pandas_udf("binary")
    def names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = [t if isinstance(t, str) else "" for t in series.tolist()]
            yield pd.Series([set_name(s) for a, b in slices(texts, SLICE) for s in shingle_sets(texts[a:b])], dtype=object)

    named = in_small_batches(docs).withColumn(own_set, names(F.col(text_col)))
    first = kept.filter("set_id is not null").groupBy("component").agg(F.min("set_id").alias("set_id"), F.first(id_col).alias("id"))
    rows = cut(first.select("id", "set_id").unionByName(kept.filter("set_id is null").select(F.col(id_col).alias("id"), "set_id").distinct()).toDF(own_id, kept_set))
    small = rows.count() <= BROADCAST_ROWS
    out = cut(named.join(F.broadcast(rows) if small else rows, named[id_col].eqNullSafe(F.col(own_id)) & F.col(own_set).eqNullSafe(F.col(kept_set)), "left_semi"))
    texts = out.filter(F.col(own_set).isNotNull()).groupBy(F.col(own_set).alias(kept_set)).agg(F.min(text_col).alias(least))
    out = out.join(texts, F.col(own_set) == F.col(kept_set), "left").filter(F.col(own_set).isNull() | (F.col(text_col) == F.col(least)))
    return out.select(*docs.columns).dropDuplicates([id_col, text_col])


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
