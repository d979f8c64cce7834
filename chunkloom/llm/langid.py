"""Language identification by interpolated Kneser-Ney character models.

One model per language, over lower-cased letters and single spaces. The models share sorted arrays of n-gram hashes, one
for each order, with a column per language: discounted probabilities beside the n-grams, back-off masses beside the
contexts. A text's language is the one with the lowest cross-entropy per symbol; a softmax whose steepness is fitted on
set-aside texts turns entropies into a score, and a text whose entropy lies beyond what set-aside texts of that language
show is marked as rejected.

Fitted on a bounded sample: different whole texts, drawn by a hash, of at most TRAIN_CHARS characters for each language and
TRAIN_TOTAL for all, of the TRAIN_LANGS languages that have most text. Equal texts of a language count once.

Defined results: null text, and text without a letter, is `und` with score 0 and rejected; empty tables give empty results;
if there is nothing to learn from, every text is `und`; a null id is in no training fold; ties go to the first language
in code point order; very long texts are scored whole, in pieces that carry the symbols before them; repeated rows each get
their row; result columns take the place of input columns of the same name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm._common import bucket_of, in_small_batches, slices, table, tidy

ORDER = 5
TRAIN_CHARS, TRAIN_TOTAL, TRAIN_LANGS = 800_000, 24_000_000, 500
#: Every fifth sampled text fits the calibration, not the counts.
CALIBRATE_EVERY = 5
#: Characters that are scored at a time; a longer text is scored in pieces of as many.
SLICE = 400_000
STEP = np.uint64(0x9E3779B97F4A7C15)
UND = "und"
_RESULT = {"lang_pred": "string", "score": "double", "entropy": "double", "rejected": "boolean"}
_SPACE, _PAD = 32, 1


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """For each code point its symbol: a letter's (or combining mark's) lower case, or a space."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (k := unicodedata.category(ch := chr(c)))[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    s = symbols()
    out = np.zeros(len(s), bool)
    out[[c for c in np.flatnonzero(s != _SPACE).tolist() if unicodedata.category(chr(c))[0] == "L"]] = True
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns of the last ORDER symbols at each position, positions of each text, whether each has a letter)"""
    lengths = np.array([len(t) for t in texts]) + 1
    points = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[points]
    starts = np.cumsum(lengths) - lengths
    letters = np.concatenate(([0], np.cumsum(is_letter()[points])))
    has = letters[starts + lengths] > letters[starts]
    space = s == _SPACE
    keep = np.ones(len(s), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts] = False  # the separators
    upto = np.concatenate(([0], np.cumsum(keep)))
    n = upto[starts + lengths] - upto[starts]
    pad = ORDER - 1
    out = np.full(int(n.sum()) + pad * len(texts), _PAD, np.uint32)
    at = np.arange(int(n.sum())) + pad * (np.repeat(np.arange(len(texts)), n) + 1)
    out[at] = s[keep]
    return np.stack([out[at - k] for k in range(pad, -1, -1)]), n, has


def _hash(cols: np.ndarray) -> np.ndarray:
    h = np.full(cols.shape[1], len(cols), np.uint64)
    with np.errstate(over="ignore"):
        for c in cols:
            h = (h + c) * STEP
            h ^= h >> np.uint64(29)
    return h


class Models:
    """Kneser-Ney models of several languages in sorted hash arrays."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        per = [self._counts(texts[lang]) for lang in self.langs]
        n_symbols = 2 + len(np.unique(np.concatenate([p[0][0][:, 0] for p in per]))) if per else 2
        self.floor = 1.0 / n_symbols
        width = len(self.langs)
        self.keys, self.probs, self.contexts, self.masses = [], [], [], []
        for k in range(ORDER):
            entries, contexts = [], []
            for lang in range(width):
                grams, counts = per[lang][k]
                few = [np.count_nonzero(counts == j) for j in (1, 2)]
                discount = few[0] / max(1, few[0] + 2 * few[1]) if few[0] and few[1] else 0.5
                context, inverse = np.unique(_hash(grams[:, :-1].T) if k else np.zeros(len(grams), np.uint64), return_inverse=True)
                total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
                entries.append((_hash(grams.T), (counts - discount) / total[inverse]))
                contexts.append((context, discount * kinds / total))
            for of, keys, values, missing in ((entries, self.keys, self.probs, 0.0), (contexts, self.contexts, self.masses, 1.0)):
                every = np.unique(np.concatenate([h for h, _ in of]))
                held = np.full((len(every), width), missing)
                for lang, (h, v) in enumerate(of):
                    held[np.searchsorted(every, h), lang] = v
                keys.append(every)
                values.append(held)
        seen = np.unique(np.concatenate([p[ORDER - 1][0] for p in per]), axis=0).T
        order = np.argsort(h := _hash(seen))
        self.top, self.top_logs = h[order], self._log_probs(seen)[order].astype(np.float32)

    @staticmethod
    def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order: distinct n-grams, with counts at the top and numbers of distinct left extensions below."""
        cols, _, _ = _grams(texts)
        out = []
        grams, counts = np.unique(cols.T, axis=0, return_counts=True)
        out.append((grams, counts))
        for _ in range(ORDER - 1):
            grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
            out.append((grams, counts))
        return out[::-1]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], values[at], missing)

    def _log_probs(self, cols: np.ndarray) -> np.ndarray:
        """Natural logarithms of each n-gram's last symbol's probability, a column per language."""
        p = np.full((cols.shape[1], len(self.langs)), self.floor)
        for k in range(ORDER):
            part = cols[ORDER - 1 - k :]
            context = _hash(part[:-1]) if k else np.zeros(cols.shape[1], np.uint64)
            p = self._find(self.keys[k], self.probs[k], _hash(part), 0.0) + self._find(self.contexts[k], self.masses[k], context, 1.0) * p
        return np.log(p)

    def _logs(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which distinct n-gram each column is, logarithms of those, a column per language)"""
        codes, unique = pd.factorize(_hash(cols))
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        at = np.minimum(np.searchsorted(self.top, unique), len(self.top) - 1)
        logs = self.top_logs[at]
        new = np.flatnonzero(self.top[at] != unique)
        if len(new):
            logs[new] = self._log_probs(cols[:, first[new]])
        return codes, logs

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats a symbol for each text and language, symbols, whether each text has a letter)"""
        out, n, has = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for a, b in slices(texts, SLICE):
            if len(texts[a]) > SLICE:
                out[a], n[a], has[a] = self._folded(texts[a])
                continue
            cols, n[a:b], has[a:b] = _grams(texts[a:b])
            codes, logs = self._logs(cols)
            ends = np.cumsum(n[a:b])
            for lang in range(len(self.langs)):
                sums = np.concatenate(([0.0], np.cumsum(logs[codes, lang], dtype=np.float64)))
                out[a:b, lang] = -(sums[ends] - sums[ends - n[a:b]]) / np.maximum(n[a:b], 1)
        return out, n, has

    def _folded(self, text: str) -> tuple[np.ndarray, int, bool]:
        """The entropies of one long text, piece by piece; the last symbols of a piece go before the next."""
        sums, n, has, before = np.zeros(len(self.langs)), 0, False, np.full(ORDER - 1, _PAD, np.uint32)
        after_space = True
        for at in range(0, len(text), SLICE):
            points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            s = symbols()[points]
            has = has or bool(is_letter()[points].any())
            space = s == _SPACE
            keep = ~(space & np.concatenate(([after_space], space[:-1])))
            after_space = bool(space[-1])
            s = np.concatenate((before, s[keep]))
            if len(s) >= ORDER:
                codes, logs = self._logs(np.stack([s[k : len(s) - ORDER + 1 + k] for k in range(ORDER)]))
                sums += np.bincount(codes, minlength=len(logs)) @ logs.astype(np.float64)
                n += len(codes)
            before = s[-(ORDER - 1) :]
        return -sums / max(n, 1), n, has


class Identifier:
    """Models with calibration: `steep` of the softmax, and each language's usual entropy and its spread."""

    def __init__(self, texts: dict[str, list[str]]):
        fit = {k: [t for i, t in enumerate(v) if i % CALIBRATE_EVERY or len(v) < CALIBRATE_EVERY] for k, v in texts.items()}
        self.models = Models(fit)
        langs = self.models.langs
        rest = [(t, langs.index(k)) for k, v in texts.items() for t in (v[::CALIBRATE_EVERY] if len(v) >= CALIBRATE_EVERY else v)]
        h, n, _ = self.models.entropies([t for t, _ in rest])
        truth = np.array([k for _, k in rest])
        steps = np.geomspace(1, 100, 40)
        self.steep = float(steps[np.argmin([-np.log(np.maximum(self._soft(h, s)[np.arange(len(truth)), truth], 1e-9)).mean() for s in steps])])
        own = h[np.arange(len(truth)), truth]
        self.usual = np.array([own[truth == k].mean() for k in range(len(langs))])
        self.spread = np.array([np.std((own - self.usual[truth])[truth == k] * np.sqrt(np.minimum(n[truth == k], 400))) + 0.1 for k in range(len(langs))])

    @staticmethod
    def _soft(h: np.ndarray, steep: float) -> np.ndarray:
        e = np.exp(-steep * (h - h.min(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> pd.DataFrame:
        h, n, has = self.models.entropies(texts)
        best = h.argmin(axis=1)
        rows = np.arange(len(texts))
        entropy = h[rows, best]
        limit = self.usual[best] + 6 * self.spread[best] / np.sqrt(np.clip(n, 1, 400))
        lang = np.array([*self.models.langs, UND], object)[np.where(has, best, len(self.models.langs))]
        return pd.DataFrame({"lang_pred": lang, "score": np.where(has, self._soft(h, self.steep)[rows, best], 0.0), "entropy": np.where(has, entropy, 0.0), "rejected": ~has | (entropy > limit)})


def training_texts(docs: DataFrame, lang_col: str, text_col: str, chars: int = TRAIN_CHARS, total: int = TRAIN_TOTAL, seed: int = 11) -> dict[str, list[str]]:
    """Different whole texts of each language, together at most `chars` characters of one and `total` of all: drawn by a
    hash of the text against a rate that comes from the language's size, equal ones as one (summed where they are read), and
    then cut to the bound in the order of the hash. The same in every run, and no group is gathered."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("size")).orderBy(F.desc("size"), "lang").limit(TRAIN_LANGS)
    sizes = {r[0]: r[1] for r in sizes.collect()}
    if not sizes:
        return {}
    chars = min(chars, total // len(sizes))
    rate = F.element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, chars / max(1, v))))), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    drawn = known.filter(F.col("lang").isin(list(sizes)) & (F.length("text") <= chars) & (draw < rate * (1 << 30))).distinct()
    upto = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy(draw, "text").rowsBetween(Window.unboundedPreceding, 0))
    out: dict[str, list[str]] = {}
    for r in sorted(drawn.withColumn("upto", upto).filter(F.col("upto") <= chars).select("lang", "text").collect()):
        out.setdefault(r[0], []).append(r[1])
    return {k: v for k, v in out.items() if any(map(str.isalpha, "".join(v)))}


def identify(docs: DataFrame, identifier: Identifier | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, entropy, rejected for every row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(identifier)
    keep = tuple(k for k in keep if k not in _RESULT)
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), *(f"{k} {v}" for k, v in _RESULT.items())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text_col].tolist()]
            for a, b in slices(texts, SLICE):
                if fitted is None:
                    out = pd.DataFrame({"lang_pred": [UND] * (b - a), "score": 0.0, "entropy": 0.0, "rejected": True})
                else:
                    out = fitted.predict(texts[a:b])
                yield pd.concat([pdf[list(keep)].iloc[a:b].reset_index(drop=True), out], axis=1)

    return in_small_batches(docs.select(*dict.fromkeys((*keep, text_col)))).mapInPandas(tidy(run), schema)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", chars: int = TRAIN_CHARS) -> Identifier | None:
    texts = training_texts(docs, lang_col, text_col, chars)
    return Identifier(texts) if texts else None


def _held_out(id_col: str) -> Column:
    return F.coalesce(bucket_of(id_col, 5) == 0, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = train(docs.filter(bucket_of("doc_id", 5) != 0).select("lang", "text"))
    out = identify(docs.select("doc_id", "text"), fitted)
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy", "rejected")
