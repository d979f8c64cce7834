"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into blocks of BLOCK bytes; two neighbouring blocks form a chunk, so chunks overlap by
half and cover the whole document. Learned filters of WIDTH bytes (a weight for each byte value at each place) run over
the chunks, STRIDE bytes at a time; each chunk keeps every filter's largest response. The chunks' mean and largest
responses go through one hidden layer to one probability.

Fitted on a bounded sample: at most TRAIN_ROWS labelled rows, drawn by a hash of the id, of at most TRAIN_BYTES bytes
together: a row that would go beyond is left out of the fit (never out of scoring), so a long document is learned from
wherever it fits. Scoring reads every byte of every text, a long one in pieces.

Defined results: null and empty text are one block of zero bytes and get that block's score; a null id is in no fold
(held_out false, and not learned from); labels with a null quality are not learned from; equal labels of an id, and equal
texts of a labelled id, are learned from once; with nothing to learn from every score is 0.5; empty tables give empty
results; a result column takes the place of an input column of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import bucket_of, in_small_batches, slices, table, tidy

BLOCK, WIDTH, STRIDE, FILTERS, HIDDEN = 128, 8, 4, 16, 16
TRAIN_ROWS, TRAIN_BYTES = 4000, 16 << 20
STEPS, BATCH = 1200, 64
THRESHOLD = 0.7
#: Bytes that are scored at a time; a longer text is scored in pieces of as many.
SLICE = 1 << 20


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each padded with zeros to whole blocks and WIDTH more at the end, blocks of each text)"""
    n = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    out = b"".join([t.ljust(k * BLOCK, b"\0") for t, k in zip(texts, n.tolist(), strict=True)])
    return np.frombuffer(out + bytes(WIDTH), np.uint8), n


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "hidden": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "hidden_at": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "out_at": np.zeros(1, np.float32),
        }

    def _responses(self, data: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Every filter's response at each place of each block."""
        places = (len(data) - WIDTH) // STRIDE
        z = np.take(self.p["filters"][0], data[: places * STRIDE : STRIDE], axis=0)
        for w in range(1, WIDTH):
            z += np.take(self.p["filters"][w], data[w : w + places * STRIDE : STRIDE], axis=0)
        z = z.reshape(-1, BLOCK // STRIDE, FILTERS)
        z[np.cumsum(n) - 1, -1] = -np.inf  # would reach into the next text; the place before covers these bytes too
        return z

    def _chunks(self, data: np.ndarray, n: np.ndarray, where: bool) -> tuple:
        """Each block's largest responses, then those of each chunk: a block with the next of its text, or alone if there is none."""
        z = self._responses(data, n)
        top = z.max(axis=1)
        at = z.argmax(axis=1) if where else None
        last = np.zeros(len(top), bool)
        last[np.cumsum(n) - 1] = True
        alone = np.repeat(n == 1, n)
        following = np.roll(top, -1, axis=0)
        second = ~last[:, None] & (following > top)
        chunk = np.where(second, following, top)
        kept = ~last | alone
        return np.tanh(chunk), second, kept, at

    def forward(self, data: np.ndarray, n: np.ndarray, train: bool = False) -> tuple:
        act, second, kept, at = self._chunks(data, n, train)
        starts = np.cumsum(n) - n
        weight = kept / np.repeat(np.maximum(n - 1, 1), n)
        mean = np.add.reduceat(act * weight[:, None], starts, axis=0)
        largest = np.maximum.reduceat(np.where(kept[:, None], act, -2), starts, axis=0)
        x = np.concatenate([mean, largest], axis=1).astype(np.float32)
        prob = self._prob(x)
        h = np.tanh(x @ self.p["hidden"] + self.p["hidden_at"]) if train else None
        return (prob, x, h, act, second, kept, at, weight, starts) if train else (prob,)

    def gradients(self, data: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, x, h, act, second, kept, at, weight, starts = self.forward(data, n, True)
        d = ((prob - y) / len(y)).astype(np.float32)
        dh = np.outer(d, self.p["out"]) * (1 - h * h)
        g = {"out": h.T @ d, "out_at": np.array([d.sum()]), "hidden": x.T @ dh, "hidden_at": dh.sum(axis=0)}
        dx = dh @ self.p["hidden"].T
        of = np.repeat(np.arange(len(n)), n)
        first = np.where(kept[:, None] & (act == x[of, FILTERS:]), 1.0, 0.0)
        share = first / np.maximum(np.add.reduceat(first, starts, axis=0), 1)[of]
        dz = (dx[of, :FILTERS] * weight[:, None] + dx[of, FILTERS:] * share) * (1 - act * act) * kept[:, None]
        block = np.arange(len(act))[:, None] + second
        place = (block * (BLOCK // STRIDE) + at[np.minimum(block, len(at) - 1), np.arange(FILTERS)]) * STRIDE
        flat = np.zeros(WIDTH * 256 * FILTERS)
        live = dz != 0
        place, value, which = place[live], dz[live], np.broadcast_to(np.arange(FILTERS), dz.shape)[live]
        for w in range(WIDTH):
            flat += np.bincount((w * 256 + data[place + w].astype(np.int64)) * FILTERS + which, value, WIDTH * 256 * FILTERS)
        g["filters"] = flat.reshape(WIDTH, 256, FILTERS)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 6) -> Network:
        """Adam over batches of like lengths' documents in a random order, with a falling rate."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        s = {k: np.zeros_like(v, np.float64) for k, v in self.p.items()}
        order: list[int] = []
        for step in range(1, steps + 1):
            if len(order) < min(BATCH, len(texts)):
                order += rng.permutation(len(texts)).tolist()
            batch, order = order[:BATCH], order[BATCH:]
            g = self.gradients(*blocks_of([texts[i] for i in batch]), y[batch])
            rate = 0.01 * (1 - step / (steps + 1))
            for k, v in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                v -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _folded(self, text: bytes) -> float:
        """The probability of one long text, piece by piece: a piece reads one block beyond its end, for the places that
        reach there, and the last block of a piece goes before the next."""
        total, step = -(-len(text) // BLOCK), SLICE // BLOCK
        sums, largest, before = np.zeros(FILTERS), np.full(FILTERS, -2.0, np.float32), None
        for a in range(0, total, step):
            b = min(total, a + step)
            data, n = blocks_of([text[a * BLOCK : (b + 1) * BLOCK]])
            top = self._responses(data, n).max(axis=1)[: b - a]
            top = top if before is None else np.concatenate((before, top))
            act = np.tanh(np.maximum(top[:-1], top[1:]))
            sums += act.sum(axis=0, dtype=np.float64)
            largest = np.maximum(largest, act.max(axis=0, initial=-2))
            before = top[-1:]
        return float(self._prob(np.concatenate((sums / (total - 1), largest))[None].astype(np.float32))[0])

    def _prob(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(x @ self.p["hidden"] + self.p["hidden_at"])
        return 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_at"], -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; short texts share slices, a text longer than a slice is folded."""
        out = np.zeros(len(texts))
        for a, b in slices(texts, SLICE):
            out[a:b] = self._folded(texts[a]) if len(texts[a]) > SLICE else self.forward(*blocks_of(texts[a:b]))[0]
        return out


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int, size: int) -> list[tuple[str, float]]:
    """(text, label) of at most `rows` different labelled rows outside the held-out fold, of at most `size` bytes together. Which ones is
    decided on hashes and lengths, so that no more texts than these are gathered, however often an id or a text stands."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter((bucket_of("id", 4) != 2) & F.col("label").isNotNull())
    n = known.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30))
    drawn = known.filter(draw < min(1.0, 1.2 * rows / n) * (1 << 30)).distinct().orderBy(draw, "id", "label").limit(rows)
    # at most `rows` labels, whatever the size of the table
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(drawn), "id")
    own = own.withColumn("key", F.xxhash64(F.lit(5), "id", "label", "text"))
    wanted, used = [], 0
    for r in own.select("key", F.octet_length("text").alias("bytes")).distinct().orderBy("key").limit(rows).collect():
        if used + r["bytes"] <= size:
            wanted.append((r["key"],))
            used += r["bytes"]
    if not wanted:
        return []
    keys = docs.sparkSession.createDataFrame(wanted, "key long")
    sample = own.join(F.broadcast(keys), "key", "left_semi").select("key", "text", "label").distinct().collect()
    return [(r["text"], r["label"]) for r in sorted(sample)]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, steps: int = STEPS, size: int = TRAIN_BYTES) -> Network | None:
    """Fits a network to a bounded sample of labelled rows outside the held-out fold."""
    sample = training_rows(docs, labels, label_col, id_col, text_col, rows, size)
    if len({y for _, y in sample}) < 2:
        return None
    return Network().fit([t.encode("utf-8", "surrogatepass") for t, _ in sample], np.array([y for _, y in sample], np.float32), steps)


def score(docs: DataFrame, network: Network | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    keep = tuple(k for k in keep if k != "score")
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for pdf in batches:
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf[text_col].tolist()]
            yield pdf[list(keep)].assign(score=net.scores(texts) if net else 0.5)

    return in_small_batches(docs.select(*dict.fromkeys((*keep, text_col)))).mapInPandas(tidy(run), schema)


def accepted(docs: DataFrame, network: Network | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns as they were; all rows if there is no network."""
    if network is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(shared.value.scores(texts) >= threshold, pa.bool_()))

    return in_small_batches(docs).mapInArrow(tidy(run), docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
