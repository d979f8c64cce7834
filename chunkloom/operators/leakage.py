"""What a frequency distribution shows to an observer: entropy, distance from uniform, and schemes that flatten it.

The distance is reported as it is, log2(n) - H; nothing is subtracted from it afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.digests import SKETCH_WIDTH, unit_interval
from chunkloom.operators.sketches import cells, running_estimates


def frequencies(chunks: DataFrame, *key: str) -> DataFrame:
    return chunks.groupBy(*(key or ("fp",))).agg(F.count(F.lit(1)).alias("freq"))


def spectrum(freqs: DataFrame) -> DataFrame:
    """freq, n_fps: how many fingerprints have each frequency."""
    return freqs.groupBy("freq").agg(F.count(F.lit(1)).alias("n_fps"))


def divergence(freqs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """logical, distinct, entropy, kld for each group, in bits: log2(T) - sum(f log2 f) / T, and log2(n) less that."""
    total, logs = F.sum("freq"), F.sum(F.col("freq") * F.log2("freq"))
    out = freqs.groupBy(*by).agg(total.alias("logical"), F.count(F.lit(1)).alias("distinct"), (F.log2(total) - logs / total).alias("_h"))
    return out.select(*by, "logical", "distinct", F.round("_h", 9).alias("entropy"), F.round(F.log2("distinct") - F.col("_h"), 9).alias("kld"))


def blowup_threshold(freqs: DataFrame, blowup: float = 1.15) -> DataFrame:
    """One row, t: the frequency at which copies are spread so that stored copies stay within blowup x distinct.

    With frequencies in ascending order, the first i >= 1 for which f_i is no less than what is left, spread over the
    remaining copies, gives t; if already the least frequency is that high, t is 1. Frequencies are first reduced to
    (freq, multiplicity), so that the ordered window is over distinct frequencies; inside a run of equal frequencies the
    condition is monotone enough to be solved in closed form.
    """
    runs = freqs.groupBy("freq").agg(F.count(F.lit(1)).alias("m"))
    total = runs.agg(F.sum(F.col("freq") * F.col("m")).alias("t_all"), F.sum("m").alias("n_all"), F.min("freq").alias("f0"))
    w = Window.orderBy("freq").rowsBetween(Window.unboundedPreceding, -1)
    x = runs.withColumn("i0", F.coalesce(F.sum("m").over(w), F.lit(0))).withColumn("p0", F.coalesce(F.sum(F.col("freq") * F.col("m")).over(w), F.lit(0)))
    x = x.crossJoin(F.broadcast(total)).withColumn("e", F.ceil(F.col("n_all") * F.lit(blowup) - 1e-9))
    # inside a run, f (e - i) >= t_all - prefix_i has the same two sides less f each step: it holds for all or none of the run
    first = F.greatest(F.col("i0"), F.lit(1))
    left = F.col("t_all") - F.col("p0") - F.col("freq") * (first - F.col("i0"))
    room = F.col("e") - first
    holds = (first < F.col("i0") + F.col("m")) & (room > 0) & (F.col("freq") * room >= left)
    x = x.withColumn("answer", F.when(holds, F.ceil(F.greatest(F.lit(1.0), left / room))))
    best = x.agg(F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("freq"))).alias("answer"), F.first(F.col("f0") >= F.col("t_all") / F.col("e")).alias("flat"))
    return best.select(F.when(F.col("flat"), 1).otherwise(F.coalesce("answer", F.lit(1))).cast("long").alias("t"))


def spread_states(chunks: DataFrame, t: int | Column, width: int = SKETCH_WIDTH, seed: str = "tunable") -> DataFrame:
    """seq, fp, est, state: each chunk draws one of est / t + 1 states, so that frequent contents get several ciphertexts.
    The draw is a hash of seed, seq and fp, and so the same in every run."""
    n_states = F.floor(F.col("est") / (F.lit(t) if isinstance(t, int) else t)) + 1
    drawn = F.least(F.floor(unit_interval(F.lit(seed), F.col("seq"), F.col("fp")) * n_states), n_states - 1)
    return running_estimates(chunks, width).withColumn("state", drawn.cast("long"))


def tunable_leakage(chunks: DataFrame, blowup: float = 1.15, width: int = SKETCH_WIDTH) -> DataFrame:
    """plain_kld, cipher_kld, t of the tunable scheme; a ciphertext is a pair (fp, state)."""
    sketch = cells(chunks, width)
    t = blowup_threshold(sketch.filter("row = 0").select(F.col("cnt").alias("freq")), blowup)
    t_value = t.head()["t"]  # one number
    states = spread_states(chunks, t_value, width)
    plain = divergence(frequencies(chunks)).select(F.col("kld").alias("plain_kld"), F.col("distinct").alias("plain_distinct"))
    cipher = divergence(frequencies(states, "fp", "state")).select(F.col("kld").alias("cipher_kld"), F.col("distinct").alias("cipher_distinct"))
    return plain.crossJoin(cipher).withColumn("t", F.lit(t_value))  # a row each
