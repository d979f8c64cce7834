"""Protection schemes compared: keys, ciphertext fingerprints, stored copies and key metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import ciphers


def keys(chunks: DataFrame, scheme: str, secret: str = "chunkloom", state: str | None = None) -> DataFrame:
    """chunks (…, fp) with key: plain, convergent, server_aided or tunable (needs a column of states)."""
    fp = F.col("fp")
    key: Column = {
        "plain": lambda: ciphers.plain_key(),
        "convergent": lambda: fp,
        "server_aided": lambda: ciphers.server_aided_key(fp, secret),
        "tunable": lambda: ciphers.seeded_key(fp, ciphers.key_seed(fp, F.col(state or "state"), secret)),
    }[scheme]()
    return chunks.withColumn("key", key)


def cipher_chunks(keyed: DataFrame, scheme: str) -> DataFrame:
    """keyed (…, data, key) with cipher and cipher_fp; the plain scheme stores the data as it is."""
    return keyed.withColumn("cipher", ciphertext(F.col("data"), F.col("key"), scheme)).withColumn("cipher_fp", F.sha2("cipher", 256))


def ciphertext(data: Column, key: Column, scheme: str) -> Column:
    return data.cast("binary") if scheme == "plain" else ciphers.deterministic_encrypt(data.cast("binary"), key)


def opened(scheme: str) -> Column:
    """The data of a row (cipher, key)."""
    return F.col("cipher") if scheme == "plain" else ciphers.decrypt(F.col("cipher"), F.col("key"))


def key_recipes(ciphered: DataFrame) -> DataFrame:
    return ciphered.select("file_id", "seq", "key", "cipher_fp")


def open_chunks(ciphers_by_position: DataFrame, key_recipe: DataFrame, scheme: str) -> DataFrame:
    """file_id, seq, data: each chunk under the key at its own place in the key recipe."""
    x = ciphers_by_position.join(key_recipe.select("file_id", "seq", "key"), ["file_id", "seq"])
    return x.select("file_id", "seq", opened(scheme).alias("data"))


def metadata_overhead(logical: Column, unique: Column) -> tuple[Column, Column]:
    """(bytes of keys with one key entry for each unique chunk and a head, bytes with a key for each chunk)"""
    return unique * 16 + 64, logical * 32
