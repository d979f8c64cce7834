"""Content keys and encryption, as Spark expressions.

Keys are hex strings of 32 bytes. Encryption is authenticated: AES-GCM with a 12-byte IV before and a 16-byte tag after
the ciphertext, so decryption of altered bytes fails instead of giving garbage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERHEAD = 28


def convergent_key(content: Column) -> Column:
    """The content's own digest: equal contents, equal keys."""
    return F.sha2(content, 256)


def plain_key() -> Column:
    """Placeholder key of the unprotected scheme (nothing is encrypted with it)."""
    return F.lit("01" * 32)


def server_aided_key(fp: Column, secret: str) -> Column:
    """A key only the holder of the secret can derive: what a blind signature of the fingerprint gives, without the protocol."""
    return F.sha2(F.concat(F.lit(secret), fp), 256)


def seeded_key(fp: Column, seed: Column) -> Column:
    """Key of the tunable scheme: fingerprint and key seed hashed together."""
    return F.sha2(F.concat(fp, seed), 256)


def key_seed(fp: Column, state: Column, secret: str) -> Column:
    return F.sha2(F.concat_ws("|", fp, state.cast("string"), F.lit(secret)), 256)


def _raw(key: Column, bits: int) -> Column:
    return F.unhex(F.substring(key, 1, bits // 4))


def encrypt(content: Column, key: Column, iv: Column | None = None, mode: str = "GCM", bits: int = 256) -> Column:
    """With no iv, a fresh one for each row; with one, the result depends on its inputs only (equal inputs stay equal). Modes
    are Spark's: GCM, or CBC, which isn't authenticated and whose IV has 16 bytes. bits: 128, 192 or 256, of the key's first."""
    args = (content, _raw(key, bits), F.lit(mode), F.lit("DEFAULT"))
    return F.aes_encrypt(*args) if iv is None else F.aes_encrypt(*args, iv)


def deterministic_encrypt(content: Column, key: Column) -> Column:
    """Fixed IV: safe only under keys that are never used for two contents, as content-derived keys are."""
    return encrypt(content, key, F.unhex(F.lit("00" * 12)))


def decrypt(cipher: Column, key: Column, mode: str = "GCM", bits: int = 256) -> Column:
    return F.aes_decrypt(cipher, _raw(key, bits), F.lit(mode))


def index_key(fp: Column, secret: str) -> Column:
    """A deterministic keyed image of a fingerprint, for an index outside the trusted side: a keyed digest in place of a
    reversible wide-block cipher, since the index only needs equality."""
    return F.sha2(F.concat(F.lit(secret), F.lit("|index|"), fp), 256)
