"""Digests, authenticated envelopes, key derivation and password strength."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = b"TWE1"


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def derive_key(password: str, salt: bytes) -> bytes:
    import hashlib

    return hashlib.scrypt(password.encode(), salt=salt, n=16384, r=8, p=1, dklen=32)


def seal(data: Column, key: bytes) -> Column:
    """magic, 12-byte iv, 16-byte tag, ciphertext (AES-256 in Galois counter mode).

    Every evaluation draws an iv of its own, so the pieces are cut from one bound value.
    """

    def cut(made: Column) -> Column:
        size = F.octet_length(made)
        tag, body = F.substr(made, size - 15, F.lit(16)), F.substr(made, F.lit(13), size - 28)
        return F.concat(F.lit(MAGIC), F.substring(made, 1, 12), tag, body)

    return F.transform(F.array(F.aes_encrypt(data, F.lit(key), F.lit("GCM"))), cut)[0]


def unseal(data: Column, key: bytes) -> Column:
    """The content of an envelope; data without the magic is returned as it is."""
    tag, body = F.substring(data, 17, 16), F.substr(data, F.lit(33), F.octet_length(data) - 32)
    opened = F.aes_decrypt(F.concat(F.substring(data, 5, 12), body, tag), F.lit(key), F.lit("GCM"))
    return F.when(F.substring(data, 1, 4) == F.lit(MAGIC), opened).otherwise(data)


def password_strength(password: Column) -> Column:
    """0 to 5: eight characters, twelve, both cases, a digit, a sign."""
    tests = (
        F.length(password) >= 8,
        F.length(password) >= 12,
        password.rlike("[a-z]") & password.rlike("[A-Z]"),
        password.rlike("[0-9]"),
        password.rlike("[^A-Za-z0-9]"),
    )
    return sum((t.cast("int") for t in tests), F.lit(0))
