"""AES-ECB over chunks, with keys that the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decrypt_chunk(chunk: Column, key: Column, last: Column) -> Column:
    """Plain bytes of a chunk of whole 16-byte blocks.

    Spark takes the padding off whatever it decrypts, so inner chunks get a block of padding first; the last chunk has
    its own, which goes.
    """
    pad = F.aes_encrypt(F.unhex(F.lit("")), key, F.lit("ECB"))
    inner = F.aes_decrypt(F.concat(chunk, pad), key, F.lit("ECB"))
    return F.when(last, F.aes_decrypt(chunk, key, F.lit("ECB"))).otherwise(inner)


def encrypt(data: Column, key: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("ECB"))


def key_of(*parts: Column) -> Column:
    """A 16-byte key from text parts joined by colons."""
    return F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))


def chunks(data: Column, size: int) -> Column:
    """array<struct<off, data, last>>: a binary value in chunks."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(size)).cast("int"))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct((i * size).cast("long").alias("off"), F.substring(data, i * size + 1, F.lit(size)).alias("data"), (i == n - 1).alias("last")),
    )
