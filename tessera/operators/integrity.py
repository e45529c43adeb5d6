"""Digests, identities, mergeable checksums, manifests and completion records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLYNOMIAL = 0xEDB88320


def digests(content: Column) -> dict[str, Column]:
    data = content.cast("binary")
    return {"sha256": F.sha2(data, 256), "sha1": F.sha1(data), "md5": F.md5(data)}


def identity(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """(keys, identity): SHA-256 over a key's rows in order; a row is its parts joined by colons, rows end in newlines."""
    line = F.concat_ws(":", *parts)
    items = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    text = F.array_join(F.transform(items, lambda x: x["line"]), "\n")
    return rows.groupBy(*keys).agg(F.sha2(text.cast("binary"), 256).alias("identity"))


# --- CRC-32 as a linear map over GF(2): 32 columns of 32 bits


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for k, column in enumerate(matrix):
        if vector >> k & 1:
            total ^= column
    return total


def zero_operators(powers: int = 48) -> list[list[int]]:
    """The maps that 2**k zero bytes do to a CRC, for each k."""
    bit = [POLYNOMIAL, *[1 << k for k in range(31)]]
    for _ in range(3):
        bit = [_times(bit, c) for c in bit]
    out = [bit]
    while len(out) < powers:
        out.append([_times(out[-1], c) for c in out[-1]])
    return out


def crc32_combine(a: Column, b: Column, length: Column) -> Column:
    """CRC-32 of two byte strings one after the other, from their CRCs and the second's length; in Catalyst.

    The CRC of the first goes through the maps of the powers of two in the length; each map is 32 masked XORs.
    """
    operators = F.array(*[F.array(*[F.lit(c).cast("long") for c in op]) for op in zero_operators()])
    used = F.filter(F.sequence(F.lit(0), F.lit(47)), lambda k: F.getbit(length.cast("long"), k) == 1)

    def through(crc: Column, k: Column) -> Column:
        masked = F.transform(F.element_at(operators, k + 1), lambda c, i: F.when(F.getbit(crc, i) == 1, c).otherwise(F.lit(0).cast("long")))
        return F.aggregate(masked, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    return F.aggregate(used, a.cast("long"), through).bitwiseXOR(b.cast("long"))


def crc32_fold(parts: Column) -> Column:
    """CRC-32 of byte strings one after another, from array<struct<crc, len>> in order."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: crc32_combine(acc, p["crc"], p["len"]))


# --- records


def manifest(rows: DataFrame, keys: Sequence[str], entries: Column, version: int = 1) -> DataFrame:
    """(keys, manifest): a JSON document of each key's entries, sorted."""
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.sort_array(F.collect_list(entries)).alias("entries"), F.lit(version).alias("manifest_version"))).alias("manifest"))


def latest_record(state: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in state.columns if c not in keys]
    return state.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def pending(wanted: DataFrame, state: DataFrame, keys: Sequence[str], *, digest: str | None = None) -> DataFrame:
    """wanted outputs that no verified record (with the same digest, if one is named) completes."""
    done = state.filter("verified").select(*keys, *([digest] if digest else []))
    return wanted.join(done, [*keys, *([digest] if digest else [])], "left_anti")


def duplicates(rows: DataFrame, name: Column, *rest: Column) -> DataFrame:
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), *rest).filter("n > 1")
