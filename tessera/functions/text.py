"""Scalar functions on text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("KiB", "MiB", "GiB", "TiB")


def human_bytes(size: Column) -> Column:
    """`512 B`, `1.50 KiB` and so on, up to TiB; two decimals, rounded half to even."""
    text = F.concat(F.format_string("%d", size.cast("long")), F.lit(" B"))
    case = F.when(size < 1024, text)
    for k, unit in enumerate(UNITS, 1):
        value = size.cast("double") / float(1024**k)
        short = F.format_string(f"%.2f {unit}", F.bround(value, 2))
        case = case.when(size < 1024 ** (k + 1), short) if k < len(UNITS) else case.otherwise(short)
    return case


def parse_rate(text: Column) -> Column:
    """Bytes of `500`, `500K`, `10M`, `1.5GiB` (powers of 1024), null if it isn't a positive rate."""
    plain = F.upper(F.trim(text, F.lit(" \t\n\r\f\x0b")))
    digits = F.length(F.regexp_extract(plain, "^[0-9.]*", 0))
    number, unit = F.substr(plain, F.lit(1), digits), F.ltrim(F.substr(plain, digits + 1), F.lit(" \t\n\r\f\x0b"))
    names = {letter + end: 1024.0**k for k, letter in enumerate(("", "K", "M", "G", "T")) for end in ("", "B", "IB")}
    scale = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), unit)
    whole = ~(number.startswith(".") | number.endswith("."))
    value = F.floor(number.try_cast("double") * scale).cast("long")
    return F.when(whole & (value > 0), value)


def eta(done: Column, total: Column, speed: Column, complete: Column | None = None) -> Column:
    """`mm:ss` or `hh:mm:ss` until the rest is done at this speed; `--:--` if it has none, or the total isn't known.

    complete: nothing more will come; then nothing of an unknown total is left.
    """
    complete = F.lit(False) if complete is None else complete
    s = F.ceil((total - done) / speed).cast("long")
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    hours = F.floor(s / 3600)
    parts = F.array(F.when(hours > 0, two(hours)), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), two(F.pmod(s, F.lit(60))))
    none_left = F.when(total > 0, done >= total).otherwise(complete)
    return F.when(none_left, "00:00").when(~complete & (total > 0) & (speed > 0), F.array_join(parts, ":")).otherwise("--:--")


def plain_path(path: Column) -> Column:
    """A path without its .enc2 or .enc4 suffix."""
    return F.regexp_replace(path, r"(?i)\.enc[24]$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)/*$", 1)


def permuted(value: Column, nonce: Column) -> Column:
    """The characters of value at the low four bits of each of nonce's characters; value has 16 at least."""
    return F.array_join(F.transform(F.split(nonce, ""), lambda c: F.substr(value, F.ascii(c).bitwiseAND(15) + 1, F.lit(1))), "")


def signed_magnitude(raw: Column) -> Column:
    """A little-endian 64-bit number whose top bit is its sign, from 8 bytes."""
    pairs = F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), 1))
    text = F.array_join(pairs, "")
    top = F.conv(F.substr(text, F.lit(1), F.lit(1)), 16, 10).cast("int")
    low = F.conv(F.concat(F.hex(F.pmod(top, F.lit(8))), F.substr(text, F.lit(2))), 16, 10).cast("long")
    return F.when(top >= 8, -low).otherwise(low)


def little_endian(raw: Column, at: int, size: int) -> Column:
    """An unsigned number of up to 7 bytes from a binary value, `at` counted from 0."""
    part = F.regexp_extract_all(F.hex(F.substring(raw, at + 1, size)), F.lit("(..)"), 1)
    return F.conv(F.array_join(F.reverse(part), ""), 16, 10).cast("long")
