"""Selectors: names by exact match, prefix or glob, in the selectors' order, with errors for what matches nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SelectionError

GLOB = re.compile(r"[*?\[]")


def glob_regex(glob: str) -> str:
    """A glob (*, ?, [set], [!set]) as an anchored Java regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := glob.find("]", i + (glob[i : i + 1] in "!]") + (glob[i : i + 2] == "!]"))) > 0:
            inner = glob[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = j + 1
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?-])", r"\\\1", c))
    return "(?s)^" + "".join(out) + "$"


def split_selectors(values: list[str]) -> list[str]:
    """Comma lists, trimmed, without empty ones and repetitions, in order."""
    return list(dict.fromkeys(x.strip() for v in values for x in v.split(",") if x.strip()))


def matches(name: Column, selector: str) -> Column:
    """Whether an entry is selected, case-folded and with backslashes as slashes: its name or its last part is the selector;
    else, if this has a wildcard, one of them fits it as a glob; else one of them begins with it and an underscore."""
    low, want = F.replace(F.lower(name), F.lit("\\"), F.lit("/")), selector.strip().lower().replace("\\", "/")
    forms = (low, F.regexp_extract(low, "([^/]*)/*$", 1))
    if GLOB.search(want):
        tests = [(f == want) | f.rlike(glob_regex(want)) for f in forms]
    else:
        tests = [(f == want) | f.startswith(want + "_") for f in forms]
    return tests[0] | tests[1]


def matches_target(name: Column, selector: str) -> Column:
    """Whether a partition or file of an update is selected: its name, or that without its suffix, fits the glob."""
    glob, low = glob_regex(selector.strip().lower()), F.lower(name)
    return low.rlike(glob) | F.regexp_replace(low, r"(?<=.)\.[^.]+$", "").rlike(glob)


def select(entries: DataFrame, name: str, selectors: list[str], fits=matches) -> DataFrame:
    """entries that any selector matches, with the first one's position as `selector`; selectors are a short list of
    arguments, so they are tested in one pass and not joined. Without selectors nothing is selected."""
    order = split_selectors(selectors)
    first = F.coalesce(*[F.when(fits(F.col(name), s), F.lit(i)) for i, s in enumerate(order)], F.lit(None).cast("int"))
    return entries.withColumn("selector", first).filter(F.col("selector").isNotNull())


def unmatched(entries: DataFrame, name: str, selectors: list[str], fits=matches) -> DataFrame:
    """(selector): those that match no entry."""
    spark, order = entries.sparkSession, split_selectors(selectors)
    if not order:
        return spark.createDataFrame([], "selector string")
    hits = entries.agg(*[F.coalesce(F.max(fits(F.col(name), s).cast("int")), F.lit(0)).alias(f"h{i}") for i, s in enumerate(order)])
    want = spark.createDataFrame([(i, s) for i, s in enumerate(order)], "i int, selector string")
    flags = hits.select(F.posexplode(F.array(*[F.col(f"h{i}") for i in range(len(order))])).alias("i", "hit"))
    return want.join(flags.filter("hit = 0"), "i").select("selector")


def require_all(entries: DataFrame, name: str, selectors: list[str], fits=matches) -> DataFrame:
    """select(), after every selector is known to match something; it is an error if all are empty."""
    if not split_selectors(selectors):
        raise SelectionError("selectors are empty")
    missing = [r[0] for r in unmatched(entries, name, selectors, fits).collect()]
    if missing:
        raise SelectionError("no entry matches: " + ", ".join(missing))
    return select(entries, name, selectors, fits)


def with_slot(requested: DataFrame, available: DataFrame, name: str, size: str) -> DataFrame:
    """requested names with the available entry for each: the name itself, else its slot _a, else _b, of which empty ones
    don't count."""
    ranked = F.explode(F.array(*[F.struct(F.concat(F.col(name), F.lit(s)).alias("entry"), F.lit(i).alias("rank")) for i, s in enumerate(("", "_a", "_b"))]))
    wanted = requested.select(name, ranked.alias("\u0001w")).select(name, "\u0001w.entry", "\u0001w.rank")
    have = available.select(F.col(name).alias("entry"), F.col(size))
    hit = wanted.join(have, "entry").filter((F.col("rank") == 0) | (F.col(size) > 0))
    best = hit.groupBy(name).agg(F.min_by(F.struct("entry", size), "rank").alias("b"))
    return requested.join(best, name, "left").select(*requested.columns, "b.entry", F.col(f"b.{size}"))
