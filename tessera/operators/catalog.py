"""Release catalogues: reading, merging, choosing and comparing release rows."""

from __future__ import annotations

from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatError


def present(text: Column) -> Column:
    """Trimmed text; null and empty both mean missing."""
    return F.nullif(F.trim(text), F.lit(""))


def first_present(*texts: Column) -> Column:
    return F.coalesce(*map(present, texts))


def upper_code(text: Column) -> Column:
    return F.upper(F.trim(F.coalesce(text, F.lit(""))))


def normal_version(code: Column) -> Column:
    """Slash-separated parts, trimmed; three parts get the first as a fourth, and an empty third is the first."""
    parts = F.transform(F.split(code, "/"), lambda p: F.trim(p))
    four = F.array(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(0)))
    parts = F.when(F.size(parts) == 3, four).otherwise(parts)
    third = F.transform(parts, lambda p, i: F.when((i == 2) & (p == ""), F.get(parts, F.lit(0))).otherwise(p))
    return F.array_join(F.when(F.size(parts) > 2, third).otherwise(parts), "/")


def android_version(text: Column) -> Column:
    """Text in parentheses, else text that starts with android, else `Android N` of a number, else empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    inner = F.regexp_extract(t, r"\(([^)]*)\)", 1)
    return F.when(F.trim(inner) != "", F.trim(inner)).when(F.lower(t).startswith("android"), t).when(t.rlike(r"^\d+$"), F.concat(F.lit("Android "), t)).otherwise("")


def _release_fields(xml: str | None) -> list[list[tuple[str, list[str]]]]:
    """For each BINARY_INFO element its children's tags with their texts, each once: of the first Data child, else all of the
    child's own."""
    if not (xml or "").strip():
        return []
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        raise FormatError(f"history is not well-formed XML: {e}") from e
    found = []
    for info in root.iter("BINARY_INFO"):
        fields: dict[str, dict[str, None]] = {}
        for child in info:
            own = child.findtext("Data") or "".join(child.itertext())
            fields.setdefault(child.tag, {})[own.strip()] = None
        found.append([(tag, list(texts)) for tag, texts in fields.items()])
    return found


def release_rows(history: DataFrame, xml_col: str) -> DataFrame:
    """One row for each BINARY_INFO element of XML documents: fields map<string, array<string>> with each tag's distinct
    values in order, of its first Data child or its own text. Rows without a version are left out; XML that isn't
    well-formed is an error; null and empty documents have no rows."""
    rows = history.select("*", F.posexplode(_fields_udf()(F.col(xml_col))).alias("position", "\u0001pairs")).withColumn("fields", F.map_from_entries("\u0001pairs"))
    rows = rows.withColumn("version", field(F.col("fields"), "BINARY_SW_VERSION"))
    return rows.filter(F.col("version").isNotNull()).drop("\u0001pairs")


def _fields_udf():
    @F.arrow_udf("array<array<struct<key:string,value:array<string>>>>")
    def parse(xml: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("key", pa.string()), ("value", pa.list_(pa.string()))])))
        rows = [[[{"key": k, "value": v} for k, v in info] for info in _release_fields(x)] for x in xml.to_pylist()]
        return pa.array(rows, kind)

    return parse


def field(fields: Column, *tags: str) -> Column:
    """The first non-empty value of the first tag that has one."""
    every = F.flatten(F.array(*[F.coalesce(F.try_element_at(fields, F.lit(t)), F.array().cast("array<string>")) for t in tags]))
    return F.try_element_at(F.filter(every, lambda v: F.trim(v) != ""), F.lit(1))


def sequence_value(sequence: Column) -> Column:
    return F.coalesce(F.trim(sequence).try_cast("long"), F.lit(-1).cast("long"))


def merge_history(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, version, idx, seq, fields, natures, open_date): rows as from release_rows that are alike in version, index and
    sequence as one, with the union of their fields' values in order, their natures, sorted, and the latest open date."""
    f = F.col("fields")
    named = {"idx": field(f, "BINARY_INDEX"), "seq": field(f, "BINARY_SEQUENCE"), "\u0001open": F.coalesce(field(f, "BINARY_OPEN_DATE"), F.lit(""))}
    rows = rows.withColumns(named)
    alike = [*keys, "version", "idx", "seq"]
    flat = rows.select(*alike, "position", "\u0001open", F.explode("fields").alias("tag", "values"))
    one = F.array_sort(F.collect_list(F.struct("position", "values")))
    tags = flat.groupBy(*alike, "tag").agg(F.array_distinct(F.flatten(one["values"])).alias("values"), F.max("\u0001open").alias("open_date"))
    out = tags.groupBy(*alike).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "values")))).alias("fields"), F.max("open_date").alias("open_date"))
    natures = F.coalesce(F.try_element_at("fields", F.lit("BINARY_NATURE")), F.array().cast("array<string>"))
    return out.withColumn("natures", F.array_sort(F.filter(natures, lambda v: v != "")))


def merge_rows(rows: DataFrame, keys: Sequence[str], values: str, date: str) -> DataFrame:
    """One row a key: the set of its values, sorted, its latest date, and how many rows it had."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(values)).alias("merged"), F.max(date).alias("latest"), F.count("*").alias("n_rows"))


def latest(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], *, alternate: Column | None = None) -> DataFrame:
    """Each key's value of the last row in order; rows for which `alternate` holds don't count."""
    if alternate is not None:
        rows = rows.filter(~F.coalesce(alternate, F.lit(False)))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def chosen(rows: DataFrame, keys: Sequence[str], version: str, index: str, order: Sequence[str], wanted: str | None = None) -> DataFrame:
    """Each key's last row in order of the wanted version, both normalised; without one, of those whose index isn't 90, or of
    all if there is no other."""
    if wanted is not None:
        rows = rows.filter(normal_version(F.col(version)) == normal_version(F.lit(wanted)))
        rank = F.lit(0)
    else:
        rank = (F.coalesce(F.trim(F.col(index).cast("string")), F.lit("")) != "90").cast("int")
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(rank.alias("\u0001r"), *order)).alias("\u0001b"))
    return best.select(*keys, "\u0001b.*")


def unique_match(rows: DataFrame, keys: Sequence[str], candidate: str, condition: Column) -> DataFrame:
    """Keys with exactly one distinct candidate among the rows that meet the condition, and that candidate."""
    found = rows.filter(condition).groupBy(*keys).agg(F.min(candidate).alias("low"), F.max(candidate).alias("high"))
    return found.filter("low = high").select(*keys, F.col("low").alias(candidate))


def compare_sets(rows: DataFrame, item: str, side: Column, a, b) -> DataFrame:
    """(item, found): only_a, only_b or common. One aggregation in place of an intersection and two differences."""
    marked = rows.groupBy(item).agg(F.max((side == a).cast("int")).alias("a"), F.max((side == b).cast("int")).alias("b"))
    found = F.when(F.col("a") + F.col("b") == 2, "common").when(F.col("a") == 1, "only_a").when(F.col("b") == 1, "only_b")
    return marked.withColumn("found", found).filter("found is not null").select(item, "found")


def field_diff(rows: DataFrame, pair: str, second: Column, fields: Sequence[str]) -> DataFrame:
    """(pair, field, a, b) where two rows of a pair differ; null differs from a value, not from null."""
    long = rows.select(pair, second.alias("second"), *[F.col(f).cast("string").alias(f) for f in fields])
    long = long.unpivot([pair, "second"], list(fields), "field", "value")
    both = long.groupBy(pair, "field").agg(F.max(F.when(~F.col("second"), F.col("value"))).alias("a"), F.max(F.when(F.col("second"), F.col("value"))).alias("b"), F.count("*").alias("n"))
    return both.filter("n = 2 and not (a <=> b)").select(pair, "field", "a", "b")


def with_rank(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by a composite order."""
    return rows.withColumn("\u0001r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("`\u0001r` = 1").drop("\u0001r")
