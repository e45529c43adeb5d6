"""Update archives from end to end: inspect, choose bases, check, apply, verify, record.

Archives are rows (path, content) of ZIP files, as spark.read.format("binaryFile") gives them; base images are blocks
(partition, block, data). Everything is checked before anything is applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import batches
from ..errors import FormatError
from ..operators import catalog, integrity, metadata, selectors
from ..sources import archives, payload

METADATA, SCRIPT, PAYLOAD = "META-INF/com/android/metadata", "META-INF/com/google/android/updater-script", "payload.bin"
PROPERTIES = "payload_properties.txt"


def inspect(files: DataFrame, wanted: str = "auto", *, verify: bool = True) -> DataFrame:
    """(path, kind, problem, props, hints, base_ap, base_csc): what each archive is, says of itself, and needs. A payload must be
    stored, and as its properties say, its metadata's digest included unless told otherwise."""
    entries = archives.zip_extract(files)
    of = lambda name, value: F.max(F.when(F.col("name") == name, value))
    text = lambda name: of(name, F.col("content").cast("string"))
    # a payload's header of 24 bytes has its manifest's length in the eight from the 13th on
    manifest = F.conv(F.hex(F.substring("content", 13, 8)), 16, 10).cast("long")
    head = F.expr("substring(content, 1, cast(least(octet_length(content), 24 + manifest) as int))")
    rows = entries.withColumn("manifest", manifest).withColumn("head", F.when(F.col("name") == PAYLOAD, head)).withColumn("size", F.octet_length("content"))
    one = rows.groupBy(F.col("archive").alias("path")).agg(
        F.collect_list("name").alias("names"), text(METADATA).alias("meta"), text(SCRIPT).alias("script"), text(PROPERTIES).alias("said"),
        of(PAYLOAD, F.col("method")).alias("method"), of(PAYLOAD, F.col("size")).alias("size"), of(PAYLOAD, F.col("head")).alias("head"),
    )
    one = one.withColumns({"props": metadata.properties(F.coalesce("meta", F.lit(""))), "said": metadata.properties(F.coalesce("said", F.lit("")))})
    prop = lambda key: F.coalesce(F.try_element_at("props", F.lit(key)), F.lit(""))
    problem = F.when(F.col("meta").isNull(), "no metadata").otherwise(
        F.coalesce(metadata.problems(F.col("names"), prop("ota-type"), wanted), metadata.payload_problem(F.col("method"), F.col("size"), F.col("head"), F.col("said"), verify=verify))
    )
    ap = F.coalesce(metadata.part_of(prop("source-ap-name"), "AP", 1), F.upper(F.try_element_at("props", F.lit("pre-build-incremental"))))
    csc = metadata.base_csc(prop("source-csc-name"))
    return one.select("path", metadata.detected(F.col("names")).alias("kind"), problem.alias("problem"), "props", metadata.hints(F.col("props"), F.col("script")).alias("hints"), ap.alias("base_ap"), csc.alias("base_csc"))


def operations(files: DataFrame) -> DataFrame:
    """The payload operations of A/B archives, by archive path."""
    blobs = archives.zip_extract(files).filter(F.col("name") == PAYLOAD)
    return payload.manifest(blobs.select(F.col("archive").alias("payload"), "content"))


def base_images(listing: DataFrame, wanted: DataFrame, name: str = "partition") -> DataFrame:
    """wanted partitions with the base image for each among listed files (path): its name, else slot _a, else _b, with
    .img, .img.lz4 or .raw; the plainest form first. Several files of one rank are an error."""
    forms = [".img", ".img.lz4", ".raw"]
    base = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    ranked = F.explode(F.array(*[F.struct(F.concat(F.lower(name), F.lit(slot + form)).alias("file"), F.lit(3 * i + j).alias("rank")) for i, slot in enumerate(("", "_a", "_b")) for j, form in enumerate(forms)]))
    hits = wanted.select(name, ranked.alias("c")).select(name, "c.file", "c.rank").join(listing.select("path", base.alias("file")), "file")
    best = hits.groupBy(name, "rank").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = catalog.with_rank(best, [name], F.col("rank"))
    sure = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several base images for "), name))).otherwise(F.col("path"))
    return wanted.join(best.select(name, sure.cast("string").alias("path")), name, "left")


def plan(files: DataFrame, names: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Checked operations of the archives' selected partitions that no completion record covers.

    names: selectors of partitions, all if it is None. done: (ota, name, sha256, verified) records.
    """
    bad = inspect(files).filter("problem is not null").select("path", "problem").limit(3).collect()
    if bad:
        raise FormatError("; ".join(f"{r.path}: {r.problem}" for r in bad))
    ops = operations(files).cache()
    if names is not None:
        chosen = selectors.require_all(ops.select("payload", "partition").distinct(), "partition", names, selectors.matches_target)
        ops = ops.join(chosen.select("payload", "partition"), ["payload", "partition"], "left_semi")
    wrong = payload.violations(ops).limit(3).collect()
    if wrong:
        raise FormatError("; ".join(f"{r.partition}: {r.what}" for r in wrong))
    if done is not None:
        keyed = ops.withColumns({"ota": F.col("payload"), "name": F.col("partition"), "sha256": F.lower(F.hex("new_sha256"))})
        ops = integrity.pending(keyed, done, ["ota", "name"], digest="sha256").select(*ops.columns)
    return ops


def merge(ops: DataFrame, old: DataFrame, *, verify: bool = True) -> DataFrame:
    """(payload, partition, content, sha256): the new images, put together and, unless told otherwise, checked."""
    blocks = payload.apply(ops, old, verify=verify)
    # a partition's sizes, then its blocks
    named = ["block_size", "new_size", "new_sha256"]
    heads = ops.select("payload", "partition", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), *named).distinct()
    both = heads.unionByName(blocks.select("payload", "partition", "block", "data", *[F.lit(None).cast(ops.schema[c].dataType).alias(c) for c in named]))

    def run(key, rows):
        _, _, _, _, size, total, want = next(rows)
        out = bytearray(total)
        for _, _, k, data, *_ in rows:
            if k >= 0:
                part = data[: max(0, total - k * size)]
                out[k * size : k * size + len(part)] = part
        yield *key, bytes(out), want

    whole = batches.grouped(both, ["payload", "partition"], ["block"], run, "payload string, partition string, content binary, want binary")
    whole = whole.withColumn("sha256", F.sha2("content", 256)).withColumn("want", F.lower(F.hex("want")))
    if verify:
        checked = F.when((F.col("want") != "") & (F.col("want") != F.col("sha256")), F.raise_error(F.concat(F.lit("image hash differs: "), "partition"))).otherwise(F.col("sha256"))
        whole = whole.withColumn("sha256", checked.cast("string"))
    return whole.drop("want")


def records(images: DataFrame, at) -> DataFrame:
    """Completion records of merged images."""
    return images.select(F.col("payload").alias("ota"), F.col("partition").alias("name"), "sha256", F.lit(True).alias("verified"), F.lit(at).alias("at"))


def blocks_of(images: DataFrame, size: int = 4096) -> DataFrame:
    """(partition, block, data) of whole images (partition, content)."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("content", i * size + 1, F.lit(size)))
    return images.select("partition", F.posexplode(parts).alias("block", "data"))

