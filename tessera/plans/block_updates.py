"""Block updates from their archives: transfer lists with their data, patches of whole partitions, and direct files.

Entries are rows (archive, name, content, ok, method), as archives.zip_extract gives them; base images are rows
(partition, content). What an archive declares is rows too, so that checks are filters and aggregates; only patching and
the commands of one partition run in kernels. Empty tables give empty tables; null contents count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import batches
from ..errors import FormatError
from ..operators import integrity, selectors
from ..sources import archives, patches, transfers
from .updates import SCRIPT

#: How entries are named.
LIST, NEW, PATCHED = ".transfer.list", ".new.dat", ".patch.dat"
DIRECT, PATCHES = (".img", ".bin"), (".img.p", ".bin.p")
SIZES = "dynamic_partitions_op_list"


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])


def _at_root(name: Column) -> Column:
    return ~F.contains(name, F.lit("/"))


def _text(entries: DataFrame, name: str) -> DataFrame:
    return entries.filter(F.col("name") == name).select("archive", F.col("content").cast("string").alias("raw"))


def sure(value: Column, wrong: Column, *message: Column | str) -> Column:
    """value, or an error where `wrong` holds."""
    said = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
    return F.when(wrong, F.raise_error(said)).otherwise(value)


def lists(entries: DataFrame) -> DataFrame:
    """(archive, partition, text): the transfer lists at the root of archives."""
    found = entries.filter(_at_root(F.col("name")) & F.col("name").endswith(LIST))
    return found.select("archive", F.expr(f"left(name, length(name) - {len(LIST)})").alias("partition"), F.col("content").cast("string").alias("text"))


def declared_sizes(entries: DataFrame) -> DataFrame:
    """(archive, partition, resized, scanned): bytes by the first `resize partition bytes` line of the size list, and by the
    first range scan of the script that begins at block 0 and names the partition; either can be null."""
    words = F.transform(F.split("raw", r"\r\n|\r|\n"), lambda x: F.split(F.trim(x), r"\s+"))
    resized = _text(entries, SIZES).select("archive", F.posexplode(words).alias("at", "w")).filter((F.size("w") == 3) & (F.get("w", F.lit(0)) == "resize"))
    resized = resized.groupBy("archive", F.get("w", F.lit(1)).alias("partition")).agg(F.min_by(F.get("w", F.lit(2)), "at").cast("long").alias("resized"))
    scans = F.regexp_extract_all(F.col("line"), F.lit(r'/by-name/([\w-]+)",\s*"2,0,\d+"'), 0)
    scanned = _text(entries, SCRIPT).select("archive", F.posexplode(F.split("raw", "\n")).alias("at", "line")).filter(F.contains("line", F.lit("range_scan(")))
    scanned = scanned.select("archive", "at", F.posexplode(scans).alias("in_line", "call"))
    name, blocks = F.regexp_extract("call", r"^/by-name/([\w-]+)", 1), F.regexp_extract("call", r',(\d+)"$', 1).cast("long")
    scanned = scanned.groupBy("archive", name.alias("partition")).agg(F.min_by(blocks * transfers.BLOCK, F.struct("at", "in_line")).alias("scanned"))
    return resized.join(scanned, ["archive", "partition"], "full")


def declared_patches(entries: DataFrame) -> DataFrame:
    """(archive, partition, output, entry, size, sha1, old_size, old_sha1): the script's calls that patch a partition from an
    entry. Of a call's words, a number before 40 hexadecimal digits is a size and its digest: first the new image's, then
    the old one's. A patch entry that no call of that form names is an error."""
    script = _text(entries, SCRIPT)
    calls = script.select("archive", F.explode(F.slice(F.split("raw", r"patch_partition\("), 2, 1 << 20)).alias("call"))
    words = F.split(F.substring_index("call", "package_extract_file(", 1), r"[\":,\s)]+")
    sized = F.transform(words, lambda w, i: F.when(w.rlike("^[0-9a-fA-F]{40}$") & (i > 0), F.struct(F.get(words, i - 1).try_cast("long").alias("size"), F.lower(w).alias("sha1"))))
    named = calls.select("archive", F.regexp_extract("call", r'package_extract_file\("([^"\n]+\.p)"\)\s*\)', 1).alias("entry"), F.filter(sized, lambda x: x["size"].isNotNull()).alias("d"), F.contains("call", F.lit("/by-name/")).alias("named"))
    named = named.filter((F.col("entry") != "") & (F.size("d") == 2) & F.col("named"))
    output = F.regexp_extract("entry", r"([^/]+)\.p$", 1)
    known = named.select("archive", F.regexp_replace(output, r"(?<=.)\.[^.]+$", "").alias("partition"), output.alias("output"), "entry", F.col("d")[0]["size"].alias("size"), F.col("d")[0]["sha1"].alias("sha1"), F.col("d")[1]["size"].alias("old_size"), F.col("d")[1]["sha1"].alias("old_sha1"))
    there = entries.filter(_ends(F.col("name"), PATCHES)).select("archive", F.col("name").alias("entry"))
    both = known.join(there.withColumn("there", F.lit(True)), ["archive", "entry"], "full")
    # in the column that every reader needs, or it would be pruned
    wrong = F.when(F.col("partition").isNull(), "no declaration of the patch ").when(F.col("there").isNull(), "no patch entry ")
    output = sure(F.col("output"), wrong.isNotNull(), wrong, F.col("entry"))
    return both.withColumn("output", output.cast("string")).drop("there")


def direct_files(entries: DataFrame) -> DataFrame:
    """(archive, output, content, size): whole files at the root of archives."""
    found = entries.filter(_at_root(F.col("name")) & _ends(F.lower("name"), DIRECT))
    return found.select("archive", F.col("name").alias("output"), "content", F.octet_length("content").cast("long").alias("size"))


def _key() -> Column:
    """One key for archive and partition that can be a partition's name."""
    return F.concat(F.sha1(F.col("archive").cast("binary")), F.lit("-"), F.col("partition"))


def _steps(entries: DataFrame) -> DataFrame:
    """The lists' commands, with one key for archive and partition that can be a partition's name."""
    found = lists(entries)
    label = sure(_key(), F.col("partition") == "", "a transfer list has no name")
    keyed = found.select(label.cast("string").alias("key"), "text", "archive", F.col("partition").alias("label"))
    return transfers.commands(keyed, "key", keep=("archive", "label")).withColumnRenamed("partition", "key").withColumnRenamed("label", "partition")


def _sizes(entries: DataFrame, steps: DataFrame) -> DataFrame:
    """(archive, partition, key, least, size): bytes up to the last block written, and the declared size or null."""
    end = steps.groupBy("archive", "partition", "key").agg((F.max("target_end") * transfers.BLOCK).alias("least"))
    rows = end.join(declared_sizes(entries), ["archive", "partition"], "left")
    resized = sure(F.col("resized"), F.col("resized") < F.col("least"), "commands write behind the resized ", F.col("partition"))
    return rows.select("archive", "partition", "key", "least", F.coalesce(resized.cast("long"), F.greatest("scanned", F.when(F.col("scanned").isNotNull(), F.col("least")))).alias("size"))


def partitions(entries: DataFrame) -> DataFrame:
    """(archive, partition, output, size, source_required, histogram): what an archive makes, by lists and by patches. A size
    that isn't declared goes up to the last block written."""
    steps = _steps(entries)
    counts = steps.groupBy("archive", "partition", F.upper("command").alias("command")).agg(F.count("*").alias("n"))
    counts = counts.groupBy("archive", "partition").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("command", "n")))).alias("histogram"))
    needs = F.exists(F.map_keys("histogram"), lambda c: c.isin("MOVE", "BSDIFF", "IMGDIFF", "STASH"))
    sized = _sizes(entries, steps).select("archive", "partition", F.coalesce("size", "least").alias("size"))
    by_list = counts.join(sized, ["archive", "partition"]).select("archive", "partition", F.concat("partition", F.lit(".img")).alias("output"), "size", needs.alias("source_required"), "histogram")
    one = F.create_map(F.lit("BSDIFF"), F.lit(1).cast("long"))
    return by_list.unionByName(declared_patches(entries).select("archive", "partition", "output", "size", F.lit(True).alias("source_required"), one.alias("histogram")))


def targets(entries: DataFrame, names: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """(archive, kind, name, output, size): selected partitions and direct files. Without selectors everything is, with
    selectors of one kind only nothing of the other. Outputs of one archive that would share a file name are an error."""
    part = partitions(entries).select("archive", F.lit("partition").alias("kind"), F.col("partition").alias("name"), "output", "size")
    whole = direct_files(entries).select("archive", F.lit("file").alias("kind"), F.col("output").alias("name"), "output", "size")
    if names is not None or files is not None:
        part, whole = (rows.limit(0) if by is None else selectors.require_all(rows, "name", by, selectors.matches_target).drop("selector") for rows, by in ((part, names), (whole, files)))
    every = part.unionByName(whole)
    twice = every.groupBy("archive", "output").agg(F.count("*").alias("\u0001n"))
    output = sure(F.col("output"), F.col("\u0001n") > 1, "two targets are ", F.col("output"))
    return every.join(twice, ["archive", "output"]).withColumn("output", output.cast("string")).select("archive", "kind", "name", "output", "size")


def guarded(wanted: DataFrame, existing: DataFrame, completed: DataFrame, *, force: bool = False) -> DataFrame:
    """wanted outputs still to be made: those that `completed` (archive, output) records are left out; one that exists
    (output) without a record is an error, unless forced."""
    left = wanted.join(completed.select("archive", "output"), ["archive", "output"], "left_anti")
    if force:
        return left
    there = existing.select("output", F.lit(True).alias("\u0001there")).distinct()
    output = sure(F.col("output"), F.col("\u0001there"), "output exists without a completion record: ", F.col("output"))
    return left.join(there, "output", "left").withColumn("output", output.cast("string")).select(*wanted.columns)


def copied(entries: DataFrame, existing: DataFrame | None = None, *, keys: tuple[str, ...] | list[str] = ("output",)) -> DataFrame:
    """(archive, output, content, sha256, reused): direct files. An existing file (keys, size, crc32) of the same size and
    CRC is not copied again: reused, without content."""
    # digests before the join, which then moves contents only where they are read
    rows = direct_files(entries).withColumns({"crc32": F.crc32("content"), "sha256": F.sha2("content", 256)})
    if existing is not None:
        known = existing.select(*keys, "size", "crc32", F.lit(True).alias("reused")).distinct()
        rows = rows.join(known, [*keys, "size", "crc32"], "left")
    else:
        rows = rows.withColumn("reused", F.lit(None).cast("boolean"))
    left = F.when(F.col("reused").isNull(), F.col("content"))
    return rows.select("archive", "output", left.alias("content"), "sha256", F.coalesce("reused", F.lit(False)).alias("reused"))


def patched(entries: DataFrame, base: DataFrame, wanted: DataFrame | None = None, *, verify: bool = True) -> DataFrame:
    """(archive, partition, output, content): whole partitions patched from their base images, whose size, and digests unless
    told otherwise, are checked before and after; only the wanted (archive, output), if they are given."""
    rows = declared_patches(entries)
    if wanted is not None:
        rows = rows.join(wanted, ["archive", "output"], "left_semi")
    rows = rows.join(entries.select("archive", F.col("name").alias("entry"), F.col("content").alias("patch")), ["archive", "entry"])
    rows = rows.join(base.select("partition", F.col("content").alias("old")), "partition", "left")
    wrong = F.when(F.col("old").isNull(), "no base image of ").when(F.octet_length("old") != F.col("old_size"), "another size has the base image of ")
    if verify:
        wrong = wrong.when(F.sha1("old") != F.col("old_sha1"), "hash differs of the base image of ")
    rows = rows.withColumn("old", sure(F.col("old"), wrong.isNotNull(), wrong, F.col("partition")).cast("binary"))

    def run(found):
        for archive, partition, output, sha1, size, old, patch in found:
            yield archive, partition, output, sha1, patches.apply_patch(old, patch or b"", size)

    made = batches.mapped(rows.select("archive", "partition", "output", "sha1", "size", "old", "patch"), run, "archive string, partition string, output string, sha1 string, content binary")
    if verify:
        made = made.withColumn("content", sure(F.col("content"), F.sha1("content") != F.col("sha1"), "target hash differs: ", F.col("output")).cast("binary"))
    return made.drop("sha1")


def replayed(entries: DataFrame, base: DataFrame, wanted: DataFrame | None = None, *, verify: bool = True) -> DataFrame:
    """(archive, partition, output, content): images that transfer lists make from new data, patch data and base images, in
    the size that the archive declares, else the base's or up to the last block written; only the wanted (archive, output),
    if they are given."""
    steps = _steps(entries)
    if wanted is not None:
        steps = steps.withColumn("output", F.concat("partition", F.lit(".img"))).join(wanted, ["archive", "output"], "left_semi").drop("output")
    packed = entries.filter(F.col("name").endswith(PATCHED) & (F.col("method") != 0)).agg(F.min("name")).first()[0]  # in one job
    if packed is not None:
        raise FormatError(f"patch data must be stored: {packed}")
    # each part of a partition's data is a row of its own: sizes, base image, new data, patch data
    sized = _sizes(entries, steps).select("archive", "partition", "key", "size")
    parts = {"image": sized.join(base.select("partition", F.col("content").alias("image")), "partition", "left")}
    for column, suffix in (("new", NEW), ("patch", PATCHED)):
        own = entries.filter(F.col("name").endswith(suffix)).select("archive", F.expr(f"left(name, length(name) - {len(suffix)})").alias("partition"), F.col("content").alias(column))
        if wanted is not None:
            own = own.withColumn("output", F.concat("partition", F.lit(".img"))).join(wanted, ["archive", "output"], "left_semi").drop("output")
        parts[column] = own.withColumn("key", _key())
    data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
    made = transfers.apply(steps.drop("partition").withColumnRenamed("key", "partition"), data.select(F.col("key").alias("partition"), "image", "new", "patch", "size", "archive", F.col("partition").alias("label")), verify=verify)
    return made.select("archive", F.col("label").alias("partition"), F.concat("label", F.lit(".img")).alias("output"), "content")


def merge(files: DataFrame, base: DataFrame, names: list[str] | None = None, file_names: list[str] | None = None, *, done: DataFrame | None = None, verify: bool = True) -> DataFrame:
    """(archive, output, content, sha256): everything selected that block updates (path, content) make and that no verified
    record (ota, name, sha256, verified) completes."""
    entries = archives.zip_extract(files)
    bad = entries.filter(~F.col("ok")).select("name").limit(1).collect()
    if bad:
        raise FormatError(f"entry {bad[0][0]} is damaged")
    chosen = targets(entries, names, file_names)
    if done is not None:
        named = chosen.withColumns({"ota": F.col("archive"), "made": F.col("output")})
        chosen = integrity.pending(named.drop("name").withColumnRenamed("made", "name"), done, ["ota", "name"]).select("archive", "kind", "output", "size")
    wanted = chosen.select("archive", "output")
    parts = [replayed(entries, base, wanted, verify=verify), patched(entries, base, wanted, verify=verify)]
    made = reduce(DataFrame.unionByName, parts).select("archive", "output", "content").withColumn("sha256", F.sha2("content", 256))
    return made.unionByName(copied(entries).join(wanted, ["archive", "output"], "left_semi").select("archive", "output", "content", "sha256"))
