"""Byte-format operators as round trips over the driver's tables: texts are packed into a format and read back by the
operators; SQL says what must come out."""

from __future__ import annotations

import bz2
import hashlib
import io
import lzma
import tarfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import batches
from ..operators import hierarchy
from ..sources import archives, ext4, images, patches, payload, transfers
from .registry import query, table

BLOCK = 4096


def _packed(rows: DataFrame, make: Callable[[str, bytes], dict[str, bytes | str | None]], schema: str) -> DataFrame:
    """rows (key string, text) turned into files by a kernel; schema names its columns after path."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(rows):
        for key, text in rows:
            made = make(key, (text or "").encode())
            yield tuple(made[n] for n in names)

    return batches.mapped(rows, run, schema)


def _texts(spark, sf_dir, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("string").alias("key"), "text")


def _blocks(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0")


def _sizes(texts: DataFrame) -> DataFrame:
    return texts.select("key", F.octet_length("text").alias("n"))


def _nulls(texts: DataFrame, **columns) -> DataFrame:
    """Rows of null texts, which make no files; None is a null text."""
    null = F.lit(None).cast("string")
    return texts.filter("text is null").select(*[(F.col(c) if isinstance(c, str) else null if c is None else c).alias(n) for n, c in columns.items()])


def _cut(content: str) -> object:
    return F.sha2(F.expr(f"substring({content}, 1, n)"), 256)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sparse_expand(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    make = lambda key, raw: {"path": key, "content": images.make_sparse(_blocks(raw) + bytes(3 * BLOCK) + b"\x01\x02\x03\x04" * BLOCK)}
    chunks = images.chunk_table(_packed(texts, make, "path string, content binary"))
    size = _sizes(texts).select(F.col("key").alias("image"), (F.ceil(F.greatest(F.lit(1), "n") / BLOCK) * BLOCK + 7 * BLOCK).cast("long").alias("size"), "n")
    whole = images.assembled(chunks, ["image"], size)
    return whole.select(F.col("image").cast("long").alias("doc_id"), _cut("content").alias("sha256"))


@query("SELECT doc_id, 'system_a' AS partition, sha256(text) AS sha256 FROM documents UNION ALL SELECT doc_id, 'vendor_a', sha256(reverse(lang) || source) FROM documents")
def lp_extract(spark, sf_dir):
    known = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  a null makes its own partition empty, not both
    rest = F.concat(known(F.col("text")), F.lit("\x00"), known(F.reverse("lang")), known(F.col("source")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), rest.alias("text"))

    def make(key, raw):
        text, _, rest = raw.rpartition(b"\0")
        return {"path": key, "content": images.make_super({"system_a": text, "empty": b"", "vendor_a": rest})}

    files = _packed(docs, make, "path string, content binary")
    chunks = images.chunk_table(files)
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image"), F.explode(F.create_map(F.lit("system_a"), F.octet_length("text"), F.lit("vendor_a"), F.octet_length(F.concat("lang", "source")))).alias("partition", "n"))
    sizes = images.lp_sizes(images.lp_extents(chunks)).filter("size > 0").join(lengths, ["image", "partition"])
    whole = images.assembled(images.extract_partitions(chunks, ["system_a", "vendor_a"]), ["image", "partition"], sizes)
    digests = whole.select("image", "partition", _cut("content").alias("sha256"))  # joined without the contents
    found = lengths.join(digests, ["image", "partition"], "left")
    empty = F.when(F.col("n") == 0, F.sha2(F.lit(b""), 256))  # a partition of no bytes has no extents
    return found.select(F.col("image").cast("long").alias("doc_id"), "partition", F.coalesce("sha256", empty).alias("sha256"))


@query("SELECT doc_id, sha256(text) AS copied, sha256(text) AS replaced FROM documents")
def payload_apply(spark, sf_dir):
    texts = _texts(spark, sf_dir)

    def make(key, raw):
        old = _blocks(raw)
        n = len(old) // BLOCK
        turned = b"".join(old[i * BLOCK : (i + 1) * BLOCK] for i in reversed(range(n)))
        coder = (lambda x: x, bz2.compress, lambda x: lzma.compress(x, preset=0))[int(key) % 3]
        ops = [(4, b"", [(i, 1) for i in reversed(range(n))], [(0, n)]), ((0, 1, 8)[int(key) % 3], coder(old), [], [(n, n)]), (6, b"", [], [(2 * n, 2)])]
        return {"payload": key, "content": payload.make([{"name": "p" + key, "old": old, "new": turned + old + bytes(2 * BLOCK), "ops": ops}])}

    # read by both sides of the gathering join, so that texts are coded once
    ops = payload.manifest(_packed(texts, make, "payload string, content binary")).persist(StorageLevel.DISK_ONLY)
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col("text").cast("binary"), i * BLOCK + 1, F.lit(BLOCK)))
    old = texts.select(F.concat(F.lit("p"), "key").alias("partition"), F.posexplode(blocks).alias("block", "data"))
    new = payload.apply(ops, old)
    images_ = _sizes(texts).select(F.col("key").alias("payload"), ((2 * F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)) + 2) * BLOCK).alias("size"), "n")
    whole = images.assembled(new.select("payload", (F.col("block") * BLOCK).alias("off"), "data"), ["payload"], images_)

    def halves(rows):
        for key, content, n in rows:
            half = (len(content) // BLOCK - 2) // 2 * BLOCK
            yield key, b"".join(content[at : at + BLOCK] for at in range(half - BLOCK, -1, -BLOCK)), content[half : 2 * half], n

    new = batches.mapped(whole, halves, "payload string, a binary, b binary, n int")
    return new.select(F.col("payload").cast("long").alias("doc_id"), _cut("a").alias("copied"), _cut("b").alias("replaced"))


@query("SELECT doc_id, 'SOURCE_COPY:1,ZERO:2' AS histogram, true AS source_required, 3::BIGINT AS violations FROM documents")
def payload_check(spark, sf_dir):
    # a plan with one good copy, an overlap, and a target behind the image
    make = lambda key, raw: {"payload": key, "content": payload.make([{"name": "p" + key, "old": bytes(BLOCK), "new": bytes(4 * BLOCK), "ops": [(4, b"", [(0, 1)], [(0, 1)]), (6, b"", [], [(0, 2)]), (6, b"", [], [(1, 9)])]}])}
    ops = payload.manifest(_packed(_texts(spark, sf_dir), make, "payload string, content binary"))
    plan = payload.partitions(ops).select("payload", "source_required", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("histogram"))
    bad = payload.violations(ops).groupBy("payload").agg(F.count("*").alias("violations"))
    return plan.join(bad, "payload").select(F.col("payload").cast("long").alias("doc_id"), "histogram", "source_required", "violations")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def block_apply(spark, sf_dir):
    texts = _texts(spark, sf_dir)

    def make(key, raw):
        data = _blocks(raw)
        n = len(data) // BLOCK
        sha = lambda x: hashlib.sha1(x).hexdigest()
        # new data at the end, moved to the front by way of a stash, patched from and to itself, the rest zeroed
        patch = patches.make_patch(data, data)
        lines = ["4", str(3 * n), "0", "0", f"new 2,{2 * n},{3 * n}", f"stash {sha(data)} 2,{2 * n},{3 * n}", f"zero 2,{2 * n},{3 * n}"]
        lines += [f"move {sha(data)} 2,{n},{2 * n} {n} - {sha(data)}:2,0,{n}", f"bsdiff 0 {len(patch)} {sha(data)} {sha(data)} 2,0,{n} {n} 2,{n},{2 * n}", f"free {sha(data)}", f"erase 2,{n},{2 * n}"]
        return {"partition": "p" + key, "text": "\n".join(lines), "new": data, "patch": patch}

    files = _packed(texts, make, "partition string, text string, new binary, patch binary")
    data = files.select("partition", F.lit(None).cast("binary").alias("image"), "new", "patch", F.lit(None).cast("int").alias("n"))
    # lengths come as one more row of each partition's data, and stay with the images
    lengths = _sizes(texts).select(F.concat(F.lit("p"), "key").alias("partition"), "n")
    out = transfers.apply(transfers.commands(files), data.unionByName(lengths, allowMissingColumns=True))
    return out.select(F.substring("partition", 2, 99).cast("long").alias("doc_id"), _cut("content").alias("sha256"))


@query("SELECT doc_id, sha256(text || ' patched') AS sha256 FROM documents")
def bsdiff_apply(spark, sf_dir):
    kinds = (None, (0, 0, 0), (2, 2, 2), (0, 1, 2))

    def make(key, raw):
        patch = patches.make_patch(raw, raw + b" patched", kinds[int(key) % 4])
        return {"path": key, "content": patches.apply_patch(raw, patch)}

    texts = _texts(spark, sf_dir)
    out = _packed(texts.filter("text is not null"), make, "path string, content binary").select("path", F.sha2("content", 256).alias("sha256"))
    return out.unionByName(_nulls(texts, path="key", sha256=None)).select(F.col("path").cast("long").alias("doc_id"), "sha256")


def _zip(key: str, raw: bytes) -> dict:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("dir/"), b"")
        z.writestr(zipfile.ZipInfo("dir/text.txt"), raw, zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("id"), key.encode(), zipfile.ZIP_STORED)
    return {"path": key, "content": out.getvalue()}


@query("SELECT doc_id, 'dir/text.txt' AS name, strlen(text)::BIGINT AS size, 8 AS method, sha256(text) AS sha256, true AS ok FROM documents UNION ALL SELECT doc_id, 'id', strlen(doc_id::VARCHAR), 0, sha256(doc_id::VARCHAR), true FROM documents")
def zip_list(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    files = _packed(texts, _zip, "path string, content binary")
    listed = archives.zip_list(files).select("archive", "name", "size", "method")
    digests = archives.zip_extract(files).select("archive", "name", F.sha2("content", 256).alias("sha256"), "ok")  # joined without the contents
    both = listed.join(digests, ["archive", "name"]).join(_sizes(texts), F.col("archive") == F.col("key"))
    known = (F.col("name") == "id") | F.col("n").isNotNull()  # a null text is packed as an empty entry
    return both.select(F.col("archive").cast("long").alias("doc_id"), "name", F.when(known, F.col("size")).alias("size"), "method", F.when(known, F.col("sha256")).alias("sha256"), "ok")


@query("SELECT doc_id, 'text' AS name, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def tar_list(spark, sf_dir):
    def make(key, raw):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            t.addfile(tarfile.TarInfo("folder"))
            t.members[0].type = tarfile.DIRTYPE
            info = tarfile.TarInfo("text")
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
        return {"path": key, "content": out.getvalue()}

    texts = _texts(spark, sf_dir)
    out = archives.tar_extract(_packed(texts.filter("text is not null"), make, "path string, content binary")).filter("name = 'text'")
    out = out.select("archive", "name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    out = out.unionByName(_nulls(texts, archive="key", name=F.lit("text"), size=F.lit(None).cast("long"), sha256=None))
    return out.select(F.col("archive").cast("long").alias("doc_id"), "name", "size", "sha256")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def lz4_decode(spark, sf_dir):
    def make(key, raw):
        if int(key) % 2:
            return {"path": key + ".lz4", "content": pa.compress(raw or b"\0", codec="lz4", asbytes=True)}
        parts = [raw[i : i + 3000] for i in range(0, len(raw), 3000)] or [b"\0"]
        coded = [pa.compress(p, codec="lz4_raw", asbytes=True) for p in parts]
        return {"path": key + ".lz4", "content": b"\x02\x21\x4c\x18" + b"".join(len(c).to_bytes(4, "little") + c for c in coded)}

    texts = _texts(spark, sf_dir)
    chunks = images.chunk_table(_packed(texts, make, "path string, content binary"))
    sizes = _sizes(texts).withColumn("image", F.concat("key", F.lit(".lz4")))
    size = sizes.filter("n is not null").select("image", F.col("n").cast("long").alias("size"))
    digests = images.assembled(chunks, ["image"], size).select("image", F.sha2("content", 256).alias("sha256"))  # joined without the contents
    return sizes.join(digests, "image", "left").select(F.col("key").cast("long").alias("doc_id"), "sha256")


@query("SELECT item_id, p AS path, sha256(CASE p WHEN 'etc/id.txt' THEN item_id::VARCHAR ELSE text END) AS sha256 FROM benchmark, (VALUES ('etc/id.txt'), ('text'), ('etc/link')) t(p)")
def ext4_files(spark, sf_dir):
    make = lambda key, raw: {"path": key, "content": ext4.make({"etc/id.txt": key.encode(), "text": raw}, {"etc/link": "/text"})}
    files = _packed(_texts(spark, sf_dir, "benchmark", "item_id"), make, "path string, content binary")
    entries, extents = ext4.tables(files)
    # one namespace for all images: their names before the paths, their roots under root 0
    nodes = entries.select(F.xxhash64("image", "parent").alias("parent"), "name", F.xxhash64("image", "node").alias("node"), F.when(F.col("link").isNotNull(), F.concat(F.lit("/"), "image", "link")).alias("link"))
    roots = entries.select(F.lit(0).cast("long").alias("parent"), F.col("image").alias("name"), F.xxhash64("image", F.lit(ext4.ROOT).cast("long")).alias("node"), F.lit(None).cast("string").alias("link")).distinct()
    wanted = files.select("path", F.explode(F.array(*map(F.lit, ("etc/id.txt", "text", "etc/link")))).alias("file"))
    wanted = wanted.select(F.col("path").alias("image"), "file", F.concat("path", F.lit("/"), "file").alias("path"))
    found = hierarchy.resolve(wanted, nodes.unionByName(roots), root=0)
    sizes = entries.filter("link is null").select(F.xxhash64("image", "node").alias("node"), "size").distinct()
    found = found.join(sizes, "node").select("image", F.col("path").alias("partition"), "file", "node", "size")
    pieces = extents.select("image", F.xxhash64("image", "node").alias("node"), "target", "source", F.col("size").alias("length"))
    parts = found.select("image", "partition", "node", "size").withColumnRenamed("size", "total").join(pieces, ["image", "node"])
    parts = parts.select("image", "partition", "target", "source", F.least("length", F.col("total") - F.col("target")).alias("size"), F.lit(False).alias("hole"))
    data = images.copy_extents(parts, images.chunk_table(files), ["image"], ["image", "partition"])
    whole = images.assembled(data, ["image", "partition"], found.select("image", "partition", "size"))
    return whole.join(found, ["image", "partition"]).select(F.col("image").cast("long").alias("item_id"), F.col("file").alias("path"), F.sha2("content", 256).alias("sha256"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'sparse' WHEN 1 THEN 'zip' ELSE 'binary' END AS format, true AS valid FROM benchmark")
def verify_files(spark, sf_dir):
    def make(key, raw):
        kind = int(key) % 3
        return {"path": key, "content": images.make_sparse(_blocks(raw)) if kind == 0 else _zip(key, raw)["content"] if kind == 1 else raw}

    files = _packed(_texts(spark, sf_dir, "benchmark", "item_id"), make, "path string, content binary")
    return archives.verify(files).select(F.col("path").cast("long").alias("item_id"), "format", "valid")
