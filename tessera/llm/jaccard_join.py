"""Similarity self-join of documents by word n-grams: Bayesian candidate pruning, then exact verification.

1. Documents with the same word sequence form a class; a class has one node, a 64-bit hash of the sequence.
2. A class's MinHash values (16 bits each) are cut into bands; classes that share a band are compared. LSH with these
   bands misses a pair at the threshold with a probability of 4e-7, and pairs above it more rarely.
3. A pair is compared in the first band that it shares, in steps: after m of n values agree, its Jaccard similarity has the
   posterior Beta(m + 1, n - m + 1); the pair is dropped once the probability of reaching the threshold falls below a
   tolerance (1e-9).
4. The pairs that are left, and no others, are verified on their exact n-gram sets, where the texts of those that have any
   left meet again. That gives each class's number of links and the edges of a forest of each task's links, and so the
   groups of documents that links connect.

No pair is ever a row: tasks compare blocks of classes and give members, and then counts by class and forest edges. A band
with more members, or longer texts, than a block holds becomes one task for each pair of its blocks, so nothing is
capped, and no task grows with a group. Copies are counted, not expanded.

A text with fewer words than an n-gram is one n-gram of all its words; texts without words (null too) are linked to
none, and each is a class of its own. Repeated rows are copies. Null ids are members like others and name a class only if
it has no other id. Words, n-grams and word sequences are compared by 64-bit hashes. Extra columns are dropped; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, load, mix, shards_of, span_hash, text_column, word_bounds, word_hashes

GRAM, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS, STEP = 28, 4, 16
VALUES = BANDS * ROWS
BLOCK, BLOCK_BYTES, BINS = 1024, 4 << 20, 8
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)


def shingles(words: np.ndarray, first: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and where each document's begin; documents without words have none."""
    lens = np.diff(first)
    n = np.where(lens >= gram, lens - gram + 1, np.minimum(lens, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    end = np.minimum(start + gram, np.repeat(first[1:], n))
    return span_hash(words, start, end), at


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of documents, each of which has a gram: the top 16 bits of minima of random linear maps."""
    out = np.empty((len(at) - 1, VALUES), np.uint16)
    low = (grams >> np.uint64(32)) | np.uint64(1)
    for k in range(VALUES):
        h = ((low * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
        least = np.minimum.reduceat(h, at[:-1])
        # minima crowd near zero: spread them before taking 16 bits
        out[:, k] = (mix(least.astype(np.uint64) + np.uint64(k << 32)) >> np.uint64(48)).astype(np.uint16)
    return out


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After so many values, the fewest agreements with which P(similarity >= threshold) is not below tolerance."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        # uniform prior: P = P(Binomial(n + 1, threshold) <= m)
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(sizes: np.ndarray, most: int = 1 << 18):
    """Index pairs within consecutive groups of these sizes, in portions."""
    ends = np.cumsum(sizes)
    later = np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0) - 1
    done = np.cumsum(later)
    i = 0
    while i < len(later):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + most, "right")))
        n = later[i:j]
        a = np.repeat(np.arange(i, j), n)
        if len(a):
            yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        i = j


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """Which pairs stay when values are compared step by step."""
    on = np.arange(len(a))
    same = np.zeros(len(a), np.int32)
    for n, least in fewest.items():
        part = slice(n - STEP, n)
        same = same + (sig[a[on], part] == sig[b[on], part]).sum(axis=1)
        stay = same >= least
        on, same = on[stay], same[stay]
    return on


def first_shared(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which pairs share this band of a and none before it."""
    bands = sig.view(np.uint64)
    on = np.flatnonzero(bands[a, band[a]] == bands[b, band[a]])
    for k in range(int(band.max(initial=0))):
        at = a[on]
        on = on[(band[at] <= k) | (bands[at, k] != bands[b[on], k])]
    return on


def connected(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, label): nodes of edges (a, b) other than the smallest of each component, and that smallest.

    Alternating large and small stars. What a round aggregates is written to the shared folder before it is joined, so
    the joins are plain ones, which Spark can split at a node that many others hang on.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, used = None, []
    while True:
        e = cut(e, name)
        drop(*used)
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            out.cut_at = e.cut_at
            return out
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")), name)
        rest = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        used = [e, least, large, lower]
        e = rest.union(lower.select("u", F.col("m").alias("v"))).distinct()


def _tasks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """rows with i, j and side: a group in so many blocks, a task for each pair of blocks."""
    own = F.pmod(F.xxhash64("node", key), F.col(blocks)).cast("int")
    rows = rows.withColumns({"\u0001own": own, "\u0001other": F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))})
    rows = rows.withColumns({"i": F.least("\u0001own", "\u0001other"), "j": F.greatest("\u0001own", "\u0001other"), "side": F.col("\u0001own") > F.col("\u0001other")})
    return rows.drop("\u0001own", "\u0001other", blocks)


def _binned(rows: DataFrame, key: str, bins: int) -> DataFrame:
    return rows.withColumn("bin", F.pmod(F.xxhash64(key, "i", "j"), F.lit(bins)).cast("int"))


def _groups(rows: pa.Table, key: str):
    """Order of rows by task, sizes of tasks, and for the ordered rows whether the task has two blocks, and the side."""
    k, i, j = (np.asarray(rows.column(c)) for c in (key, "i", "j"))
    side = np.asarray(rows.column("side"))
    order = np.lexsort((np.asarray(rows.column("node")), j, i, k))
    k, i, j = k[order], i[order], j[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    return order, np.diff(np.append(np.flatnonzero(head), len(k))), i != j, side[order]


def classes_of(docs: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """(id, tie, node, sig, bytes) of each document; node and sig are null for texts without words; tie: hash of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))

    def sign(batches):
        for batch in batches:
            data, off = text_column(batch.column(2))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + (2 << 20), "right")) - 1)
                part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                s, e = word_bounds(part, o)
                first = np.searchsorted(s, o)
                words = word_hashes(part, s, e)
                has = np.diff(first) > 0
                node = span_hash(words, first[:-1], first[1:]).view(np.int64)
                grams, at = shingles(words, first, gram)
                rows = signatures(grams, at[np.append(has, True)]) if has.any() else np.zeros((0, VALUES), np.uint16)
                sig = iter(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(node, pa.int64(), mask=~has), pa.array([next(sig).tobytes() if h else None for h in has], pa.binary()), pa.array(np.diff(o), pa.int64())],
                    names=["id", "tie", "node", "sig", "bytes"],
                )
                a = b

    return source.mapInArrow(sign, "id long, tie long, node long, sig binary, bytes long")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(id_col, tie, node, group, class_id, n_links): one row for each of docs'.

    tie: xxhash64 of the text. node: the document's word sequence, as a hash. group: the smallest node of the documents
    that links connect; class_id: their smallest id. n_links: other documents of at least the threshold's similarity,
    copies included.
    """
    spark = docs.sparkSession
    shards = shards_of(spark)
    signed = cut(classes_of(docs, id_col, text_col, gram), "jaccard-signed")
    member = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    classes = signed.filter("node is not null").groupBy("node")
    classes = classes.agg(F.min(member).alias("one"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.max("bytes").alias("bytes"))
    classes = cut(classes, "jaccard-classes")

    # bands that at least two classes have, in blocks of classes and of text
    band = lambda k: F.xxhash64(F.lit(k), F.substring("sig", 1 + 2 * ROWS * k, 2 * ROWS))
    bands = classes.select("node", "bytes", F.posexplode(F.array(*map(band, range(BANDS)))).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("all")).filter("n > 1")
    blocks = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / BLOCK_BYTES))).cast("int")
    shared = cut(shared.select("key", "n", blocks.alias("blocks")), "jaccard-bands")
    met = _tasks(bands.join(shared.select("key", "blocks"), "key"), "key", "blocks")
    rows = shared.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    met = _binned(met, "key", max(BINS * shards, rows >> 14))
    met = met.join(classes.select("node", "sig"), "node").select("bin", "key", "band", "i", "j", "side", "node", "bytes", "sig")
    fewest = fewest_matches(threshold, tolerance)

    def remaining(rows: pa.Table, two, side, order, sizes):
        """Portions of the pairs that a bin's tasks have left, as indexes into order."""
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)[order]
        of = np.asarray(rows.column("band"))[order]
        for a, b in _pairs(sizes):
            keep = ~two[a] | (side[a] != side[b])
            a, b = a[keep], b[keep]
            on = first_shared(sig, a, b, of)
            a, b = a[on], b[on]
            on = survivors(sig, a, b, fewest)
            yield a[on], b[on]

    def prune(rows: pa.Table) -> pa.Table:
        order, sizes, two, side = _groups(rows, "key")
        left = np.zeros(len(order), bool)
        for a, b in remaining(rows, two, side, order, sizes):
            left[a] = left[b] = True
        return rows.drop_columns(["bin", "sig"]).take(pa.array(order[left]))

    members = "key long, band int, i int, j int, side boolean, node long, bytes long"
    left = cut(met.groupBy("bin").applyInArrow(prune, members), "jaccard-left")
    size = left.agg(F.sum("bytes")).first()[0] or 0

    # texts of the classes that have pairs left, one of each
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id2"), F.xxhash64(text).alias("tie2"), text.alias("text"))
    some = classes.join(left.select("node").distinct(), "node").select("node", "copies", "sig", "one.id", "one.tie")
    with_text = some.join(texts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tie") == F.col("tie2")))
    with_text = with_text.select("node", "copies", "sig", "text").dropDuplicates(["node"])  # ids may repeat
    verify = _binned(left.drop("bytes"), "key", max(BINS * shards, size // (2 * BLOCK_BYTES))).join(with_text, "node")

    def exact(rows: pa.Table) -> pa.Table:
        order, sizes, two, side = _groups(rows, "key")
        node, copies = np.asarray(rows.column("node"))[order], np.asarray(rows.column("copies"))[order]
        grams, at = gram_sets(rows.column("text").combine_chunks().take(pa.array(order)), gram)
        links, a_, b_ = np.zeros(len(node), np.int64), [], []
        for a, b in remaining(rows, two, side, order, sizes):
            on = similar(grams, at, a, b, threshold)
            a, b = a[on], b[on]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            a_.append(a)
            b_.append(b)
        forest = _forest(node, a_, b_)
        some = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(node[some]), forest.column("a").combine_chunks()]),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), forest.column("b").combine_chunks()]),
                "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(forest.num_rows, pa.int64())]),
            }
        )

    verified = cut(verify.groupBy("bin").applyInArrow(exact, "a long, b long, links long"), "jaccard-verified")
    links = verified.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    label = connected(verified.filter("b is not null").select("a", "b"), "jaccard-links")
    info = classes.select("node", "copies", "one.id").join(label, "node", "left").join(links, "node", "left")
    info = info.select("node", F.coalesce("label", "node").alias("label"), "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labelled = cut(info, "jaccard-info")
    named = labelled.groupBy("label").agg(F.min("id").alias("class_id"))
    info = cut(labelled.join(named, "label").select("node", F.col("label").alias("group"), "class_id", "n_links"), "jaccard-info")
    drop(classes, shared, left, verified, label, labelled)
    out = signed.select("id", "tie", "node").join(info, "node", "left")
    return out.select(
        F.col("id").alias(id_col),
        "tie",
        "node",
        "group",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _forest(node: np.ndarray, left: list, right: list) -> pa.Table:
    """Edges that connect what the pairs connect, at most one for each node."""
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    own, of = np.unique(node, return_inverse=True)
    label = components(len(own), of[a], of[b])
    at = np.flatnonzero(label != np.arange(len(own)))
    return pa.table({"a": pa.array(own[at], pa.int64()), "b": pa.array(own[label[at]], pa.int64())})


def gram_sets(column, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' distinct n-grams as numbers, and where each text's begin."""
    data, off = text_column(column)
    s, e = word_bounds(data, off)
    grams, at = shingles(word_hashes(data, s, e), np.searchsorted(s, off), gram)
    n = len(at) - 1
    own, code = np.unique(grams, return_inverse=True)
    key = np.unique(np.repeat(np.arange(n), np.diff(at)) * len(own) + code)  # each gram of a text once
    return key % max(1, len(own)), np.searchsorted(key, np.arange(n + 1) * len(own))


def similar(grams: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, most: int = 1 << 20) -> np.ndarray:
    """Which pairs of texts have n-gram sets of at least the threshold's Jaccard similarity."""
    size = np.diff(at)
    both = np.zeros(len(a), np.int64)
    has = np.zeros(int(grams.max(initial=0)) + 1, bool)
    order = np.argsort(a, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
        own = grams[at[a[part[0]]] : at[a[part[0]] + 1]]
        has[own] = True
        done = np.cumsum(size[b[part]])
        i = 0
        while i < len(part):  # the others' grams, in portions
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + most, "right")))
            other = b[part[i:j]]
            n = size[other]
            first = np.cumsum(n) - n
            hit = has[grams[np.repeat(at[other] - first, n) + np.arange(n.sum())]]
            both[part[i:j]] = np.add.reduceat(hit, first, dtype=np.int64)
            i = j
        has[own] = False
    # similarity >= threshold, without rounding of the quotient
    return np.flatnonzero(both >= threshold * (size[a] + size[b] - both) - 1e-9)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
SQL = {
    "op2_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, (SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links FROM documents d"""
}
