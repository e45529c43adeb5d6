"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources, by code point with null last, weigh 3, 1, 2, repeating, and share a total; a target stops at a
multiple of its source's size, and the excess is shared anew by weight until none is above.

Draw: a hash gives each document a point, and the points of a source, in order, are its permutation; equal stretches of
points are its permuted blocks, about as many words in each of all sources. A source's target is some whole passes over
its blocks and a rest: the documents up to one point, which is found to the document by counting ever finer stretches.
So a source has an exact quota of blocks, those of all its passes one after another. The tree splits these quotas
among the output shards: at each node a multivariate hypergeometric draw says how many blocks of each source go left, in
proportion to the shards there, and the leaves hold exact quotas that add up to the whole. A leaf's quota is the next
stretch of its source's sequence of blocks: a document is taken as often as its block lies in a leaf's stretch, and goes
to that leaf's shard. Shards are then shuffled locally: their rows are in the order of a hash.

The driver and the executors hold one row for each source, whatever its size; a source with a third of all rows is counted
by stretches, and only numbers are shuffled for that. With more sources than BROADCAST the row of a source is joined plainly.
The seed fixes every draw; reruns agree.

Null texts have size 0. Null sources are a source of their own. Repeated rows are drawn each for itself (of rows alike in
id, source and text, at the end of the rest, any come first). Documents of size 0 are taken with the passes of their place.
Columns that are added replace columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop, load

WEIGHTS = (3.0, 1.0, 2.0)
SEED = 20240601
SHARDS, BLOCKS, PART_WORDS = 64, 1 << 14, 1 << 16
#: most sources whose rows (about 1 KB each) are sent to every executor
BROADCAST = 10_000
_BITS, _STEP = 63, 10


def targets(sizes: list[int], *, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets of sources in order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """quotas of blocks by source, as a table shard x source of exact parts: the leaves of the tree.

    Each shard gets the same number of blocks, or one more.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    room = [total * (i + 1) // shards - total * i // shards for i in range(shards)]
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        a, b, have = stack.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(have, sum(room[a:mid]), method="marginals") if have.sum() else have
        stack += [(a, mid, left), (mid, b, have - left)]
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def block_of(point, blocks):
    """The block of a point, of so many; for columns and numbers alike."""
    if isinstance(point, Column):
        return F.shiftrightunsigned(F.shiftrightunsigned(point, 31) * blocks, 32)
    return (point >> 31) * blocks >> 32


def _with(rows: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """rows, each with the row of its source."""
    return rows.join(F.broadcast(of) if n <= BROADCAST else of, F.col("\u0001source").eqNullSafe(F.col("\u0001of"))).drop("\u0001of")


def _ends(slim: DataFrame, rest: dict) -> dict:
    """For each source with a rest (words): the point at which it ends, and how many of how many rows there are within.

    Rows before that point are within. Each round counts stretches a thousandth as wide, of the one where the rest ends.
    """
    spark = slim.sparkSession
    out, left, shift = {}, {s: (0, w) for s, w in rest.items() if w > 0}, _BITS
    while left:
        near = max(0, shift - _STEP)
        rows = [(s, at, float(w)) for s, (at, w) in left.items()]
        of = spark.createDataFrame(rows, "`\u0001of` string, stretch long, room double")
        some = _with(slim, of, len(rows)).filter(F.shiftright("\u0001point", shift) == F.col("stretch"))
        some = some.groupBy("\u0001source", F.shiftright("\u0001point", near).alias("at"))
        some = some.agg(F.sum("\u0001size").alias("words"), F.count("*").alias("n"), F.min("\u0001point").alias("a"), F.max("\u0001point").alias("b"), F.first("room").alias("room"))
        sums = Window.partitionBy("\u0001source").orderBy("at")  # a thousand stretches
        some = some.withColumn("before", F.sum("words").over(sums) - F.col("words")).filter("before <= room and before + words > room")
        found, left = {r["\u0001source"]: r for r in some.collect()}, {}
        for s, r in found.items():
            room = r["room"] - r["before"]
            if r["a"] == r["b"]:  # one document, or rows alike
                out[s] = r["a"], min(r["n"], math.floor(room * r["n"] / r["words"] + 0.5)), r["n"]
            else:
                left[s] = r["at"], room
        shift = near
    return out


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    shards: int = SHARDS,
    blocks: int = BLOCKS,
    seed: int = SEED,
    share: float = 1.5,
    most: float = 2.0,
    weights=WEIGHTS,
) -> DataFrame:
    """docs with size, source_size, target, times (how often the mix takes the document), taken (words), and for each
    time its shard, the part of it, and its place within that: draws array<struct<shard, part, place>>.

    blocks: about how many the mix has. size_col: a column that has the sizes already; text_col may then be a hash.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "times", "taken", "draws")
    size = F.col(f"`{size_col}`").cast("long") if size_col else size_of(F.col(f"`{text_col}`").cast("string"))
    kept = [c for c in docs.columns if c not in added]
    source = F.col(f"`{source_col}`").cast("string")
    point = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), source, F.col(f"`{text_col}`")), 1)
    sized = docs.withColumns({"\u0001size": size, "\u0001source": source, "\u0001point": point})
    slim = cut(sized.select("\u0001source", "\u0001size", "\u0001point"), "mix-sizes")

    got = slim.groupBy("\u0001source").agg(F.sum("\u0001size").alias("words")).collect()  # one row for each source
    sources = sorted(((r[0], int(r[1])) for r in got), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([w for _, w in sources], weights=weights, share=share, most=most)
    total = sum(wanted)
    of_words = lambda w: max(1, round(blocks * w / total)) if total else 1
    passes = {s: int(t // w) if w else 0 for (s, w), t in zip(sources, wanted, strict=True)}
    ends = _ends(slim, {s: t - passes[s] * w for (s, w), t in zip(sources, wanted, strict=True)})
    drop(slim)
    rest = [block_of(ends[s][0], of_words(w)) + 1 if s in ends else 0 for s, w in sources]
    quotas = np.array([passes[s] * of_words(w) + r for (s, w), r in zip(sources, rest, strict=True)], np.int64)
    leaves = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    none = (-1, 0, 0)
    rows = [
        (s, w, t, passes[s], of_words(w), *ends.get(s, none), [int(x) for x in leaves[:, i]])
        for i, ((s, w), t) in enumerate(zip(sources, wanted, strict=True))
    ]
    of = spark.createDataFrame(rows, "of string, source_size long, target double, passes int, blocks long, end long, within long, alike long, leaves array<long>")
    of = of.select(F.col("of").alias("\u0001of"), F.struct(*of.columns[1:]).alias("\u0001b"))
    b = lambda name: F.col("\u0001b")[name]

    out = _with(sized, of, len(rows))
    at_end = F.col("\u0001point") == b("end")
    inside = (F.col("\u0001point") < b("end")) | (at_end & (b("within") == b("alike")))
    if any(0 < x < n for _, x, n in ends.values()):  # of rows alike, some
        some = at_end & (b("within") > 0) & (b("within") < b("alike"))
        rank = F.row_number().over(Window.partitionBy("\u0001source").orderBy("\u0001point"))
        out = out.filter(~some).withColumn("\u0001extra", inside).unionByName(out.filter(some).withColumn("\u0001extra", rank <= b("within")))
    else:
        out = out.withColumn("\u0001extra", inside)
    parts = max(1, math.ceil(total / shards / PART_WORDS))

    def draw(k: Column) -> Column:
        """The draw of the document in pass k: the leaf in whose stretch its block of that pass is."""
        at = k * b("blocks") + block_of(F.col("\u0001point"), b("blocks"))
        place = F.xxhash64(F.lit(seed + 3), k, F.col("\u0001point"))
        part = F.shiftrightunsigned(F.shiftrightunsigned(place, 32) * F.lit(parts), 32).cast("int")
        return F.struct(F.size(F.filter(b("leaves"), lambda e: e <= at)).alias("shard"), part.alias("part"), place.alias("place"))

    through = F.slice(F.sequence(F.lit(0), b("passes")), F.lit(1), b("passes") + F.col("\u0001extra").cast("int"))
    drawn_ = F.filter(F.transform(through, draw), lambda d: d["shard"] < shards)
    out = out.withColumn("\u0001draws", drawn_)
    made = {
        "size": F.col("\u0001size"),
        "source_size": b("source_size"),
        "target": b("target"),
        "times": F.size("\u0001draws"),
        "taken": F.col("\u0001size") * F.size("\u0001draws"),
        "draws": F.col("\u0001draws"),
    }
    return out.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in made.items()])


def drawn(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its shard, part and place."""
    each = mixed.select("*", F.explode("draws").alias("\u0001draw")).drop("draws")
    return each.select("*", "\u0001draw.shard", "\u0001draw.part", "\u0001draw.place").drop("\u0001draw")


def laid_out(mixed: DataFrame) -> DataFrame:
    """The mix shuffled: rows of a shard's part (about PART_WORDS words, a stretch of its places) are together, in the order of their
    places, and the parts of all shards are dealt over the tasks."""
    return drawn(mixed).repartition("shard", "part").sortWithinPartitions("shard", "part", F.expr("shiftrightunsigned(place, 1)"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", size_of(text).alias("n"), F.xxhash64(text).alias("text"))
    out = mix(cut(docs, "mix-sizes"), size_col="n")
    shards, places = F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places")
    return out.select("doc_id", "size", "source_size", "target", "taken", shards, places)


QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
