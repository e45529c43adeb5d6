"""Paths, directories and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def is_safe(path: Column) -> Column:
    """Absolute, without backslashes or NUL, and without empty, `.` or `..` parts."""
    rest = F.substr(path, F.lit(2))
    good = F.forall(F.split(rest, "/"), lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.coalesce(path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\x00")) & good, F.lit(False))


def prefixes(parts: Column) -> Column:
    """Every prefix of a list of parts, joined by slashes, the shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def directory_counts(paths: DataFrame, path: str) -> DataFrame:
    """(directory, depth, entries): how many rows lie at or below each prefix of a path."""
    rows = paths.select(path_parts(F.col(path)).alias("parts")).filter(F.size("parts") > 0)
    rows = rows.select(F.posexplode(prefixes(F.col("parts"))).alias("depth", "directory"))
    return rows.groupBy("directory", "depth").agg(F.count("*").alias("entries"))


def grouped_paths(paths: DataFrame, path: str) -> DataFrame:
    """(first, paths): paths by their first component, in order."""
    rows = paths.withColumn("first", F.get(path_parts(F.col(path)), F.lit(0)))
    return rows.groupBy("first").agg(F.sort_array(F.collect_set(path)).alias("paths"))


def resolve(requests: DataFrame, entries: DataFrame, *, path: str = "path", root: int = 2, links: int = 32) -> DataFrame:
    """requests with node: the inode at the end of a path, null if there is none.

    entries: (parent, name, node, link), link being a symbolic link's target or null. A round takes one component of every
    path by an equi-join; a link puts its target before what is left, from the root if it is absolute. After `links`
    links a path resolves to nothing.
    """
    state = requests.select(F.col(path), F.lit(root).cast("long").alias("at"), path_parts(F.col(path)).alias("left"), F.lit(0).alias("hops"))
    state = state.distinct()
    done = None
    dirents = entries.select(F.col("parent").alias("at"), F.col("name").alias("head"), F.col("node"), F.col("link"))
    while True:
        finished = state.filter((F.size("left") == 0) | F.col("at").isNull()).select(path, F.col("at").alias("node"))
        done = finished if done is None else done.unionByName(finished)
        state = state.filter((F.size("left") > 0) & F.col("at").isNotNull())
        if state.isEmpty():
            break
        step = state.withColumn("head", F.get("left", F.lit(0))).join(dirents, ["at", "head"], "left")
        rest = F.slice("left", F.lit(2), F.greatest(F.size("left") - 1, F.lit(0)))
        is_link = F.col("link").isNotNull()
        at = F.when(~is_link, F.col("node")).when(F.col("hops") >= links, F.lit(None)).when(F.col("link").startswith("/"), F.lit(root).cast("long")).otherwise(F.col("at"))
        left = F.when(is_link, F.concat(path_parts(F.col("link")), rest)).otherwise(rest)
        state = step.select(path, at.alias("at"), left.alias("left"), (F.col("hops") + is_link.cast("int")).alias("hops"))
    return requests.join(done, path, "left")


def resolve_in(requests: DataFrame, entries: DataFrame, partition: str, *, path: str = "path", **how) -> DataFrame:
    """resolve(), but a path that isn't there is sought below a directory named like its partition, as images hold it whose
    partition is the system's root."""
    forms = F.array(F.struct(F.lit(0).alias("rank"), F.col(path).alias("form")), F.struct(F.lit(1).alias("rank"), F.concat_ws("/", F.lit(""), F.col(partition), F.ltrim(path, F.lit("/"))).alias("form")))
    both = requests.select(path, partition, F.explode(forms).alias("f")).select(path, partition, "f.rank", "f.form").distinct()
    found = resolve(both, entries, path="form", **how).filter("node is not null")
    best = found.groupBy(path, partition).agg(F.min_by("node", "rank").alias("node"))
    return requests.join(best, [path, partition], "left")


def flatten_extents(nodes: DataFrame, *, depth: int = 5) -> DataFrame:
    """(file, logical, blocks, physical) of extent trees. nodes: (file, node, child, logical, blocks, physical), child null
    at leaves; a file's tree starts at node 0. Levels are joins; more than `depth` of them is an error."""
    level = nodes.filter("node = 0")
    out = level.filter("child is null").select("file", "logical", "blocks", "physical")
    for _ in range(depth):
        inner = level.filter("child is not null").select("file", F.col("child").alias("node"))
        level = inner.join(nodes, ["file", "node"])
        out = out.unionByName(level.filter("child is null").select("file", "logical", "blocks", "physical"))
    # an aggregate, which the error can't be moved below
    deep = level.filter("child is not null").agg(F.count("*").alias("n"))
    error = F.when(F.col("n") > 0, F.raise_error(F.lit("extent tree is too deep"))).cast("long")
    none = F.lit(None).cast("long")
    checks = deep.select(F.lit(None).cast("string").alias("file"), none.alias("logical"), none.alias("blocks"), error.alias("physical"))
    return out.unionByName(checks.filter("physical is not null"))
