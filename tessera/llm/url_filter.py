"""URL filtering: rules by host and path, and for the rest trust and distrust over the link graph, in DataFrame
functions only.

Links are absolute references in the pages' HTML; they give edges between hosts, with counts. Trust is personalised
PageRank along the edges from the hosts of pages that a rule allows, distrust along the reversed edges from the hosts
of pages that a rule blocks. Rounds go on until all that they could still bring, to all hosts together, is below a
tolerance. A host whose distrust is above its trust by more than a threshold is blocked. Edges and ranks are aggregated by host before they are joined, so a host with a third of all pages is one row there; the last
join, of pages with host verdicts, is a plain join that Spark can split where it is skewed.

A null url, or one without `://`, has an empty host and path and no rule; the empty host takes no part in the graph and
is allowed. Null HTML has no links. Repeated rows are judged alike (their links count again); an empty table gives
an empty table. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, load

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: of a rank; below judge's threshold
TOLERANCE = 1e-13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _first_rule(rules, value) -> Column:
    """value(rule) of the longest rule that fits host and path, else null. Rules are a short list, held in the plan."""
    case = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        host, path = F.col("host"), F.col("path")
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        case = F.when(fits, F.lit(value(rule))) if case is None else case.when(fits, F.lit(value(rule)))
    return F.lit(None).cast("string") if case is None else case


def with_rules(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and ruled (the rule's verdict)."""
    url = F.col(f"`{url_col}`").cast("string")
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    return out.withColumns({"rule": _first_rule(rules, lambda r: r[1] + r[2]), "ruled": _first_rule(rules, lambda r: r[0])})


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, share): links between different hosts, as shares of the links from src. pages has host."""
    found = F.array_distinct(F.regexp_extract_all(F.col(f"`{html_col}`").cast("string"), F.lit(LINK), 1))
    links = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter((F.col("dst") != "") & (F.col("dst") != F.col("src")))
    links = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def page_rank(edges: DataFrame, seeds: DataFrame, *, tolerance: float = TOLERANCE, damping: float = 0.85, cut_every: int = 8) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, weight), whose weights sum to one; all ranks together are
    less than tolerance below the limit."""
    start = seeds.select("host", (F.col("weight") * (1 - damping)).alias("part"))
    rank = start.select("host", F.col("part").alias("rank"), F.col("part").alias("last"))  # last: what the latest round brought
    while True:
        for _ in range(cut_every):
            moved = edges.join(rank.withColumnRenamed("host", "src"), "src")
            moved = moved.select(F.col("dst").alias("host"), *((damping * F.col("share") * F.col(c)).alias(c) for c in ("rank", "last")))
            moved = moved.unionByName(start.select("host", F.col("part").alias("rank"), F.lit(0.0).alias("last")))
            rank = moved.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("last").alias("last"))
        rank = cut(rank, "rank")
        # a round passes on damping of the last one's mass at most, so what is still to come is bounded
        if (rank.agg(F.sum("last")).first()[0] or 0.0) * damping / (1 - damping) < tolerance:
            return rank.drop("last")


def host_verdicts(ruled: DataFrame, *, threshold: float = 0.0, tolerance: float = TOLERANCE, damping: float = 0.85, html_col: str = "html") -> DataFrame:
    """(host, trust, distrust, blocked) of the hosts that trust or distrust reaches. ruled: as from with_rules, with html."""
    hosts = ruled.filter((F.col("host") != "") & F.col("ruled").isNotNull()).groupBy("host", "ruled").agg(F.count("*").alias("n"))
    hosts = cut(hosts, "seeds")
    edges = cut(host_edges(ruled, html_col), "edges")

    def seeds(verdict: str) -> DataFrame:
        some = hosts.filter(F.col("ruled") == verdict)
        every = some.agg(F.sum("n").alias("all"))
        return some.crossJoin(F.broadcast(every)).select("host", (F.col("n") / F.col("all")).alias("weight"))  # one row

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    total = back.groupBy("src").agg(F.sum("share").alias("all"))
    back = cut(back.join(total, "src").select("src", "dst", (F.col("share") / F.col("all")).alias("share")), "edges")
    trust = page_rank(edges, seeds("allow"), tolerance=tolerance, damping=damping).withColumnRenamed("rank", "trust")
    distrust = page_rank(back, seeds("block"), tolerance=tolerance, damping=damping).withColumnRenamed("rank", "distrust")
    both = trust.join(distrust, "host", "full").fillna(0.0, ["trust", "distrust"])
    return both.withColumn("blocked", F.col("distrust") - F.col("trust") > threshold)


def judge(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 1e-12) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust) of every page. The threshold is above rounding errors."""
    columns = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")]
    ruled = with_rules(pages.select(*columns), rules)
    hosts = cut(host_verdicts(ruled, threshold=threshold), "verdicts")
    out = ruled.drop("html", "url").join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages")).drop("trust", "distrust")


def _sql(rounds: int = 12, damping: float = 0.85, threshold: float = 1e-12) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = {quote(h)} OR ends_with(host, {quote('.' + h)})) AND starts_with(path, {quote(p)})" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {quote(r[1] + r[2])}" for f, r in zip(fits, ordered, strict=True)) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN {quote(r[0])}" for f, r in zip(fits, ordered, strict=True)) + " END"
    lower = f"translate({{0}}, {quote(UPPER)}, {quote(LOWER)})"
    steps = []
    for name, verdict, edges in (("trust", "allow", "edges"), ("distrust", "block", "back")):
        steps.append(f"{name}_seed AS (SELECT host, n / sum(n) OVER () AS weight FROM seeds WHERE ruled = {quote(verdict)})")
        steps.append(f"{name}0 AS (SELECT host, weight AS rank FROM {name}_seed)")
        for k in range(rounds):
            steps.append(
                f"{name}{k + 1} AS (SELECT host, sum(part) AS rank FROM (SELECT dst AS host, {damping} * share * rank AS part FROM {edges} JOIN {name}{k} ON src = host"
                f" UNION ALL SELECT host, weight * {1 - damping} FROM {name}_seed) GROUP BY host)"
            )
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r AS (SELECT page_id, html, host, path, {rule} AS rule, {ruled} AS ruled FROM h),
seeds AS (SELECT host, ruled, count(*) AS n FROM r WHERE host <> '' AND ruled IS NOT NULL GROUP BY 1, 2),
links AS (SELECT host AS src, {lower.format("unnest(list_distinct(regexp_extract_all(html, " + quote(LINK) + ", 1)))")} AS dst FROM r WHERE host <> ''),
pairs AS (SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' AND dst <> src GROUP BY 1, 2),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM pairs),
back AS (SELECT dst AS src, src AS dst, share / sum(share) OVER (PARTITION BY dst) AS share FROM edges),
{", ".join(steps)}
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.rank, 0) - coalesce(t.rank, 0) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN trust{rounds} t ON r.host = t.host LEFT JOIN distrust{rounds} d ON r.host = d.host"""


QUERIES = {"op10_url_filter": op10_url_filter}
SQL = {"op10_url_filter": _sql()}
