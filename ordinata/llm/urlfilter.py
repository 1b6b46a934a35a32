"""URL filters: rules first, then trust and distrust spread over host edges, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.llm.common import cut, discard, known, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host in an attribute of a page, after a scheme or as `//host`.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or no `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules of it and its parent domains, the longest first.

    `rules` has rhost, rpath and rverdict.  Only hosts are expanded into their
    suffixes, so a host that holds a third of all pages is one row here.
    """
    parts = hosts.select("host", F.split("host", r"\.").alias("p"))
    suffix = parts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "."))).alias("rhost")).where("rhost <> ''").distinct()
    r = rules.select(F.translate("rhost", UPPER, LOWER).alias("rhost"), "rpath", "rverdict")
    found = suffix.join(r, "rhost").select("host", F.struct((-F.length(F.concat("rhost", "rpath"))).alias("n"), F.concat("rhost", "rpath").alias("rule"), "rpath", "rverdict").alias("r"))
    return found.groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))


def fitting(rules: Column, path: Column) -> Column:
    """The longest of a host's rules whose path starts the url's path; null if none does."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["rpath"])), F.lit(0))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 16, every: int = 4) -> DataFrame:
    """Personalised PageRank: (kind, host, score) over weighted `edges` (kind, src, dst, n) from `seeds` (kind, host, mass).

    Kinds are ranked side by side.  Mass at hosts without out-edges leaves the
    walk, which lowers all scores alike.  Each round joins edges with ranks on
    the source and sums by the target; every `every` rounds the ranks are cut.
    """
    e = edges.groupBy("kind", "src", "dst").agg(F.sum("n").alias("n"))
    out = e.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    e = cut(e.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("n") / F.col("all")).alias("w")))
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    start = cut(seeds.join(F.broadcast(total), "kind").where("total > 0").select("kind", "host", ((1 - damping) * F.col("mass") / F.col("total")).alias("r")))
    rank, old = start, None
    for i in range(rounds):
        moved = e.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("w") * F.col("r")).alias("r"))
        rank = start.union(moved).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % every == every - 1 or i == rounds - 1:
            rank = cut(rank)
            if old is not None:
                discard(old)
            old = rank
    discard(e)
    discard(start)
    return rank.select("kind", "host", F.col("r").alias("score"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 1e-12, kin: float = 1.0) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every page.

    A page that a rule fits has the rule's verdict.  Others take their host's:
    block where distrust exceeds trust by more than `threshold` (noise, by default), else allow.
    Trust is personalised PageRank from hosts with pages that rules allow,
    distrust the same from hosts with pages that rules block, against the
    direction of the edges (a host that links to blocked ones is suspect).
    Edges are links between hosts in the pages' markup and, with weight `kin`,
    each host and its parent domain of two labels or more, either way.  Hosts
    that neither reaches, and pages without a host, are allowed.

    Null urls have empty host and path, null markup no links; repeated rows and
    ids are judged row by row; other columns are not read; no pages, no rows.
    """
    prepare(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    p = p.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    seen = cut(p.groupBy("host").agg(F.count("*").alias("pages")))
    hosts = cut(seen.join(host_rules(seen.select("host"), rules), "host", "left"))
    pages_in_all = seen.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    fit = known(p.select("id", "host", "path"), hosts, ["host"], "pages", pages_in_all).select("host", fitting(F.col("rules"), F.col("path"))["rverdict"].alias("v"))
    seeds = fit.where("v is not null and host <> ''").groupBy(F.when(F.col("v") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("mass"))
    # links: counted by pair of hosts on each task before they are dealt
    links = p.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to")).select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    parent = F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1)
    up = seen.select(F.col("host").alias("src")).select("src", parent.alias("dst")).where("dst <> ''").withColumn("n", F.lit(kin))
    links = cut(links.union(up).union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    score = spread(edges, seeds).groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    of_host = cut(hosts.join(score, "host", "left"))
    out = known(p.select("id", "host", "path"), of_host, ["host"], "pages", pages_in_all).withColumn("r", fitting(F.col("rules"), F.col("path")))
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust - trust > threshold, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.rverdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path), at least one, as a DataFrame (rhost, rpath, rverdict)."""
    rows = [F.struct(F.lit(h).alias("rhost"), F.lit(p).alias("rpath"), F.lit(v).alias("rverdict")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
