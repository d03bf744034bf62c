"""URL rules whose block decisions also reach the aliases of a blocked address.

Redirects and canonical links say that two addresses are one resource. Their connected components
are found by alternating large-star and small-star steps, each a grouped minimum and a join, so no
component ever stands in one row or one task. Everything is DataFrame functions.

Edge cases: a null url, or one without ``://``, has an empty host and path and no rule; a null or
empty html has no links; repeated rows are judged alike; empty tables give empty results; further
columns of the inputs are ignored. Of two equal rules with different verdicts ``allow`` holds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.plans.small import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_address(url: Column) -> Column:
    """The node of the alias graph: host, path and query, without scheme and fragment; null
    without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url_host(url) != "", F.concat(url_host(url), rest))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src``, ``dst`` addresses: canonical links and immediate refreshes of the pages. Relative
    targets are resolved against the host (``/x``) or the folder of the page (``x``)."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b.*\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    target = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(
            t, r"(?i)\bcontent\s*=\s*[\"']?\s*\d+\s*;\s*url\s*=\s*['\"]?([^\"'\s>]+)", 1)))
    found = (pages.where(F.col(html).isNotNull())
             .select(F.col(url).alias("from"), F.explode(target).alias("to")).where("`to` <> ''"))
    to, host = F.col("to"), url_host(F.col("from"))
    folder = F.regexp_replace(url_path(F.col("from")), r"[^/]*$", "")
    absolute = (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
                .when(to.startswith("//"), F.concat(F.lit("http:"), to))
                .when(to.startswith("/"), F.concat(F.lit("http://"), host, to))
                .when(to.rlike("^[?#]"), F.concat(F.lit("http://"), host, url_path(F.col("from")), to))
                .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), to)))
    return (found.select(url_address(F.col("from")).alias("src"), url_address(absolute).alias("dst"))
            .where("src is not null and dst is not null and src <> dst").distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its least node) of the undirected graph ``src``-``dst``.

    Large-star hangs every larger neighbour of a node on the least node around it, small-star the
    smaller ones; the diameter shrinks geometrically. A hub's edges meet in a join on the hub, which
    adaptive execution splits; its minimum is a partial aggregate. Each round is written to the shared
    folder, so a lost executor costs a re-read. The driver sees a count and a checksum."""
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        if not larger:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(least, "u")
        moved = (hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger
                 else hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))))
        return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"),
                                                         F.least("src", "dst").alias("v")).distinct(), "alias-edges")
    seen = state(pairs)
    for _ in range(max_rounds if seen[0] else 0):
        pairs = materialize(star(star(pairs, True), False), "alias-stars")
        now = state(pairs)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(pairs.select("v", "v").distinct()).toDF("node", "component"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path``, ``rule``, ``rule_verdict``: the longest fitting rule of every distinct
    host and path of ``urls`` that has one. ``rules``: ``host``, ``path``, ``verdict``. The candidates are the
    ends of the host with at most as many labels as a rule has, joined by equality."""
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    ends = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda k: F.call_function(
        "substring_index", F.col("host"), F.lit("."), F.negative(k))))
    candidates = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("rule_host"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    fits = candidates.join(known, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"),
                          rule.alias("rule"), F.col("verdict").alias("verdict")))
    return (fits.groupBy("host", "path").agg(best.alias("b"))
            .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url",
               html: str | None = "html") -> DataFrame:
    """All columns of ``pages`` that do not clash with the added ``host``, ``path``, ``rule``, ``verdict``
    and ``decided_by`` (``rule``, ``alias`` or ``none``).

    ``redirects`` (``src``, ``dst`` urls) adds edges to those read from ``html``. A url with a rule has
    its rule's verdict. Otherwise it is blocked if a rule blocks one of its aliases and no rule allows
    one of them: an explicit allow takes precedence over propagated blocks. Aliases count whether or not
    they are rows of ``pages``."""
    added = ("host", "path", "rule", "verdict", "decided_by")
    rows = pages.select(*[c for c in pages.columns if c not in added], url_host(F.col(url)).alias("host"),
                        url_path(F.col(url)).alias("path"), url_address(F.col(url)).alias("__node"))
    edges = page_links(pages, url, html) if html else None
    if redirects is not None:
        logged = redirects.select(url_address(F.col("src")).alias("src"), url_address(F.col("dst")).alias("dst"))
        logged = logged.where("src is not null and dst is not null and src <> dst")
        edges = logged if edges is None else edges.union(logged)
    own = match_rules(rows, rules)
    judged = rows.join(own, ["host", "path"], "left")
    if edges is not None:
        members = connected_components(edges)
        if not members.isEmpty():
            judged = judged.join(_propagated(members, rules), "__node", "left")
    if "__alias" not in judged.columns:
        judged = judged.withColumn("__alias", F.lit(None).cast("string"))
    return judged.select(
        *[c for c in rows.columns if c != "__node"], "rule",
        F.coalesce("rule_verdict", "__alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("__alias").isNotNull(), "alias")
        .otherwise("none").alias("decided_by"))


def _propagated(members: DataFrame, rules: DataFrame) -> DataFrame:
    """``__node``, ``__alias`` = block for the members of components that a rule blocks and none allows."""
    address = F.concat(F.lit("http://"), F.col("node"))
    nodes = members.select("node", "component", url_host(address).alias("host"), url_path(address).alias("path"))
    ruled = nodes.join(match_rules(nodes, rules), ["host", "path"])
    blocked = (ruled.groupBy("component").agg(F.max((F.col("rule_verdict") == "block").cast("int")).alias("b"),
                                              F.max((F.col("rule_verdict") == "allow").cast("int")).alias("a"))
               .where("b = 1 and a = 0").select("component"))
    return members.join(blocked, "component").select(F.col("node").alias("__node"), F.lit("block").alias("__alias"))
