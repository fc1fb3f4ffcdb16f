"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Trust starts at hosts whose pages the rules allow and follows links; distrust starts at hosts whose
pages the rules block and follows links backwards, to the hosts that link there. Both are personalised
PageRank: a host starts with the share of its pages that the rules allow (or block), and each step
keeps `1 - DAMPING` of that and adds `DAMPING` times what its neighbours pass on. A page without a rule
is blocked if its host's distrust exceeds its trust by `THRESHOLD`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

DAMPING = 0.85
STEPS = 20
# What a host without links reaches if the rules block half of its pages.
THRESHOLD = 0.5 * (1 - DAMPING)

ALLOW, BLOCK = "allow", "block"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for NULL or a text without `://`. A-Z in the host is lower-cased."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else NULL. Of equally long ones a block wins, then the text's order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[1] == BLOCK, [-ord(c) for c in r[0]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """`src`, `dst`, `links`: links from the pages of one host to another. Columns `host` and `html`."""
    found = pages.where("host <> '' and html is not null").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    named = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return named.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """`host`, `score` after so many steps over the weighted edges `src`, `dst`, `links` from `host`, `seed`.

    What a host passes on is divided by its links. A host of very many links is summed with map-side
    combine; the join on it is one that Spark splits if skewed. Each step is a written table.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    shares = stage(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "link-shares")
    scores = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    if shares.isEmpty():
        return scores
    scores = stage(scores, "scores")
    for _ in range(steps):
        passed = shares.join(broadcast_if_small(scores), F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("part"))
        kept = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("part"))
        scores = stage(kept.union(passed).groupBy("host").agg(F.sum("part").alias("score")), "scores")
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """`page_id, host, path, rule, verdict` for every row of `page_id, url, html`.

    A page without a host (NULL url, or no `://`) is in no graph and allowed. NULL html has no links.
    Links to hosts without pages count as edges; links within a host do not. Repeated rows are judged
    alike and count as often as they occur. An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))

    # Hosts are far fewer than pages: everything below is by host, summed in the tasks first.
    hosts = stage(ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == ALLOW).alias("allowed"), F.count_if(F.col("ruled") == BLOCK).alias("blocked")), "hosts")
    edges = stage(host_edges(placed), "host-edges")
    trust = propagate(hosts.select("host", (F.col("allowed") / F.col("pages")).alias("seed")), edges)
    distrust = propagate(hosts.select("host", (F.col("blocked") / F.col("pages")).alias("seed")),
                         edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    judged = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    bad = stage(judged.where(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold).select(
        F.col("host").alias("_bad")), "distrusted-hosts")
    return ruled.join(broadcast_if_small(bad), F.col("host") == F.col("_bad"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("_bad").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"))
