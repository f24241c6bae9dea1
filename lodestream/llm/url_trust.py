"""URL verdicts: rules of host and path, and trust and distrust spread over links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import doc_column, join_counted, materialise

#: (host, path, verdict) of the registered query. A rule fits its host and all subdomains.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Rounds between two looks at how far ranks still move, and the share of any host's rank at which they have settled.
ROUNDS = 8
SETTLED = 1e-9
#: A host with more than this part of all links is a hub.
HUB_SHARE = 20_000
DAMPING = 0.85
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s<>]+)"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones the first by name; null where none does.

    Rules are a list that a person writes, so they stand in the plan.
    """
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links from pages of one host to another host, counted before they are shuffled."""
    url, html = doc_column(pages, "url", "string"), doc_column(pages, "html", "string")
    linking = pages.where(html.contains("//")).select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("link"))
    edges = linking.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst")).where("src != '' and dst != '' and src != dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, cut_every: int = 4) -> DataFrame:
    """(host, rank) by power iteration from ``seeds`` (host, seed): mass jumps back to the seeds in proportion.

    Links from hosts with a large share of all links get their host's rank by broadcast:
    such hosts are few, and no task gets all links of one. Every ``rounds`` rounds it ends if no host's rank has moved by more than the share
    ``SETTLED``; a host just reached has moved by all of it, so no chain is cut short.
    Mass at hosts without links is lost, as if it left the table. The edges are laid
    out once by source; each round joins, and sums by target, with partial sums first,
    so that a host with very many links into it is no hot key. Lineage is cut by
    written tables every few rounds.
    """
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    start = seeds.select("host", (F.col("seed") / F.lit(total or 1.0)).alias("jump"))
    many = edges.count() / HUB_SHARE
    hubs = materialise(edges.groupBy("src").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > many).select("src"), "hubs")  # fewer than HUB_SHARE
    plain = edges.join(F.broadcast(hubs), "src", "left_anti")
    from_hubs = None if hubs.isEmpty() else edges.join(F.broadcast(hubs), "src", "left_semi")
    rank = start.select("host", F.col("jump").alias("rank"))
    seen = rank
    i = 0
    while True:
        given = plain.join(rank, plain.src == rank.host).select("dst", (F.col("share") * F.col("rank")).alias("got"))
        if from_hubs is not None:
            of_hubs = F.broadcast(rank.join(F.broadcast(hubs), rank.host == hubs.src, "left_semi"))
            given = given.unionByName(from_hubs.join(of_hubs, from_hubs.src == of_hubs.host).select("dst", (F.col("share") * F.col("rank")).alias("got")))
        sent = given.groupBy("dst").agg(F.sum("got").alias("got"))
        rank = sent.select(F.col("dst").alias("host"), (F.col("got") * damping).alias("rank")).unionByName(
            start.select("host", (F.col("jump") * (1 - damping)).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        i += 1
        if i % cut_every == 0 or i % rounds == 0:
            rank = materialise(rank, "host-rank")
        if i % rounds == 0:
            both = rank.join(seen.select("host", F.col("rank").alias("was")), "host", "left")
            moved = both.agg(F.max(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))) - SETTLED * F.col("rank"))).first()[0]
            if moved is None or moved <= 0:
                break
            seen = rank
    return rank


def with_shares(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """A verdict for every row of ``pages``: the longest rule's, else the host's.

    Trust starts at hosts with allowed pages and follows links; distrust starts at hosts
    with blocked pages and goes against links, to those that link to them. A host is
    blocked if distrust is more than ``threshold`` of its trust and distrust together;
    a host that neither reaches is allowed. A url that is null or has no ``://`` has
    an empty host and path and is allowed. Repeated rows are judged each; an empty table
    gives an empty result; extra columns are ignored. Returns page_id, host, path, rule,
    verdict, trust, distrust.
    """
    host, path = host_of(doc_column(pages, "url", "string")), path_of(doc_column(pages, "url", "string"))
    placed = pages.select(doc_column(pages, "page_id", "long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "by_rule": verdict})
    seeds = materialise(
        ruled.where("host != ''").groupBy("host").agg(
            F.sum((F.col("by_rule") == "allow").cast("double")).alias("allowed"),
            F.sum((F.col("by_rule") == "block").cast("double")).alias("blocked"),
            F.count(F.lit(1)).alias("pages")), "host-seeds")
    edges = materialise(host_edges(pages), "host-edges")
    forward = materialise(with_shares(edges), "host-forward")
    backward = materialise(with_shares(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "host-backward")
    seed = lambda c: seeds.where(F.col(c) > 0).select("host", F.col(c).alias("seed"))
    trust = personalised_rank(forward, seed("allowed"), rounds).withColumnRenamed("rank", "trust")
    distrust = personalised_rank(backward, seed("blocked"), rounds).withColumnRenamed("rank", "distrust")
    hosts = seeds.select("host", "pages").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    hosts = hosts.withColumn("by_host", F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit("block")).otherwise(F.lit("allow")))
    # A host with very many pages is no hot key, and pages without a host are joined with nothing.
    judged = join_counted(ruled.where("host != ''"), materialise(hosts, "judged-hosts"), ["host"], "pages", placed.count())
    judged = judged.unionByName(ruled.where("host = ''"), allowMissingColumns=True)
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
