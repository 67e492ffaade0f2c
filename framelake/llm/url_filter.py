"""URL filter by link-graph propagation, in DataFrame operations alone.

Rules (a host and a path) decide the urls they fit; the longest fitting rule
wins. The rest are judged by their host: trust is a personalised PageRank
over host edges from trusted seeds, distrust one over the reversed edges from
blocked seeds. Seeds are hosts of whose pages more than half are allowed, or
blocked, by rules. A host is blocked if its share distrust / (trust +
distrust) is above ``THRESHOLD``; a host that neither reaches is allowed.

Edges come from absolute links in the pages' html (comments, scripts and styles aside), each weighted by its part of
the source's links to other hosts; links within a host don't count. Mass at hosts without links
returns to the seeds (by normalising at the end, which is the same). Both
propagations run in one loop, whose state is a row for each seed-reachable host
in the shared folder; two numbers a round come to the driver. It ends when what all ranks moved by is small and
no host is new or has moved by much of its own rank, so long chains are followed to their ends. Pages of one host are
counted before they are shuffled; the hosts of more than 1 / ``HOT`` of all pages (fewer than ``HOT``, so a bounded
broadcast) meet their verdicts without a shuffle.

Defined results: a url that is null or has no ``://`` has an empty host and
path, no rule, and is allowed. Null html has no links. Repeated rows are judged
alike and each counts in weights. An empty table gives no rows. Columns other than page_id, url
and html are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._scratch import Scratch

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-4
#: Of its rank, what any host's may still have moved by when propagation ends.
SHARE = 0.01
#: Of all pages, the part that makes a host's pages meet their verdict where they are.
HOT = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a browser shows no links of.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
#: Absolute links, and those that leave out the scheme alone; the group is the host.
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def lower(c: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    shown = F.when(F.col("html").contains("//"), F.regexp_replace("html", _HIDDEN, " ")).otherwise(F.lit(""))
    links = F.explode(F.array_distinct(F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1))))
    return (
        pages.where("url IS NOT NULL AND html IS NOT NULL")
        .select(host_of(F.col("url")).alias("src"), links.alias("dst"))
        .select("src", lower(F.col("dst")).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Ranks (kind, host, rank) by kind, of sum 1 each, of edges (kind, src, dst, weight) and seeds (kind, host, rank)."""
    total = seeds.groupBy("kind").agg(F.sum("rank").alias("total"))
    start = scratch.keep(seeds.join(total, "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("seed")))
    ranks = scratch.keep(start.df.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank")))
    while True:
        now = ranks.df
        for _ in range(2):
            flow = edges.join(now.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (damping * F.col("weight") * F.col("rank")).alias("rank")
            )
            now = (
                flow.unionByName(start.df.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank")))
                .groupBy("kind", "host")
                .agg(F.sum("rank").alias("rank"))
            )
        after = scratch.keep(now)
        # ranks grow from the seeds on, so a host that has one keeps it
        was = F.coalesce("was", F.lit(0.0))
        moved = (
            after.df.join(ranks.df.withColumnRenamed("rank", "was"), ["kind", "host"], "left")
            .agg(F.sum(F.abs(F.col("rank") - was)), F.count_if(F.abs(F.col("rank") - was) > SHARE * F.col("rank")))
            .first()
        )
        ranks.drop()
        ranks = after
        if (moved[0] or 0.0) <= tolerance and not moved[1]:
            break
    whole = ranks.df.groupBy("kind").agg(F.sum("rank").alias("whole"))
    return ranks.df.join(whole, "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every url."""
    scratch = Scratch(pages.sparkSession)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("by_rule", verdict)

    hosts = (
        urls.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"),
            F.count_if(F.col("by_rule") == "block").alias("blocked")
        )
    )
    hosts = scratch.keep(hosts).df
    seeds = hosts.select(
        "host",
        F.when(F.col("allowed") * 2 > F.col("n"), F.lit("trust")).when(F.col("blocked") * 2 > F.col("n"), F.lit("distrust")).alias("kind"),
        F.lit(1.0).alias("rank")
    ).where("kind IS NOT NULL")
    links = scratch.keep(host_edges(pages)).df
    out = links.groupBy("src").agg(F.sum("n").alias("whole"))
    back = links.groupBy("dst").agg(F.sum("n").alias("whole"))
    edges = (
        links.join(out, "src")
        .select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("whole")).alias("weight"))
        .unionByName(
            links.join(back, "dst").select(
                F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"),
                (F.col("n") / F.col("whole")).alias("weight")
            )
        )
    )
    ranks = propagate(scratch.keep(edges).df, seeds, scratch)

    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    known = scratch.keep(ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))).df
    # at most HOT hosts have more than that part of all pages: their verdicts go to the pages, whose other hosts are joined
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = (
        hosts.where(F.col("n") * HOT > whole)
        .select("host")
        .join(known, "host", "left")
        .select(F.col("host").alias("hot"), F.struct(F.col("trust").alias("t"), F.col("distrust").alias("d")).alias("own"))
    )
    joined = urls.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull() & (F.col("host") != ""), F.col("host")).otherwise(
        F.concat(F.lit("/"), F.xxhash64("page_id", "path").cast("string"))
    )
    joined = joined.withColumn("key", key).join(known.withColumnRenamed("host", "key"), "key", "left")
    trust, distrust = F.coalesce(F.col("own.t"), "trust", F.lit(0.0)), F.coalesce(F.col("own.d"), "distrust", F.lit(0.0))
    by_host = F.when(distrust > threshold * (trust + distrust), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"),
        distrust.alias("distrust")
    )
