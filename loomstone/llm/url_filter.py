"""URL filters: rules first, then trust and distrust that spread over the host graph.

A URL is judged by the longest rule that fits its host and path. Hosts whose URLs no rule fits are judged by link-graph
propagation: personalised PageRank from trusted hosts (those that an allow rule fits) along links, and from blocked hosts
against the direction of links, so that hosts which link to blocked ones are distrusted. Both take their steps together, over one
table of directed edges. The rank is the series of what a seed passes on over 0, 1, 2, ... links: a step moves only what has just
arrived, so it is a join of the hosts reached last with their edges and a grouped sum, combined before the shuffle. What arrives at a host in one step and is no
more than TOLERANCE is not passed on; a step passes on DAMPING of the mass at most, so the series ends by itself, however long
the chains of links are. Hosts with more than one in HOT_SHARE of all links (fewer than HOT_SHARE) have their scores sent to their edges. Seeds,
scores and edges stay in Spark. A host is blocked when its distrust exceeds its trust by the factor BLOCK_RATIO; hosts without
evidence are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import HOT_SHARE, ascii_lower, join_split, plain, release, staged

#: Fixed rules of the contract: (verdict, rule).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
DAMPING = 0.85
TOLERANCE = 1e-4
BLOCK_RATIO = 1.0
LINK = r"""(?i)\bhref\s*=\s*["']?([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. Of equally long rules the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs of the pages' absolute links to other hosts."""
    bare, own = plain(pages)
    src, _ = host_and_path(F.col(own["url"]).cast("string"))
    found = F.regexp_extract_all(F.coalesce(F.col(own["html"]).cast("string"), F.lit("")), F.lit(LINK), F.lit(2))
    each = bare.select(src.alias("src"), F.explode(F.array_distinct(F.transform(found, ascii_lower))).alias("dst"))
    return each.filter((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score): personalised PageRank from the seeds (kind, host) along (kind, src, dst), for every kind apart.

    Every seed starts with 1 - damping; score that reaches a host without links ends there. edges should be staged.
    """
    degree = edges.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    shares = staged(join_split(edges, degree, ["kind", "src"], "degree"), "pagerank-edges")
    limit = shares.count() / HOT_SHARE
    hubs = shares.filter(F.col("degree") > limit)
    hub_hosts = staged(hubs.select("kind", "src").distinct(), "pagerank-hubs")
    some_hubs = not hub_hosts.isEmpty()
    others = shares.filter(F.col("degree") <= limit)
    reached = [staged(seeds.select("kind", F.col("host").alias("src"), F.lit(1.0 - damping).alias("score")), "pagerank-step")]
    while not reached[-1].isEmpty():
        met = others.join(reached[-1], ["kind", "src"])
        if some_hubs:
            far = reached[-1].join(F.broadcast(hub_hosts), ["kind", "src"], "left_semi")
            met = met.unionByName(hubs.join(F.broadcast(far), ["kind", "src"]))
        moved = met.groupBy("kind", F.col("dst").alias("src")).agg(F.sum(damping * F.col("score") / F.col("degree")).alias("score"))
        reached.append(staged(moved.filter(F.col("score") > tolerance), "pagerank-step"))
    every = reached[0]
    for step in reached[1:]:
        every = every.unionByName(step)
    out = staged(every.groupBy("kind", F.col("src").alias("host")).agg(F.sum("score").alias("score")), "pagerank-scores", *reached)
    release(shares)
    return out


def host_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that trust or distrust reaches."""
    bare, own = plain(pages)
    host, path = host_and_path(F.col(own["url"]).cast("string"))
    _, verdict = matched_rule(host, path, rules)
    hosts = bare.select(host.alias("host"), verdict.alias("kind")).filter("host != '' and kind is not null").distinct()
    seeds = staged(hosts, "hosts-seeds")
    links = host_edges(pages)
    forth = links.select(F.lit("allow").alias("kind"), "src", "dst")
    back = links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = staged(forth.unionByName(back), "hosts-edges")
    scores = propagate(edges, seeds)

    def of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))

    both = scores.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") > BLOCK_RATIO * F.col("trust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, trust and distrust.

    Null URLs and URLs without `://` have empty host and path and are allowed. Null html has no links; URLs and html of any length are
    read whole. Repeated rows each keep a row and count once as links. Of equally long rules the first listed wins; a host whose
    distrust equals its trust is allowed. No rows in: no rows out. Other columns, whatever their names, are ignored.
    """
    bare, own = plain(pages)
    host, path = host_and_path(F.col(own["url"]).cast("string"))
    parsed = bare.select(F.col(own["page_id"]).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parsed = staged(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "hosts-pages")
    counts = parsed.groupBy("host").agg(F.count("*").alias("n"))
    met = join_split(parsed, staged(counts.join(host_verdicts(pages, rules), "host", "left"), "hosts-verdicts"), ["host"], "n")
    by_host = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    zero = F.lit(0.0)
    return met.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
