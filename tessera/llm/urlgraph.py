"""URL filters: path rules first, then link-graph propagation over hosts.

Trust flows from trusted seed hosts along links, distrust from blocked seed hosts against them, both as personalised
PageRank with teleport weight 1 - damping at each seed. Distrust shares a seed's weight out over all who link to it, so
the verdict is by exposure instead: the discounted probability that a walk along a host's own links comes to a blocked
seed (1 at a seed). It doesn't depend on how many others link to the seed. A host whose exposure reaches the threshold's
share of a seed's own weight and exceeds its trust is blocked. Seeds come from the rules alone, or from a table passed
in; a host that no rule fits and no links lead to a blocked one is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HotKeys, ascii_lower, checkpoint, lookup_join, materialize

#: (action, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Distrust from which a host is blocked: half of what a blocked seed has by itself.
THRESHOLD = 0.5 * (1 - DAMPING)
#: Scores are iterated until none moves by more than this, and compared at DIGITS decimals. A round shrinks what is left
#: by the damping at least, so the rounds needed are bounded; more of them are an error.
TOLERANCE = 1e-11
DIGITS = 9
#: Rounds between two checkpoints.
STEPS = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where :// is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def _fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith("." + rule_host)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(id, host, path, rule, action, links) of every row; the longest fitting rule wins."""
    host, path = host_and_path(F.col("_url"))
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"), F.col(html_col).alias("html"))
    out = out.select("id", host.alias("host"), path.alias("path"), linked_hosts(F.col("html")).alias("links"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one overrides
        fits = _fits(F.col("host"), h) & F.col("path").startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return out.select("id", "host", "path", rule.alias("rule"), action.alias("action"), "links")


def linked_hosts(html: Column) -> Column:
    """Hosts that a page's links name (A-Z lower-cased), repeats included."""
    refs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>/?#]+)"), F.lit(1))
    return F.transform(refs, lambda r: ascii_lower(F.regexp_extract(r, r"//(.*)$", 1)))


def host_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, n) of links between different hosts, from rows (host, links); links within a host carry nothing on."""
    links = rows.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(hosts: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, more: DataFrame | None = None) -> DataFrame:
    """(kind, host, seed): distrust seeds are hosts that a rule blocks whole, trust seeds the others that an allow rule
    names; ``more`` (host, action) adds hosts that are known otherwise, where block goes before allow."""
    h = F.col("host")
    blocked, trusted = F.lit(False), F.lit(False)
    for act, rule_host, path in rules:
        if act == "block" and path in ("", "/"):
            blocked = blocked | _fits(h, rule_host)
        elif act == "allow":
            trusted = trusted | _fits(h, rule_host)
    if more is not None:
        known = more.where("host is not null and action in ('block', 'allow')").groupBy("host").agg(F.max("action").alias("action"))
        hosts = hosts.join(known, "host", "left")
        blocked, trusted = blocked | F.coalesce(F.col("action") == "block", F.lit(False)), trusted | F.coalesce(F.col("action") == "allow", F.lit(False))
    both = hosts.select(F.explode(F.array(F.struct(F.lit("distrust").alias("kind"), blocked.alias("is")), F.struct(F.lit("trust").alias("kind"), (trusted & ~blocked).alias("is")))).alias("s"), "host")
    return both.select("s.kind", "host", F.col("s.is").cast("double").alias("seed"))


def propagate(edges: DataFrame, seeded: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) by power iteration of all walks (trust, distrust, exposure) at once; what reaches a host
    without onward links ends there.

    A round is one join of the edges with the scores, hub hosts apart, and one sum per host; every STEPS rounds are
    checkpointed, until no score moves by more than ``tolerance``."""
    ends = seeded.where("kind = 'distrust' and seed > 0").select(F.col("host").alias("src"))
    share = lambda by: HotKeys(edges, by).join(edges.groupBy(by).agg(F.sum("n").alias("all"))).select("src", "dst", (F.col("n") / F.col("all") * damping).alias("p"))
    along = share("src")
    against = share("dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "p")
    exposed = along.join(ends, "src", "left_anti").select(F.lit("exposure").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "p")  # the walk ends at a seed
    steps = along.select(F.lit("trust").alias("kind"), "src", "dst", "p").union(against).union(exposed)
    key = F.concat_ws(":", "kind", "src").alias("from")
    steps = materialize(steps.select(key, "kind", "dst", "p"), "urlgraph-steps")
    seeded = seeded.union(seeded.where("kind = 'distrust'").select(F.lit("exposure").alias("kind"), "host", "seed"))
    base = F.when(F.col("kind") == "exposure", F.col("seed")).otherwise((1 - damping) * F.col("seed"))
    scores = checkpoint(seeded.select("kind", "host", "seed", base.alias("score")))
    if steps.isEmpty():
        return scores.select("kind", "host", "score")
    step = HotKeys(steps, "from")
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping) / STEPS) + 2):
        for _ in range(STEPS):
            sent = scores.where("score > 0").select(F.concat_ws(":", "kind", "host").alias("from"), "score")
            inflow = step.join(sent).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("p") * F.col("score")).alias("inflow"))
            scores = scores.select("kind", "host", "seed", F.col("score").alias("old")).join(inflow, ["kind", "host"], "left")
            scores = scores.select("kind", "host", "seed", "old", (base + F.coalesce("inflow", F.lit(0.0))).alias("score"))
        scores = checkpoint(scores)
        moved = scores.agg(F.max(F.abs(F.col("score") - F.col("old"))).alias("m")).first().m
        if moved is None or moved <= tolerance:
            return scores.select("kind", "host", "score")
    raise RuntimeError("scores didn't settle within the rounds that the damping allows")


def host_verdicts(rows: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, more: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, exposure, host_verdict) of every host of a page or link, from rows (host, links)."""
    edges = materialize(host_edges(rows), "urlgraph-edges")
    hosts = rows.select("host").union(edges.select(F.col("dst"))).where("host <> ''").distinct()
    scores = propagate(edges, seeds(hosts, rules, more))
    wide = scores.groupBy("host").agg(*[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust", "exposure")])
    bad = (F.round("exposure", DIGITS) >= round(threshold / (1 - DAMPING), DIGITS)) & (F.round("exposure", DIGITS) > F.round("trust", DIGITS))
    return wide.select("host", *[F.round(k, 6).alias(k) for k in ("trust", "distrust", "exposure")], F.when(bad, "block").otherwise("allow").alias("host_verdict"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", more: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict, trust, distrust, exposure.

    Null urls and those without :// have an empty host and path, no rule, and are allowed. Null html has no links.
    Repeated rows each come back (and count their links twice). An empty table gives none; other columns are left out,
    whatever they are called. Pages are read once; further seeds may come as ``more`` (host, action)."""
    rows = materialize(parsed(pages, id_col, url_col, html_col), "urlgraph-pages")
    verdicts = materialize(host_verdicts(rows, more=more), "urlgraph-hosts")
    out = lookup_join(rows.drop("links"), verdicts, "host")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust", "exposure")
