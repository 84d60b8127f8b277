"""URL filters with link-graph propagation, with DataFrame functions only.

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
Where none fits, the host decides. Links between hosts (absolute and protocol-relative `href` targets of the pages) are
counted; trust flows from hosts along their links (personalised PageRank, seeded with the pages that rules allow) and
distrust flows against the links, from a host to those that link to it (seeded with the pages that rules block). Mass of
hosts without a link in that direction returns to the seeds. A host is blocked if its distrust share,
distrust / (trust + distrust), is at least `threshold`; hosts that neither reaches are allowed.

Edges are summed by host pair before the rounds, so a host with a third of all pages is one row a linked host. State is
written to the shared folder after each round; the rounds end when no score moves by `tolerance`, or after `rounds`.

Defined cases: a null url or one without `://` has an empty host and path and no rule fits; the empty host has no links
and is allowed; null html has no links; repeated rows are each judged and each count as a seed; an empty table gives an
empty result; columns named like a result are replaced, others pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import written

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are tried one by one on each row; longer lists belong into a table.
MAX_RULES = 1000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first `://`."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def ruled(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """`pages` (with host and path) and the rule that decides, with its verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):  # later ones, being longer, win
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    targets = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _CAPITALS, _SMALL)).where("src <> dst AND src <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) from seed weights (host, good, bad) and edges (src, dst, n)."""
    nodes = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    sums = seeds.agg(F.sum("good"), F.sum("bad")).first()
    share = lambda c, total: F.coalesce(F.col(c) / F.lit(float(total)), F.lit(0.0)) if total else F.lit(0.0)
    start = nodes.join(seeds, "host", "left").select("host", share("good", sums[0]).alias("good"), share("bad", sums[1]).alias("bad"))
    out = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    flows = written(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out_n")).alias("along"), (F.col("n") / F.col("in_n")).alias("against")))
    ends = start.join(out.select(F.col("src").alias("host"), F.lit(True).alias("sends")), "host", "left")
    ends = ends.join(into.select(F.col("dst").alias("host"), F.lit(True).alias("receives")), "host", "left")
    state = written(ends.select("host", "good", "bad", F.col("sends").isNull().alias("no_out"), F.col("receives").isNull().alias("no_in"), F.col("good").alias("trust"), F.col("bad").alias("distrust")))
    for _ in range(rounds):
        lost = state.agg(F.sum(F.when(F.col("no_out"), F.col("trust"))), F.sum(F.when(F.col("no_in"), F.col("distrust")))).first()
        loose = [float(x or 0.0) for x in lost]
        ahead = flows.join(state.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("along")).alias("t"), F.lit(0.0).alias("d"))
        behind = flows.join(state.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("against")).alias("d"))
        inflow = ahead.union(behind).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        mixed = lambda flow, seed, lost: damping * F.coalesce(F.col(flow), F.lit(0.0)) + (1 - damping + damping * lost) * F.col(seed)
        new = state.join(inflow, "host", "left").withColumns({"new_t": mixed("t", "good", loose[0]), "new_d": mixed("d", "bad", loose[1])})
        new = new.withColumn("moved", F.greatest(F.abs(F.col("new_t") - F.col("trust")), F.abs(F.col("new_d") - F.col("distrust"))))
        done = written(new.select("host", "good", "bad", "no_out", "no_in", F.col("new_t").alias("trust"), F.col("new_d").alias("distrust"), "moved"))
        state = done.drop("moved")
        if (done.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("host", "trust", "distrust")


def filtered(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html", threshold: float = 0.5) -> DataFrame:
    """`pages` with host, path, rule, verdict, and the host's trust and distrust."""
    base = pages.drop("host", "path", "rule", "verdict", "trust", "distrust", "rule_verdict")
    judged = ruled(base.withColumns({"host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit(""))}), rules)
    count = lambda v: F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0))
    seeds = judged.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad"))
    scores = propagated(written(seeds), written(host_links(judged, html))).withColumnsRenamed({"host": "_host_"})
    out = judged.join(scores, judged["host"] == scores["_host_"], "left").drop("_host_")
    bad = F.coalesce(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), F.lit(0.0))
    return out.withColumn("verdict", F.coalesce("rule_verdict", F.when(bad >= threshold, "block").otherwise("allow"))).drop("rule_verdict")
