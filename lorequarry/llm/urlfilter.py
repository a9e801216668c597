"""URL filter: rules, and beyond them trust and distrust that spread over the host graph.

Rules name a host and a path prefix; a rule fits its host and all subdomains if the path starts with its prefix, and the
longest fitting rule decides. Where none fits, the host decides. Edges between hosts are the links found in pages, and ties
between a host and its parent domain. Seeds come from the rules: a host is a trusted seed to the share of its pages that a
rule allows, a blocked seed to the share that one blocks. Trust is personalised PageRank from the trusted
seeds along edges, ``t = (1 - a) s + a * sum over u -> v of w(u, v) t(u)``; distrust is the same from the blocked seeds
along reversed edges, so a host that links to blocked ones is distrusted. Each direction's weights sum to one at their
source, and both scores are scaled by ``1 - a``, so that a host's own seed counts in full.

A host is blocked when distrust less trust is at or above a threshold. The threshold is learned from hosts held out: scores
are also spread from the seeds of one half of the hosts (dealt by a hash of the name), so the other half has only what its
neighbours send, as a host without a rule does; of all thresholds the one that tells its blocked from its allowed pages best,
by the mean of both recalls, is taken; of equals the highest, which blocks least. It is above zero, so a host without
evidence is allowed. Where the held-out half lacks a class, ``THRESHOLD`` stands in.

Ranks are DataFrames of one row per node; an iteration is a join on the edge's source and a sum per target, so a hub is
pre-aggregated and its join can be split. Iterations stop when no rank moves by more than ``TOLERANCE``.

Defined results: a null url, and one without ``://``, has empty host and path, no rule and the verdict allow; null html has
no links; repeated rows are judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import BROADCAST_ROWS, ascii_lower
from lorequarry.session import cut

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.5, 40, 1e-3, 0.25
#: Steps of the learned threshold over a margin of -1 to 1, which bounds its histogram.
STEPS = 200
#: Rounds between cuts of the lineage; convergence is looked at there.
EVERY = 4
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_: Column, path_: Column, rules) -> Column:
    """The longest rule that fits (rules are a bounded list), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host_ == domain) | host_.endswith(f".{domain}")) & path_.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(kind, src, dst, w): edges along which trust and distrust flow; the weights of a kind at a source sum to one."""
    named = pages.where("host <> ''")
    links = named.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"))
    links = links.select("src", F.regexp_replace(ascii_lower(F.col("to")), r"^.*@|:\d*$", "").alias("dst"))
    child = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("parent")).where("instr(parent, '.') > 0 AND host <> parent")
    ties = child.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(child.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    counts = links.unionByName(ties).where("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    ways = F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))
    directed = cut(counts.select(F.explode(ways).alias("e"), "n").select("e.kind", F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "n"))
    total = directed.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    return cut(directed.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score, half): personalised PageRank of ``seeds`` (kind, host, score, half) over ``edges`` (kind, src, dst, w), scaled by 1 - damping.

    Kinds do not mix, and the two columns of seeds spread side by side.
    """
    columns = ("score", "half")
    now = before = cut(seeds)
    for k in range(1, rounds + 1):
        sent = edges.join(now.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(*[F.sum(F.col("w") * F.col(c) * damping).alias(f"got_{c}") for c in columns])
        before, now = now, seeds.join(sent, ["kind", "host"], "full_outer").select("kind", "host", *[(F.coalesce(c, F.lit(0.0)) + F.coalesce(f"got_{c}", F.lit(0.0))).alias(c) for c in columns])
        if k % EVERY == 0 or k == rounds:
            now = cut(now)
            old = before.select("kind", "host", *[F.col(c).alias(f"old_{c}") for c in columns])
            moved = now.join(old, ["kind", "host"], "left").agg(F.max(F.greatest(*[F.abs(F.col(c) - F.coalesce(f"old_{c}", F.lit(0.0))) for c in columns]))).first()[0]
            if (moved or 0.0) <= tolerance:
                break
    return now


def learned(counts: list[tuple[int, int, int]]) -> float:
    """The threshold that tells held-out pages best, of (step of the margin, blocked pages, allowed pages)."""
    blocked, allowed = sum(b for _, b, _ in counts), sum(a for _, _, a in counts)
    if not blocked or not allowed:
        return THRESHOLD
    best, at, caught, spared = 0.5, 2.0, 0, allowed  # a threshold of 2 blocks none
    for step, b, a in sorted(counts, reverse=True):
        caught, spared = caught + b, spared - a
        told = (caught / blocked + spared / allowed) / 2
        if step > 0 and told > best + 1e-12:
            best, at = told, step / STEPS
    return at


def judge(pages: DataFrame, rules=RULES, threshold: float | None = None) -> DataFrame:
    """Per row of (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust. Without a threshold it is learned."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule]) if rules else F.create_map()
    ruled = ruled.withColumn("said", F.when(F.col("rule").isNotNull(), F.try_element_at(verdicts, F.col("rule"))) if rules else F.lit(None).cast("string"))
    is_ = lambda what: F.coalesce(F.col("said"), F.lit("")) == what
    share = lambda what: F.avg(is_(what).cast("double"))
    ruled_pages = lambda what: F.sum(is_(what).cast("long"))
    kinds = {"trust": "allow", "distrust": "block"}
    measures = [f(what).alias(f"{name}_{what}") for what in kinds.values() for name, f in (("score", share), ("pages", ruled_pages))]
    hosts = ruled.where("host <> ''").groupBy("host").agg(*measures)
    # half of the hosts seed what the threshold is learned from; the others, held out whole, only receive
    seeding = F.crc32(F.col("host").cast("binary")) % 2 == 0
    halves = [F.when(seeding, F.col(f"score_{what}")).otherwise(F.lit(0.0)).alias(f"half_{what}") for what in kinds.values()]
    hosts = cut(hosts.select("host", *[f"score_{what}" for what in kinds.values()], *halves, *[F.when(seeding, 0).otherwise(F.col(f"pages_{what}")).alias(f"left_{what}") for what in kinds.values()]))
    seeds = None
    for kind, what in kinds.items():
        one = hosts.select(F.lit(kind).alias("kind"), "host", F.col(f"score_{what}").alias("score"), F.col(f"half_{what}").alias("half")).where("score > 0")
        seeds = one if seeds is None else seeds.unionByName(one)
    ranks = spread(host_edges(rows, hosts), seeds).groupBy("host").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(n) for k in kinds for c, n in (("score", k), ("half", f"half_{k}"))])
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    ranks = cut(hosts.join(ranks, "host", "left").select("host", "left_block", "left_allow", *[zero(c).alias(c) for c in ("trust", "distrust")], (zero("half_distrust") - zero("half_trust")).alias("margin")))
    if threshold is None:
        step = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("margin"))) * STEPS).cast("int")
        found = ranks.groupBy(step.alias("step")).agg(F.sum("left_block").alias("b"), F.sum("left_allow").alias("a")).collect()  # at most 2 * STEPS + 1 rows
        threshold = learned([(r.step, r.b, r.a) for r in found])
    few = ranks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else a shuffled join
    of_host = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold, "block").otherwise("allow")
    ranks = ranks.select("host", "trust", "distrust")
    return ruled.drop("html").join(F.broadcast(ranks) if few else ranks, "host", "left").select("page_id", "host", "path", "rule", F.when(F.col("host") == "", "allow").otherwise(F.coalesce("said", of_host)).alias("verdict"), "trust", "distrust")
