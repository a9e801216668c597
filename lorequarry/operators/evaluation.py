"""Search modes judged by cases, and statistics over groups that no built-in expresses."""

from __future__ import annotations

import random
import statistics
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.stats import wilson

DRAWS, SEED = 2000, 0


def interval(values: list[float], draws: int = DRAWS, seed: int = SEED) -> tuple[float, float]:
    """Ends of the 95 % bootstrap interval of the median; no values give (0, 0)."""
    if not values:
        return 0.0, 0.0
    rng = random.Random(seed)
    medians = sorted(statistics.median(rng.choices(values, k=len(values))) for _ in range(draws))
    return medians[int(0.025 * draws)], medians[int(0.975 * draws) - 1]


def bootstrap_interval(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low, high): groups are summaries (a value per pair of runs or day), small by construction."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = sorted(part[value].tolist())
        low, high = interval(values)
        return pd.DataFrame({group: [part[group].iloc[0]], "n": [len(values)], "low": [round(low, 6)], "high": [round(high, 6)]})

    return rows.select(group, value).groupBy(group).applyInPandas(one, f"{group} string, n long, low double, high double")


#: Ranks that a case looks at, ranks that count as found, and the share of right answers below the threshold.
DEPTH, TOP, LOW_SHARE = 10, 5, 0.1
#: Below so many tasks no comparison is conclusive, and the labels of the rest.
MIN_TASKS, OPEN, SAVES, SAVES_NOT = 10, "inconclusivo", "economiza", "não economiza"


def judged(cases: DataFrame, relevant: DataFrame, hits: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Each case in each mode: (mode, query_id, class, difficulty, answerable, first, ndcg, top).

    ``cases`` (query_id, class, difficulty), ``relevant`` (query_id, doc_id), ``hits`` (mode, query_id, rank, doc_id, score).
    A document gains once, at its first place, however many hits it has. A case without relevant documents is one
    that has no answer. A case without hits keeps its row, with a null first place and a gain of zero.
    """
    wanted = relevant.select("query_id", "doc_id").distinct()
    counts = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
    shown = hits.where(F.col("rank").between(1, DEPTH))
    places = shown.groupBy("mode", "query_id", "doc_id").agg(F.min("rank").alias("rank")).join(wanted, ["query_id", "doc_id"])
    gains = places.groupBy("mode", "query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    best = shown.where("rank = 1").groupBy("mode", "query_id").agg(F.max("score").alias("top"))
    every = cases.select("query_id", "class", "difficulty", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    rows = every.join(counts, "query_id", "left").join(gains, ["mode", "query_id"], "left").join(best, ["mode", "query_id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(DEPTH)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ndcg = F.when(F.col("n").isNotNull(), F.coalesce(F.col("gain") / ideal, F.lit(0.0)))
    return rows.select("mode", "query_id", "class", "difficulty", F.col("n").isNotNull().alias("answerable"), "first", ndcg.alias("ndcg"), "top")


def mode_metrics(rows: DataFrame) -> DataFrame:
    """One row per mode: recall at 5 with its interval, MRR, nDCG at 10, and what cases without an answer would be shown.

    The threshold is the tenth percentile of the best scores of cases that were answered right; a case without an answer
    whose best score reaches it would pass for a right answer. Without right answers there is no threshold.
    """
    hit = F.col("answerable") & F.coalesce(F.col("first") <= TOP, F.lit(False))
    base = rows.withColumn("hit", hit)
    limit = base.groupBy("mode").agg(F.expr(f"percentile_disc({LOW_SHARE}) WITHIN GROUP (ORDER BY CASE WHEN hit THEN top END)").alias("threshold"))
    none = ~F.col("answerable")
    over = none & F.coalesce(F.col("top") >= F.col("threshold"), F.lit(False))
    mean = lambda x: F.coalesce(F.avg(F.when(F.col("answerable"), x)), F.lit(0.0))
    per = base.join(limit, "mode").groupBy("mode", "threshold").agg(
        F.count_if("answerable").alias("cases"), F.count_if("hit").alias("hits"), mean(F.col("hit").cast("double")).alias("recall_at_5"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), mean(F.col("ndcg")).alias("ndcg_at_10"),
        F.count_if(none).alias("no_answer_cases"), F.count_if(over).alias("false_positives"),
    )
    low, high = wilson(F.col("hits"), F.col("cases"))
    return per.withColumns({"low": low, "high": high})


def mode_groups(rows: DataFrame) -> DataFrame:
    """(mode, by, key, hits, cases) of answerable cases by class and by difficulty."""
    each = F.explode(F.array(*[F.struct(F.lit(by).alias("by"), F.col(by).alias("key")) for by in ("class", "difficulty")])).alias("g")
    hit = F.coalesce(F.col("first") <= TOP, F.lit(False))
    return rows.where("answerable").select("mode", hit.alias("hit"), each).groupBy("mode", "g.by", "g.key").agg(F.count_if("hit").alias("hits"), F.count("*").alias("cases"))


def failures(rows: DataFrame) -> DataFrame:
    """(mode, query_id, first) of answerable cases whose first relevant document is late or missing."""
    return rows.where(F.col("answerable") & ~F.coalesce(F.col("first") <= TOP, F.lit(False))).select("mode", "query_id", "first")


def savings(runs: DataFrame, base: str) -> DataFrame:
    """(arm, task, rep, saving) against a base arm, of runs (arm, task, rep, billable, hit, error): only pairs where both found the file.

    Of repeated runs of an arm the one with the fewest tokens counts. Runs with an error, and a base that cost nothing, make no pair.
    """
    good = runs.where("error IS NULL").groupBy("task", "rep", "arm").agg(F.min(F.struct(F.col("billable"), F.col("hit"))).alias("r"))
    first = good.where(F.col("arm") == base).select("task", "rep", "r.*").where("hit AND billable > 0").select("task", "rep", F.col("billable").alias("was"))
    rest = good.where(F.col("arm") != base).select("task", "rep", "arm", "r.*").where("hit")
    return first.join(rest, ["task", "rep"]).select("arm", "task", "rep", ((F.col("was") - F.col("billable")) / F.col("was")).alias("saving"))


def comparisons(runs: DataFrame, base: str, tasks: int) -> DataFrame:
    """(arm, pairs, median, q1, q3, low, high, label): what an arm saves, with the interval that decides whether it is told.

    Few tasks or an interval around zero leave a comparison open.
    """
    pairs = savings(runs, base)
    stats = pairs.groupBy("arm").agg(F.count("*").alias("pairs"), *[F.percentile("saving", q).alias(name) for name, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))])
    rows = stats.join(bootstrap_interval(pairs, "arm", "saving").drop("n"), "arm")
    open_ = (F.lit(tasks) < MIN_TASKS) | ((F.col("low") <= 0) & (F.col("high") >= 0))
    return rows.withColumn("label", F.when(open_, OPEN).when(F.col("median") > 0, SAVES).otherwise(SAVES_NOT))
