"""Contracts between projects: what they provide and consume, linked by a confidence cascade.

``surfaces`` extracts items (project, kind, direction, normalized, confidence, contract) from source texts. ``link`` matches
each consumed item with the surest provider of another project; failing that, a provider of the same route under another verb
is a divergence; packages without a provider are outside the workspace; the rest is unresolved. Links below the least
confidence are suggestions. A contract that very many projects provide costs no pairs: per contract only the best provider
and the best of another project go into the join.

Defined results: null projects, kinds or names are no items; repeated items count once, with their greatest confidence; ties
of confidence go to the smaller project; an item is never linked to its own project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as T

#: Confidences and relation names are fixed values: results must equal those of the behaviour that they reproduce.
CONTRACT, METHOD_PATH, NAME, EXTRACTED = 1.0, 0.95, 0.8, 0.85
RELATIONS = (("http", "consumes"), ("package", "depends_on"), ("table", "depends_on"), ("event", "subscribes"))
LEAST = 0.6
VERBS = "get|post|put|delete|patch"
KEY = ["kind", "normalized"]


def surfaces(files: DataFrame) -> DataFrame:
    """Items of texts (project, text): routes declared and called, events published and subscribed, packages imported."""
    found = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    http = lambda pattern: F.zip_with(found(pattern, 1), found(pattern, 2), lambda v, r: F.concat_ws(" ", F.upper(v), T.route(F.regexp_replace(r, r"^\w+://[^/]+", ""))))
    quoted = r"\(\s*f?[\"']([^\"']+)[\"']"
    event = lambda verb: found(rf"\.{verb}{quoted}", 1)
    packages = F.transform(found(r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w*)", 1), F.lower)
    kinds = (
        ("http", "provides", http(rf"@\w+\.({VERBS}){quoted}"), EXTRACTED), ("http", "consumes", http(rf"(?<!@)\b(?:requests|httpx|client|axios)\.({VERBS}){quoted}"), EXTRACTED),
        ("event", "provides", event("publish"), EXTRACTED), ("event", "consumes", event("subscribe"), EXTRACTED), ("package", "consumes", packages, EXTRACTED),
    )
    item = lambda k, d, c: lambda n: F.struct(F.lit(k).alias("kind"), F.lit(d).alias("direction"), n.alias("normalized"), F.lit(c).alias("confidence"))
    every = F.concat(*[F.transform(names, item(kind, direction, confidence)) for kind, direction, names, confidence in kinds])
    rows = files.select("project", F.explode(every).alias("x"), F.contains("text", F.lit("openapi:")).alias("contract"))
    return rows.select("project", "x.kind", "x.direction", "x.normalized", "x.confidence", "contract").distinct()


def _best_two(items: DataFrame, key: list[str]) -> DataFrame:
    """Per key an array of the surest item and the surest of another project."""
    best = items.groupBy(*key, "project").agg(F.max_by(F.struct("normalized", "confidence", "contract"), F.struct("confidence", "contract", "normalized")).alias("x")).select(*key, "project", F.col("x.normalized").alias("name"), "x.confidence", "x.contract")
    own = Window.partitionBy(*key).orderBy(F.desc("confidence"), "project")
    two = best.withColumn("r", F.row_number().over(own)).where(F.col("r") <= 2)
    return two.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", "project", "name", "confidence", "contract"))).alias("two"))  # at most 2


def link(items: DataFrame, least: float = LEAST) -> DataFrame:
    """(project, kind, normalized, state, provider, confidence, evidence, relation, detail) of each consumed item.

    ``state`` is linked, suggestion, divergent, external or unresolved.
    """
    sound = items.where("project IS NOT NULL AND kind IS NOT NULL AND normalized IS NOT NULL")
    sound = sound.groupBy("project", "direction", *KEY).agg(F.max("confidence").alias("confidence"), F.max(F.coalesce("contract", F.lit(False))).alias("contract"))
    provides, consumes = sound.where("direction = 'provides'"), sound.where("direction <> 'provides'").select("project", *KEY)
    route = F.when((F.col("kind") == "http") & (F.instr("normalized", " ") > 0), F.expr("substring(normalized, instr(normalized, ' ') + 1)"))
    routes = _best_two(provides.withColumn("route", route).where("route IS NOT NULL"), ["route"]).withColumnRenamed("two", "near")
    met = consumes.withColumn("route", route).join(_best_two(provides, KEY), KEY, "left").join(routes, "route", "left")
    met = met.withColumn("p", F.when(F.col("two").isNotNull(), F.expr("get(filter(two, x -> x.project <> project), 0)"))).withColumn("q", F.when(F.col("near").isNotNull(), F.expr("get(filter(near, x -> x.project <> project), 0)")))
    http, matched = F.col("kind") == "http", F.col("p").isNotNull()
    confidence = F.when(http & F.col("p.contract"), CONTRACT).when(http, METHOD_PATH).otherwise(NAME)
    state = F.when(matched & (confidence < least), "suggestion").when(matched, "linked").when(F.col("q").isNotNull(), "divergent").when(F.col("kind") == "package", "external").otherwise("unresolved")
    relation = F.lit("consumes")
    for kind, name in RELATIONS:
        relation = F.when(F.col("kind") == kind, name).otherwise(relation)
    return met.select(
        "project", *KEY, state.alias("state"), F.when(matched, F.col("p.project")).otherwise(F.col("q.project")).alias("provider"), F.when(matched, confidence).alias("confidence"),
        F.when(matched, F.when(F.col("p.contract"), "contract").otherwise("method+path")).alias("evidence"), F.when(matched, relation).alias("relation"), F.when(~matched, F.col("q.name")).alias("detail"),
    )


def contract_search(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, project, kind, normalized, score): the share of a query's words that a contract's name has, times its confidence."""
    asked = queries.select("query_id", F.array_distinct(T.words(F.col("text"))).alias("w")).where(F.size("w") > 0).select("query_id", F.size("w").alias("of"), F.explode("w").alias("word"))
    held = items.where("normalized IS NOT NULL").select("project", *KEY, "confidence", F.explode(F.array_distinct(T.words(F.col("normalized")))).alias("word"))
    met = held.join(asked, "word").groupBy("query_id", "of", "project", *KEY).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    return met.select("query_id", "project", *KEY, F.round(F.col("n") / F.col("of") * F.col("confidence"), 6).alias("score"))
