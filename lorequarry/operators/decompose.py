"""Requests to classified work: signals of a rule catalogue, impact from hits, gates, planned documents, tracks and their edges.

Catalogues are small tables. They are counted, read once and compiled to expressions, so a request is judged within its row
and nothing is joined or shuffled but the hits that measure its impact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lorequarry.operators import tasks as K

#: Most rows that a catalogue may have.
CATALOGUE = 2000
DIMENSIONS = tuple(K.WEIGHTS)
BANDS = ("direct", "analysis", "documentation", "decomposition")
#: Limits of scores that a mean does not overrule, and the weight from which a signal is strong.
GATES = {"security_never_direct": 40, "security_needs_approval": 50, "security_needs_documentation": 60, "risk_needs_approval": 60, "risk_needs_documentation": 70}
STRONG = 40
#: Tracks of work as (track, type, needs these tracks, priority, asked by this dimension, from this score).
TRACKS = (
    ("analysis", "analysis", (), "high", None, 0),
    ("documentation", "documentation", ("analysis",), "high", None, 0),
    ("database", "technical", ("documentation",), "high", "architecture", 45),
    ("backend", "technical", ("documentation", "database"), "high", None, 0),
    ("integration", "integration", ("backend",), "medium", "architecture", 50),
    ("frontend", "technical", ("backend",), "medium", "business_rule", 50),
    ("tests", "testing", ("backend",), "high", None, 0),
    ("security", "security", ("backend", "tests"), "high", "security", 40),
    ("performance", "performance", ("backend", "tests"), "medium", "complexity", 60),
    ("deploy", "deployment", ("tests",), "medium", "risk", 50),
    ("observability", "operations", ("backend",), "medium", "risk", 50),
    ("validation", "validation", ("tests",), "high", None, 0),
)
#: Tracks that a person approves, and those that become critical with it.
APPROVED, CRITICAL = ("database", "deploy", "security"), ("security", "database")
RULE = "struct<rule:string,dimension:string,weight:int,reduce:boolean,hard:boolean>"


def catalogue(table: DataFrame, key: str, most: int = CATALOGUE) -> list[Row]:
    """The rows of a rule table by its key; a table over the bound is refused, for every row becomes part of the plan."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a catalogue of over {most} rows")
    return sorted(rows, key=lambda r: r[key])


def signals(text: Column, rules: Sequence[Row]) -> Column:
    """The rules (rule, dimension, weight, pattern, hard) whose pattern occurs in a text; a weight below zero reduces."""
    unknown = sorted({r["dimension"] for r in rules} - set(DIMENSIONS))
    if unknown:
        raise ValueError(f"dimensions that are not scored: {unknown}")
    made = lambda r: F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["dimension"]).alias("dimension"), F.lit(r["weight"]).alias("weight"), F.lit(r["weight"] < 0).alias("reduce"), F.lit(bool(r["hard"])).alias("hard"))
    found = [F.when(text.rlike(r["pattern"]), made(r)) for r in rules]
    return F.array_compact(F.array(*found)).cast(f"array<{RULE}>") if found else F.array().cast(f"array<{RULE}>")


def impact(hits: DataFrame) -> DataFrame:
    """(request_id, dependency, documentation) of keyword hits (request_id, path): modules and code files that a request touches."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    doc = F.lower(path).rlike(r"\.(md|rst|txt|adoc)$")
    own = doc & ~path.startswith("@base/")
    counted = hits.groupBy("request_id").agg(
        F.countDistinct(F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")).alias("modules"), F.count(F.when(~doc, 1)).alias("code"), F.count(F.when(own, 1)).alias("docs")
    )
    return counted.select(
        "request_id",
        F.least(F.lit(100), F.col("modules") * 12 + F.col("code") * 3).cast("int").alias("dependency"),
        F.when(F.col("docs") == 0, 60).otherwise(F.greatest(F.lit(0), 40 - F.col("docs") * 12)).cast("int").alias("documentation"),
    )


def assess(requests: DataFrame, rules: Sequence[Row], measured: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, text) with fired rules, scores, total, band, nature, requirements and strategy.

    Without ``measured`` (see ``impact``) a missing document is presumed; with it, a request without hits lacks documents
    and depends on nothing. A null or blank text is a direct one with no scores. Other columns are left out.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = requests.select("request_id", "text", F.when(blank, F.array().cast(f"array<{RULE}>")).otherwise(signals(F.col("text"), rules)).alias("fired"), blank.alias("blank"))
    up, down = F.filter("fired", lambda s: ~s["reduce"]), F.filter("fired", lambda s: s["reduce"])
    highest = F.array_max(F.transform(up, lambda s: s["weight"]))
    trivial = (F.size(down) > 0) & ((F.size(up) == 0) | (highest < STRONG) | (-F.array_min(F.transform(down, lambda s: s["weight"])) >= highest))
    rows = rows.withColumn("trivial", trivial)
    if measured is None:
        rows = rows.withColumns({"dependency": F.lit(0), "documentation": F.lit(40)})
    else:
        rows = rows.join(measured.select("request_id", "dependency", "documentation"), "request_id", "left")
    idle = F.col("trivial") | F.col("blank")
    added = {"dependency": F.coalesce("dependency", F.lit(0)), "documentation": F.coalesce("documentation", F.lit(60))}
    weighed = lambda d: F.aggregate(F.filter("fired", lambda x: x["dimension"] == d), F.lit(0), lambda a, x: a + x["weight"])
    score = {}
    for d in DIMENSIONS:
        raw = weighed(d)
        score[d] = F.greatest(F.lit(0), F.least(F.lit(100), raw + (F.when(idle, 0).otherwise(added[d]) if d in added else 0))).cast("int")
    rows = rows.select("request_id", "text", "fired", "blank", "trivial", F.struct(*[c.alias(d) for d, c in score.items()]).alias("scores"))
    s = {d: F.col(f"scores.{d}") for d in DIMENSIONS}
    damped = F.exists("fired", lambda x: x["reduce"])
    hard = lambda d: F.exists("fired", lambda x: x["hard"] & (x["dimension"] == d))
    total = K.total_score({d: c.cast("double") for d, c in s.items()})
    rows = rows.withColumn("total", F.when(F.col("trivial") | F.col("blank"), 0).when(damped, F.bround(total * F.lit(0.6))).otherwise(total).cast("int"))
    band = F.array_position(F.array(*map(F.lit, BANDS)), K.band(F.col("total"))).cast("int")
    gate = lambda d: ~F.col("trivial") & (~damped | hard(d)) & (s[d] >= GATES[f"{d}_needs_documentation"])
    documented = gate("security") | gate("risk")
    lifted = F.when((band == 1) & (s["security"] >= GATES["security_never_direct"]) & (~F.col("trivial") | hard("security")), 2).otherwise(band)
    rows = rows.withColumn("level", F.when(documented, F.greatest(lifted, F.lit(3))).otherwise(lifted))
    breadth = sum((F.when(c > 0, 1).otherwise(0) for c in s.values()), F.lit(0))
    approval = (~F.col("trivial") & (s["security"] >= GATES["security_needs_approval"])) | (s["risk"] >= GATES["risk_needs_approval"])
    needs_doc = documented | (band >= 3)
    rows = rows.withColumns({"requires_documentation": needs_doc, "requires_decomposition": (band == 4) | (needs_doc & (breadth >= 4)), "requires_approval": approval})
    leading, most = F.greatest(s["security"], s["architecture"], s["business_rule"]), F.greatest(*s.values())
    label = F.element_at(F.array(*map(F.lit, BANDS)), F.col("level"))
    nature = (
        F.when(F.col("trivial") | (F.col("level") == 1), "direct")
        .when(F.size("fired") == 0, "unknown")
        .when((leading >= 50) & (leading >= most - 5), F.when(s["security"] == leading, "security").when(s["architecture"] == leading, "architecture").otherwise("product"))
        .when(F.exists("fired", lambda x: x["rule"] == "performance") & (s["complexity"] >= 30), "performance")
        .otherwise(label)
    )
    strategy = F.when(F.col("requires_decomposition"), "document, decompose, execute").when(F.col("requires_documentation"), "document, execute").when(F.col("level") == 2, "analyze, execute").otherwise("execute")
    return rows.select(
        "request_id", "text", F.transform("fired", lambda x: x["rule"]).alias("fired"), "scores", "total", "trivial", label.alias("band"), nature.alias("nature"),
        "requires_documentation", "requires_decomposition", "requires_approval", strategy.alias("strategy"),
    )


def ordered_types(types: Sequence[Row]) -> list[tuple[str, set[str]]]:
    """Types of a catalogue (type, requires) with all that they require, required ones first, then by name; a cycle is refused."""
    needs = {t["type"]: set(t["requires"] or ()) for t in types}
    unknown = sorted(set().union(*needs.values()) - set(needs)) if needs else []
    if unknown:
        raise ValueError(f"required types that the catalogue lacks: {unknown}")
    done: dict[str, set[str]] = {}
    while len(done) < len(needs):
        ready = sorted(t for t in needs if t not in done and needs[t] <= set(done))
        if not ready:
            raise ValueError(f"types that require each other: {sorted(set(needs) - set(done))}")
        for t in ready:
            done[t] = needs[t].union(*(done[r] for r in needs[t]))
    return list(done.items())


def planned(scores: Column, types: Sequence[Row]) -> Column:
    """Types of document (type, requires, triggers, min_score) that scores call for, with all that these require, in order."""
    asked = {t["type"]: F.greatest(F.lit(-1), *[scores[d] for d in t["triggers"]]) >= t["min_score"] if t["triggers"] else F.lit(False) for t in types}
    order = ordered_types(types)
    wanted = [F.when(sum((asked[u].cast("int") for u, below in order if t == u or t in below), F.lit(0)) > 0, F.lit(t)) for t, _ in order]
    return F.array_compact(F.array(*wanted)) if wanted else F.array().cast("array<string>")


def _active(assessed: DataFrame, types: Sequence[Row]) -> DataFrame:
    s = F.col("scores")
    tracks = []
    for place, (name, kind, needs, priority, dimension, least) in enumerate(TRACKS):
        asked = F.lit(True) if dimension is None else s[dimension] >= least
        asked = (F.size("documents") > 0) if name == "documentation" else asked
        rank = F.when(F.col("requires_approval"), "critical").otherwise(priority) if name in CRITICAL else F.lit(priority)
        needed = F.array(*map(F.lit, needs)).cast("array<string>")
        approve = F.col("requires_approval") if name in APPROVED else F.lit(False)
        tracks.append(F.when(asked, F.struct(F.lit(place).alias("place"), F.lit(name).alias("track"), F.lit(kind).alias("type"), needed.alias("needs"), rank.alias("priority"), approve.alias("approve"))))
    return assessed.withColumn("documents", planned(s, types)).withColumn("active", F.array_compact(F.array(*tracks)))


def task_id(request: Column, seq: Column) -> Column:
    return F.concat_ws("-", request.cast("string"), F.concat(F.lit("T"), F.lpad(seq.cast("string"), 3, "0")))


def decompose(assessed: DataFrame, types: Sequence[Row]) -> DataFrame:
    """Tasks (request_id, task_id, seq, track, type, priority, approve, documents) in order of their tracks, a track without its signal left out."""
    one = _active(assessed, types).select("request_id", "documents", F.posexplode("active").alias("at", "t"))
    seq = (F.col("at") + 1).cast("int")
    return one.select(
        "request_id", task_id(F.col("request_id"), seq).alias("task_id"), seq.alias("seq"), "t.track", "t.type", "t.priority", "t.approve",
        F.when(F.col("t.track") == "documentation", F.col("documents")).alias("documents"),
    )


def edges(assessed: DataFrame, types: Sequence[Row]) -> DataFrame:
    """(request_id, task_id, depends_on): active tracks that an active track needs; acyclic, as tracks need earlier ones only."""
    names = F.transform("active", lambda t: t["track"])
    one = _active(assessed, types).select("request_id", names.alias("names"), F.posexplode("active").alias("at", "t"))
    one = one.select("request_id", "names", "at", F.explode(F.array_intersect("t.needs", "names")).alias("need"))
    before = F.array_position("names", F.col("need"))
    return one.select("request_id", task_id(F.col("request_id"), F.col("at") + 1).alias("task_id"), task_id(F.col("request_id"), before).alias("depends_on"))
