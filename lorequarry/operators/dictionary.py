"""Project dictionaries under a token budget: cuts of their sections in a fixed order, and reading levels.

Entries are rows (project, section, place from 1, tokens). The lengths that a section may be cut to follow from its count
alone, so entries are summed into the steps between these lengths at once; what is ranked afterwards is a few rows a section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The budget, the sections that are cut, in order, with the length that each keeps, and the most entries of levels.
BUDGET = 4000
FLOORS = (("glossary", 5), ("docs", 10), ("services", 12), ("data_stores", 10), ("modules", 10))
LEVELS = (
    (("technologies", 8), ("repo_map", 10), ("services", 8), ("modules", 6), ("entrypoints", 5)),
    (("technologies", 20), ("repo_map", 25), ("services", 12), ("modules", 20), ("entrypoints", 20), ("conventions", 20), ("docs", 10)),
)
#: A cut keeps two thirds, so so many cuts bring any count of 64 bits to its floor.
CUTS = 120


def _lengths(entries: DataFrame, floors) -> DataFrame:
    """(project, section, turn, lengths): the falling lengths of each section, its count first."""
    order = F.create_map(*[F.lit(x) for turn, (name, floor) in enumerate(floors) for x in (name, F.struct(F.lit(turn).alias("turn"), F.lit(floor).cast("long").alias("floor")))])
    rule = F.try_element_at(order, F.col("section"))
    counted = entries.groupBy("project", "section").agg(F.count("*").alias("n")).withColumn("rule", rule)
    floor = F.coalesce(F.col("rule.floor"), F.col("n"))
    step = lambda a, _: F.when(F.element_at(a, -1) > floor, F.concat(a, F.array(F.greatest(F.floor(F.element_at(a, -1) * 2 / 3).cast("long"), floor)))).otherwise(a)
    return counted.select("project", "section", F.col("rule.turn").alias("turn"), F.aggregate(F.sequence(F.lit(1), F.lit(CUTS)), F.array("n"), step).alias("lengths"))


def fitted(entries: DataFrame, budget: int = BUDGET, floors=FLOORS, overhead: int = 0) -> DataFrame:
    """(project, section, n, kept, cut, total): how many entries each section keeps so that its project fits the budget.

    Sections are cut in order, each to two thirds of its length at a time and not below its floor, until the whole fits;
    a project that fits nowhere is cut to all floors. ``total`` is the project's size afterwards, ``overhead`` that of its
    frame. A null place counts as after all others, null tokens as none; null sections are never cut; of entries of the
    same place in a section all places count on, in no stated order; an empty table has no rows.
    """
    own = entries.select("project", "section", "place", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    at = _lengths(own, floors)
    key = F.col("e.project").eqNullSafe(F.col("l.project")) & F.col("e.section").eqNullSafe(F.col("l.section"))
    # step k takes away the entries between lengths k + 1 and k; the last step is what always stays
    step = F.size(F.filter("lengths", lambda n: n >= F.coalesce(F.col("place").cast("long"), F.element_at("lengths", 1))))
    sums = own.alias("e").join(at.alias("l"), key).select("e.project", "e.section", F.greatest(step, F.lit(1)).alias("k"), "tokens")
    sums = sums.groupBy("project", "section", "k").agg(F.sum("tokens").alias("tokens"))
    steps = at.select("project", "section", "turn", "lengths", F.posexplode("lengths").alias("i", "length")).withColumn("k", F.col("i") + 1)
    a, b = steps.alias("a"), sums.alias("b")
    joined = a.join(b, F.col("a.project").eqNullSafe(F.col("b.project")) & F.col("a.section").eqNullSafe(F.col("b.section")) & (F.col("a.k") == F.col("b.k")), "left")
    rows = joined.select("a.*", F.coalesce("b.tokens", F.lit(0)).alias("tokens"), (F.col("a.k") < F.size("a.lengths")).alias("goes"))
    whole = F.sum("tokens").over(Window.partitionBy("project")) + overhead
    before = Window.partitionBy("project", "goes").orderBy("turn", "section", "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("whole", whole).withColumn("gone", F.col("goes") & (F.col("whole") - F.coalesce(F.sum("tokens").over(before), F.lit(0)) > budget))
    cut = rows.groupBy("project", "section").agg(
        F.element_at(F.first("lengths"), 1).alias("n"), F.element_at(F.first("lengths"), (F.count_if("gone") + 1).cast("int")).alias("kept"), F.max("whole").alias("whole"), F.sum(F.when(F.col("gone"), F.col("tokens")).otherwise(0)).alias("saved")
    )
    total = F.col("whole") - F.sum("saved").over(Window.partitionBy("project"))
    return cut.select("project", "section", "n", "kept", (F.col("kept") < F.col("n")).alias("cut"), total.alias("total"))


def kept_entries(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """The entries within the lengths that ``fitted`` leaves their sections."""
    e, c = entries.alias("e"), cuts.alias("c")
    same = F.col("e.project").eqNullSafe(F.col("c.project")) & F.col("e.section").eqNullSafe(F.col("c.section"))
    return e.join(c, same).where(F.coalesce(F.col("e.place").cast("long"), F.col("c.n")) <= F.col("c.kept")).select("e.*")


def reading_level(entries: DataFrame, budget: int, levels=LEVELS) -> DataFrame:
    """(project, level, tokens): the fullest level of reading that fits a budget; the last level is everything, 0 the least.

    All levels are summed in one aggregation. A project that fits at no level is read at level 0.
    """
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    sums = []
    for k, plan in enumerate(levels):
        most = F.try_element_at(F.create_map(*[F.lit(x) for pair in plan for x in pair]), F.col("section"))
        sums.append(F.sum(F.when(F.col("place") <= most, tokens).otherwise(0)).alias(f"level_{k}"))
    one = entries.groupBy("project").agg(*sums, F.sum(tokens).alias(f"level_{len(levels)}"))
    level = F.lit(0)
    for k in range(1, len(levels) + 1):
        level = F.when(F.col(f"level_{k}") <= budget, k).otherwise(level)
    size = F.element_at(F.array(*[f"level_{k}" for k in range(len(levels) + 1)]), F.col("level") + 1)
    return one.withColumn("level", level.cast("int")).select("project", "level", size.alias("tokens"))
