"""Extractive compression of fragments under a token target, in four steps of which the first that fits is taken.

Noise goes first (licence and generated-file lines, imports of code, repeated blank lines). Then code keeps its signature and
docstring with a mark for the lines left out, and prose keeps its heading, its first sentence and those nearest to the query.
What still does not fit is cut at a line end and marked. All of it is Columns; a step runs only for rows that need it.

Defined results: a null fragment is empty; a fragment that fits is returned as it is; a signature is never removed; a first
line longer than the target is shortened to max(3 * target, 40) characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.functions import text as T

#: Patterns and marks below are fixed values: results must equal those of the behaviour that they reproduce.
LICENCE = r"(?i)^\s*(?:#|//|\*|/\*)\s*(?:copyright|licensed under|SPDX-License|all rights reserved)"
GENERATED = r"(?i)^\s*(?:#|//|<!--)\s*(?:auto-?generated|do not edit|@generated)"
IMPORT = r"^\s*(?:import\s|from\s+\S+\s+import\s|use\s+\S+;|require\()"
DEFINITION = r"^\s*(?:(?:async\s+)?def\s|class\s|function\s|public\s|private\s|protected\s|export\s|const\s+\w+\s*=\s*(?:async\s*)?\(|@)"
SENTENCE = r"(?<=[.!?])\s+"
OMITTED = ("    # ... (", " linhas omitidas)")
TRUNCATED = "…(truncado)"
QUOTES = ('"""', "'''")


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end adds none."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", ""), "\n")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pruned(text: Column, is_code: Column) -> Column:
    """Without licence, generated-file and (in code) import lines; of blank lines in a row one stays."""
    kept = F.filter(lines(text), lambda x: ~x.rlike(LICENCE) & ~x.rlike(GENERATED) & ~(is_code & x.rlike(IMPORT)))
    single = F.filter(F.transform(kept, lambda x, i: F.struct(x.alias("x"), ((i > 0) & (F.trim(x) == "") & (F.trim(F.get(kept, i - 1)) == "")).alias("again"))), lambda s: ~s["again"])
    return F.regexp_replace(F.array_join(F.transform(single, lambda s: s["x"]), "\n"), "^\n+|\n+$", "")


def collapsed(held: Column) -> Column:
    """Lines of code to their signature, their docstring and a mark; unchanged where two lines or fewer would go."""
    n = F.size(held)
    other = F.array_position(F.transform(held, lambda x: (F.trim(x) == "") | x.rlike(DEFINITION)), False).cast("int")
    i = F.when(other == 0, n).when(other == 1, 1).otherwise(other - 1)
    first = _stripped(F.coalesce(F.get(held, i), F.lit("")))
    has = lambda quote: F.transform(F.slice(held, i + 2, F.greatest(n, F.lit(1))), lambda x: F.contains(x, F.lit(quote)))
    doc = F.lit(0)
    for quote in reversed(QUOTES):
        rest = F.array_position(has(quote), True).cast("int")
        many = F.when(first.endswith(quote) & (F.length(first) > len(quote)), 1).when(rest > 0, rest + 1).otherwise(n)
        doc = F.when(first.startswith(quote), many).otherwise(doc)
    left = n - i - doc
    mark = F.concat(F.lit(OMITTED[0]), left.cast("string"), F.lit(OMITTED[1]))
    return F.when(left <= 2, F.array_join(held, "\n")).otherwise(F.array_join(F.array_append(F.slice(held, F.lit(1), i + doc), mark), "\n"))


def _fitting(costs: Column, used: Column, target: Column, least: int) -> Column:
    """How many leading costs fit, at least ``least``."""
    step = lambda s, c: F.when(s["done"] | ((s["used"] + c > target) & (s["n"] >= least)), F.struct(s["used"], s["n"], F.lit(True).alias("done"))).otherwise(F.struct((s["used"] + c).alias("used"), (s["n"] + 1).alias("n"), F.lit(False).alias("done")))
    start = F.struct(used.cast("long").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(costs, start, step)["n"]


def selected(text: Column, target: Column, query: Column) -> Column:
    """The heading, and of the sentences those that share most of the query's words while they fit; the first has a bonus of one half."""
    first = F.substring_index(text, "\n", 1)
    headed = F.ltrim(first).startswith("#")
    body = F.when(headed, F.substring(text, F.length(first) + 2, F.length(text))).otherwise(text)
    said = F.filter(F.transform(F.split(body, SENTENCE), _stripped), lambda s: s != "")
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    asked = words(F.coalesce(query, F.lit("")))
    near = lambda s: F.when(F.size(asked) > 0, F.size(F.array_intersect(words(s), asked)) / F.size(asked)).otherwise(F.lit(0.0))
    ranked = F.array_sort(F.transform(said, lambda s, i: F.struct((-(near(s) + F.when(i == 0, 0.5).otherwise(0.0))).alias("score"), i.alias("i"), s.alias("s"))))
    used = F.when(headed, T.token_count(first)).otherwise(F.lit(0))
    n = _fitting(F.transform(ranked, lambda r: T.token_count(r["s"])), used, target, 1)
    picked = F.array_sort(F.transform(F.slice(ranked, F.lit(1), n), lambda r: F.struct(r["i"].alias("i"), r["s"].alias("s"))))
    joined = F.array_join(F.transform(picked, lambda p: p["s"]), " ")
    return F.when(F.size(said) <= 1, text).otherwise(_stripped(F.when(headed, F.concat_ws("\n", first, joined)).otherwise(joined)))


def truncated(held: Column, target: Column) -> Column:
    """Leading lines that fit beside the mark, then the mark."""
    n = _fitting(F.transform(held, T.token_count), T.token_count(F.lit(TRUNCATED)), target, 0)
    short = F.array(F.substring(F.get(held, F.lit(0)), F.lit(1), F.greatest(target * 3, F.lit(40))))
    return F.array_join(F.array_append(F.when(n > 0, F.slice(held, F.lit(1), n)).otherwise(short), F.lit(TRUNCATED)), "\n")


def compress(rows: DataFrame, text: str = "text", target: Column | int = 512, query: Column | None = None, is_code: Column | None = None) -> DataFrame:
    """``rows`` with (compressed, strategy, saved_tokens): none, prune, collapse, sentences or truncate."""
    target = F.lit(target) if isinstance(target, int) else target
    query = F.lit("") if query is None else query
    code = F.lit(False) if is_code is None else F.coalesce(is_code, F.lit(False))
    first = rows.withColumns({"__t": F.coalesce(F.col(text).cast("string"), F.lit("")), "__target": target.cast("int"), "__code": code, "__query": query})
    first = first.withColumn("__n", T.token_count(F.col("__t")))
    fits = F.col("__n") <= F.col("__target")
    second = first.withColumn("__p", F.when(~fits, pruned(F.col("__t"), F.col("__code")))).withColumn("__np", T.token_count(F.col("__p")))
    prunes = ~fits & (F.col("__np") <= F.col("__target"))
    deeper = F.when(F.col("__code"), collapsed(lines(F.col("__p")))).otherwise(selected(F.col("__p"), F.col("__target"), F.col("__query")))
    third = second.withColumn("__d", F.when(~fits & ~prunes, deeper)).withColumn("__nd", T.token_count(F.col("__d")))
    goes = ~fits & ~prunes & (F.col("__nd") <= F.col("__target"))
    fourth = third.withColumn("compressed", F.when(fits, F.col("__t")).when(prunes, F.col("__p")).when(goes, F.col("__d")).otherwise(truncated(lines(F.col("__d")), F.col("__target"))))
    strategy = F.when(fits, "none").when(prunes, "prune").when(goes & F.col("__code"), "collapse").when(goes, "sentences").otherwise("truncate")
    out = fourth.withColumns({"strategy": strategy, "saved_tokens": F.col("__n") - T.token_count(F.col("compressed"))})
    return out.drop("__t", "__target", "__code", "__query", "__n", "__p", "__np", "__d", "__nd")
