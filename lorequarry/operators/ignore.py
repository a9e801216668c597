"""Ignore rules: glob lines of nested files, compiled to expressions, decided per path and pruned from the root down.

Rules are rows (place, source, scope, ordinal, regex, include, prefix, explicit). ``place`` is the precedence of a source: its
kind first, then the depth of its folder. A path meets the rules of its folders by an equality join on the scope, so nested
files cost only the paths below them. Within a source the last rule that fits decides, where an exclusion by way of a folder
gives way to any rule on the path itself; among sources the last that decides wins, and a source may take an exclusion back.

Defined results: blank lines and comments are no rules; a path that no rule fits is kept; backslashes count as slashes; a
folder is asked with a trailing slash; repeated paths are decided once; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.session import cut

RULES = "place int, source string, scope string, ordinal int, regex string, include boolean, prefix string, explicit boolean"
#: Rows of rules that may be broadcast to the paths; more are joined by a shuffle.
BROADCAST_RULES = 20_000
KINDS = 1000  # depths that a kind of source has room for


def regex_of(line: str) -> tuple[str, bool] | None:
    """(regular expression, include) of one glob line; its first group is the slash where a folder was fitted."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    include = not line.startswith("!")
    glob = line[0 if include else 1 :]
    glob = glob[1:] if glob.startswith(("\\#", "\\!")) else glob
    folder = glob.endswith("/")
    parts = glob.strip("/").split("/")
    if parts == [""]:
        return None
    anchored = glob.startswith("/") or len(parts) > 1
    inside = parts[-1] == "**" and len(parts) > 1
    parts = parts[:-1] if inside else parts
    out = "^" if anchored else "^(?:.+/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "[^/]+(?:/.+)?" if last else "(?:.+/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    if inside:
        return f"{out}/.*()$", include
    return (f"{out}(/).*$" if folder else f"{out}(?:(/).*)?$"), include


def _segment(part: str) -> str:
    out, k = "", 0
    while k < len(part):
        c = part[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[k + 2 :]:
            end = part.index("]", k + 2)
            held = part[k + 1 : end]
            out += "[" + ("^" + held[1:] if held[0] in "!^" else held).replace("\\", "\\\\") + "]"
            k = end
        elif c == "\\" and k + 1 < len(part):
            k += 1
            out += re.escape(part[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def fixed_prefix(line: str, scope: str) -> str:
    """The literal path that a pattern leads to; empty for a single segment or a leading wildcard, which fit at any depth."""
    parts, held = line.strip().strip("/").split("/"), []
    if len(parts) < 2:
        return ""
    for part in parts:
        if not part or set(part) & set("*?["):
            break
        held.append(part)
    return "/".join(([scope] if scope else []) + held) if held else ""


def _rows(place: int, source: str, scope: str, text: str, explicit: bool) -> Iterator[tuple]:
    for ordinal, line in enumerate(text.split("\n")):
        found = regex_of(line)
        if found:
            yield place, source, scope, ordinal, *found, "" if found[1] else fixed_prefix(line.strip()[1:], scope), explicit and not found[1]


def configured(spark: SparkSession, lines: Iterable[str], name: str, kind: int, explicit: bool = False) -> DataFrame:
    """Rules of the root that are given as a list: defaults, or what a user excludes or includes (``explicit``)."""
    return spark.createDataFrame(list(_rows(kind * KINDS, name, "", "\n".join(lines), explicit)), RULES)


def found(files: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """Rules of ignore files (path, text) in a tree; ``kinds`` gives the rank of each file name."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    scope = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    depth = F.when(scope == "", 0).otherwise(F.size(F.split(scope, "/")))
    rank = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, s, c, t in frame.itertuples(index=False) for r in _rows(int(p), s, c, t, False)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    held = files.select(path.alias("path"), "text", name.alias("name")).where(F.col("name").isin(*kinds))
    return held.select((F.element_at(rank, F.col("name")) * KINDS + depth).cast("int").alias("place"), F.col("path").alias("source"), scope.alias("scope"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, RULES)


def folders(path: Column) -> Column:
    """The folders above a path, the root (empty) first."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def decide(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored, source): the decision and the source that took it; folders end in a slash."""
    held = paths.select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path")).distinct()
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    met = held.withColumn("scope", F.explode(folders(F.col("path")))).join(F.broadcast(rules) if few else rules, "scope")
    target = F.when(F.col("scope") == "", F.col("path")).otherwise(F.expr("substring(path, length(scope) + 2)"))
    fits = met.withColumn("target", target).where(F.expr("regexp_like(target, regex)")).withColumn("mark", F.expr("regexp_extract(target, regex, 1) = '/'"))
    # at most the rules of one source
    each = fits.groupBy("path", "place", "source").agg(F.array_sort(F.collect_list(F.struct("ordinal", "include", "mark"))).alias("hits"))
    rank = lambda m: F.when(m["mark"], 1).otherwise(2)
    step = lambda s, m: F.when(m["include"] & m["mark"], F.struct(F.lit(True).alias("out"), F.lit(1).alias("rank"))).when(
        rank(m) >= s["rank"], F.struct(m["include"].alias("out"), rank(m).alias("rank"))
    ).otherwise(s)
    last = F.aggregate("hits", F.struct(F.lit(False).alias("out"), F.lit(0).alias("rank")), step)["out"]
    said = each.select("path", "place", "source", last.alias("match"), F.exists("hits", lambda m: ~m["include"]).alias("negates"))
    # at most a row per folder above the path and kind of source
    listed = said.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "source", "match", "negates"))).alias("said"))
    state = lambda ignored, source: F.struct(ignored.alias("ignored"), source.cast("string").alias("source"))
    go = lambda s, m: F.when(m["match"], state(F.lit(True), m["source"])).when(s["ignored"] & m["negates"], state(F.lit(False), F.concat(m["source"], F.lit(" (negation)")))).otherwise(s)
    out = listed.select("path", F.aggregate("said", state(F.lit(False), F.lit(None)), go).alias("d"))
    return held.join(out, "path", "left").select("path", F.coalesce("d.ignored", F.lit(False)).alias("ignored"), F.col("d.source").alias("source"))


def prunable(dirs: DataFrame, rules: DataFrame) -> DataFrame:
    """The folders (path, no trailing slash) that are ignored and into which no negation leads: nothing below can come back."""
    ignored = decide(dirs.where("path <> ''").select(F.concat("path", F.lit("/")).alias("path")), rules).where("ignored").select(F.rtrim("path", F.lit("/")).alias("path"))
    negations = rules.where(~F.col("include"))
    if not negations.where((F.col("prefix") == "") & F.col("explicit")).isEmpty():
        return ignored.where(F.lit(False))  # an explicit include without a path holds everywhere
    led = negations.where("prefix <> ''").select("prefix").distinct()
    above = lambda c: F.explode(F.array_append(F.slice(folders(F.col(c)), F.lit(2), F.lit(1 << 20)), F.col(c)))  # noqa: E731  a path's folders and itself
    below = ignored.select("path", above("path").alias("prefix")).join(led, "prefix", "left_semi").select("path")
    over = ignored.join(led.select(above("prefix").alias("path")), "path", "left_semi").select("path")
    return ignored.join(below.unionByName(over).distinct(), "path", "left_anti")


def _under(rows: DataFrame, column: str, pruned: DataFrame) -> DataFrame:
    """Rows whose path lies below none of the pruned folders and is none of them."""
    held = rows.select(F.col(column).alias("own")).distinct()
    up = held.select("own", F.explode(F.array_append(folders(F.col("own")), F.rtrim(F.col("own"), F.lit("/")))).alias("path"))
    hit = up.join(pruned.select("path"), "path", "left_semi").select(F.col("own").alias(column)).distinct()
    return rows.join(hit, column, "left_anti")


def walk(paths: DataFrame, given: DataFrame, files: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """(path, ignored, source) of the files that a walk from the root meets: pruned folders are not entered.

    Ignore files (``files``: path, text) inside a pruned folder do not count, so their depths are settled from the root down;
    one round per depth at which such files lie.
    """
    nested = cut(found(files, kinds))
    level = F.when(F.col("scope") == "", 0).otherwise(F.size(F.split("scope", "/")))
    depths = sorted(r[0] for r in nested.select(level.alias("d")).distinct().collect())  # at most the depth of the tree
    dirs = cut(paths.select(F.explode(folders(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))).alias("path")).where("path <> ''").distinct())
    rules = given
    for d in depths:
        now = nested.where(level == d)
        if d:
            now = _under(now, "scope", prunable(dirs.where(F.size(F.split("path", "/")) <= d), rules))
        rules = cut(rules.unionByName(now))
    return _under(decide(paths, rules), "path", prunable(dirs, rules))
