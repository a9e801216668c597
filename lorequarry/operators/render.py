"""Renderings of a context pack: Markdown, XML, JSON and an explanation of what was kept and dropped.

A pack is a row of ``packs`` (query_id, query, intent, budget). Its ``fragments`` are rows (query_id, place, path, first_line,
last_line, name, tokens, score, compressed, strategy, reason, text) that an assembly has kept under the budget, so a pack's
fragments fit one row by construction. Rows ``dropped`` (query_id, id, why, place) may be many more: they are counted per
reason before they meet a pack, and at most ``SHOWN`` of them travel as examples.

Defined results: a pack without fragments renders as an empty one; null texts and names are empty; ties of places go by path
and text; repeated fragments are all shown; extra columns are ignored; no packs give no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.stats import looks_random

#: Examples of dropped candidates that an explanation shows, and characters of a query that an output repeats.
SHOWN, ECHO = 5, 96
#: The words of the published renderings.
TITLE, COMPRESSED, FOOTER, LOST = "# Contexto — ", "  (comprimido)", "%d fonte(s) · ~%d / %d tokens", " · %d candidatos descartados"
INTENT, BUDGET, KEPT, VIA, DROPPED, EXAMPLES = "Intenção detectada: ", "Orçamento: %d / %d tokens", "INCLUÍDOS:", "via %s", "DESCARTADOS (%d):", "  exemplos:"
BY = ", comprimido por '%s'"
MASKED = "«curto»"


def echo(query: Column) -> Column:
    """A query as an output may repeat it: words that look like secrets are masked, and what is long is cut."""
    masked = lambda w: F.when(F.length(w) < 16, F.lit(MASKED)).otherwise(F.concat(F.substring(w, 1, 4), F.lit("…"), F.substring(w, -4, 4)))
    safe = lambda w: F.when(looks_random(w), masked(w)).otherwise(w)
    q = F.coalesce(query, F.lit(""))
    words = F.array_join(F.transform(F.split(q, " ", -1), safe), " ")
    apart = F.when((F.length(q) > ECHO) | F.contains(q, F.lit(" ")), words).otherwise(q)
    cut = F.concat(F.substring(apart, 1, ECHO), F.when(F.length(apart) > ECHO, "…").otherwise(""))
    return F.when(looks_random(q), masked(q)).otherwise(cut)


def label() -> Column:
    """Where a fragment stands, and the name it has there."""
    name = F.coalesce("name", F.lit(""))
    return F.concat(F.format_string("%s:%d-%d", F.coalesce("path", F.lit("")), "first_line", "last_line"), F.when(name != "", F.concat(F.lit(" › "), name)).otherwise(""))


def xml_text(x: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else [])
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(x, F.lit("")))


def _packed(packs: DataFrame, fragments: DataFrame, dropped: DataFrame | None, part: Column) -> DataFrame:
    """One row per pack: its fields, the rendered parts in order, tokens, sources, and what is known of dropped candidates."""
    held = fragments.select("query_id", F.struct("place", "path", F.coalesce("text", F.lit("")).alias("text"), part.alias("part")).alias("f"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "path")
    kept = held.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list("f")), lambda f: f["part"]).alias("parts"), F.sum("tokens").alias("used"), F.array_sort(F.collect_set("path")).alias("sources")
    )
    rows = packs.select("query_id", echo(F.col("query")).alias("query"), "intent", "budget").join(kept, "query_id", "left")
    if dropped is None:
        none = F.array().cast("array<struct<n:bigint,why:string>>")
        rows = rows.withColumns({"reasons": none, "examples": F.array().cast("array<struct<id:string,why:string>>"), "lost": F.lit(0).cast("long")})
    else:
        rows = rows.join(_reasons(dropped), "query_id", "left").join(_examples(dropped), "query_id", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in ("reasons", "examples")}).withColumn("lost", F.coalesce("lost", F.lit(0)))
    return rows.withColumns({"parts": F.coalesce("parts", F.array()), "used": F.coalesce("used", F.lit(0)), "sources": F.coalesce("sources", F.array())})


def _reasons(dropped: DataFrame) -> DataFrame:
    """(query_id, reasons, lost): counts per reason, the commonest first; a reason ends at its first colon."""
    each = dropped.groupBy("query_id", F.substring_index(F.coalesce("why", F.lit("")), ":", 1).alias("why")).agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "why"))), lambda r: F.struct((-r["m"]).alias("n"), r["why"].alias("why")))
    return each.groupBy("query_id").agg(listed.alias("reasons"), F.sum("n").alias("lost"))


def _examples(dropped: DataFrame) -> DataFrame:
    """(query_id, examples): the first few that went for another reason than likeness."""
    told = dropped.where(~F.coalesce("why", F.lit("")).startswith("mmr")).select("query_id", "place", F.col("id").cast("string").alias("id"), "why")
    first = told.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id", "why"))).where(F.col("k") <= SHOWN)
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "why"))), lambda e: F.struct(e["id"].alias("id"), e["why"].alias("why"))).alias("examples"))


def _lines(*parts: Column) -> Column:
    """Lines of arrays of lines, joined."""
    return F.array_join(F.concat(*parts), "\n")


def _texts(*lines: str | Column) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def markdown(packs: DataFrame, fragments: DataFrame, dropped: DataFrame | None = None, title: bool = True, references: DataFrame | None = None) -> DataFrame:
    """(query_id, rendered): a heading per fragment; ``references`` (query_id, line) are told in a line of their own."""
    head = F.concat(F.format_string("## [%d] ", "place"), label(), F.when(F.coalesce("compressed", F.lit(False)), COMPRESSED).otherwise(""))
    rows = _packed(packs, fragments, dropped, F.array_join(F.array(head, F.lit(""), F.coalesce("text", F.lit("")), F.lit("")), "\n"))
    rows = rows.join(references.select("query_id", "line"), "query_id", "left") if references is not None else rows.withColumn("line", F.lit(None).cast("string"))
    foot = F.concat(F.format_string(FOOTER, F.size("sources"), "used", "budget"), F.when(F.col("lost") > 0, F.format_string(LOST, "lost")).otherwise(""))
    top = _texts(F.concat(F.lit(TITLE), F.col("query")), "") if title else F.array().cast("array<string>")
    told = F.when(F.col("line").isNotNull(), F.array("line", F.lit(""))).otherwise(F.array().cast("array<string>"))
    return rows.select("query_id", _lines(top, F.col("parts"), told, _texts("---", foot)).alias("rendered"))


def xml(packs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(query_id, rendered): markup characters in texts, paths and queries are escaped."""
    marks = F.format_string('  <fragment source="%s" lines="%d-%d" compressed="%s">', xml_text(F.col("path")), "first_line", "last_line", F.coalesce("compressed", F.lit(False)).cast("string"))
    rows = _packed(packs, fragments, None, F.array_join(F.array(marks, F.concat(F.lit("    "), xml_text(F.col("text"))), F.lit("  </fragment>")), "\n"))
    top = F.concat(F.lit('<context query="'), xml_text(F.col("query"), True), F.lit('">'))
    meta = F.format_string('  <meta tokens="%d" budget="%d" sources="%d" />', "used", "budget", F.size("sources"))
    return rows.select("query_id", _lines(_texts(top), F.col("parts"), _texts(meta, "</context>")).alias("rendered"))


def json(packs: DataFrame, fragments: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(query_id, rendered): every field, nulls included; of dropped candidates the counts per reason and the examples."""
    part = F.struct(
        F.col("path").alias("document_path"), F.array("first_line", "last_line").alias("lines"), F.col("name").alias("symbol"), F.round("score", 6).alias("score"), "tokens",
        F.coalesce("compressed", F.lit(False)).alias("compressed"), "strategy", "reason", F.coalesce("text", F.lit("")).alias("content"),
    )
    fields = F.struct(
        "query", "intent", F.col("used").alias("estimated_tokens"), "budget", "sources", F.col("parts").alias("fragments"), F.col("lost").alias("dropped"), "reasons", "examples"
    )
    return _packed(packs, fragments, dropped, part).select("query_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("rendered"))


def explain(packs: DataFrame, fragments: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(query_id, rendered): why each fragment is there, and why others are not."""
    why = F.concat(F.format_string(VIA, F.coalesce("reason", F.lit(""))), F.when(F.coalesce("compressed", F.lit(False)), F.format_string(BY, F.coalesce("strategy", F.lit("")))).otherwise(""))
    score = F.call_function("format_number", F.col("score"), F.lit("0.0000"))
    told = F.concat(F.lit("       score "), score, F.format_string(" · %d tokens · ", F.coalesce("tokens", F.lit(0))), why)
    rows = _packed(packs, fragments, dropped, F.concat(F.format_string("  [%d] ", "place"), label(), F.lit("\n"), told))
    top = _texts(F.concat(F.lit(INTENT), F.coalesce("intent", F.lit(""))), F.format_string(BUDGET, "used", "budget"), "", KEPT)
    counts = F.transform("reasons", lambda r: F.concat(F.lit("  "), F.lpad(r["n"].cast("string"), F.greatest(F.length(r["n"].cast("string")), F.lit(4)), F.lit(" ")), F.lit("  "), r["why"]))
    shown = F.transform("examples", lambda e: F.concat(F.lit("    "), F.substring(e["id"], 1, 14), F.lit("  "), F.coalesce(e["why"], F.lit(""))))
    none = F.array().cast("array<string>")
    lost = F.when(F.col("lost") > 0, F.concat(_texts("", F.format_string(DROPPED, "lost")), counts)).otherwise(none)
    some = F.when(F.size("examples") > 0, F.concat(_texts("", EXAMPLES), shown)).otherwise(none)
    return rows.select("query_id", _lines(top, F.col("parts"), lost, some).alias("rendered"))
