"""Documents to units of code and prose: one narrow pass per document, ids within it, contexts as Columns, no shuffle.

A unit is a class header without its methods' bodies, a method, a function, the leading imports of a module, a section of
markdown, a block of JSON, TOML, YAML or XML, a statement of SQL, or a paragraph. Long units are cut at lines, short ones
join their neighbour. Module statements between functions, and class statements after the first method, belong to no unit.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import tomllib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.operators.chunking import count_tokens

VERSION = "1"
#: Rows of one output batch.
TOGETHER = 2000
SCHEMA = (
    "doc_id long, path string, ordinal int, chunk_id string, parent_id string, kind string, symbol string, heading_path string, "
    "start_line int, end_line int, content string, tokens int, summary string, degraded boolean"
)
#: Marks of units in texts, and what stands before the names of a class's methods.
METHODS = "# métodos: "
FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
ATX = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
UNDERLINE = re.compile(r"\s{0,3}(?:(=+)|-+)\s*$")
YAML_KEY = re.compile(r"([A-Za-z_][\w.\-]*)\s*:")
XML_TAG = re.compile(r"\s*<([A-Za-z_][\w.\-:]*)")
SQL_START = re.compile(r"\s*(?:CREATE\s+(?:TABLE|VIEW|INDEX|FUNCTION|PROCEDURE|TRIGGER)|ALTER|INSERT|UPDATE|DELETE|SELECT|DROP|WITH)\b", re.I)
SQL_NAME = re.compile(r"CREATE\s+(?:TABLE|VIEW|INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)", re.I)
CODE = ("python", "sql")


@dataclass
class Unit:
    """Lines ``first`` to ``last`` (from 1) of a document; ``inner`` units lie within, nothing is cut at lines of ``whole``."""

    kind: str
    first: int
    last: int
    symbol: str | None = None
    heading: str | None = None
    summary: str | None = None
    inner: list[Unit] = field(default_factory=list)
    whole: set[int] = field(default_factory=set)


@dataclass(eq=False)
class Chunk:
    kind: str
    first: int
    last: int
    content: str
    symbol: str | None
    heading: str | None = None
    summary: str | None = None
    parent: Chunk | None = None
    tokens: int = 0
    id: str = ""


def python_units(text: str, prefix: str = "", body: list[ast.stmt] | None = None) -> list[Unit]:
    out, top = [], body is None
    body = ast.parse(text).body if body is None else body
    if top:
        lead = 0
        for node in body:
            if not isinstance(node, (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.Expr)):
                break
            lead = node.end_lineno
        out += [Unit("file", 1, lead)] if lead else []
    for node in body:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            summary = next(iter((ast.get_docstring(node) or "").strip().splitlines()), None)
            unit = Unit("method" if prefix else "function", first, node.end_lineno, prefix + node.name, summary=summary)
            if isinstance(node, ast.ClassDef):
                unit.kind, unit.inner = "class", python_units(text, f"{unit.symbol}.", node.body)
            out.append(unit)
    return out


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line lies in a fenced block, its marks included."""
    out, mark = [], None
    for line in lines:
        found = FENCE.match(line)
        out.append(bool(found) or mark is not None)
        if found and mark in (None, found[1][0]):
            mark = found[1][0] if mark is None else None
    return out


def runs(flags: list[bool]) -> list[tuple[int, int]]:
    """First and last line (from 1) of each run of set flags."""
    edges = [i for i, (a, b) in enumerate(zip([False, *flags], [*flags, False], strict=True), 1) if a != b]
    return [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def markdown_units(lines: list[str]) -> list[Unit]:
    inside, heads = fenced(lines), []
    for i, line in enumerate(lines):
        if inside[i]:
            continue
        if m := ATX.match(line):
            heads.append((i + 1, len(m[1]), m[2]))
        elif i and not inside[i - 1] and lines[i - 1].strip() and not ATX.match(lines[i - 1]) and (m := UNDERLINE.match(line)):
            heads.append((i, 1 if m[1] else 2, lines[i - 1].strip()))
    tables = [not f and s.lstrip().startswith("|") and s.rstrip().endswith("|") for f, s in zip(inside, lines, strict=True)]
    whole, above, out = {i for i, (a, b) in enumerate(zip(inside, tables, strict=True), 1) if a or b}, [], []
    for (first, level, name), (after, _, _) in zip(heads, [*heads[1:], (len(lines) + 1, 0, "")], strict=True):
        above = [h for h in above if h[0] < level] + [(level, name)]
        out.append(Unit("section", first, after - 1, name, " > ".join(h[1] for h in above), whole=whole))
    lead = heads[0][0] - 1 if heads else len(lines)
    return ([Unit("section", 1, lead, whole=whole)] if any(s.strip() for s in lines[:lead]) else []) + out


def marked(lines: list[str], kind: str, marks: list[tuple[int, str | None]]) -> list[Unit]:
    """A unit from each mark to the line before the next one; what stands before the first mark is a unit without a name."""
    if marks and any(s.strip() for s in lines[: marks[0][0] - 1]):
        marks = [(1, None), *marks]
    ends = [n - 1 for n, _ in marks[1:]] + [len(lines)]
    return [Unit(kind, n, max(n, end), name) for (n, name), end in zip(marks, ends, strict=True)]


def structured_units(lang: str, text: str, lines: list[str]) -> list[Unit]:
    if lang == "json":
        data, at, marks = json.loads(text), 0, []
        for key in data if isinstance(data, dict) else ():
            said = json.dumps(key, ensure_ascii=False)
            at = next((i for i in range(at, len(lines)) if said in lines[i]), at)
            marks.append((at + 1, f"$.{key}"))
        return marked(lines, "block", marks)
    if lang == "toml":
        tomllib.loads(text)
        return marked(lines, "block", [(i, s.strip().strip("[]")) for i, s in enumerate(lines, 1) if s.lstrip().startswith("[")])
    if lang == "yaml":
        keys = [(i, "---" if s.strip() == "---" else m[1] if (m := YAML_KEY.match(s)) else None) for i, s in enumerate(lines, 1)]
        return marked(lines, "block", [k for k in keys if k[1]])
    if lang == "xml":
        return marked(lines, "block", [(i, m[1]) for i, s in enumerate(lines, 1) if (m := XML_TAG.match(s))])
    out = marked(lines, "statement", [(i, None) for i, s in enumerate(lines, 1) if SQL_START.match(s)])
    for unit in out:
        found = SQL_NAME.search("\n".join(lines[unit.first - 1 : unit.last]))
        unit.symbol = found[1] if found else None
    return out


def outline(lang: str | None, text: str, lines: list[str]) -> tuple[list[Unit], bool]:
    """Units of a text, and whether its parser refused it; a text without units is one block or its paragraphs."""
    try:
        if lang == "python":
            found = python_units(text)
        elif lang == "markdown":
            found = markdown_units(lines)
        elif lang in ("json", "toml", "yaml", "xml", "sql"):
            found = structured_units(lang, text, lines) or [Unit("block", 1, len(lines))]
        else:
            found = []
        refused = False
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found, refused = [], True
    return found or [Unit("paragraph", a, b) for a, b in runs([bool(s.strip()) for s in lines])], refused


def cuts(lines: list[str], upto: list[int], unit: Unit, most: int, code: bool) -> list[tuple[int, int]]:
    """Spans of a unit over the limit: code opens one at a shallow line, prose closes one at a free blank line."""
    margin = lambda s: len(s) - len(s.lstrip())
    deepest = margin(lines[unit.first - 1]) + 4
    if code:
        fits: Callable[[int], bool] = lambda i: bool(lines[i - 1].strip()) and margin(lines[i - 1]) <= deepest
    else:
        fits = lambda i: not lines[i - 1].strip() and i not in unit.whole
    starts, used = [unit.first], 0
    for i in range(unit.first, unit.last + 1):
        used += upto[i] - upto[i - 1]
        begin = i if code else i + 1
        if used >= most and begin > starts[-1] and fits(i):
            starts, used = [*starts, begin], 0
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], unit.last + 1], strict=True) if a < b]


def emitted(lines: list[str], upto: list[int], unit: Unit, most: int, code: bool, parent: Chunk | None = None) -> Iterator[Chunk]:
    """Chunks of a unit; no token crosses a line, so tokens are differences of ``upto``, those of the first lines."""
    said = lambda a, b: "\n".join(lines[a - 1 : b])
    if unit.inner:
        last = max(unit.first, min(u.first for u in unit.inner) - 1)
        names = ", ".join(u.symbol.rpartition(".")[2] for u in unit.inner)
        tokens = upto[last] - upto[unit.first - 1] + count_tokens(METHODS + names)
        head = Chunk(unit.kind, unit.first, last, f"{said(unit.first, last)}\n{METHODS}{names}", unit.symbol, None, unit.summary, parent, tokens)
        yield head
        for inner in unit.inner:
            yield from emitted(lines, upto, inner, most, code, head)
        return
    over = upto[unit.last] - upto[unit.first - 1] > most
    spans = cuts(lines, upto, unit, most, code) if over else [(unit.first, unit.last)]
    long = code and unit.symbol and over
    for k, (a, b) in enumerate(spans, 1):
        text = said(a, b)
        if code or text.strip():
            yield Chunk(unit.kind, a, b, text, f"{unit.symbol}#part-{k}" if long else unit.symbol, unit.heading, unit.summary if k == 1 else None, parent, upto[b] - upto[a - 1])


def chunks(path: str, lang: str | None, text: str, most: int, least: int) -> tuple[list[Chunk], bool]:
    """Chunks of one text in order: a tiny one joins the one before it of the same kind and parent, two lines away at most."""
    lines = re.split(r"\r\n|\r|\n", text)
    upto = [0, *accumulate(map(count_tokens, lines))]
    found, refused = outline(lang, text, lines)
    out: list[Chunk] = []
    for unit in found:
        for c in emitted(lines, upto, unit, most, lang in CODE and not refused):
            before = out[-1] if out else None
            if before and c.tokens < least and before.tokens < most and (before.kind, before.parent) == (c.kind, c.parent) and c.first <= before.last + 2:
                before.content, before.last = f"{before.content}\n{c.content}", c.last
                before.tokens += c.tokens
            else:
                out.append(c)
    seen: Counter[str] = Counter()
    for c in out:
        copy = f"::copy-{seen[c.content]}::" if seen[c.content] else ""
        seen[c.content] += 1
        c.id = hashlib.sha256("\0".join((path, c.content + copy, VERSION)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    return out, refused


def words_of_name(path: Column, symbol: Column) -> Column:
    """The lower-cased words of a file's stem and a symbol, null unless a name falls into several words by its capitals."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    plain = F.trim(F.regexp_replace(F.concat_ws(" ", stem, symbol), r"[\s._\-/:]+", " "))
    apart = F.regexp_replace(plain, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.when(apart != plain, F.lower(apart))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def context(path: Column, kind: Column, symbol: Column, heading: Column, content: Column, summary: Column) -> Column:
    """What a chunk is embedded with: path, heading or kind and symbol, words of the name, signature, first sentence of its docstring."""
    signed = F.filter(F.transform(F.split(content, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike("^[@#]"))
    signature = F.when(kind.isin("class", "function", "method"), shortened(F.try_element_at(signed, F.lit(1)), 160))
    sentence = shortened(F.regexp_extract(F.trim(summary), r"^(.+?\.(?= )|.*)", 1), 200)
    label = F.coalesce(heading, F.concat_ws(" ", kind, symbol))
    label = F.when(heading.isNotNull() | symbol.isNotNull(), label)
    return F.concat_ws(" › ", path, label, words_of_name(path, symbol), signature, F.when(sentence != "", sentence))


def units(docs: DataFrame, most: int = 512, least: int = 24) -> DataFrame:
    """Chunks of (doc_id, path, lang, text) with ids, parents and contexts.

    A null text has no chunks, a null path counts as empty; a text that its parser refuses gives paragraphs and is marked;
    equal contents within a document get ids of their own; repeated rows repeat their chunks; other columns are left out.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for doc_id, path, lang, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                found, refused = chunks(path or "", lang, text.as_py() or "", most, least)
                rows += [
                    (doc_id, path, k, c.id, c.parent.id if c.parent else None, c.kind, c.symbol, c.heading, c.first, c.last, c.content, c.tokens, c.summary, refused)
                    for k, c in enumerate(found)
                ]
                if len(rows) >= TOGETHER:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "lang", "text").mapInArrow(run, SCHEMA)
    said = context(F.coalesce("path", F.lit("")), F.col("kind"), F.col("symbol"), F.col("heading_path"), F.col("content"), F.col("summary"))
    return out.withColumn("context", said)


def rechunked(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, state, embed): what became of each chunk between two runs.

    added, removed, moved (other lines, ordinal or parent) or kept; ``embed`` says that its vector is missing or was made of
    another context. One shuffled join on the id, whose contents stay behind.
    """
    cols = ("ordinal", "start_line", "end_line", "parent_id", "context")
    a = old.select("chunk_id", F.struct(*cols).alias("was"))
    b = new.select("chunk_id", F.struct(*cols).alias("now"))
    both = a.join(b, "chunk_id", "full_outer")
    same = F.lit(True)
    for c in cols[:-1]:
        same = same & F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(same, "kept").otherwise("moved")
    fresh = F.col("now").isNotNull() & (F.col("was").isNull() | ~F.col("was.context").eqNullSafe(F.col("now.context")))
    return both.select("chunk_id", state.alias("state"), fresh.alias("embed"))


def valid_vectors(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """The vectors that outlive a run: their chunk is still there and its embedded text is the same."""
    return vectors.join(changes.where("state in ('kept', 'moved') AND NOT embed").select("chunk_id"), "chunk_id", "left_semi")
