"""Text functions as Columns: tokens, snippets, detectors, normal forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and word lists below are fixed values: results must equal those of the behaviour that they reproduce.
WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
QUESTION = r"(?i)\?|^\s*(como|o que|oque|por que|porque|quando|onde|qual|quais|quem)\b"
IDENTIFIER = r"[a-z][A-Z]|::|\(\)|_[a-z]|\.[a-z]+\("
INTENTS = (
    ("implement", (r"\b(implementar|criar|adicionar|construir|desenvolver|fazer)\b", r"\b(implement|create|add|build)\b")),
    ("locate", (r"\b(onde|como funciona|o que (e|é)|por que|quando|qual)\b", r"\b(where|how does|what is|why)\b")),
    ("fix", (r"\b(corrigir|consertar|bug|erro|falha|quebrad[oa]|exception|traceback)\b", r"\b(fix|broken|failing|error)\b")),
    ("review", (r"\b(revisar|review|auditar|avaliar|refatorar|melhorar)\b",)),
)
STOP_WORDS = ("de", "da", "do", "para", "com", "em", "um", "uma", "o", "a", "os", "as", "e", "no", "na", "que", "por", "the", "of", "to", "for", "and", "novo", "nova", "usar")
WORK_FOLDERS = ("task", "tasks", "backlog", "stories", "planning")
TEST_FOLDERS = ("tests", "test", "spec", "specs", "__tests__")


def _marks() -> tuple[str, str]:
    """Letters that decompose into one letter and combining marks, and those letters, over the Latin and Greek-extended blocks."""
    marked, plain = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x2000)):
        first, *rest = unicodedata.normalize("NFD", chr(code))
        if rest and all(unicodedata.combining(c) for c in rest):
            marked, plain = marked + chr(code), plain + first
    return marked, plain


MARKED, PLAIN = _marks()


def folded(text: Column) -> Column:
    """Text without diacritics: composed letters become their base letter, combining marks go."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}+", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    """Estimated model tokens: a run of word characters of n > 4 counts ceil(n / 4), any other token 1."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    price = lambda t: F.when(F.length(t) <= 4, F.lit(1)).otherwise(F.ceil(F.length(t) / 4)).cast("long")
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, t: total + price(t))


def snippet(text: Column, most: int) -> Column:
    """The first ``most`` characters, cut at the last line end if it lies in their last 40 %, else at a space; an ellipsis marks a cut."""
    whole = F.rtrim(F.regexp_replace(text, r"\s+$", ""))
    window = F.substring(whole, 1, most)
    last = lambda mark: F.when(F.instr(window, mark) > 0, most - F.instr(F.reverse(window), mark)).otherwise(F.lit(-1))
    at = F.when(last("\n") < int(most * 0.6), last(" ")).otherwise(last("\n"))
    at = F.when(at <= 0, F.lit(most)).otherwise(at)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(F.substring(window, F.lit(1), at), r"\s+$", ""), F.lit("…")))


def line_snippet(text: Column, most: int) -> Column:
    """The first line that is not blank, trimmed and limited."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return F.substring(F.trim(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))), 1, most)


def is_question(text: Column) -> Column:
    return text.rlike(QUESTION)


def is_identifier(text: Column) -> Column:
    return text.rlike(IDENTIFIER)


def intent_core(pattern: str) -> str:
    """An intent's pattern without the word boundaries at its ends, whose meaning differs between engines and versions."""
    return pattern.removeprefix(r"\b").removesuffix(r"\b")


def intent(text: Column) -> Column:
    """The first intent one of whose words stands in the text as a whole word, in any case; letters with diacritics are letters."""
    out = F.lit("general")
    for name, patterns in reversed(INTENTS):
        for pattern in patterns:
            out = F.when(text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){intent_core(pattern)}(?![\p{{L}}\p{{N}}_])"), F.lit(name)).otherwise(out)
    return out


def tier(path: Column) -> Column:
    """work, test or knowledge; work wins when both fit."""
    under = lambda names: path.rlike(f"(^|/)({'|'.join(names)})/")
    return F.when(under(WORK_FOLDERS), "work").when(under(TEST_FOLDERS), "test").otherwise("knowledge")


def split_identifier(token: Column) -> Column:
    """Lower-cased parts of a name cut at ``_ - .`` and at case changes, longer than one character."""
    spaced = F.regexp_replace(F.regexp_replace(token, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(F.regexp_replace(spaced, r"[_\-.]+", " "), " +"), F.lower), lambda p: F.length(p) > 1)


def query_terms(text: Column) -> Column:
    """Distinct terms of a query: each word lower-cased, then the parts of its name, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.concat(F.array(F.lower(w)), split_identifier(w)))))


def route(path: Column) -> Column:
    """One form for equal routes of different stacks: parameters become {}, slashes collapse, a slash leads."""
    p = path
    for pattern in (r"\{[^}]*\}", r":[A-Za-z_][A-Za-z0-9_]*", r"<[^>]*>", r"%[sd]"):
        p = F.regexp_replace(p, pattern, "{}")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def slug(text: Column) -> Column:
    joined = F.regexp_replace(F.array_join(F.slice(terms(text), 1, 6), "-"), "[^a-z0-9-]+", "")
    out = F.substring(joined, 1, 60)
    return F.when(out == "", F.lit("trabalho")).otherwise(out)


def module_of(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", 2)


def valid_path(path: Column) -> Column:
    """Relative, without drive letters and without parent steps."""
    return ~path.rlike(r"^([A-Za-z]:|[/\\])|(^|[/\\])\.\.([/\\]|$)") & (path != "")


def artifact_name(path: Column) -> Column:
    """Slashes become two underscores; a path that already holds two gets a hash so that names stay distinct."""
    flat = F.replace(path, F.lit("/"), F.lit("__"))
    return F.when(F.instr(path, "__") > 0, F.concat(flat, F.lit("-"), F.substring(F.sha2(path, 256), 1, 6))).otherwise(flat)


def clean_subject(subject: Column) -> Column:
    """A commit subject without its ``type(scope):`` prefix and its trailing ticket in parentheses."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(subject), r"^[a-z]+(\([^)]*\))?!?:\s*", ""), r"\s*\([A-Z]+-[0-9]+\)\s*$", ""))
