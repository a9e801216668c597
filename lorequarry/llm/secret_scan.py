"""Secret scan: an Aho-Corasick pass finds keywords, anchored expressions run only at its hits, checksums settle the rest.

One automaton over the lower-cased text holds every keyword. Only where it hits does an expression run, anchored at the
hit, on the text as written. Runs of hex digits have no keyword; they are found by probing every sixth byte, since a run
of 24 covers four probes in a row, and only such places are widened to whole runs. Tokens that embed a checksum (the last
six of 36 characters are the CRC-32 of the first thirty in base 62) count only if it holds.

Defined results: a null or empty text has no spans; whole texts are read, however long; rows that repeat are scanned one
by one; spans are in code points, end exclusive; matches of one kind never overlap, spans of two kinds may.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import texts

#: In the order in which spans of one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = ("password", "passwd", "secret", "token")
ASSIGN = re.compile(rf"""(?:{"|".join(map(_either, _NAMES))}|{_either("api")}_?{_either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
GITHUB = re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: keyword (lower case) -> kind
KEYWORDS = {k: "assign" for k in (*_NAMES, "apikey", "api_key")} | {"akia": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_RUN = re.compile(b"[0-9a-f]+")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def checksum_holds(body: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those before, padded with zeros."""
    n, tail = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        tail = _DIGITS[digit] + tail
    return tail == body[-6:]


def _good(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= LEAST_VALUE
    return len(m[0]) >= LEAST_ACCESS if kind == "access" else checksum_holds(m[1])


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the maximal runs of 24 or more of 0-9 and a-f."""
    probe = _HEX[np.frombuffer(data, dtype=np.uint8)[::6]]
    if len(probe) < 4:
        return []
    found, end = [], 0
    for k in np.flatnonzero(probe[:-3] & probe[1:-2] & probe[2:-1] & probe[3:]):
        at = int(k) * 6
        if at < end:
            continue
        start = at
        while start > end and _HEX[data[start - 1]]:
            start -= 1
        end = _HEX_RUN.match(data, start).end()
        if end - start >= LEAST_HEX:
            found.append((start, end))
    return found


def spans(data: bytes, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in a UTF-8 text, by start and then by kind as listed."""
    found, text, last = [], None, dict.fromkeys(EXPRESSIONS, 0)
    for at, (kind, n) in keywords.iter(data.lower().decode()):
        start = at + 1 - n
        if start < last[kind]:
            continue
        text = data.decode() if text is None else text
        if m := EXPRESSIONS[kind].match(text, start):
            last[kind] = m.end()
            if _good(kind, m):
                found.append((start, m.end(), kind))
    for start, end in hex_runs(data):
        first = len(data[:start].decode())
        found.append((first, first + end - start, "hex"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _said(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in batches:
        for first, run in texts(batch.column(1)):
            rows = []
            for data in run:
                found = spans(data, keywords)
                base = [s for s in found if s[2] in BASE_KINDS]
                count = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
                rows.append((*count, hashlib.sha256(_said(base).encode()).hexdigest(), _said(found)))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, a digest of the base spans, and all spans. Never a secret itself."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, keywords) -> str:
    """The text with each run of overlapping spans replaced by the names of its kinds."""
    runs: list[list] = []
    for start, end, kind in spans(text.encode(), keywords):
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
            runs[-1][2] |= {kind}
        else:
            runs.append([start, end, {kind}])
    parts, at = [], 0
    for start, end, kinds in runs:
        parts += [text[at:start], "[secret:" + "+".join(k for k in KINDS if k in kinds) + "]"]
        at = end
    return "".join([*parts, text[at:]])


def _redact(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
    keywords = automaton()
    for values in column:
        yield pd.Series([None if v is None else redacted(v, keywords) for v in values], dtype=object)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced; a length column, if there is one, follows the new text. Null stays null."""
    out = docs.withColumn(text_col, F.pandas_udf(_redact, "string")(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
