"""Identity rules: normal forms of texts and paths, digests and shards, as Columns. Values must be bit-exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    """Line ends become LF, trailing blanks of lines and edge newlines go."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t\f\x0B]+(\n|$)", "$1")
    return F.regexp_replace(lines, r"^\n+|\n+$", "")


def normalize_path(path: Column) -> Column:
    """Forward slashes and no leading ``./``; absolute paths give null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(~p.rlike(r"^(/|[A-Za-z]:)"), F.regexp_replace(p, r"^(\./)+", ""))


def digest(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by NUL; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def shard_of(id_: Column, shards: int) -> Column:
    """First eight hex digits as a number modulo the shards, as two hex digits."""
    return F.lower(F.lpad(F.hex(F.conv(F.substring(id_, 1, 8), 16, 10).cast("long") % shards), 2, "0"))
