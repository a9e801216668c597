"""Documents to chunks. Line chunks are plain Columns; structured pages go through one narrow Arrow pass per document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word of n characters falls into its ceil(n / 4) tokens.
_TOKEN = re.compile(r"\w{1,4}|[^\w\s]")
_HEADINGS = {f"h{k}": k for k in range(1, 7)}


def line_chunks(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, ordinal, start_line, end_line, content): lines grouped by the running length of their document.

    A line's chunk follows from the characters up to its end, within one row, so nothing is shuffled.
    """
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("line"), (i + 1).cast("long").alias("n")))
    walked = F.aggregate(
        lines,
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<line:string,n:bigint,ordinal:bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["used"] + F.length(x["line"]) + 1).alias("used"),
            F.concat(acc["out"], F.array(F.struct(x["line"], x["n"], F.floor((acc["used"] + F.length(x["line"])) / most).cast("long").alias("ordinal")))).alias("out"),
        ),
    )["out"]
    rows = docs.select("doc_id", walked.alias("rows")).select("doc_id", "rows", F.explode(F.array_distinct(F.transform("rows", lambda r: r["ordinal"]))).alias("ordinal"))
    own = F.filter("rows", lambda r: r["ordinal"] == F.col("ordinal"))
    return rows.select("doc_id", "ordinal", F.array_min(F.transform(own, lambda r: r["n"])).alias("start_line"), F.array_max(F.transform(own, lambda r: r["n"])).alias("end_line"), F.array_join(F.transform(own, lambda r: r["line"]), "\n").alias("content"))


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


class _Blocks(HTMLParser):
    """Blocks of a page: (heading path, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.stack, self.blocks, self.open, self.text, self.skip = "", [], [], None, [], 0

    def _close(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if not said:
            return
        if self.open == "title":
            self.title = said
        elif self.open in _HEADINGS:
            level = _HEADINGS[self.open]
            self.stack = [*(s for s in self.stack if s[0] < level), (level, said)]
        else:
            self.blocks.append((" › ".join(s for _, s in self.stack), said))

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("p", "li", "div", "article", "title", "footer", "nav", "br", *_HEADINGS):
            self._close()
            self.open = tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "li", "div", "article", "title", "footer", "nav", *_HEADINGS):
            self._close()
            self.open = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def blocks(html: str) -> tuple[str, list[tuple[str, str]]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._close()
    return parser.title, parser.blocks


def merged(parts: list[tuple[str, str]], most: int, least: int) -> list[tuple[str, str]]:
    """Neighbours under one heading are joined while one is tiny and the sum fits; long blocks are cut at words."""
    out: list[tuple[str, str]] = []
    for head, text in parts:
        words, piece, used = text.split(" "), [], 0
        cut = []
        for w in words:
            n = count_tokens(w)
            if piece and used + n > most:
                cut.append(" ".join(piece))
                piece, used = [], 0
            piece.append(w)
            used += n
        cut.append(" ".join(piece))
        for c in cut:
            if out and out[-1][0] == head and min(count_tokens(out[-1][1]), count_tokens(c)) < least and count_tokens(out[-1][1]) + count_tokens(c) <= most:
                out[-1] = (head, f"{out[-1][1]}\n{c}")
            else:
                out.append((head, c))
    return out


def page_chunks(pages: DataFrame, most: int = 512, least: int = 24) -> DataFrame:
    """(page_id, ordinal, title, heading_path, content, tokens, degraded); a page that cannot be parsed is one plain chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                try:
                    title, parts = blocks(html or "")
                    degraded = False
                except Exception:
                    title, parts, degraded = "", [("", html or "")], True
                rows += [(page_id, k, title, head, text, count_tokens(text), degraded) for k, (head, text) in enumerate(merged(parts, most, least))]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "title", "heading_path", "content", "tokens", "degraded"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ordinal int, title string, heading_path string, content string, tokens long, degraded boolean")
