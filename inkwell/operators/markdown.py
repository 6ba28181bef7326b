"""Markdown to rows: a table function for blocks, expressions for inline spans.

Blocks need state from line to line, so a Python table function reads each text once. mode='compat' drops the lines that
look like a marker but are none (`#### x`, `**bold** at the start`, `-x`); mode='lenient' makes them paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import udtf

WEB_SPACE = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_S = f"[{WEB_SPACE}]"

# What a line begins with to be a block of a kind, and what it begins with not to be part of a paragraph.
HEADING = re.compile(rf"(#{{1,3}}){_S}+([^\n\r\u2028\u2029]*)")
RULE = re.compile(r"(-{3,}|\*{3,}|_{3,})\Z")
BULLET = re.compile(rf"[*\-+]{_S}+")
NUMBER = re.compile(rf"[0-9]+\.{_S}+")
MARKER = re.compile(r"#{1,3}|[*\-+]|[0-9]+\.|>|```|---|___|\*\*\*")
FENCE, QUOTE = "```", "> "
# Fixed value: inline marks; bold, italic, code, strike-through; Java's and Python's syntax alike.
INLINE = r"(\*\*(.+?)\*\*|\*(.+?)\*|`(.+?)`|~~(.+?)~~)"
_INLINE = re.compile(INLINE)
KINDS = ("", "", "bold", "italic", "code", "strike")


@dataclass
class Block:
    kind: str
    level: int
    items: list[str]


class Reader:
    """One pass over the lines; each rule takes the lines of its block or none."""

    def __init__(self, text: str, mode: str = "compat"):
        self.lines, self.at, self.mode, self.begun = text.split("\n"), 0, mode, False
        self.rules = (self.code, self.heading, self.rule, self.bullets, self.numbers, self.quote, self.blank, self.paragraph)

    def blocks(self) -> Iterator[Block]:
        while self.at < len(self.lines):
            line, before = self.lines[self.at], self.at
            found = next((b for b in (rule(line) for rule in self.rules) if b is not None), None)
            if self.at == before:
                self.at += 1  # no rule took the line
                found = Block("paragraph", 0, [line]) if self.mode == "lenient" else None
            if found is not None and found.kind:
                self.begun = True
                yield found

    def while_(self, keeps) -> list[str]:
        start = self.at
        while self.at < len(self.lines) and keeps(self.lines[self.at]):
            self.at += 1
        return self.lines[start : self.at]

    def one(self, kind: str, level: int, *items: str) -> Block:
        self.at += 1
        return Block(kind, level, list(items))

    def code(self, line: str) -> Block | None:
        if not line.startswith(FENCE):
            return None
        self.at += 1
        inside = self.while_(lambda x: not x.startswith(FENCE))
        return self.one("code", 0, "\n".join(inside))

    def heading(self, line: str) -> Block | None:
        m = HEADING.match(line)
        return self.one("heading", len(m[1]), m[2]) if m else None

    def rule(self, line: str) -> Block | None:
        return self.one("rule", 0) if RULE.match(line.strip(WEB_SPACE)) else None

    def _listed(self, kind: str, mark: re.Pattern, line: str) -> Block | None:
        if not mark.match(line):
            return None
        return Block(kind, 0, [mark.sub("", x, count=1) for x in self.while_(mark.match)])

    def bullets(self, line: str) -> Block | None:
        return self._listed("bullets", BULLET, line)

    def numbers(self, line: str) -> Block | None:
        return self._listed("numbers", NUMBER, line)

    def quote(self, line: str) -> Block | None:
        return self.one("quote", 0, line[len(QUOTE) :]) if line.startswith(QUOTE) else None

    def blank(self, line: str) -> Block | None:
        if line.strip(WEB_SPACE):
            return None
        return self.one("spacer" if self.begun else "", 0)

    def paragraph(self, line: str) -> Block | None:
        found = self.while_(lambda x: bool(x.strip(WEB_SPACE)) and not MARKER.match(x))
        return Block("paragraph", 0, [" ".join(found)]) if found else None


def blocks(text: str | None, mode: str = "compat") -> list[Block]:
    return list(Reader(text, mode).blocks()) if text else []


@udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType()))]))
class MarkdownBlocks:
    """SQL and DataFrame table function: markdown_blocks(text, mode)."""

    def eval(self, text: str, mode: str = "compat"):
        for pos, b in enumerate(blocks(text, mode)):
            yield pos, b.kind, b.level, b.items


def register(spark: SparkSession) -> None:
    """markdown_blocks for SQL: select ... from t, lateral markdown_blocks(t.text, 'compat')."""
    spark.udtf.register("markdown_blocks", MarkdownBlocks)


def with_blocks(df: DataFrame, column: str, mode: str = "compat") -> DataFrame:
    """df's columns with a row per block of the text in `column`."""
    register(df.sparkSession)
    return df.sparkSession.sql(f"select t.*, b.* from {{t}} t, lateral markdown_blocks(t.`{column}`, '{mode}') b", t=df)


def spans(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the inline spans, in order; kind 'text' for what is between."""
    out, last = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > last:
            out.append(("text", text[last : m.start()]))
        group = next(k for k in (2, 3, 4, 5) if m[k] is not None)
        out.append((KINDS[group], m[group]))
        last = m.end()
    if last < len(text) or not out:
        out.append(("text", text[last:]))
    return out


def marked(text: Column) -> Column:
    """array<string>: the marked spans, marks and all."""
    return F.regexp_extract_all(text, F.lit(INLINE), F.lit(1))


def marked_kind(span: Column) -> Column:
    return F.when(F.startswith(span, F.lit("**")) & (F.length(span) > 4), "bold").when(F.startswith(span, F.lit("*")), "italic").when(F.startswith(span, F.lit("`")), "code").otherwise("strike")
