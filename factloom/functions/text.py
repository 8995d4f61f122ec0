"""Text expressions: digests, excerpts, canonical forms, handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """The first 16 hexadecimal digits of a SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def collapsed(text: Column) -> Column:
    """White space reduced to single blanks, without any at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, most: int = 200) -> Column:
    """A text on one line, cut to ``most`` characters."""
    return F.substring(collapsed(text), 1, most)


def snippet(text: Column, most: int = 200) -> Column:
    """A text whose line ends are blanks, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(text, r"[\r\n]", " "), 1, most)


def canonical(text: Column) -> Column:
    """A form that is equal for texts which differ in ASCII case, numbers and white space only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[0-9]+", "0"), r"[ \t\r\n]+", " "))


def handle(*parts: Column) -> Column:
    """An opaque, stable name of a row: base64 of its identifying fields as JSON."""
    return F.base64(F.to_json(F.struct(*parts)).cast("binary"))


def line_count(text: Column) -> Column:
    """Lines of a text; an empty one has one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def occurrences(text: Column, pattern: str) -> Column:
    """Matches of a regular expression (of the subset that all dialects share) in a text."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def html_decoded(text: Column) -> Column:
    """A text with the five named entities of markup replaced, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
