"""Text expressions.  All of them stay on the JVM and process whole texts."""

from __future__ import annotations

from string import Formatter

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space when a text is stripped, line feed included.
BLANKS = (
    "\n\t\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Remove Unicode white space, line feeds included, from both ends.

    Trimming looks at the ends only, where a pattern would be tried everywhere.
    """
    return F.trim(value, F.lit(BLANKS))


def rstrip(value: Column) -> Column:
    return F.rtrim(value, F.lit(BLANKS))


def clean_text(value: Column) -> Column:
    """Canonical cell text: one kind of line end, single spaces, stripped lines,
    at most one blank line in a row, stripped ends.

    Patterns run only on cells that hold something to replace.
    """
    raw = as_text(value)
    text = F.when(raw.contains("\r"), F.regexp_replace(raw, r"\r\n?", "\n")).otherwise(raw)
    spaced = raw.contains("  ") | raw.contains("\t")
    text = F.when(spaced, F.regexp_replace(text, r"[ \t]+", " ")).otherwise(text)
    text = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    # the lines are stripped by now, so only line feeds can be left at the ends
    return F.trim(text, F.lit("\n"))


def lines(value: Column) -> Column:
    """Array of the stripped, non-blank lines of a text."""
    parts = F.split(as_text(value), _LINE_ENDS)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def contains_any(value: Column, phrases: list[str]) -> Column:
    return any_of([value.contains(p) for p in phrases])


def ellipsis(value: Column, max_chars: int) -> Column:
    cut = F.concat(rstrip(F.substring(value, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(value) > max_chars, cut).otherwise(value)


def safe_text(value: Column, default: str = "Unknown", max_chars: int = 400) -> Column:
    """Stripped text, a default where nothing is left, cut with an ellipsis."""
    text = strip(as_text(value))
    return F.when(text == "", F.lit(default)).otherwise(ellipsis(text, max_chars))


def first_group(value: Column, patterns: list[str], group: int = 1) -> Column:
    """Group of the first pattern that matches anywhere; null when none does."""
    return F.coalesce(
        *[
            F.when(value.rlike(p), F.regexp_extract(value, p, group))
            for p in patterns
        ]
    )


def sha16(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def filled(template: str, **values: Column) -> Column:
    """A sentence with its named places filled; null where a value is null."""
    parts = [
        piece
        for text, name, _, _ in Formatter().parse(template)
        for piece in ([F.lit(text)] if text else []) + ([values[name].cast("string")] if name else [])
    ]
    return F.concat(*parts)
