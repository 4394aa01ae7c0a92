"""Line-first cleaning: rules per line, then rejection of texts that lose too much.

Everything is built-in Spark expressions.  A line with a word fails if it does not end like a
sentence, looks like navigation, or holds boilerplate.  Failed lines are removed; a text that
loses more than ``max_loss`` of its word characters is rejected, as is one that fails the base
rules (too few words, or too many words in repeated windows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import GAP, WORD, text_or_empty

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: A line that ends like a sentence, closing quotes and brackets aside.
SENTENCE_END = r"[.!?:;…。！？؟।][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Separators between menu entries.
SEPARATORS = r"[\x20\x09-\x0D][|»›•·>][\x20\x09-\x0D]"
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top"
    r"|read more|share this|skip to content|contact us|about us|site map)[.!:;]*[\x20\x09-\x0D]*$"
)
BOILERPLATE = (
    r"(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript"
    r"|javascript is (disabled|required)|lorem ipsum|subscribe to our newsletter|click here to)"
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that stand in a window found twice or more, the first find included.

    Windows are compared by a 64-bit hash.  Texts without a repeated window, the usual case, are
    done after one distinct count; for others the hashes are sorted with their positions.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            def has_twin(x: Column, k: Column) -> Column:
                before = F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                after = F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                return before | after

            return F.array_sort(F.transform(F.filter(s, has_twin), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            bound(pairs, twins),
            start,
            lambda a, p: F.struct(
                (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
            ),
            lambda a: a["n"],
        )

    def of_words(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )
        count = bound(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
        return F.when(F.size(w) > WINDOW, count).otherwise(F.lit(0))

    return bound(words, of_words)


def line_passes(line: Column) -> Column:
    """A line without a word passes: removing it changes nothing."""
    ends_well = line.rlike(SENTENCE_END)
    solid = F.length(F.regexp_replace(line, r"[^|»›•·>]+", ""))
    separated = (solid >= 2) & (F.regexp_count(line, F.lit(SEPARATORS)) >= 2)
    return ~line.rlike(WORD) | (
        ends_well & ~separated & ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE)
    )


def solid_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, GAP, ""))


def clean_lines(
    docs: DataFrame, min_words: int = 10, max_repeated: int = 20, max_loss: int = 50
) -> DataFrame:
    """``docs`` plus ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``lost_chars``, ``kept`` and ``clean_text``.

    Columns that bear these names are replaced.  A null or empty text has no words, so it fails
    the base rules; its clean text is empty.  ``max_repeated`` and ``max_loss`` are percentages.
    Rows are independent: repeated rows get equal results, an empty table none.
    """
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "lost_chars", "kept", "clean_text",
    ]
    text = text_or_empty()
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.split(text, "\n")

    def repeated_lines(x: Column) -> Column:
        return F.size(x) - F.size(F.array_distinct(x))

    rows = docs.drop(*made).withColumns(
        {
            "__base": bound(
                words,
                lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")),
            ),
            "clean_text": F.array_join(F.filter(lines, line_passes), "\n"),
            "word_chars": solid_length(text).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint"),
            "n_dup_lines": bound(F.filter(lines, lambda x: x.rlike(WORD)), repeated_lines).cast("bigint"),
        }
    )
    rows = rows.withColumns(
        {
            "n_words": F.col("__base.n").cast("bigint"),
            "n_repeat_words": F.col("__base.repeated").cast("bigint"),
            "lost_chars": F.col("word_chars") - solid_length(F.col("clean_text")),
        }
    ).drop("__base")
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")
    )
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_loss * F.col("word_chars"))
    return rows.withColumn("kept", kept).select(*docs.drop(*made).columns, *made)
