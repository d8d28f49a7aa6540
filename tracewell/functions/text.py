"""Column expressions that turn raw trace text into frames, lines and tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that are stripped and count as white space.
WHITE = " \t\n\r\f\v"


def clean_trace(text: Column) -> Column:
    """Without carriage returns, and without an `a` that begins a line other than the first."""
    return F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\na"), F.lit("\n"))


def word_frames(text: Column) -> Column:
    """Stripped text with newlines as spaces, cut at every single space; the empty text is one empty frame."""
    return F.split(F.btrim(F.translate(text, "\n", " "), F.lit(WHITE)), " ", -1)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def adjacent(items: Column, n: int = 2) -> Column:
    """Runs of n neighbouring items joined by spaces; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.array_join(F.slice(items, i, n), " "))
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<string>"))


def line_bigrams(text: Column) -> Column:
    return adjacent(lines(text))


def vector_text(text: Column) -> Column:
    """Newlines as spaces, without $ / < >."""
    return F.translate(text, "\n$/<>", " ")


def normalized_frame(frame: Column) -> Column:
    """Lower case, without $ / < >."""
    return F.translate(F.lower(frame), "$/<>", "")


def packages(text: Column) -> Column:
    """Of each line what stands before its last dot (nothing without a dot), joined by spaces; without $ / < >."""
    head = lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, ".", -1)) - 1)
    joined = F.array_join(F.transform(lines(text), head), " ")
    return F.translate(joined, "$/<>", "")


def tokens(text: Column) -> Column:
    """Tokens [a-z0-9_.]{2,} of the text in lower case, between word borders.

    Letters, marks and digits beyond ASCII are word characters but no token characters; upper-case X
    stands for them, so that the border rule is the same in every regex engine.
    """
    plain = F.regexp_replace(F.lower(text), r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]", "X")
    return F.regexp_extract_all(plain, F.lit(r"\b[a-z0-9_.]{2,}\b"), F.lit(0))


def padded(ids: Column, length: int) -> Column:
    """ids cut to `length`, or filled with zeros at the end."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)
