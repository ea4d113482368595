"""Text functions: normal forms that are not interchangeable, splitting, matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_form(x: Column) -> Column:
    """Lower case, possessive 's dropped, other than letters and digits of ASCII to single spaces."""
    low = F.regexp_replace(F.lower(x), "'s\\b", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def relation_form(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def gold_form(x: Column) -> Column:
    """Like label_form, but digits go as well."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z]+", " "))


def answer_form(x: Column) -> Column:
    """Lower case without ASCII punctuation and English articles, spaces squeezed."""
    bare = F.regexp_replace(F.lower(x), "[!-/:-@\\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "\\b(a|an|the)\\b", " "), "\\s+", " "))


def entity_form(x: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0), " ")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0)


def paragraphs(x: Column, least: int = 10) -> Column:
    """Trimmed pieces between blank lines, of ``least`` characters or more."""
    pieces = F.transform(F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n[ \t]*\n"), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: F.length(p) >= least)


def sentences(x: Column) -> Column:
    """Pieces that end in ., ! or ? (and closing quotes) before white space."""
    marked = F.regexp_replace(x, "([.!?][\"')\\]]*)\\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(F.trim(s)) > 0)


def overlapping_chunks(x: Column, size: int, overlap: int) -> Column:
    """Stripped pieces of ``size`` characters, each ``overlap`` into its predecessor; none after the text's end."""
    step = max(1, size - overlap)
    last = F.greatest(F.ceil((F.length(x) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(x, i * step + 1, F.lit(size))))


def truncated(x: Column, limit: int) -> Column:
    """Stripped; beyond the limit cut to limit - 1 characters and an ellipsis."""
    bare = F.trim(x)
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.rtrim(F.substring(bare, 1, limit - 1)), F.lit("…")))


def clean(x: Column) -> Column:
    """No byte-order mark, line feeds only, at most two blank lines in a row."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^﻿", ""), "\r\n?", "\n"), "\n{4,}", "\n\n\n")


def match_strength(alias: Column, surface: Column) -> Column:
    """4 exact, 3 but for case, 2 but for white space too, 1 in the normal form, 0 otherwise."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    return (
        F.when(alias == surface, 4)
        .when(F.lower(alias) == F.lower(surface), 3)
        .when(squeeze(alias) == squeeze(surface), 2)
        .when((label_form(alias) == label_form(surface)) & (label_form(alias) != ""), 1)
        .otherwise(0)
    )


def citations(x: Column, prefix: str = "NODE-") -> Column:
    """Cited node ids in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"\\[({prefix}[0-9a-f]+)\\]"), 1))


def capitalised(x: Column, least: int = 6) -> Column:
    """Each capitalised ASCII word of ``least`` letters or more, once. Word characters are ASCII's, as in RE2: other letters end a word (Java's \\b takes them in)."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?<![A-Za-z0-9_])[A-Z][a-z]{{{least - 1},}}(?![A-Za-z0-9_])"), 0))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit("href=\"([^\"#]+)"), 1))


def token_estimate(x: Column) -> Column:
    """A third of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(x) / 3).cast("long")


@F.pandas_udf(T.StringType())  # a type, not its name: no session is needed to import
def folded(x: pd.Series) -> pd.Series:
    """Compatible characters taken apart, accents dropped, cases folded, spaces squeezed."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join(bare.split()).casefold()

    return x.map(one)
