"""Text measures and splits as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence boundary, token separator, tokens per whitespace word.
SENTENCE_BOUNDARY = r"(?<=[.!?]) +"
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
TOKENS_PER_WORD = 1.3


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BOUNDARY)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def estimated_tokens(words: Column) -> Column:
    """Token estimate of a word total: truncate once, after summing."""
    return F.floor(words * F.lit(TOKENS_PER_WORD)).cast("bigint")


def tokens(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TOKEN_SEPARATOR), lambda t: t != "")
