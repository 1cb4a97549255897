"""Counts of a text, taken in one pass over its words.

Scores of recognised and merged text need four counts of the same text. Column functions take a
pattern pass for each and build arrays of all words on the way; here the words are read once, in
the stage that has the text, and only numbers go on from there.
"""

from __future__ import annotations

from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lectern.functions import text as T

COUNTS = ("words", "solid", "symbols", "odd")
_EDGE = ".,;:()[]{}"
_NOISE = ("?", "|", "�")


_LETTERS = "".join(c for c in map(chr, range(128)) if c.isalnum()).encode()


def _symbols(solid: str) -> int:
    """Characters of a text without white space that are neither letters nor numbers."""
    if solid.isascii():
        return len(solid.encode().translate(None, _LETTERS))
    return sum(solid.count(c) for c in set(solid) if not c.isalnum())


def word_counts(s: str | None) -> tuple[int, int, int, int]:
    """Words, their characters, characters that are neither letters nor numbers, and odd words:
    those of one character at most between punctuation, and again those that hold noise."""
    words = s.split() if s else []
    solid = "".join(words)
    odd = sum(map((2).__gt__, map(len, map(str.strip, words, repeat(_EDGE)))))
    if any(noise in solid for noise in _NOISE):
        odd += sum(any(noise in w for noise in _NOISE) for w in words)
    return len(words), len(solid), _symbols(solid), odd


def page_counts(s: str | None, limit: int) -> tuple[int, int, int, int, str]:
    """Characters that are neither letters, numbers nor white space, words, distinct words regardless
    of case, lines that are not blank, and the first ``limit`` characters with white space runs as one blank."""
    s = s or ""
    words, low = s.split(), s.lower().split()
    lines = sum(not line.isspace() for line in s.splitlines() if line)
    return _symbols("".join(words)), len(low), len(set(low)), lines, " ".join(words[:limit])[:limit]


@F.pandas_udf(StructType([StructField(name, IntegerType()) for name in COUNTS]))
def counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_counts(s) for s in texts], columns=COUNTS, dtype="int32")


def page_measures(limit: int):
    """``page_counts`` of a text column in one Arrow step."""
    fields = [StructField(name, IntegerType()) for name in ("symbols", "words", "distinct", "lines")]

    @F.pandas_udf(StructType([*fields, StructField("preview", StringType())]))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_counts(s, limit) for s in texts], columns=["symbols", "words", "distinct", "lines", "preview"])

    return measured


def with_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the counts of a text column. The Arrow step is projected on its own."""
    return df.withColumn(name, counts(F.col(column)))


def length(m: Column) -> Column:
    """Characters of the text with white space runs as one blank."""
    return F.when(m["words"] > 0, m["solid"] + m["words"] - 1).otherwise(0)


def symbol_ratio(m: Column) -> Column:
    return F.when(m["words"] > 0, m["symbols"] / length(m)).otherwise(F.lit(0.0))


def fragmentation(m: Column) -> Column:
    return F.when(m["words"] > 0, F.least(F.lit(1.0), m["odd"] / m["words"])).otherwise(F.lit(1.0))


def readability(m: Column) -> Column:
    score = T.clamp(T.clamp(length(m) / 160) - symbol_ratio(m) * 0.7 - fragmentation(m) * 0.5)
    return F.when(m["words"] > 0, score).otherwise(F.lit(0.0))


def together(*parts: Column) -> Column:
    """Counts of texts with white space between them."""
    return F.struct(*[sum((p[name] for p in parts[1:]), parts[0][name]).alias(name) for name in COUNTS])
