"""Column functions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of letters, digits and everything beyond ASCII.
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. Pure ASCII takes the fast built-in; other texts are translated."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def letter_words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(LETTER_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string")) % modulus


def once(value: Column, use) -> Column:
    """``use(value)`` where the value is computed once although the lambda reads it often."""
    return F.transform(F.array(value), use)[0]
