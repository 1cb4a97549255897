"""Mathematical notation: normal form, symbols, formula test and formula terms.

Spark has no compatibility normalisation (NFKC), so a text goes through an Arrow UDF; whoever
needs its symbols as well (``with_notation``) gets them from the same pass over the words.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lectern.functions import fixed as X
from lectern.functions import text as T


def _spell(ch: str) -> str:
    return X.SYMBOL_NAMES.get(ch) or unicodedata.normalize("NFKC", ch) or ch


_SPELLED: dict[int, str] = {}
_LETTER_DIGIT = re.compile("([A-Za-z])([0-9])")
_DIGIT_LETTER = re.compile("([0-9])([A-Za-z])")
_SYMBOL = re.compile("[A-Za-z]+|[0-9]+")
_WORDS = frozenset(X.MATH_WORDS)


_PLAIN: set[str] = set()


def spell_symbols(value: str) -> str:
    if value.isascii():
        return value
    spelled = set(value) - _PLAIN  # a text of characters that stand for themselves is not translated
    for ch in spelled:
        if ord(ch) not in _SPELLED:
            _SPELLED[ord(ch)] = _spell(ch)
            if _SPELLED[ord(ch)] == ch:
                _PLAIN.add(ch)
    return value.translate(_SPELLED) if spelled else value


def normalized(value: str | None) -> str:
    out = value or ""
    if "\\" in out:
        for markup, name in X.LATEX_NAMES:
            out = out.replace(markup, name)
    out = spell_symbols(out).replace("^T", " transpose ").replace("_", " ")
    if any(digit in out for digit in "0123456789"):
        out = _DIGIT_LETTER.sub(r"\1 \2", _LETTER_DIGIT.sub(r"\1 \2", out))
    return " ".join(out.split())


def read_notation(value: str | None) -> tuple[str, list[str], bool]:
    """Normal form, its distinct symbols in order, and whether one of its words is mathematical."""
    norm = normalized(value)
    found = dict.fromkeys(w.lower() for w in dict.fromkeys(_SYMBOL.findall(norm)))
    return norm, [w for w in found if len(w) == 1 or w in _WORDS], not _WORDS.isdisjoint(norm.lower().split())


_OPERATOR = re.compile(rf"[$\\]|{X.MATH_OPERATORS}")
_LIKE = re.compile(X.MATH_LIKE)


def read_formula(value: str | None) -> tuple[str, list[str], bool]:
    """``read_notation`` of a text that looks like a formula; of others nothing goes on.

    A text without operators can be one by a mathematical word, or by several symbols and a sign; where it
    has neither such letters nor a sign it is not read.
    """
    plain = "", [], False
    if not value:
        return plain
    operator = _OPERATOR.search(value)
    sign = operator or _LIKE.search(value)
    if not sign:
        low = spell_symbols(value).lower()
        if not any(word in low for word in X.MATH_WORDS):
            return plain
    norm, syms, keyword = read_notation(value)
    return (norm, syms, True) if operator or keyword or (sign and len(syms) >= 2) else plain


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalized)


_READ = StructType([StructField("norm", StringType()), StructField("syms", ArrayType(StringType())), StructField("formula", BooleanType())])


@F.pandas_udf(_READ)
def _read(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_formula(t) for t in texts], columns=_READ.names)


def normalize(c: Column) -> Column:
    return _normalized(c)


def formula_terms(normalized: Column, syms: Column) -> Column:
    low = F.lower(normalized)
    # a pattern that begins at a word boundary is dear; its last word has to be there
    held = lambda p: F.contains(low, F.lit(re.findall("[a-z]{3,}", p)[-1]))
    named = [F.when(held(p), T.squeeze(F.regexp_extract(low, f"({p})", 1))).otherwise("") for p in X.MATH_TERMS]
    rest = [F.array_join(F.slice(syms, 1, 12), " "), T.squeeze(F.left(low, F.lit(160)))]
    return F.array_distinct(F.filter(F.array(*named, *rest), lambda t: t != ""))


def with_notation(df, text_col: str, prefix: str = "math_"):
    """Add normalised text, symbols, formula flag and formula terms.

    The Arrow step is projected on its own so that it runs once per row.
    """
    read = F.col(f"{prefix}read")
    norm, syms = read["norm"], read["syms"]
    out = df.withColumn(f"{prefix}read", _read(F.col(text_col))).withColumn(f"{prefix}has_formula", read["formula"])
    flag = F.col(f"{prefix}has_formula")
    empty = F.array().cast("array<string>")
    return (
        out.withColumn(f"{prefix}normalized", F.when(flag, norm).otherwise(""))
        .withColumn(f"{prefix}symbols", F.when(flag, syms).otherwise(empty))
        .withColumn(f"{prefix}formula_ids", F.when(flag, formula_terms(norm, syms)).otherwise(empty))
        .drop(f"{prefix}read")
    )
