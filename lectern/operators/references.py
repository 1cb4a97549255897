"""Bibliography and citations of a document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T

_SPLIT = "(?s)\\A(.*?)" + X.REFERENCE_HEADER + "(.*)\\z"


def split_references(docs: DataFrame) -> DataFrame:
    """Add ``body`` and ``reference_part`` around the first bibliography header."""
    has = F.col("text").rlike(X.REFERENCE_HEADER)
    return docs.withColumn(
        "body", F.when(has, F.regexp_extract("text", _SPLIT, 1)).otherwise(F.col("text"))
    ).withColumn("reference_part", F.when(has, F.regexp_extract("text", _SPLIT, 2)).otherwise(""))


def bibliography(docs: DataFrame) -> DataFrame:
    """One row per ``[n]`` entry: authors, title, year, venue."""
    part = F.col("reference_part")
    ids = F.regexp_extract_all(part, F.lit(X.REFERENCE_ENTRY), F.lit(1))
    texts = F.regexp_extract_all(part, F.lit(X.REFERENCE_ENTRY), F.lit(2))
    rows = docs.select("doc_id", F.posexplode_outer(F.arrays_zip(ids.alias("id"), texts.alias("entry"))).alias("entry_no", "e")).where("e is not null")
    entry = T.strip(F.col("e.entry"))
    rows = rows.select("doc_id", "entry_no", F.col("e.id").alias("ref_id"), entry.alias("entry")).withColumn(
        "parts", F.filter(F.transform(F.split("entry", "\\."), T.strip), lambda p: p != "")
    )
    at = lambda i: F.get("parts", F.lit(i))
    authors = F.filter(F.transform(F.split(at(0), f",[{X.SPACE}]*"), T.strip), lambda a: a != "")
    year = F.regexp_extract("entry", X.YEAR, 1)
    return rows.select(
        "doc_id",
        "entry_no",
        "ref_id",
        F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        F.coalesce(at(1), F.lit("")).alias("title"),
        F.when(year != "", year.cast("int")).alias("year"),
        at(2).alias("venue"),
    )


def _expanded(ids: Column) -> Column:
    """``1, 3-5`` as 1 3 4 5; what does not read as a range stays as it is."""

    def one(p: Column) -> Column:
        low = F.regexp_extract(p, "^([0-9]+)-([0-9]+)$", 1).try_cast("int")
        high = F.regexp_extract(p, "^([0-9]+)-([0-9]+)$", 2).try_cast("int")
        return (
            F.when(low.isNull() | high.isNull(), F.array(p))
            .when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda i: i.cast("string")))
            .otherwise(F.array().cast("array<string>"))
        )

    parts = F.filter(F.split(ids, f"[,{X.SPACE}]+"), lambda p: p != "")
    return F.flatten(F.transform(parts, one))


#: Characters shown on each side of a citation.
AROUND = 200
#: So many citations, three characters each at least, fill that.
_REACH = -(-AROUND // 3)


def citations(docs: DataFrame) -> DataFrame:
    """One row per cited id with the 200 characters on either side of the citation.

    The body is split at its citations, once, and stays in its row. What surrounds a
    citation is joined from the ends of the pieces next to it, so the work is in proportion to
    body and citations, and only finished excerpts become rows. Characters are code points.
    """
    split = F.struct(
        F.split("body", X.CITATION).alias("gaps"),
        F.regexp_extract_all("body", F.lit(X.CITATION), F.lit(0)).alias("marks"),
        F.regexp_extract_all("body", F.lit(X.CITATION), F.lit(1)).alias("inner"),
    )
    ending = lambda c: F.substring(c, -AROUND, AROUND)
    opening = lambda c: F.substring(c, 1, AROUND)

    def ends(s: Column) -> Column:
        """Of each gap and the mark behind it what a later citation can see; of each mark and the gap behind it what an earlier one can."""
        before = F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["marks"])), s["marks"], lambda g, m: F.concat(ending(g), ending(m)))
        after = F.zip_with(s["marks"], F.slice(s["gaps"], F.lit(2), F.size(s["marks"])), lambda m, g: F.concat(opening(m), opening(g)))
        return F.struct(s["gaps"], s["marks"], s["inner"], before.alias("before"), after.alias("after"))

    def cited(s: Column) -> Column:
        def one(mark: Column, i: Column) -> Column:
            low = F.greatest(F.lit(0), i - _REACH)
            left = ending(F.concat(F.array_join(F.slice(s["before"], low + 1, i - low), ""), ending(F.get(s["gaps"], i))))
            right = opening(F.concat(opening(F.get(s["gaps"], i + 1)), F.array_join(F.slice(s["after"], i + 2, F.lit(_REACH)), "")))
            return F.struct(mark.alias("in_text"), T.strip(F.concat(left, mark, right)).alias("around"), F.get(s["inner"], i).alias("inner"))

        return F.transform(s["marks"], one)

    # lists of one element bind what is computed once, so that no lambda computes it again
    found = F.flatten(F.transform(F.transform(F.array(split), ends), cited))
    rows = docs.where(F.col("body").isNotNull()).select("doc_id", F.posexplode_outer(found).alias("cite_no", "c")).where("c is not null")
    return rows.select(
        "doc_id",
        "cite_no",
        F.col("c.in_text").alias("in_text"),
        F.col("c.around").alias("surrounding_text"),
        F.posexplode(_expanded(F.col("c.inner"))).alias("id_no", "ref_id"),
    )
