"""Texts of any length, put together by position.

The rows of a text are never collected into one string. A running offset says where each row stands,
rows are cut where a block of ``PIECE`` characters begins, and a piece is joined from the parts that fall into
its block: at most ``PIECE`` of them, whatever the length of the text, of one row, or the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators.ranking import running_before

#: Characters (code points) of a piece.
PIECE = 4096


def stripped_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` whose joined text has no white space at its ends: rows before the first and after
    the last one that is not blank go, and those two lose their outer white space.

    ``first`` and ``last`` tell these two; texts that are blank throughout have no rows left.
    """
    full = rows.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    edges = full.groupBy(*keys).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    kept = rows.join(edges, keys).where(F.col(order).between(F.col("first"), F.col("last")))
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col(order) == F.col("first"), F.regexp_replace(text, f"\\A[{X.SPACE}]+", "")).otherwise(text)
    return kept.withColumn("text", text).withColumn(
        "text", F.when(F.col(order) == F.col("last"), F.regexp_replace("text", f"[{X.SPACE}]+\\z", "")).otherwise(F.col("text"))
    )


def _parts(text: Column, offset: Column, size: int) -> Column:
    """``text`` cut at multiples of ``size`` counted from its start at ``offset``, in one pass."""
    head = (F.lit(size) - F.pmod(offset, F.lit(size))).cast("int")
    rest = F.regexp_extract_all(F.substr(text, head + 1), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.concat(F.array(F.substr(text, F.lit(1), head)), rest)


def sizes(rows: DataFrame, keys: list[str], order: str, sep: str) -> DataFrame:
    """(keys, last, chars): the last row of a group and the characters of its text; no text is moved."""
    text = F.coalesce("text", F.lit(""))
    return rows.groupBy(*keys).agg(F.max(order).alias("last"), (F.sum(F.length(text)) + len(sep) * (F.count(F.lit(1)) - 1)).alias("chars"))


def pieces(rows: DataFrame, keys: list[str], order: str, sep: str, size: int = PIECE, sized: DataFrame | None = None) -> DataFrame:
    """(keys, piece_no, piece): the texts of a group in ``order``, a whole number without ties, with ``sep``
    between two, as pieces of ``size`` characters; the last is shorter. Null texts count as empty.

    A text that fits a piece is joined where its rows meet; only longer ones are placed and cut. With
    ``sized`` (``sizes``, perhaps of some groups only) other groups fall away.
    """
    narrow = rows.select(*keys, order, F.coalesce("text", F.lit("")).alias("text"))
    if not sep:  # rows without a character do not show; any number of them would meet in a short text
        narrow = narrow.where("text <> ''")
    sized = (sizes(narrow, keys, order, sep) if sized is None else sized).select(*keys, "last", "chars")
    together = F.sort_array(F.collect_list(F.struct(order, "text")))
    short = narrow.join(sized.where(F.col("chars").between(1, size)).drop("last"), keys).groupBy(*keys).agg(together.alias("_rows"))
    short = short.select(*keys, F.lit(0).cast("long").alias("piece_no"), F.array_join("_rows.text", sep).alias("piece"))
    long = narrow.join(sized.where(F.col("chars") > size), keys)
    joined = F.when(F.col(order) == F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit(sep)))
    narrow = long.select(*keys, order, joined.alias("text")).withColumn("_n", F.length("text"))
    placed = running_before(narrow, keys, order, "_n", "_offset").where("_n > 0")
    cut = placed.select(*keys, order, "_offset", F.posexplode_outer(_parts(F.col("text"), F.col("_offset"), size)).alias("_i", "_part"))
    cut = cut.withColumn("piece_no", F.floor(F.col("_offset") / size) + F.col("_i"))
    # parts of one row are in different pieces, so the row's place orders those of a piece
    met = cut.groupBy(*keys, "piece_no").agg(F.sort_array(F.collect_list(F.struct(order, "_part"))).alias("_parts"))
    return short.unionByName(met.select(*keys, "piece_no", F.array_join("_parts._part", "").alias("piece")))
