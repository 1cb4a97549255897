"""Labelled documents for the classifiers that learn on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents of each class a classifier learns from, at most.
PER_CLASS = 1500
#: Longer texts (bytes) are scored like all others but not learnt from.
LONGEST = 1 << 20


@dataclass
class Sample:
    texts: list[str]
    classes: list[int]
    #: rows of each class among all labels that may be learnt from
    totals: dict[int, int]


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS) -> Sample:
    """At most ``per_class`` texts of each class, those whose doc_id has the smallest hash.

    ``learn`` says which labelled doc_ids may be used. The choice is made on the narrow labels
    table, so the documents are read once, against a broadcast of at most 2 * ``per_class`` ids.
    Null labels and ids are left out; an id labelled twice counts once, with its larger label.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("_class"))
    totals = {r["_class"]: r["n"] for r in usable.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    first = lambda c: usable.where(F.col("_class") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = first(0).unionByName(first(1))
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = found.dropDuplicates(["doc_id"]).select("doc_id", "text", "_class").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return Sample([r["text"] for r in rows], [r["_class"] for r in rows], totals)


def prior_shift(sample: Sample) -> float:
    """What to add to log odds learnt on the sample so that they hold for all labelled rows."""
    import math

    seen = [max(1, sample.classes.count(c)) for c in (0, 1)]
    true = [max(1, sample.totals.get(c, 0)) for c in (0, 1)]
    return math.log(true[1] / true[0]) - math.log(seen[1] / seen[0])
