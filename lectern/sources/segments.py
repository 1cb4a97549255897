"""A log of written segments under one folder: the base of the document store.

A write adds one segment, a folder of parquet files named after the versions it covers and what
its rows do. Nothing that is written is changed. A segment counts once Spark has put
its ``_SUCCESS`` mark there, so a job that dies half-way leaves nothing that is read, and the
next writer takes the same number again. Merging segments writes one that covers the versions of
several; of overlapping segments the widest counts, and ``vacuum`` removes the others.

One writer at a time is assumed for a log; readers need no lock.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.stage import put

_NAME = re.compile(r"^([arb])(\d{12})-(\d{12})$")


@dataclass(frozen=True)
class Segment:
    kind: str  # a: rows are added; r: rows replace or remove; b: all rows of the versions so far
    low: int
    high: int
    path: str
    size: int


class SegmentLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[Segment]:
        """One entry a segment: the driver lists folders, never files or rows."""
        root, fs = self._fs()
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            named = _NAME.match(status.getPath().getName())
            path = status.getPath()
            if named and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                kind, low, high = named.groups()
                found.append(Segment(kind, int(low), int(high), path.toString(), fs.getContentSummary(path).getLength()))
        return found

    def live(self) -> list[Segment]:
        """The segments that hold the present state, oldest first: each version stands in one."""
        chosen: list[Segment] = []
        for s in sorted(self._committed(), key=lambda s: (-s.high, s.low, s.kind != "b")):
            if not chosen or s.high < chosen[-1].low:
                chosen.append(s)
        return chosen[::-1]

    def next_version(self) -> int:
        return max((s.high for s in self._committed()), default=-1) + 1

    def write(self, rows: DataFrame, kind: str, low: int, high: int, keep_empty: bool = False) -> Segment | None:
        """Add a segment; one without rows is not kept, unless that is what it says."""
        path = f"{self.root}/{kind}{low:012d}-{high:012d}"
        put(rows, path, "overwrite")  # overwrites what a dead job left under this number
        if not keep_empty and self.spark.read.parquet(path).isEmpty():
            self._remove(path)
            return None
        return next(s for s in self._committed() if (s.kind, s.low, s.high) == (kind, low, high))

    def _remove(self, path: str) -> None:
        _, fs = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def vacuum(self) -> int:
        """Remove segments whose versions stand in wider ones; only when no reader uses them any more."""
        kept = {s.path for s in self.live()}
        gone = [s for s in self._committed() if s.path not in kept]
        for s in gone:
            self._remove(s.path)
        return len(gone)
