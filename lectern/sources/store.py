"""The document store: one log-structured table per artifact under a shared folder.

A change writes the rows that change and nothing else: new rows of a document, or a mark that it
is gone, become a segment of their own (``segments``). Reading merges: of a document, the rows of
the last version that replaced it count, and rows that were only added after that. Segments that
replace nothing, such as event logs, are read without any join.

``compact`` bounds what reading merges. Segments that together are small beside the base become one
segment; once they reach a share of the base they are folded into a new base.

Rows lie in the order of a hash of the document id, cut into files by size, so that a lookup of
one document reads the row groups whose range holds its hash. Nothing depends on a number of
buckets, and a document of any size is just more files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from lectern.operators.stage import alone, nothing, passing, written
from lectern.sources.segments import Segment, SegmentLog

#: Segments beside the base from which on ``compact`` merges them.
MOST_SEGMENTS = 8
#: Share of the base's bytes from which on all becomes a new base.
FOLD_SHARE = 0.25
ARTIFACTS = (
    "documents parsed_docs doc_pages enhanced_pages doc_sections section_summaries chunks vectors page_quality ocr_pages "
    "vision_pages understanding analysis_meta briefs translations learning_events concept_memory term_log "
    "reflections session_summaries validation_records reading_records derivations prefixes core_memory"
).split()
STATUSES = "uploaded parsing chunking summarizing indexing ready failed".split()
#: What a stored row does to the earlier rows of its document.
ADDED, REPLACING, GONE = 0, 1, 2
OWN_COLUMNS = ("_hash", "_version", "_does")


def _hash(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"))


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, artifact: str) -> str:
        if artifact not in ARTIFACTS:
            raise ValueError(f"unknown artifact {artifact!r}")
        return f"{self.root}/{artifact}"

    def log(self, artifact: str) -> SegmentLog:
        return SegmentLog(self.spark, self.path(artifact))

    def exists(self, artifact: str) -> bool:
        return bool(self.log(artifact).live())

    # --- reading ---

    def _segments(self, segments: list[Segment]) -> DataFrame:
        parts = [self.spark.read.parquet(s.path) for s in segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _merged(self, segments: list[Segment], keep_marks: bool = False) -> DataFrame:
        """The rows of ``segments`` that count; with the marks of removed documents, if asked for."""
        if all(s.kind != "r" for s in segments):
            return self._segments(segments)
        if len(segments) == 1 and segments[0].low == segments[0].high:  # one write: nothing is older than it
            rows = self._segments(segments)
            return rows if keep_marks else rows.where(F.col("_does") != GONE)
        heads = self._segments([s for s in segments if s.kind == "r"]).where(F.col("_does") != ADDED)
        heads = heads.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_version").alias("_head"))
        rows = self._segments(segments)
        kept = rows.join(heads, rows["doc_id"] == heads["_id"], "left").where("_head is null or _version >= _head")
        return kept.drop("_id", "_head") if keep_marks else kept.drop("_id", "_head").where(F.col("_does") != GONE)

    def read(self, artifact: str, doc_id: str | None = None) -> DataFrame:
        segments = self.log(artifact).live()
        if not segments:
            raise AnalysisException(f"nothing is stored as {artifact!r}")
        df = self._merged(segments)
        if doc_id is not None:
            df = df.where((F.col("_hash") == _hash(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
        return df.drop(*OWN_COLUMNS)

    # --- writing ---

    def _laid(self, rows: DataFrame) -> DataFrame:
        order = ["_hash", "pos"] if "pos" in rows.columns else ["_hash"]
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def _put(self, artifact: str, rows: DataFrame, does: int, kind: str) -> Segment | None:
        log = self.log(artifact)
        version = log.next_version()
        marked = rows.withColumn("_hash", _hash(F.col("doc_id"))).withColumn("_version", F.lit(version).cast("long"))
        return log.write(self._laid(marked.withColumn("_does", F.lit(does))), kind, version, version)

    def append(self, artifact: str, rows: DataFrame) -> Segment | None:
        return self._put(artifact, rows, ADDED, "a")

    def replace(self, artifact: str, rows: DataFrame) -> Segment | None:
        """Put these documents' rows in place of what the artifact held for them.

        Rows are laid by ranges that are sampled first, so they are computed up to three times: what
        is dear to compute has to be ``written`` before.
        """
        return self._put(artifact, rows, REPLACING, "r")

    def replaced(self, artifact: str, make: Callable[[], DataFrame]) -> DataFrame:
        """``replace`` with rows that are dear to compute: written first, then laid. Gives them as they are stored; other copies go."""
        with passing(self.spark):
            rows = alone(self.spark, make, f"store-{artifact}")
            return self.stored(self.replace(artifact, rows), rows)

    def stored(self, segment: Segment | None, rows: DataFrame) -> DataFrame:
        """``rows`` read from the segment that was written of them."""
        if segment is None:
            return nothing(self.spark, ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in rows.schema))
        return self._segments([segment]).select(*rows.columns)

    def update(self, artifact: str, changes: DataFrame) -> Segment | None:
        """Set the non-null columns of ``changes`` (one row per doc_id) on existing rows. Documents
        that hold these values already are not written again."""
        names = [c for c in changes.columns if c != "doc_id"]
        new = changes.select("doc_id", *[F.col(c).alias(f"_new_{c}") for c in names])
        rows = self.read(artifact)
        for c in names:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(changes.schema[c].dataType))
        differs = reduce(Column.__or__, [F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)) for c in names])
        met = rows.join(new, "doc_id")
        touched = met.where(differs).select("doc_id").distinct()
        changed = met.join(touched, "doc_id", "left_semi")
        for c in names:
            changed = changed.withColumn(c, F.coalesce(f"_new_{c}", c))
        return self.replace(artifact, changed.drop(*[f"_new_{c}" for c in names]))

    def delete(self, doc_ids: DataFrame, artifacts: list[str] | None = None) -> None:
        """Remove documents from every artifact: a mark for each document that an artifact holds."""
        ids = doc_ids.select("doc_id").distinct()
        for artifact in artifacts or ARTIFACTS:
            if not self.exists(artifact):
                continue
            held = self.read(artifact)
            if "doc_id" in held.columns:
                self._put(artifact, ids.join(held.select("doc_id"), "doc_id", "left_semi"), GONE, "r")

    def clear(self, *artifacts: str) -> None:
        """Drop all rows: an empty base that covers every version so far. What is written later counts
        as ever; the segments before stay until ``vacuum``."""
        for artifact in artifacts:
            log = self.log(artifact)
            live = log.live()
            if live:
                log.write(self._segments(live).where("false"), "b", 0, log.next_version(), keep_empty=True)

    def compact(self, artifact: str, most: int = MOST_SEGMENTS, share: float = FOLD_SHARE) -> Segment | None:
        """Merge small segments once there are more than ``most``, and fold all into a new base once
        they hold more than ``share`` of its bytes. Old segments stay until ``vacuum``."""
        log = self.log(artifact)
        live = log.live()
        base = sum(s.size for s in live if s.kind == "b")
        recent = [s for s in live if s.kind != "b"]
        if not recent or (len(recent) <= most and sum(s.size for s in recent) <= share * base):
            return None
        if sum(s.size for s in recent) > share * base:
            return log.write(self._laid(self._merged(live)), "b", 0, live[-1].high)
        kind = "r" if any(s.kind == "r" for s in recent) else "a"
        return log.write(self._laid(self._merged(recent, keep_marks=True)), kind, recent[0].low, recent[-1].high)

    def vacuum(self, artifact: str) -> int:
        return self.log(artifact).vacuum()

    # --- artifacts ---

    def list_documents(self) -> DataFrame:
        return self.read("documents").orderBy("doc_id")

    def parsed(self, enhanced_first: bool = True) -> DataFrame:
        """The enhanced version of a document where there is one, else the base version."""
        both = self.read("parsed_docs")
        if not enhanced_first:
            return both.where(F.col("version") == "base")
        better = both.where(F.col("version") == "enhanced")
        return better.unionByName(
            both.where(F.col("version") == "base").join(better.select("doc_id"), "doc_id", "left_anti")
        )

    def save_chunks(self, chunks: DataFrame) -> None:
        """Chunks of whole documents, and their number in the documents table."""
        self.replace("chunks", chunks)
        if self.exists("documents"):
            n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_chunks"))
            self.update("documents", n)

    def save_sections(self, sections: DataFrame) -> None:
        """Sections of whole documents, and their number in the documents table."""
        self.replace("doc_sections", sections)
        if self.exists("documents"):
            n = sections.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("num_sections"))
            self.update("documents", n)

    def index_vectors(self, chunks: DataFrame, embed_fn) -> None:
        """Vectors of whole documents; old ones go first, so indexing twice changes nothing."""
        from lectern.operators.vector import embedding_text, flatten_metadata

        flat = flatten_metadata(chunks)
        text = embedding_text(
            F.col("text"), F.col("contextual_prefix"), F.coalesce("formula_ids", F.array().cast("array<string>"))
        )
        self.replace("vectors", written(flat.withColumn("embedding", embed_fn(text)), "vectors"))  # see replace


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Uploaded files as bytes; ``source.pdf`` is preferred, then name order."""
    from lectern.functions.answers import document_id
    from lectern.operators.ranking import top_k

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.element_at(F.split("path", "/"), -2)
    named = files.select(
        "path", "length", name.alias("name"), parent.alias("parent"), (name != "source.pdf").alias("_later")
    )
    first = top_k(named, ["parent"], [F.col("_later"), F.col("name")], 1, "_n").drop("_n", "_later")
    return first.withColumn("doc_id", document_id(F.col("parent")))


def admitted(uploads: DataFrame, known_names: DataFrame, limit: int = 100 * 1024 * 1024) -> DataFrame:
    """Uploads with ``error``: wrong suffix, name taken, or above 100 MB."""
    taken = known_names.select("name").distinct().withColumn("_taken", F.lit(True))
    return uploads.join(taken, "name", "left").withColumn(
        "error",
        F.when(~F.lower("name").endswith(".pdf"), "unsupported_type")
        .when(F.col("_taken").isNotNull(), "duplicate_name")
        .when(F.col("length") > limit, "too_large")
        .otherwise(""),
    ).drop("_taken")
