"""What a reader is told about a document: its stored analysis, else the state of its parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.operators.ranking import top_k
from lectern.sources.store import Store

# ---- fixed values: sentences about the state of a parse ----
MESSAGES = {"enhanced_completed": "解析增强已完成。", "needs_enhancement": "解析质量偏低，部分页面可能需要进一步增强。", "usable": "解析质量可接受。"}
WARNING = "部分页面解析质量偏低，检索和问答可能遗漏图片、图表或扫描文本。"
DONE = "解析增强已完成，当前阅读、检索和问答将使用增强后的解析结果。"
CHECK_AGAIN = "系统已按当前配置完成可用的自动增强；若仍偏低，可继续使用解析增强做进一步检查。"
VISION = "部分页面建议使用 Vision 解析。"
VISION_LATER = "如仍有图表、公式或乱码页面，可配置 Vision 后进行进一步增强。"
FINE = "当前解析质量可用于基础阅读和检索。"
PAGES_SHOWN = 8

_UNDERSTOOD = "difficulty estimated_reading_time key_terms l0_summaries l1_overviews mermaid_map".split()
_PAGES = "array<struct<page:int,page_label:string,quality:string,recommended_action:string,overall_score:double,text_preview:string>>"


def parse_states(documents: DataFrame, quality: DataFrame, enhanced: DataFrame) -> DataFrame:
    """(doc_id, parse_quality_status, message, warnings, actions, pages) of the documents that have
    rows of quality; ``documents``: doc_id, ocr_recommended_pages; ``enhanced``: doc_id, enhanced.

    Of any number of weak pages the first ``PAGES_SHOWN`` are shown, none of an enhanced document.
    """
    weak = F.col("quality").isin("weak", "failed") | F.col("recommended_action").isin("ocr", "vision")
    counted = quality.groupBy("doc_id").agg(F.coalesce(F.bool_or(weak), F.lit(False)).alias("_weak"), F.coalesce(F.bool_or(F.col("recommended_action") == "vision"), F.lit(False)).alias("_vision"))
    done = enhanced.groupBy("doc_id").agg(F.bool_or("enhanced").alias("_done"))
    first = top_k(quality.where(weak).select("doc_id", "page_start", "quality", "recommended_action", "overall_score", "text_preview"), ["doc_id"], [F.col("page_start")], PAGES_SHOWN, "_n")
    shown = F.struct(
        "_n", F.col("page_start").cast("int").alias("page"), F.coalesce(F.concat(F.lit("第 "), (F.col("page_start") + 1).cast("int").cast("string"), F.lit(" 页")), F.lit("相关页面")).alias("page_label"),
        F.coalesce("quality", F.lit("unknown")).alias("quality"), F.coalesce("recommended_action", F.lit("keep")).alias("recommended_action"),
        F.coalesce("overall_score", F.lit(0.0)).cast("double").alias("overall_score"), F.coalesce("text_preview", F.lit("")).alias("text_preview"),
    )
    pages = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s.dropFields("_n")).alias("_pages"))
    recommended = F.coalesce(F.size("ocr_recommended_pages") > 0, F.lit(False)).alias("_recommended")
    j = documents.select("doc_id", recommended).join(counted, "doc_id").join(done, "doc_id", "left").join(pages, "doc_id", "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    open_ = ~F.col("_done")
    status = F.when(F.col("_done"), "enhanced_completed").when(F.col("_weak") | F.col("_recommended"), "needs_enhancement").otherwise("usable")
    actions = F.array_compact(
        F.array(
            F.when(F.col("_done"), DONE), F.when(open_ & F.col("_recommended"), CHECK_AGAIN),
            F.when(open_ & F.col("_vision"), VISION).when(open_ & F.col("_recommended"), VISION_LATER),
        )
    )
    told = j.withColumn("parse_quality_status", status)
    return told.select(
        "doc_id", "parse_quality_status", F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("parse_quality_status")).alias("message"),
        F.when(F.col("parse_quality_status") == "needs_enhancement", F.array(F.lit(WARNING))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit(FINE))).alias("actions"),
        F.when(open_, F.coalesce("_pages", F.array().cast(_PAGES))).otherwise(F.array().cast(_PAGES)).alias("pages"),
    )


def responses(store: Store, asked: DataFrame) -> DataFrame:
    """One row for each row of ``asked`` (doc_id): status available with source parser (or what the
    stored meta row names) or parse_quality, or missing where the store knows neither.

    The store holds understanding (doc_id, understanding), analysis_meta (doc_id, source, updated_at,
    error), page_quality, documents and enhanced_pages; each of them may be absent.
    """
    spark = store.spark

    def held(artifact: str, empty: str) -> DataFrame:
        found = store.read(artifact) if store.exists(artifact) else spark.createDataFrame([], empty)
        for c in spark.createDataFrame([], empty).schema:  # columns that no row was stored with
            if c.name not in found.columns:
                found = found.withColumn(c.name, F.lit(None).cast(c.dataType))
        return found

    nothing = "doc_id string, understanding struct<difficulty:string,estimated_reading_time:int,key_terms:array<struct<english:string,chinese:string,relation_type:string>>,l0_summaries:map<string,string>,l1_overviews:map<string,string>,mermaid_map:string>"
    understood = held("understanding", nothing).select("doc_id", *[F.col(f"understanding.{c}").alias(c) for c in _UNDERSTOOD], F.lit(True).alias("_stored"))
    meta = held("analysis_meta", "doc_id string, source string, updated_at string, error string").select("doc_id", "source", "updated_at", "error")
    ids = asked.select("doc_id")
    scored = held("page_quality", "doc_id string, page_start int, quality string, recommended_action string, overall_score double, text_preview string")
    silent = ids.distinct().join(understood.select("doc_id"), "doc_id", "left_anti")  # only their pages are looked at
    states = parse_states(
        held("documents", "doc_id string, ocr_recommended_pages array<int>").join(silent, "doc_id", "left_semi"), scored.join(silent, "doc_id", "left_semi"),
        held("enhanced_pages", "doc_id string, enhanced boolean").join(silent, "doc_id", "left_semi"),
    )
    j = ids.join(understood, "doc_id", "left").join(meta, "doc_id", "left").join(states, "doc_id", "left")
    stored = F.coalesce("_stored", F.lit(False))
    of_meta = lambda c, default: F.when(stored, F.coalesce(c, F.lit(default)))
    return j.select(
        "doc_id", F.when(stored | F.col("parse_quality_status").isNotNull(), "available").otherwise("missing").alias("status"),
        F.coalesce(of_meta("source", "parser"), F.when(F.col("parse_quality_status").isNotNull(), "parse_quality"), F.lit("missing")).alias("source"),
        *[F.coalesce(of_meta(c, ""), F.lit("")).alias(c) for c in ("updated_at", "error")],
        F.coalesce("difficulty", F.lit("")).alias("difficulty"), F.coalesce("estimated_reading_time", F.lit(0)).alias("estimated_reading_time"), *_UNDERSTOOD[2:],
        F.coalesce("parse_quality_status", F.lit("")).alias("parse_quality_status"), F.coalesce("message", F.lit("")).alias("message"), "warnings", "actions", "pages",
    )
