"""Queries over documents as parsed text: diagnosis, quality, enhancement, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.catalog import sql as Q
from lectern.catalog.inputs import table
from lectern.catalog.registry import Area
from lectern.functions import fixed as X
from lectern.functions import notation
from lectern.functions import text as T
from lectern.operators import enhance, quality

AREA = Area()
query = AREA.query


# ---------------------------------------------------------------- derived inputs


def line_pages(spark, sf_dir) -> DataFrame:
    """A page is a line of a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_num", "text"))
    return d.withColumn("char_count", F.length("text"))


def typed_pages(spark, sf_dir) -> DataFrame:
    """Pages with the type of their document, which follows from the text before it is cut."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    d = table(spark, sf_dir, "documents").withColumn("avg_chars", (F.length("text") - breaks) / (breaks + 1))
    typed = d.select("doc_id", quality.subtype_of(F.col("avg_chars"), F.lit(False)).alias("doc_subtype"), F.posexplode(F.split("text", "\n")).alias("page_num", "text"))
    return typed.withColumn("char_count", F.length("text"))


def visual_items(pages: DataFrame) -> DataFrame:
    """Figures, tables and formulas at places that follow from document and line number."""
    at = F.col("page_num") + F.col("doc_id")
    kinds = F.array_compact(
        F.array(
            F.when(at % 7 == 0, "image"), F.when(at % 11 == 0, "table"), F.when(at % 13 == 0, "formula")
        )
    )
    return pages.select("doc_id", F.col("page_num").alias("page"), F.explode(kinds).alias("kind"))


def scored_pages(spark, sf_dir) -> DataFrame:
    """All that the score needs stands in the row of a page: one scan, no join."""
    at = F.col("page_num") + F.col("doc_id")
    flagged = quality.measured(typed_pages(spark, sf_dir)).select(
        "*", (at % 7 == 0).alias("on_image"), (at % 11 == 0).alias("on_table"), (at % 13 == 0).alias("on_formula")
    )
    return quality.page_quality(flagged)


def recognized_pages(spark, sf_dir) -> DataFrame:
    """The recognised text of a page: the same line of the next document."""
    p = line_pages(spark, sf_dir)
    label = F.element_at(F.array(F.lit("good"), F.lit("weak"), F.lit("failed"), F.lit("")),
                         ((F.col("doc_id") + F.col("page_num")) % 4 + 1).cast("int"))
    return p.select(
        (F.col("doc_id") - 1).alias("doc_id"),
        F.col("page_num").alias("page"),
        "text",
        label.alias("ocr_quality"),
        F.lit(0).alias("item_no"),
    )


# ---------------------------------------------------------------- text functions


@query("token_estimate", f"SELECT doc_id, CAST({Q.estimate('text')} AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "tokenize_counts",
    f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)",
)
def tokenize_counts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
    )


@query(
    "symbol_repetition_ratio",
    f"SELECT doc_id, {Q.settle(Q.symbol_ratio('text'))} AS symbol_ratio, {Q.settle(Q.repetition('text'))} AS repetition_ratio FROM documents",
)
def symbol_repetition_ratio(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.settle(T.symbol_ratio(x)).alias("symbol_ratio"),
        T.settle(T.repetition_ratio(x)).alias("repetition_ratio"),
    )


@query(
    "text_readability",
    f"WITH {Q.LINES} SELECT doc_id, page_num, {Q.settle(Q.fragmentation('text'))} AS fragmentation, {Q.settle(Q.readability('text'))} AS readability FROM ln",
)
def text_readability(spark, sf_dir):
    x = F.col("text")
    return line_pages(spark, sf_dir).select(
        "doc_id",
        "page_num",
        T.settle(T.fragmentation(x)).alias("fragmentation"),
        T.settle(T.readability(x)).alias("readability"),
    )


@query(
    "chunk_char_limit",
    f"SELECT doc_id, CAST(floor(800 * (4.0 - 2.0 * length(regexp_replace(text, '[^{Q.CJK}]', '', 'g')) / length(text))) AS BIGINT) AS max_chars FROM documents WHERE length(text) > 0",
)
def chunk_char_limit(spark, sf_dir):
    from lectern.operators.chunking import max_chars

    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select("doc_id", max_chars(F.col("text"), 800).cast("long").alias("max_chars"))


# ---------------------------------------------------------------- diagnosis


@query(
    "doc_subtype",
    f"WITH {Q.LINES} SELECT doc_id, {Q.settle('avg(length(text))')} AS avg_chars, CASE WHEN avg(length(text)) < 300 THEN 'slides_pdf' ELSE 'research_paper' END AS doc_subtype FROM ln GROUP BY doc_id",
)
def doc_subtype(spark, sf_dir):
    pages = line_pages(spark, sf_dir).withColumn("is_two_column", F.lit(False)).withColumn("has_abstract", F.lit(False))
    return quality.document_subtype(pages).select("doc_id", T.settle(F.col("avg_chars")).alias("avg_chars"), "doc_subtype")


@query(
    "text_quality_diagnosis",
    f"""WITH {Q.LINES},
p AS (SELECT doc_id, count(*) AS n_pages, avg(length(text)) AS a, count(*) FILTER (length(text) >= 80) AS w FROM ln GROUP BY doc_id),
sec AS (SELECT doc_id, count(*) FILTER (length({Q.strip('text')}) >= 3) AS n_titled FROM ln WHERE length(text) <= 40 GROUP BY doc_id),
j AS (SELECT d.doc_id, d.n_chars, p.*, coalesce(n_titled, 0) AS nt FROM documents d JOIN p ON d.doc_id = p.doc_id LEFT JOIN sec ON d.doc_id = sec.doc_id),
k AS (SELECT *, CASE WHEN n_pages >= 3 AND a < 80 THEN 'image_based' WHEN a < 220 OR n_chars < 1000 THEN 'weak' ELSE 'good' END AS text_quality FROM j)
SELECT doc_id, text_quality, text_quality IN ('weak', 'image_based') AS ocr_needed, {Q.exact('w / n_pages', 2)} AS page_text_coverage,
  CASE WHEN nt >= 3 THEN 'good' WHEN nt > 0 THEN 'weak' ELSE 'none' END AS section_quality FROM k""",
)
def text_quality_diagnosis(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("raw_len"))
    pages = line_pages(spark, sf_dir)
    sections = pages.where(F.length("text") <= 40).select("doc_id", F.col("text").alias("title"))
    return quality.text_quality(docs, pages, sections)


_PQ_COLUMNS = (
    "doc_id, unit_id, unit_type, page_start, page_end, text_score, structure_score, visual_score, ocr_need_score, "
    "overall_score, quality, recommended_action, array_to_string(reasons, ',') AS reasons, text_preview"
)


@query("page_quality", f"WITH {Q.QUALITY} SELECT {_PQ_COLUMNS} FROM pq")
def page_quality(spark, sf_dir):
    return scored_pages(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "ocr_recommendation",
    f"""WITH {Q.QUALITY},
d AS (SELECT doc_id, count(*) FILTER (recommended_action = 'ocr') AS n_ocr, count(*) FILTER (unit_type = 'slide') AS n_slides,
       count(*) FILTER (unit_type = 'slide' AND text_score < 0.35) AS n_low FROM pq GROUP BY doc_id)
SELECT pq.doc_id, page_start AS page, CASE WHEN recommended_action = 'ocr' THEN
    CASE WHEN list_contains(reasons, 'visual_high') THEN 'text_low_parser_visuals' ELSE 'document_image_based' END
    ELSE 'document_low_text_slides' END AS reason
FROM pq JOIN d ON pq.doc_id = d.doc_id
WHERE recommended_action = 'ocr' OR (n_ocr = 0 AND n_slides >= 3 AND n_low / n_slides >= 0.6 AND unit_type = 'slide'
  AND text_score < 0.35 AND length(text_preview) >= 12 AND lower(text_preview) NOT IN ({Q.names(X.BARE_TITLES)}))""",
)
def ocr_recommendation(spark, sf_dir):
    return quality.recommend_from_quality(scored_pages(spark, sf_dir))


@query(
    "ocr_from_counts",
    f"""WITH {Q.LINES},
d AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (n < 20) AS n_low, count(*) FILTER (n <= 4) AS n_empty FROM pg GROUP BY doc_id)
SELECT pg.doc_id, page_num AS page, CASE WHEN doc_subtype = 'slides_pdf' AND n_pages >= 3 AND n_low / n_pages >= 0.6 AND n_empty / n_pages >= 0.5
   THEN 'document_image_based' WHEN on_image OR on_table OR on_formula THEN 'text_low_parser_visuals' ELSE 'text_low_visual_high' END AS reason
FROM pg JOIN d ON pg.doc_id = d.doc_id
WHERE n < 20 AND ((doc_subtype = 'slides_pdf' AND n_pages >= 3 AND n_low / n_pages >= 0.6 AND n_empty / n_pages >= 0.5)
  OR on_image OR on_table OR on_formula OR ((page_num * 13 + pg.doc_id) % 100) / 100 >= 0.18)""",
)
def ocr_from_counts(spark, sf_dir):
    pages = typed_pages(spark, sf_dir)
    flagged = quality.visual_flags(pages, visual_items(pages)).withColumn(
        "on_visual", F.col("on_image") | F.col("on_table") | F.col("on_formula")
    ).withColumn("visual_density", ((F.col("page_num") * 13 + F.col("doc_id")) % 100) / 100)
    return quality.recommend_from_counts(flagged)


@query(
    "ocr_evaluation",
    f"""WITH {Q.LINES}, u AS (SELECT doc_id, page_num, {Q.squeeze('text')} AS usable,
  ((page_num * 7 + doc_id) % 40) / 100 AS density, CASE (doc_id + page_num) % 6 WHEN 0 THEN 'diagram' WHEN 1 THEN 'flow' ELSE 'text' END AS kind FROM ln),
v AS (SELECT *, CASE WHEN length(usable) < 8 AND density >= 0.18 THEN 'weak/ocr_too_short_visual_high' WHEN length(usable) < 8 THEN 'failed/ocr_too_short'
  WHEN {Q.symbol_ratio('usable', '1.0')} >= 0.55 THEN 'failed/garbled_text' WHEN kind IN ('diagram','chart','formula','flow') THEN 'weak/diagram_like'
  WHEN length(usable) < 40 AND density >= 0.18 THEN 'weak/ocr_too_short_visual_high' ELSE 'good/ocr_text_usable' END AS verdict FROM u)
SELECT doc_id, page_num, split_part(verdict, '/', 1) AS ocr_quality, split_part(verdict, '/', 1) <> 'good' AS vision_recommended,
  split_part(verdict, '/', 2) AS reason, usable AS usable_text FROM v""",
)
def ocr_evaluation(spark, sf_dir):
    density = ((F.col("page_num") * 7 + F.col("doc_id")) % 40) / 100
    kind = F.when((F.col("doc_id") + F.col("page_num")) % 6 == 0, "diagram").when(
        (F.col("doc_id") + F.col("page_num")) % 6 == 1, "flow"
    ).otherwise("text")
    judged = line_pages(spark, sf_dir).withColumn("v", quality.recognition_quality(F.col("text"), density, kind))
    return judged.select("doc_id", "page_num", "v.*")


_DECIDE = f"""{Q.QUALITY}, {Q.RECOGNIZED},
b AS (SELECT pq.*, ocr.doc_id IS NOT NULL AS probe, ocr.text AS o_text, ocr_quality FROM pq LEFT JOIN ocr ON pq.doc_id = ocr.doc_id AND pq.page_start = ocr.page),
b1 AS (SELECT *, CASE WHEN probe THEN {Q.readability('o_text')} ELSE 0.0 END AS r0, CASE WHEN probe THEN {Q.fragmentation('o_text')} ELSE 0.0 END AS frag,
  greatest(1, CAST(floor(text_score * CASE WHEN unit_type = 'slide' THEN 120 ELSE 800 END) AS INTEGER)) AS had FROM b),
b2 AS (SELECT *, CASE WHEN NOT probe THEN 0.0 WHEN ocr_quality = 'good' THEN greatest(r0, 0.75) WHEN ocr_quality = 'failed' THEN least(r0, 0.2) ELSE r0 END AS readable,
  CASE WHEN probe THEN {Q.clamp(f"(length({Q.strip('o_text')}) - had) / greatest(80, had)")} ELSE 0.0 END AS gain FROM b1),
dec AS (SELECT *, CASE WHEN recommended_action = 'keep' OR overall_score >= 0.7 THEN 'use_original/quality_good'
  WHEN list_contains(reasons, 'sparse_but_structured') THEN 'use_original/sparse_but_structured'
  WHEN list_has_any(reasons, {Q.listing(X.VISION_REASONS)}) AND (NOT probe OR readable < 0.65 OR frag > 0.35) THEN 'apply_vision/visual_semantics_need_vision'
  WHEN probe AND readable >= 0.65 AND gain >= 0.2 THEN 'apply_ocr/ocr_readable_gain'
  WHEN probe AND visual_score >= 0.5 THEN 'apply_vision/ocr_probe_failed_visual_high'
  WHEN probe THEN 'apply_ocr/ocr_best_available'
  WHEN visual_score >= 0.5 THEN 'apply_ocr_then_maybe_vision/ocr_first_for_visual_text'
  WHEN recommended_action = 'ocr' THEN 'apply_ocr/parser_recommends_ocr' ELSE 'use_original/quality_not_low' END AS verdict FROM b2)"""


@query(
    "enhancement_decision",
    f"""WITH {_DECIDE} SELECT doc_id, page_start AS page, split_part(verdict, '/', 1) AS action, split_part(verdict, '/', 2) AS reason,
  array_to_string(reasons, ',') AS reasons, overall_score AS parser_score, visual_score, {Q.exact('readable', 3)} AS ocr_readability,
  {Q.exact('gain', 3)} AS ocr_gain, {Q.exact('frag', 3)} AS ocr_fragmentation FROM dec""",
)
def enhancement_decision(spark, sf_dir):
    decided = enhance.decisions(scored_pages(spark, sf_dir), recognized_pages(spark, sf_dir), vision_enabled=True)
    return decided.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "enhancement_page_selection",
    f"""WITH {_DECIDE} SELECT doc_id, page_start AS page, CASE WHEN verdict LIKE 'apply_vision/%' THEN 'vision' ELSE 'ocr' END AS route
  FROM dec WHERE verdict NOT LIKE 'use_original/%'""",
)
def enhancement_page_selection(spark, sf_dir):
    decided = enhance.decisions(scored_pages(spark, sf_dir), recognized_pages(spark, sf_dir), vision_enabled=True)
    return enhance.routes(decided)


def page_fragments(spark, sf_dir) -> DataFrame:
    """Recognised text of every page, and vision text of every fifth, as fragments."""
    none = F.array().cast("array<string>")
    ocr = recognized_pages(spark, sf_dir).select(
        "doc_id", "page", F.lit(0).alias("fragment_no"), F.lit("ocr").alias("source"), "text",
        F.when(F.col("ocr_quality") == "", "failed").otherwise(F.col("ocr_quality")).alias("quality"),
        F.lit("").alias("visual_type"), none.alias("key_observations"), F.lit("").alias("table_summary"),
    )
    p = line_pages(spark, sf_dir)
    vision = p.where((F.col("doc_id") + F.col("page_num")) % 5 == 0).select(
        "doc_id", F.col("page_num").alias("page"), F.lit(1).alias("fragment_no"), F.lit("vision").alias("source"),
        "text",
        F.when(F.col("doc_id") % 2 == 0, "good").otherwise("weak").alias("quality"),
        F.lit("table").alias("visual_type"), F.array(F.lit("rows"), F.lit(" ")).alias("key_observations"),
        F.col("text").alias("table_summary"),
    )
    both = ocr.unionByName(vision)
    for name in ("formula_summary", "chart_summary", "qa_hint"):
        both = both.withColumn(name, F.lit(""))
    return both


def _cand(text, source, quality):
    s = Q.squeeze(text)
    return (
        f"(CASE WHEN {s} <> '' THEN {Q.clamp(f'least(1.0, length({s}) / 180) + ({Q.lookup(quality, X.QUALITY_BONUS, 0.0)} + {Q.lookup(source, X.SOURCE_BONUS, 0.0)}) - {Q.symbol_ratio(s)} * 0.5 - {Q.fragmentation(s)} * 0.4')} ELSE 0.0 END)"
    )


_MERGE = f"""{Q.LINES}, {Q.RECOGNIZED},
fr AS (
  SELECT doc_id, page, 0 AS no, 'ocr' AS source, CASE ocr_quality WHEN '' THEN 'failed' ELSE ocr_quality END AS quality, {Q.strip('text')} AS f_text FROM ocr
  UNION ALL
  SELECT doc_id, page_num, 1, 'vision', CASE WHEN doc_id % 2 = 0 THEN 'good' ELSE 'weak' END,
    {Q.strip(f"concat_ws(chr(10), nullif({Q.strip('text')}, ''), 'Visual type: table', 'Key observations:' || chr(10) || '- rows', CASE WHEN {Q.strip('text')} <> '' THEN 'Table summary: ' || {Q.strip('text')} END)")}
  FROM ln WHERE (doc_id + page_num) % 5 = 0
),
u AS (SELECT fr.*, {Q.strip('ln.text')} AS p_text FROM fr JOIN ln ON fr.doc_id = ln.doc_id AND fr.page = ln.page_num WHERE quality <> 'failed' AND f_text <> ''),
c AS (
  SELECT DISTINCT doc_id, page, 0 AS cand, 'parser' AS source, 'good' AS quality, p_text AS c_text, 0.0 AS extra, 0.0 AS less FROM u
  UNION ALL SELECT doc_id, page, no * 2 + 1, source, quality, f_text, 0.0, 0.0 FROM u
  UNION ALL SELECT doc_id, page, no * 2 + 2, source, quality,
    CASE WHEN (source = 'ocr' AND length(p_text) < 20) OR p_text = '' THEN f_text ELSE p_text || chr(10) || chr(10) || '[' || upper(source) || ']' || chr(10) || f_text END,
    CASE WHEN p_text <> '' AND quality = 'good' THEN 0.16 ELSE 0.0 END, 0.08 FROM u
),
sc AS (SELECT *, {Q.settle(f"{_cand('c_text', 'source', 'quality')} + extra - less", 9)} AS score FROM c),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, cand) = 1)"""


def merged_pages(spark, sf_dir):
    pages = line_pages(spark, sf_dir).withColumn("content_source", F.lit("parser")).withColumn("enhanced", F.lit(False))
    return enhance.merge(pages, page_fragments(spark, sf_dir))


@query(
    "enhancement_merge",
    f"""WITH {_MERGE} SELECT ln.doc_id, ln.page_num, CASE WHEN b.cand > 0 THEN c_text ELSE ln.text END AS text,
  CASE WHEN b.cand > 0 THEN source ELSE 'parser' END AS content_source, coalesce(b.cand > 0, false) AS enhanced,
  CASE WHEN b.cand > 0 THEN length(c_text) ELSE length(ln.text) END AS char_count
FROM ln LEFT JOIN best b ON ln.doc_id = b.doc_id AND ln.page_num = b.page""",
)
def enhancement_merge(spark, sf_dir):
    return merged_pages(spark, sf_dir).withColumn("char_count", F.col("char_count").cast("long"))


@query(
    "enhanced_raw_text",
    f"""WITH {_MERGE}, pgs AS (SELECT ln.doc_id, ln.page_num, {Q.strip('CASE WHEN b.cand > 0 THEN c_text ELSE ln.text END')} AS body
  FROM ln LEFT JOIN best b ON ln.doc_id = b.doc_id AND ln.page_num = b.page)
SELECT doc_id, length(string_agg(body, chr(10) || chr(10) ORDER BY page_num)) AS n_chars, md5(string_agg(body, chr(10) || chr(10) ORDER BY page_num)) AS digest
FROM pgs WHERE body <> '' GROUP BY doc_id""",
)
def enhanced_raw_text(spark, sf_dir):
    raw = enhance.raw_text(merged_pages(spark, sf_dir))
    return raw.select("doc_id", F.length("raw_text").cast("long").alias("n_chars"), F.md5("raw_text").alias("digest"))


@query(
    "usable_fragments",
    f"""WITH {Q.LINES}, {Q.RECOGNIZED}
SELECT doc_id, page, ocr_quality AS quality, length({Q.strip('text')}) AS n_chars FROM ocr WHERE ocr_quality NOT IN ('failed', '') AND {Q.strip('text')} <> ''""",
)
def usable_fragments(spark, sf_dir):
    """Recognition payloads (one array of pages per document) as usable fragment rows."""
    payload = recognized_pages(spark, sf_dir).groupBy("doc_id").agg(
        F.collect_list(F.struct("page", "text", F.when(F.col("ocr_quality") != "", F.col("ocr_quality")).alias("ocr_quality"))).alias("pages")
    )
    rows = enhance.fragments_from_payload(payload.where(enhance.has_usable_text(F.col("pages"))), "ocr")
    text = enhance.fragment_text(F.col("source"), F.col("text"))
    return rows.withColumn("t", text).where((F.col("quality") != "failed") & (F.col("t") != "")).select(
        "doc_id", "page", "quality", F.length("t").cast("long").alias("n_chars")
    )


@query(
    "ocr_job_status",
    f"""WITH {Q.LINES}, {Q.RECOGNIZED} SELECT doc_id, CASE WHEN bool_and(ocr_quality = 'failed') THEN 'failed' ELSE 'completed' END AS status, count(*) AS n_pages FROM ocr GROUP BY doc_id""",
)
def ocr_job_status(spark, sf_dir):
    return quality.job_status(recognized_pages(spark, sf_dir), "ocr_quality")


@query(
    "merge_llm_quality",
    f"""WITH {Q.QUALITY},
v AS (SELECT doc_id, 'page_' || (page_num + 1) AS unit_id, 0.5 AS llm_score, CASE WHEN n >= 100 THEN 'good' END AS quality, 'keep' AS recommended_action, 'model' AS llm_reason
      FROM pg WHERE (doc_id + page_num) % 3 = 0)
SELECT coalesce(pq.doc_id, v.doc_id) AS doc_id, coalesce(pq.unit_id, v.unit_id) AS unit_id, overall_score, llm_score, coalesce(v.quality, pq.quality) AS quality,
  coalesce(v.recommended_action, pq.recommended_action) AS recommended_action, llm_reason
FROM pq FULL OUTER JOIN v ON pq.doc_id = v.doc_id AND pq.unit_id = v.unit_id""",
)
def merge_llm_quality(spark, sf_dir):
    p = line_pages(spark, sf_dir)
    number = F.col("doc_id") + F.col("page_num")
    unit = F.concat(F.lit("page_"), (F.col("page_num") + 1).cast("string")).alias("unit_id")
    judged = p.where(number % 3 == 0).select(
        "doc_id",
        unit,
        F.lit(1).alias("item_no"),
        F.lit(0.5).alias("llm_score"),
        F.when(F.col("char_count") >= 100, "good").alias("quality"),
        F.lit("keep").alias("recommended_action"),
        F.lit("model").alias("llm_reason"),
    )
    first_thought = p.where(number % 6 == 0).select(
        "doc_id", unit, F.lit(0).alias("item_no"), F.lit(0.1).alias("llm_score"), F.lit("failed").alias("quality"),
        F.lit("ocr").alias("recommended_action"), F.lit("first thought").alias("llm_reason"),
    )
    judged = judged.unionByName(first_thought)
    return quality.merge_model_quality(scored_pages(spark, sf_dir), judged)


@query(
    "analysis_status",
    f"""WITH {_DECIDE}, w AS (SELECT doc_id, count(*) FILTER (quality IN ('weak','failed') OR recommended_action IN ('ocr','vision')) AS n_weak FROM pq GROUP BY doc_id)
SELECT d.doc_id, 'available' AS status, CASE WHEN d.doc_id % 10 = 0 THEN 'enhanced_completed' WHEN n_weak > 0 THEN 'needs_enhancement' ELSE 'usable' END AS parse_quality_status, n_weak
FROM documents d JOIN w ON d.doc_id = w.doc_id""",
)
def analysis_status(spark, sf_dir):
    scored = scored_pages(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id")
    enhanced = line_pages(spark, sf_dir).select("doc_id", (F.col("doc_id") % 10 == 0).alias("enhanced"))
    asked = scored.where(F.col("recommended_action") == "ocr").select("doc_id", F.col("page_start").alias("page"))
    return quality.analysis_status(docs, scored, asked, enhanced)


@query(
    "weak_pages",
    f"""WITH {Q.QUALITY} SELECT doc_id, page_start, page_start + 1 AS page_no, quality, recommended_action, row_number() OVER (PARTITION BY doc_id ORDER BY page_start) AS nth
FROM pq WHERE quality IN ('weak','failed') OR recommended_action IN ('ocr','vision') QUALIFY nth <= 8""",
)
def weak_pages(spark, sf_dir):
    w = quality.weak_pages(scored_pages(spark, sf_dir))
    return w.select("doc_id", "page_start", "page_no", "quality", "recommended_action", F.col("nth").cast("long").alias("nth"))


@query(
    "label_vs_heuristic",
    f"""WITH {Q.QUALITY}, h AS (SELECT doc_id, avg(overall_score) AS mean_score, count(*) FILTER (quality = 'good') AS n_good FROM pq GROUP BY doc_id)
SELECT l.quality AS human_quality, count(*) AS n_docs, {Q.settle('avg(mean_score)')} AS mean_score, CAST(sum(n_good) AS BIGINT) AS n_good_pages
FROM labels l JOIN h ON l.doc_id = h.doc_id GROUP BY l.quality""",
)
def label_vs_heuristic(spark, sf_dir):
    h = scored_pages(spark, sf_dir).groupBy("doc_id").agg(
        F.avg("overall_score").alias("mean_score"), F.count_if(F.col("quality") == "good").alias("n_good")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("human_quality"))
    return labels.join(h, "doc_id").groupBy("human_quality").agg(
        F.count(F.lit(1)).alias("n_docs"),
        T.settle(F.avg("mean_score")).alias("mean_score"),
        F.sum("n_good").alias("n_good_pages"),
    )


# ---------------------------------------------------------------- notation and classification


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_LIST = "list_filter(list_transform(regexp_extract_all(norm, '[A-Za-z]+|[0-9]+'), lambda s: lower(s)), lambda s: length(s) = 1 OR list_contains(" + Q.listing(X.MATH_WORDS) + ", s))"


@query(
    "math_analysis",
    f"""WITH {Q.LINES}, a AS (SELECT doc_id, page_num, text, {Q.normalized('text')} AS norm FROM ln),
b AS (SELECT *, {_LIST} AS all_syms FROM a),
c AS (SELECT *, {_ordered_distinct('all_syms')} AS syms FROM b),
d AS (SELECT *, text <> '' AND (regexp_matches(text, '[$\\\\]')
  OR list_has_any(string_split(lower(norm), ' '), {Q.listing(X.MATH_WORDS)})
  OR (regexp_matches(text, '[\\$\\\\=+\\-*/^_{{}}()\\[\\]<>≤≥≠≈∙·⋅×⊙√∑Σ∫∞]') AND len(syms) >= 2)
  OR regexp_matches(text, '[=+*/^_]')
  OR (regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-Za-z]\\s*-\\s*[A-Za-z]($|[^\\p{{L}}\\p{{N}}_])') AND len(syms) >= 2)) AS f FROM c)
SELECT doc_id, page_num, f AS has_formula, CASE WHEN f THEN norm ELSE '' END AS normalized_text,
  CASE WHEN f THEN array_to_string(syms, ' ') ELSE '' END AS symbols FROM d""",
)
def math_analysis(spark, sf_dir):
    m = notation.with_notation(line_pages(spark, sf_dir).select("doc_id", "page_num", "text"), "text")
    return m.select(
        "doc_id",
        "page_num",
        F.col("math_has_formula").alias("has_formula"),
        F.col("math_normalized").alias("normalized_text"),
        F.array_join("math_symbols", " ").alias("symbols"),
    )


@query(
    "formula_candidates",
    f"""WITH {Q.LINES}, t AS (SELECT doc_id, page_num AS page, {Q.strip("replace(text, ' is ', ' x = y ')")} AS s FROM ln)
SELECT doc_id, page, s[:300] AS text, 'text_heuristic' AS source FROM t
WHERE length(s) >= 4 AND regexp_matches(s, {Q.q(X.FORMULA_LINE)})""",
)
def formula_candidates(spark, sf_dir):
    from lectern.operators.chunking import formula_candidates as find

    pages = line_pages(spark, sf_dir)
    return find(pages.withColumn("text", F.replace("text", F.lit(" is "), F.lit(" x = y "))))


@query(
    "cross_refs",
    f"""SELECT doc_id, len(r) AS n_refs, array_to_string(r, '|') AS refs FROM (SELECT doc_id, regexp_extract_all(t, {Q.q(X.CROSS_REF)}) AS r
 FROM (SELECT doc_id, replace(replace(text, 'The ', 'See Figure 2 '), ' and ', ' table 3, eq (4) ') AS t FROM documents))""",
)
def cross_refs(spark, sf_dir):
    """Texts in which two frequent words are exchanged for cross-references."""
    t = F.replace(F.replace("text", F.lit("The "), F.lit("See Figure 2 ")), F.lit(" and "), F.lit(" table 3, eq (4) "))
    d = table(spark, sf_dir, "documents").select("doc_id", T.cross_refs(t).alias("r"))
    return d.select("doc_id", F.size("r").cast("long").alias("n_refs"), F.array_join("r", "|").alias("refs"))


@query(
    "section_classifier",
    f"""WITH {Q.LINES}, t AS (SELECT doc_id, page_num, CASE (doc_id + page_num) % 5 WHEN 0 THEN 'References' WHEN 1 THEN 'Methods ' || text WHEN 2 THEN text || ' Results' ELSE text END AS title FROM ln)
SELECT doc_id, page_num, CASE WHEN lower(title) IN ('references','bibliography') THEN 'references' WHEN regexp_matches(lower(title), '{X.SECTION_METHOD}') THEN 'method'
  WHEN regexp_matches(lower(title), '{X.SECTION_RESULTS}') THEN 'results' ELSE 'prose' END AS section_type, split_part(doc_id || '.' || page_num, '.', 1) AS chapter FROM t""",
)
def section_classifier(spark, sf_dir):
    at = (F.col("doc_id") + F.col("page_num")) % 5
    title = (
        F.when(at == 0, "References").when(at == 1, F.concat(F.lit("Methods "), F.col("text")))
        .when(at == 2, F.concat(F.col("text"), F.lit(" Results"))).otherwise(F.col("text"))
    )
    sid = F.concat_ws(".", F.col("doc_id").cast("string"), F.col("page_num").cast("string"))
    return line_pages(spark, sf_dir).select(
        "doc_id", "page_num", T.section_type(title).alias("section_type"), T.chapter(sid).alias("chapter")
    )


_ASK = "CASE turn % 9 WHEN 0 THEN text || ' formula' WHEN 1 THEN 'Figure: ' || text WHEN 2 THEN text || ' outline?' WHEN 3 THEN text || ' which method' WHEN 4 THEN 'how many ' || text WHEN 5 THEN '为什么 ' || text || ' 举例' WHEN 6 THEN text || ' vs. background 99 percent' ELSE text END"


def _sql_first(rules, default):
    def pattern(p):
        import re

        m = re.match(r"\\b\((.*?)\)\\b\|(.*)$", p, re.S)
        return Q.word(m.group(1)) + "|" + m.group(2)

    arms = " ".join(f"WHEN regexp_matches(lower(question), {Q.q(pattern(p))}) THEN {Q.q(n)}" for n, p in rules)
    return f"CASE {arms} ELSE {Q.q(default)} END"


@query(
    "question_intent",
    f"""WITH c AS (SELECT conv_id, turn, {_ASK} AS question FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_sql_first(X.INTENT, X.INTENT_DEFAULT)} AS intent,
 {_sql_first((("expanded", X.DEPTH_EXPANDED),), "concise")} AS depth, {_sql_first(X.POLICY, X.POLICY_DEFAULT)} AS policy,
 regexp_matches(lower(question), {Q.q(Q.word('bleu|accuracy|score|perplexity|f1|precision|recall|rouge') + '|' + Q.word(r'[0-9]+[.]?[0-9]*[ \t]*(bleu|points|percent|%)'))}) AS is_fact,
 regexp_matches(question, '[{Q.CJK}]') AS has_cjk FROM c""",
)
def question_intent(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").where(F.col("role") == "user").withColumn("question", F.expr(_ASK))
    x = F.col("question")
    return u.select(
        "conv_id", "turn", T.question_intent(x).alias("intent"), T.answer_depth(x).alias("depth"),
        T.evidence_policy(x).alias("policy"), T.is_fact_query(x).alias("is_fact"), T.contains_cjk(x).alias("has_cjk"),
    )


@query(
    "near_duplicate_fingerprint",
    f"""WITH f AS (SELECT doc_id, regexp_replace({Q.squeeze('lower(text)')}, '[^0-9a-z{Q.CJK} ]+', '', 'g')[:320] AS fp FROM documents)
SELECT min(doc_id) AS doc_id, count(*) - 1 AS suppressed FROM f GROUP BY CASE WHEN fp = '' THEN 'id' || doc_id ELSE fp END""",
)
def near_duplicate_fingerprint(spark, sf_dir):
    """The first of all rows with one fingerprint stays, blank ones all stay; sums combine map-side."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))
    d = d.withColumn("fp", F.when(F.col("fp") == "", F.concat(F.lit("id"), F.col("doc_id").cast("string"))).otherwise(F.col("fp")))
    return d.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("suppressed")).drop("fp")
