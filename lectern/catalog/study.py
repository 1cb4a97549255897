"""Queries over a store of study material: briefs on demand, concept maps, memory cleared."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, functions as F

from lectern.catalog import sql as Q
from lectern.catalog.inputs import table
from lectern.catalog.learning import learning_events
from lectern.catalog.parsing import line_pages, scored_pages
from lectern.catalog.registry import Area
from lectern.catalog.upkeep import new_store
from lectern.operators.stage import written
from lectern.plans import analysis_response as R
from lectern.plans import answer, briefs, forget

AREA = Area()
query = AREA.query


# ---------------------------------------------------------------- briefs

_SECTION_LINES = """
se AS (SELECT doc_id, page_num // 3 AS section_no, text[:40] AS title, CAST(1 + (page_num // 3) % 4 AS INTEGER) AS level, text AS gist FROM ln WHERE page_num % 3 = 0)"""


def leveled_sections(spark, sf_dir) -> DataFrame:
    """Every third line begins a section; levels go round from one to four."""
    no = F.floor(F.col("page_num") / 3)
    return line_pages(spark, sf_dir).where("page_num % 3 = 0").select(
        F.col("doc_id").cast("string").alias("doc_id"), no.alias("section_no"), F.concat(F.lit("s"), no.cast("string")).alias("section_id"),
        F.left("text", F.lit(40)).alias("title"), (no % 4 + 1).cast("int").alias("level"), F.col("text").alias("gist"),
    )


def _brief_slot():
    """A model that answers by the document's number: whole briefs, fenced or in prose, core concepts
    for claims, evidence of every kind, a claim without a name, prose alone, a refusal."""

    def slot(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            n = int(re.search(r"\nTitle: d(\d+)\.pdf\n", p).group(1))
            if n % 9 == 6:
                raise RuntimeError("refused")
            digest = hashlib.md5(p.encode()).hexdigest()
            shown = re.search(r"\n\nChunks:\n\[1\] section s0\n([^\n]*)", p)
            first = shown.group(1) if shown else ""
            full = {
                "tldr": ["one", str(n)], "problem": digest, "contributions": [{"claim": "c" + str(n), "evidence": first}, "no object", {"claim": "other", "evidence": 5}],
                "method_walkthrough": "no list", "limitations": [], "review_questions": [{"question": "why?"}],
            }
            if n % 9 == 3:
                full |= {"brief_type": "lecture", "contributions": None, "core_concepts": [{"claim": "core", "why_it_matters": "w", "evidence": {"section_id": "s0", "quote": first[:20]}}]}
            if n % 9 == 0 and n % 2 == 0:
                full["contributions"] = [{"why_it_matters": "no claim"}]
            said = json.dumps(full, ensure_ascii=False)
            out.append("Sorry, not today." if n % 15 == 0 else "```json\n" + said + "\n```" if n % 2 else "Here: " + said + " Done.")
        return out

    return slot


@query(
    "brief_serving",
    f"""WITH {Q.LINES}, {_SECTION_LINES},
sl AS (SELECT doc_id, string_agg('- s' || section_no || ': ' || title || ' (level ' || level || ') ' || gist[:120], chr(10) ORDER BY section_no) AS sl FROM se WHERE section_no < 12 GROUP BY doc_id),
cl AS (SELECT doc_id, string_agg('[' || (page_num + 1) || '] section s' || page_num // 3 || chr(10) || {Q.squeeze('text')}[:420], chr(10) || chr(10) ORDER BY page_num) AS cl,
  max({Q.squeeze('text')}[:420]) FILTER (page_num = 0) AS first FROM ln WHERE page_num < 8 GROUP BY doc_id),
p AS (SELECT d.doc_id, d.doc_id % 4 = 0 AS slides, d.doc_id % 5 = 0 AS weak, first, md5(CASE WHEN d.doc_id % 4 = 0 THEN {Q.q(briefs.LECTURE_TASK)} ELSE {Q.q(briefs.PAPER_TASK)} END || chr(10) || chr(10) || 'Title: d' || d.doc_id || '.pdf'
  || chr(10) || chr(10) || 'Sections:' || chr(10) || coalesce(sl, '') || chr(10) || chr(10) || 'Chunks:' || chr(10) || coalesce(cl, '')) AS digest FROM documents d LEFT JOIN sl ON sl.doc_id = d.doc_id LEFT JOIN cl ON cl.doc_id = d.doc_id),
g AS (SELECT *, CASE WHEN doc_id % 9 = 6 THEN {Q.q(briefs.FAILED)} || 'RuntimeError: refused' WHEN doc_id % 15 = 0 THEN {Q.q(briefs.FAILED)} || 'no JSON object in the answer'
  WHEN doc_id % 18 = 0 THEN {Q.q(briefs.FAILED)} || 'not as asked: contributions' ELSE '' END AS failed FROM p),
w AS (SELECT g.*, wave, CASE WHEN wave = 1 THEN 'not_generated' WHEN wave = 2 AND doc_id % 3 = 0 THEN CASE WHEN failed = '' THEN 'llm' ELSE 'unavailable' END
  WHEN wave = 4 AND doc_id % 7 = 0 THEN 'unavailable' WHEN doc_id % 3 = 0 AND failed = '' THEN 'cached' ELSE 'not_generated' END AS source FROM g, (SELECT unnest([1, 2, 3, 4]) AS wave)),
h AS (SELECT *, source IN ('llm', 'cached') AS has FROM w)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, wave, source, CASE WHEN slides OR (has AND doc_id % 9 = 3) THEN 'lecture' ELSE 'paper' END AS brief_type, CASE WHEN weak THEN 'weak' ELSE 'good' END AS text_quality,
  CASE WHEN source <> 'unavailable' THEN '' WHEN wave = 4 THEN {Q.q(briefs.NOT_CONFIGURED)} ELSE failed END AS error, CASE WHEN has THEN digest END AS problem,
  CASE WHEN NOT has THEN NULL WHEN doc_id % 9 = 3 THEN 'core' ELSE 'c' || doc_id || ',other' END AS claims,
  CASE WHEN NOT has THEN NULL WHEN doc_id % 9 = 3 THEN first[:20] WHEN {Q.strip('first')} <> '' THEN {Q.strip('first')}[:260] END AS quote,
  CASE WHEN has THEN 'one|' || doc_id END AS tldr, CASE WHEN has THEN 0 END AS n_steps, CASE WHEN has THEN 'why?/basic' END AS question,
  count(*) FILTER (source = 'cached') OVER d AS n_views, count(*) FILTER (source IN ('llm', 'unavailable')) OVER d AS n_generated
FROM h WINDOW d AS (PARTITION BY doc_id)
UNION ALL SELECT 'nobody', 2, NULL, NULL, NULL, 'Document not found', NULL, NULL, NULL, NULL, NULL, NULL, 0, 0""",
)
def brief_serving(spark, sf_dir):
    """Four waves of requests to one store: none has a brief, a third is generated, all are asked
    again, and a seventh is forced where no model is configured."""
    store = new_store(spark)
    d = table(spark, sf_dir, "documents").select("doc_id")
    text_id = F.col("doc_id").cast("string")
    store.replace(
        "documents",
        d.select(
            text_id.alias("doc_id"), F.concat(F.lit("d"), text_id, F.lit(".pdf")).alias("name"), F.when(F.col("doc_id") % 4 == 0, "slides_pdf").otherwise("research_paper").alias("doc_subtype"),
            F.when(F.col("doc_id") % 5 == 0, "weak").otherwise("good").alias("text_quality"), (F.col("doc_id") % 5 == 0).alias("ocr_needed"),
        ),
    )
    store.save_sections(leveled_sections(spark, sf_dir))
    chunks = line_pages(spark, sf_dir).select(
        text_id.alias("doc_id"), F.col("page_num").alias("pos"), F.concat(F.lit("s"), F.floor(F.col("page_num") / 3).cast("string")).alias("section_id"), "text"
    )
    store.save_chunks(chunks)
    slot, waves = _brief_slot(), []
    for wave, every in ((1, None), (2, 3), (3, None), (4, 7)):
        force = F.lit(False) if every is None else F.col("doc_id") % every == 0
        asked = d.select(text_id.alias("request_id"), text_id.alias("doc_id"), force.alias("force"), F.lit(f"2024-01-0{wave}").cast("timestamp").alias("ts"))
        if wave == 2:
            asked = asked.unionByName(d.limit(1).select(F.lit("x").alias("request_id"), F.lit("nobody").alias("doc_id"), F.lit(True).alias("force"), F.current_timestamp().alias("ts")))
        waves.append(briefs.serve(store, asked, slot if wave < 4 else None).withColumn("wave", F.lit(wave)))
    served = waves[0].unionByName(waves[1]).unionByName(waves[2]).unionByName(waves[3])
    seen = store.read("learning_events").groupBy("doc_id").agg(
        F.count_if(F.col("event_type") == "brief_view").alias("n_views"), F.count_if(F.col("event_type") == "brief_generate").alias("n_generated")
    )
    b = lambda name: F.col(f"brief.{name}")
    return served.join(seen, "doc_id", "left").fillna(0, ["n_views", "n_generated"]).select(
        "doc_id", "wave", "source", "brief_type", "text_quality", "error", b("problem").alias("problem"), F.array_join(F.transform(b("contributions"), lambda c: c["claim"]), ",").alias("claims"),
        b("contributions")[0]["evidence"]["quote"].alias("quote"), F.array_join(b("tldr"), "|").alias("tldr"), F.when(F.col("brief").isNotNull(), F.size(b("method_walkthrough"))).alias("n_steps"),
        F.concat_ws("/", b("review_questions")[0]["question"], b("review_questions")[0]["level"]).alias("question"), "n_views", "n_generated",
    ).withColumn("question", F.when(F.col("question") != "", F.col("question")))


# ---------------------------------------------------------------- concept maps


@query(
    "concept_map_export",
    f"""WITH {Q.LINES}, {_SECTION_LINES},
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS n FROM se WHERE doc_id % 6 > 0 QUALIFY n <= 30),
above AS (SELECT a.doc_id, a.n, max(b.n) AS up FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.n < a.n AND b.level < a.level GROUP BY a.doc_id, a.n),
x AS (SELECT s.*, CASE WHEN u.level = s.level - 1 THEN 's' || u.n ELSE 'doc' END AS parent FROM s LEFT JOIN above a ON a.doc_id = s.doc_id AND a.n = s.n LEFT JOIN s u ON u.doc_id = a.doc_id AND u.n = a.up),
b AS (SELECT doc_id, string_agg('  s' || n || '["' || translate(replace(CASE WHEN title <> '' THEN title ELSE 's' || section_no END, '"', ''''), '[]', '()') || '"]' || chr(10) || '  ' || parent || ' --> s' || n, chr(10) ORDER BY n) AS body FROM x GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.doc_id || '_concepts.md' AS map_name, '# Concept Map — ' || d.doc_id || chr(10) || chr(10) || '```mermaid' || chr(10) || 'graph TD' || chr(10) || '  doc[Document]' || chr(10)
  || coalesce(body, '  empty["No extracted sections"]' || chr(10) || '  doc --> empty') || chr(10) || '```' || chr(10) AS map_text FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""",
)
def concept_map_export(spark, sf_dir):
    """Concept maps of all documents; every sixth has no sections."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return answer.concept_map(d, leveled_sections(spark, sf_dir).where("cast(doc_id as long) % 6 > 0"))


# ---------------------------------------------------------------- analyses read back


@query(
    "analysis_responses",
    f"""WITH {Q.QUALITY},
wk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_start) AS n FROM pq WHERE quality IN ('weak','failed') OR recommended_action IN ('ocr','vision')),
wp AS (SELECT doc_id, string_agg('第 ' || (page_start + 1) || ' 页=' || quality || '/' || recommended_action, ',' ORDER BY n) FILTER (n <= 8) AS pages, bool_or(recommended_action = 'vision') AS vision FROM wk GROUP BY doc_id),
ad AS (SELECT d.*, d.doc_id % 3 = 0 AS st, d.doc_id % 11 = 0 AS none, d.doc_id % 10 = 0 AS done, d.doc_id % 4 = 0 AS rec, pages, coalesce(vision, false) AS vision FROM documents d LEFT JOIN wp ON wp.doc_id = d.doc_id),
ax AS (SELECT *, CASE WHEN st OR none THEN '' WHEN done THEN 'enhanced_completed' WHEN pages IS NOT NULL OR rec THEN 'needs_enhancement' ELSE 'usable' END AS state FROM ad)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN none AND NOT st THEN 'missing' ELSE 'available' END AS status, CASE WHEN st AND doc_id % 2 = 0 THEN 'model' WHEN st THEN 'parser' WHEN none THEN 'missing' ELSE 'parse_quality' END AS source,
  CASE WHEN st AND doc_id % 2 = 0 THEN '2024-01-01' ELSE '' END AS updated_at, CASE WHEN st THEN lang ELSE '' END AS difficulty, CASE WHEN st THEN CAST(n_chars % 90 AS INTEGER) ELSE 0 END AS minutes,
  CASE WHEN st THEN md5(text[:220]) END AS l0, state AS parse_quality_status,
  CASE state WHEN 'enhanced_completed' THEN {Q.q(R.MESSAGES['enhanced_completed'])} WHEN 'needs_enhancement' THEN {Q.q(R.MESSAGES['needs_enhancement'])} WHEN 'usable' THEN {Q.q(R.MESSAGES['usable'])} ELSE '' END AS message,
  CASE WHEN state = '' THEN NULL WHEN state = 'needs_enhancement' THEN {Q.q(R.WARNING)} ELSE '' END AS warnings,
  CASE WHEN state = '' THEN NULL WHEN done THEN {Q.q(R.DONE)} WHEN rec AND vision THEN {Q.q(R.CHECK_AGAIN + '|' + R.VISION)} WHEN rec THEN {Q.q(R.CHECK_AGAIN + '|' + R.VISION_LATER)} WHEN vision THEN {Q.q(R.VISION)} ELSE {Q.q(R.FINE)} END AS actions,
  CASE WHEN state = '' THEN NULL WHEN done THEN '' ELSE coalesce(pages, '') END AS pages FROM ax
UNION ALL SELECT 'nobody', 'missing', 'missing', '', '', 0, NULL, '', '', NULL, NULL, NULL""",
)
def analysis_responses(spark, sf_dir):
    """Stored analyses of a third of the documents, half of them with their meta row; the parse of the
    others, of which a tenth is enhanced and an eleventh has no measures."""
    store = new_store(spark)
    d = table(spark, sf_dir, "documents").withColumn("_id", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    store.replace("documents", d.select("doc_id", F.when(F.col("_id") % 4 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("ocr_recommended_pages")))
    first = F.left("text", F.lit(220))
    told = F.struct(
        F.col("lang").alias("difficulty"), (F.col("n_chars") % 90).cast("int").alias("estimated_reading_time"),
        F.array(F.struct(F.lit("RAG").alias("english"), F.lit("").alias("chinese"), F.lit("").alias("relation_type"))).alias("key_terms"),
        F.create_map(F.lit("s0"), first).alias("l0_summaries"), F.create_map(F.lit("s0"), first).alias("l1_overviews"), F.lit("graph").alias("mermaid_map"),
    )
    store.replace("understanding", d.where("_id % 3 = 0").select("doc_id", told.alias("understanding")))
    store.replace("analysis_meta", d.where("_id % 6 = 0").select("doc_id", F.lit("model").alias("source"), F.lit("2024-01-01").alias("updated_at"), F.lit("").alias("error")))
    scored = scored_pages(spark, sf_dir).where("doc_id % 11 > 0").withColumn("doc_id", F.col("doc_id").cast("string"))
    scored = scored.select("doc_id", "page_start", "quality", "recommended_action", "overall_score", "text_preview")
    store.replace("page_quality", written(scored, "analysis-quality"))  # laying rows by range reads them up to three times
    store.replace("enhanced_pages", d.where("_id % 10 = 0").select("doc_id", F.lit(0).alias("page_num"), F.lit(True).alias("enhanced")))
    asked = d.select("doc_id").unionByName(spark.createDataFrame([("nobody",)], "doc_id string"))
    found = R.responses(store, asked)
    label = F.transform("pages", lambda p: F.concat(p["page_label"], F.lit("="), p["quality"], F.lit("/"), p["recommended_action"]))
    return found.select(
        "doc_id", "status", "source", "updated_at", "difficulty", F.col("estimated_reading_time").alias("minutes"), F.md5(F.col("l0_summaries")["s0"]).alias("l0"), "parse_quality_status", "message",
        F.array_join("warnings", "|").alias("warnings"), F.array_join("actions", "|").alias("actions"), F.array_join(label, ",").alias("pages"),
    )


# ---------------------------------------------------------------- clearing


@query(
    "memory_clearing",
    """WITH e AS (SELECT event_id AS id, user_id AS doc, event_type FROM events), art AS (SELECT unnest(['learning_events', 'concept_memory', 'reading_records', 'session_summaries', 'term_log', 'core_memory']) AS artifact, generate_series(1, 4) AS steps),
n AS (SELECT artifact, step, CASE artifact WHEN 'learning_events' THEN CASE step WHEN 1 THEN (SELECT count(*) FROM e) WHEN 2 THEN (SELECT count(*) FROM e WHERE doc % 3 <> 0) WHEN 3 THEN (SELECT count(*) FROM e WHERE id % 2 = 1) ELSE 0 END
    WHEN 'concept_memory' THEN CASE step WHEN 1 THEN (SELECT count(DISTINCT (doc, event_type)) FROM e) WHEN 4 THEN 0 ELSE (SELECT count(DISTINCT (doc, event_type)) FROM e WHERE doc % 3 <> 0) END
    WHEN 'reading_records' THEN CASE step WHEN 1 THEN (SELECT count(*) FROM e WHERE event_type = 'click') WHEN 4 THEN 0 ELSE (SELECT count(*) FROM e WHERE event_type = 'click' AND doc % 3 <> 0) END
    WHEN 'session_summaries' THEN CASE step WHEN 1 THEN (SELECT count(DISTINCT doc) FROM e) WHEN 4 THEN 0 ELSE (SELECT count(DISTINCT doc) FROM e WHERE doc % 3 <> 0) END
    ELSE CASE WHEN step = 4 THEN 0 ELSE (SELECT count(DISTINCT doc) FROM e) END END AS n_rows FROM (SELECT artifact, unnest(steps) AS step FROM art)),
o AS (SELECT DISTINCT doc FROM e)
SELECT CAST(step AS INTEGER) AS step, artifact, n_rows, CASE WHEN artifact <> 'core_memory' OR step = 4 THEN 0 WHEN step = 1 THEN (SELECT count(*) FROM o) ELSE (SELECT count(*) FROM o WHERE (doc + 1) % 3 <> 0 OR doc + 1 NOT IN (SELECT doc FROM o)) END AS n_placed,
  CASE WHEN artifact = 'core_memory' AND step < 3 THEN (SELECT count(*) FROM o) ELSE 0 END AS n_summaries FROM n""",
)
def memory_clearing(spark, sf_dir):
    """One store: memory as it is, every third document cleared, the session cleared and half of the
    events seen again, then everything cleared."""
    store, e = new_store(spark), learning_events(spark, sf_dir)
    owners = e.select("doc_id").distinct()
    store.append("learning_events", e)
    store.append("concept_memory", e.select("doc_id", F.col("event_type").alias("concept")).distinct())
    store.append("reading_records", e.where("event_type = 'section_read'").select("doc_id", "section_id", "ts"))
    store.append("session_summaries", owners.withColumn("summary", F.lit("s")))
    store.append("term_log", owners.withColumn("term", F.lit("t")))
    place = F.concat((F.col("doc_id").cast("long") + 1).cast("string"), F.lit(":s1"))
    store.replace("core_memory", owners.select("doc_id", place.alias("current_position"), F.lit("read on").alias("session_summary")))
    kept = ("learning_events", "concept_memory", "reading_records", "session_summaries", "term_log", "core_memory")

    def counted(step: int) -> list[tuple]:
        core = store.read("core_memory").agg(F.count_if(F.col("current_position") != ""), F.count_if(F.col("session_summary") != "")).first()
        return [(step, name, store.read(name).count(), *(core if name == "core_memory" else (0, 0))) for name in kept]

    out = counted(1)
    forget.documents(store, table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("doc_id")))
    out += counted(2)
    forget.session(store)
    store.append("learning_events", e.where("id % 2 = 1"))
    out += counted(3)
    forget.everything(store)
    out += counted(4)
    return spark.createDataFrame(out, "step int, artifact string, n_rows long, n_placed long, n_summaries long")
