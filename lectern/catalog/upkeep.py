"""Queries that keep a store up to date: enhancements applied, sections cut for analysis, memory as of a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from lectern.catalog import sql as Q
from lectern.catalog.documents import windows
from lectern.catalog.inputs import table
from lectern.catalog.learning import EVENT_CONCEPTS, STATUS, learning_events
from lectern.catalog.parsing import _MERGE, line_pages, page_fragments
from lectern.catalog.registry import Area
from lectern.functions import text as T
from lectern.operators import analyzer, memory, prefixes, snapshot
from lectern.operators.stage import written
from lectern.plans import enhancement
from lectern.session import shared_dir
from lectern.sources import reflections
from lectern.sources.store import Store

AREA = Area()
query = AREA.query


def new_store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark).rstrip('/')}/lectern-store-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- enhancements

_SEEN = _MERGE.replace("WHERE (doc_id + page_num) % 5 = 0", "WHERE (doc_id + page_num) % 5 = 0 AND doc_id % 4 = 0")
# a slide above the limit is packed paragraph by paragraph, the page's own and the fragment's, unless the first is a title
_SLIDES = """SELECT (doc_id * 1000000 + page_num) * 2 + i - 1 AS u, ps[i] AS s FROM (SELECT doc_id, page_num, ps, generate_subscripts(ps, 1) AS i FROM (
  SELECT doc_id, page_num, CASE WHEN length(t) // 4 > 500 AND length(string_split(t, chr(10) || chr(10))[1]) // 4 > 16 THEN list_transform(string_split(t, chr(10) || chr(10)), lambda p: {p}) ELSE [t] END AS ps FROM (SELECT doc_id, page_num, {t} AS t FROM m) WHERE t <> ''))""".format(t=Q.strip("new"), p=Q.strip("p"))


@query(
    "apply_enhancement",
    f"""WITH RECURSIVE {_SEEN},
b1 AS (SELECT * FROM sc WHERE source <> 'vision' QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, cand) = 1),
m AS (SELECT ln.doc_id, ln.page_num, CASE WHEN b.cand > 0 THEN b.c_text ELSE ln.text END AS new, CASE WHEN b.cand > 0 THEN b.source ELSE 'parser' END AS src,
    CASE WHEN b1.cand > 0 THEN b1.c_text ELSE ln.text END AS old, CASE WHEN b1.cand > 0 THEN b1.source ELSE 'parser' END AS src1
  FROM ln LEFT JOIN best b ON b.doc_id = ln.doc_id AND b.page = ln.page_num LEFT JOIN b1 ON b1.doc_id = ln.doc_id AND b1.page = ln.page_num),
diff AS (SELECT doc_id, bool_or(new <> old OR src <> src1) AS changed, count(*) FILTER (src <> 'parser') AS n_enhanced FROM m GROUP BY doc_id),
f AS (SELECT doc_id, bool_or(source = 'ocr') AS ocr, bool_or(source = 'vision') AS vision,
    count(DISTINCT page) FILTER (quality <> 'failed' AND f_text <> '') AS n2, count(DISTINCT page) FILTER (source = 'ocr' AND quality <> 'failed' AND f_text <> '') AS n1 FROM fr GROUP BY doc_id),
{windows(_SLIDES, 500, 50)},
made AS (SELECT u // 2000000 AS doc_id, count(*) AS n FROM cks GROUP BY 1),
slides AS (SELECT doc_id, count(*) AS n, sum(length({Q.strip('new')}[:200])) AS chars FROM m WHERE {Q.strip('new')} <> '' GROUP BY doc_id),
st AS (SELECT d.doc_id, coalesce(f.n2, 0) AS n2, ocr, vision, CASE WHEN ocr IS NULL OR NOT ocr THEN 'missing' WHEN n1 = 0 THEN 'skipped' ELSE 'applied' END AS s1, changed, n_enhanced
  FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id JOIN diff ON diff.doc_id = d.doc_id),
s2 AS (SELECT *, CASE WHEN ocr IS NULL THEN 'missing' WHEN n2 = 0 THEN 'skipped' WHEN s1 = 'applied' AND NOT changed THEN 'unchanged' ELSE 'applied' END AS s2 FROM st)
SELECT CAST(s2.doc_id AS VARCHAR) AS doc_id, s1 AS first_status, s2 AS second_status, CASE WHEN s2 IN ('missing', 'skipped') THEN s2 ELSE 'unchanged' END AS third_status,
  CASE WHEN s2 = 'missing' THEN 'ocr' WHEN ocr AND vision THEN 'mixed' WHEN vision THEN 'vision' ELSE 'ocr' END AS source, n2 AS num_pages_updated,
  CASE WHEN s2 IN ('missing', 'skipped') THEN 0 ELSE coalesce(made.n, 0) END AS num_chunks, CASE WHEN s2 IN ('missing', 'skipped') THEN 0 ELSE n_enhanced END AS n_enhanced,
  CASE WHEN s2 IN ('missing', 'skipped') THEN 0 ELSE coalesce(slides.n, 0) END AS n_sections, CAST(CASE WHEN s2 IN ('missing', 'skipped') THEN 0 ELSE coalesce(slides.chars, 0) END AS BIGINT) AS gist_chars,
  0 AS new_segments
FROM s2 LEFT JOIN made ON made.doc_id = s2.doc_id LEFT JOIN slides ON slides.doc_id = s2.doc_id""",
)
def apply_enhancement(spark, sf_dir):
    """Slide decks in a store: recognised text applied, then vision text of a quarter of them, then
    nothing new. The third run must not write: ``new_segments`` counts what it added."""
    store = new_store(spark)
    at = F.col("page_num") + F.col("doc_id").cast("long")
    text_id = F.col("doc_id").cast("string")
    store.replace("documents", table(spark, sf_dir, "documents").select(text_id.alias("doc_id"), F.lit("slides_pdf").alias("doc_subtype")))
    pages = line_pages(spark, sf_dir).withColumn("content_source", F.lit("parser")).withColumn("enhanced", F.lit(False))
    flags = [(at % n == 0).alias(name) for n, name in ((7, "on_image"), (11, "on_table"), (13, "on_formula"))]
    store.replace("doc_pages", pages.select("*", *flags).withColumn("doc_id", text_id))
    fragments = page_fragments(spark, sf_dir)
    store.replace("ocr_pages", fragments.where("source = 'ocr'").withColumn("doc_id", text_id))
    first = enhancement.apply(store)
    store.replace("vision_pages", fragments.where("source = 'vision' and doc_id % 4 = 0").withColumn("doc_id", text_id))
    second = enhancement.apply(store)
    derived = ("enhanced_pages", "doc_sections", "chunks", "page_quality", "documents", "derivations")
    before = sum(len(store.log(name).live()) for name in derived)
    third = enhancement.apply(store)
    added = sum(len(store.log(name).live()) for name in derived) - before
    pages = store.read("enhanced_pages").groupBy("doc_id").agg(F.count_if(F.col("content_source") != "parser").alias("n_enhanced"))
    sections = store.read("doc_sections").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("gist")).alias("gist_chars"))
    one = lambda df, name: df.select("doc_id", F.col("status").alias(name))
    joined = one(first, "first_status").join(second.withColumnRenamed("status", "second_status").drop("num_chunks"), "doc_id").join(
        third.select("doc_id", F.col("status").alias("third_status"), "num_chunks"), "doc_id"
    )
    counted = joined.join(pages, "doc_id", "left").join(sections, "doc_id", "left").fillna(0, ["n_enhanced", "n_sections", "gist_chars"])
    return counted.withColumn("new_segments", F.lit(added))


# ---------------------------------------------------------------- the analyzer

_SECTIONS = """
se AS (SELECT doc_id, page_num // 3 AS section_no, CASE WHEN (page_num // 3) % 4 = 3 THEN 'no such title' ELSE text[:20] END AS title,
  CASE WHEN (page_num // 3) % 2 = 0 THEN page_num // 6 END AS page_start FROM ln WHERE page_num % 3 = 0)"""


def third_line_sections(spark, sf_dir) -> DataFrame:
    """Every third line begins a section; half of them know their page, some have titles that stand nowhere."""
    no = F.floor(F.col("page_num") / 3)
    return line_pages(spark, sf_dir).where("page_num % 3 = 0").select(
        "doc_id", no.alias("section_no"), no.cast("string").alias("section_id"), F.lit(1).alias("level"),
        F.when(no % 4 == 3, "no such title").otherwise(F.left("text", F.lit(20))).alias("title"),
        F.when(no % 2 == 0, F.floor(F.col("page_num") / 6)).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
    )


@query(
    "analyzer_windows",
    f"""WITH {Q.LINES}, {_SECTIONS},
k AS (SELECT se.*, d.text, position(title IN text) AS p FROM se JOIN documents d USING (doc_id) WHERE section_no < 10),
w AS (SELECT *, greatest(0, CASE WHEN page_start IS NOT NULL THEN page_start * 3000 - 500 WHEN title = '' THEN 0 WHEN p > 0 THEN p - 1 - 200 ELSE 0 END) AS a,
  least(length(text), CASE WHEN page_start IS NOT NULL THEN page_start * 3000 + 3500 WHEN title = '' THEN 3000 WHEN p > 0 THEN p - 1 + 3000 ELSE 3000 END) AS z FROM k),
x AS (SELECT doc_id, section_no, CASE WHEN a < z THEN substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) ELSE '' END AS t FROM w)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, length(t) AS n_chars, md5(t) AS digest, md5(t[:2000]) AS l0_digest, md5(t[:5000]) AS l1_digest FROM x
UNION ALL SELECT doc_id, -1, length(text[:8000]), md5(text[:8000]), NULL, NULL FROM documents""",
)
def analyzer_windows(spark, sf_dir):
    """What the analyzer reads of each document and section, cut from page rows."""
    pages = line_pages(spark, sf_dir)
    found = analyzer.section_windows(pages, third_line_sections(spark, sf_dir))
    windows = found.select(
        "doc_id", F.col("section_no").cast("long").alias("section_no"), F.length("window").cast("long").alias("n_chars"),
        F.md5("window").alias("digest"), F.md5("l0_text").alias("l0_digest"), F.md5("l1_text").alias("l1_digest"),
    )
    none = F.lit(None).cast("string")
    start = analyzer.opening(pages).select(
        "doc_id", F.lit(-1).cast("long").alias("section_no"), F.length("excerpt").cast("long").alias("n_chars"), F.md5("excerpt").alias("digest"), none.alias("l0_digest"), none.alias("l1_digest")
    )
    return windows.unionByName(start)


def analyzer_answers(spark, sf_dir) -> DataFrame:
    """Answers of every kind a model gives, made from the lines of a document: fenced, without
    sections, broken, sections that are no list, an empty list, prose around, a bare list."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda t: T.strip(t) != "")
    item = lambda t, i: F.struct(F.when(i % 2 == 0, F.concat(F.lit("m"), i.cast("string"))).alias("section_id"), F.left(t, F.lit(30)).alias("title"), i.alias("page_start"))
    full = F.to_json(F.struct(F.col("lang").alias("language"), F.transform(lines, item).alias("sections")))
    small = F.to_json(F.struct(F.col("source").alias("doc_type"), F.col("n_chars").alias("estimated_reading_time")))
    odd = F.to_json(F.struct(F.lit("advanced").alias("difficulty"), F.struct(F.lit("x").alias("title")).alias("sections")))
    empty = F.to_json(F.struct(F.array().cast("array<struct<title:string>>").alias("sections"), F.col("lang").alias("language")))
    kind = F.col("doc_id") % 7
    answer = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(kind == 1, small)
        .when(kind == 2, F.concat(F.lit("{\"sections\": ["), F.left(F.col("lang"), F.lit(1)))).when(kind == 3, odd).when(kind == 4, empty)
        .when(kind == 5, F.concat(F.lit("Here it is: "), full, F.lit(" as asked"))).otherwise(F.to_json(F.transform(lines, item)))
    )
    return d.select("doc_id", answer.alias("answer"))


@query(
    "analyzer_sections",
    f"""WITH {Q.LINES}, {_SECTIONS},
li AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS i FROM ln WHERE {Q.strip('text')} <> ''),
md AS (SELECT doc_id, i AS section_no, CASE WHEN i % 2 = 0 THEN 'm' || i ELSE CAST(i AS VARCHAR) END AS section_id, text[:30] AS title, CAST(i AS INTEGER) AS page_start, 'model' AS origin FROM li WHERE doc_id % 7 IN (0, 5)),
has AS (SELECT DISTINCT doc_id FROM md),
pa AS (SELECT doc_id, section_no, CAST(section_no AS VARCHAR), title, CAST(page_start AS INTEGER), 'parser' FROM se WHERE doc_id % 7 IN (0, 1, 3, 4, 5) AND doc_id NOT IN (SELECT doc_id FROM has)),
a AS (SELECT * FROM md UNION ALL SELECT * FROM pa)
SELECT d.doc_id, CASE WHEN d.doc_id % 7 IN (2, 6) THEN 'no JSON object in the answer' ELSE '' END AS error, CASE WHEN d.doc_id % 7 = 1 THEN source ELSE 'research_paper' END AS doc_type,
  CASE WHEN d.doc_id % 7 IN (0, 4, 5) THEN lang ELSE 'en' END AS language, CASE WHEN d.doc_id % 7 = 3 THEN 'advanced' ELSE 'intermediate' END AS difficulty,
  CASE WHEN d.doc_id % 7 = 1 THEN CAST(n_chars AS INTEGER) ELSE 30 END AS minutes, CAST(a.section_no AS BIGINT) AS section_no, a.section_id, a.title, a.page_start, a.origin
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""",
)
def analyzer_sections(spark, sf_dir):
    """Answers parsed and their sections merged with the parser's, the model's first."""
    answered = analyzer_answers(spark, sf_dir).select("doc_id", analyzer.parsed_answer(F.col("answer")).alias("understanding"))
    answered = written(answered, "analyzer-answers")
    merged = analyzer.merged_sections(answered, third_line_sections(spark, sf_dir)).select("doc_id", "section_no", "section_id", "title", "page_start", "origin")
    u = lambda name, new=None: F.col(f"understanding.{name}").alias(new or name)
    told = answered.select("doc_id", u("error"), u("doc_type"), u("language"), u("difficulty"), u("estimated_reading_time", "minutes"))
    return told.join(merged, "doc_id", "left")


# ---------------------------------------------------------------- contextual prefixes


def _fails_for_a_third(prompts: list[str]) -> list[str]:
    if any(len(p) % 3 == 0 for p in prompts):
        raise RuntimeError("no answer")
    return [f"first {len(p)}" for p in prompts]


def _answers_all(prompts: list[str]) -> list[str]:
    return [f"again {len(p)}" for p in prompts]


@query(
    "contextual_prefixes",
    f"""WITH {Q.LINES}, c AS (SELECT ln.doc_id, page_num, 92 + least(2000, length(d.text)) + least(1000, length(ln.text)) AS n FROM ln JOIN documents d ON d.doc_id = ln.doc_id)
SELECT 1 AS run, CAST(doc_id AS VARCHAR) AS doc_id, page_num AS pos, 'first ' || n AS contextual_prefix FROM c WHERE n % 3 <> 0
UNION ALL SELECT 2, CAST(doc_id AS VARCHAR), page_num, CASE WHEN n % 3 = 0 THEN 'again ' ELSE 'first ' END || n FROM c""",
)
def contextual_prefixes(spark, sf_dir):
    """Every line as a chunk. The slot fails for a third of them, which drop; a second run asks only those."""
    store = new_store(spark)
    chunks = line_pages(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_num").alias("pos"), "text")
    contexts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("context"))
    first, _ = prefixes.with_prefixes(store, chunks, contexts, _fails_for_a_third)
    first = written(first.select(F.lit(1).alias("run"), "doc_id", "pos", "contextual_prefix"), "prefixes-first")
    second, _ = prefixes.with_prefixes(store, chunks, contexts, _answers_all)
    return first.unionByName(second.select(F.lit(2).alias("run"), "doc_id", "pos", "contextual_prefix"))


# ---------------------------------------------------------------- memory as of a time

_TIMES = ("2024-01-03 06:00:00", "2024-01-15 12:00:00", "2024-02-01 00:00:00")


@query(
    "memory_snapshot",
    f"""WITH {EVENT_CONCEPTS},
r AS (SELECT DISTINCT doc_id || '@' || asked AS request_id, doc_id, CAST(asked AS TIMESTAMP) AS until FROM ev, (SELECT unnest([{', '.join(Q.q(t) for t in _TIMES)}]) AS asked)),
e AS (SELECT r.request_id, evp.* FROM r JOIN evp ON evp.doc_id = r.doc_id AND evp.ts <= r.until),
pos AS (SELECT request_id, doc_id || ':' || arg_max(section_id, id) AS p FROM e GROUP BY request_id, doc_id),
act AS (SELECT request_id, id, CASE event_type WHEN 'section_read' THEN 'Read ' || title[:80] WHEN 'chat_question' THEN 'Asked: ' || message[:120]
   WHEN 'translate_text' THEN 'Translated selected text' WHEN 'explain_text' THEN 'Explained selected text' ELSE 'Reviewed study brief' END AS action FROM e),
summ AS (SELECT request_id, 'Recent learning actions: ' || string_agg(action, ' | ' ORDER BY id) AS s FROM (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY id DESC) <= 8) GROUP BY request_id),
gl AS (SELECT request_id, 'topic' || k AS term, max(id) AS id, arg_max(title, id) AS tr FROM e GROUP BY ALL),
g AS (SELECT request_id, string_agg(term || '|||' || tr, ', ' ORDER BY id) AS g FROM (SELECT * FROM gl QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY id DESC) <= 20) GROUP BY request_id),
cr AS (SELECT r.request_id, concept, count(*) AS n, arg_max({STATUS}, id) AS status, max(ts) AS seen, max(id) AS last_id FROM r JOIN cx ON cx.doc_id = r.doc_id AND cx.ts <= r.until GROUP BY r.request_id, concept),
c AS (SELECT request_id, string_agg(concept || ' (' || status || ', evidence=' || n || ')', ';' ORDER BY nth) AS c FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seen DESC, last_id DESC, concept) AS nth FROM cr QUALIFY nth <= 30) GROUP BY request_id),
rec AS (SELECT request_id, string_agg(id, ',' ORDER BY id DESC) AS i FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY id DESC) <= 30) GROUP BY request_id)
SELECT r.request_id, coalesce(p, '') AS current_position, coalesce(s, '') AS session_summary, coalesce(g.g, '') AS active_glossary, coalesce(c.c, '') AS concepts, coalesce(i, '') AS recent_events
FROM r LEFT JOIN pos USING (request_id) LEFT JOIN summ USING (request_id) LEFT JOIN g USING (request_id) LEFT JOIN c USING (request_id) LEFT JOIN rec USING (request_id)""",
)
def memory_snapshot(spark, sf_dir):
    """Every document's memory as it stood at three times."""
    events = learning_events(spark, sf_dir)
    at = F.explode(F.array(*map(F.lit, _TIMES))).alias("_at")
    requests = events.select("doc_id").distinct().select("doc_id", at)
    requests = requests.select(F.concat("doc_id", F.lit("@"), "_at").alias("request_id"), "doc_id", F.to_timestamp("_at").alias("at"))
    terms = events.select(
        "doc_id", "id", "ts", F.substring_index(memory.payload_field("message"), " ", 1).alias("term"), memory.payload_field("title").alias("translation")
    )
    found = snapshot.snapshots(events, requests, terms)
    return found.select(
        "request_id", "current_position", "session_summary", F.array_join("active_glossary", ", ").alias("active_glossary"),
        F.array_join("concepts", ";").alias("concepts"), F.array_join(F.col("recent_events").cast("array<string>"), ",").alias("recent_events"),
    )


# ---------------------------------------------------------------- reflections

_READING = """SELECT source || ': ' || lang || '/all' AS title, lang, source, date '2024-01-01' + CAST(min(doc_id) % 28 AS INTEGER) AS day, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL"""


@query(
    "reflections_round_trip",
    f"""WITH r AS ({_READING}), f AS (SELECT strftime(day, '%Y-%m-%d') || '_' || title || '.md' AS file_name,
  '---' || chr(10) || 'date: ' || strftime(day, '%Y-%m-%d') || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || 'type: reflection' || chr(10) || '---' || chr(10) || chr(10)
  || CASE WHEN lang = 'en' THEN 'Again: ' ELSE '' END || n || ' texts' || chr(10) || chars || ' characters' AS text FROM r)
SELECT *, file_name = (SELECT max(file_name) FROM f) AS is_latest FROM f""",
)
def reflections_round_trip(spark, sf_dir):
    """What was read of each source in each language, saved as entries; those of one language saved again."""
    folder = f"{shared_dir(spark).rstrip('/')}/lectern-reflections-{uuid.uuid4().hex}"
    read = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )
    told = F.concat(F.col("n").cast("string"), F.lit(" texts\n"), F.col("chars").cast("string"), F.lit(" characters"))
    entries = read.select(
        F.date_add(F.lit("2024-01-01"), (F.col("first") % 28).cast("int")).alias("day"), F.concat("source", F.lit(": "), "lang", F.lit("/all")).alias("title"),
        F.array("lang", "source").alias("tags"), told.alias("content"), F.lit(1).alias("saved"), "lang",
    )
    entries = written(entries, "reflections")
    reflections.save(entries, folder)
    reflections.save(entries.where("lang = 'en'").withColumn("content", F.concat(F.lit("Again: "), "content")).withColumn("saved", F.lit(2)), folder)
    newest = reflections.latest(spark, folder).select("file_name", F.lit(True).alias("_newest"))
    found = reflections.stored(spark, folder).join(newest, "file_name", "left")
    return found.select("file_name", "text", F.coalesce("_newest", F.lit(False)).alias("is_latest"))
