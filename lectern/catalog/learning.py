"""Queries over learning events and conversations, and over document understanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lectern.catalog import sql as Q
from lectern.catalog.inputs import table
from lectern.catalog.parsing import line_pages
from lectern.catalog.registry import Area
from lectern.functions import answers as A
from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators import analysis, memory
from lectern.plans import answer as plan
from lectern.session import shared_dir

AREA = Area()
query = AREA.query


# ---------------------------------------------------------------- inputs

EVENTS = """
ev AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'section_read' WHEN 'view' THEN 'brief_view' WHEN 'purchase' THEN 'chat_question'
   WHEN 'signup' THEN 'explain_text' ELSE 'translate_text' END AS event_type, CAST(user_id AS VARCHAR) AS doc_id, 's' || (event_id % 5) AS section_id, ts,
   CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
evp AS (SELECT *, 'topic' || k || ' deep learning model' || CASE WHEN k % 7 = 0 THEN ' attention formula' ELSE '' END AS message, 'chapter ' || (k % 10) AS title FROM ev)"""


def mapped_events(df: DataFrame) -> DataFrame:
    """The events table as learning events (works on a stream as well)."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "section_read").when(F.col("event_type") == "view", "brief_view")
        .when(F.col("event_type") == "purchase", "chat_question").when(F.col("event_type") == "signup", "explain_text")
        .otherwise("translate_text")
    )
    message = F.concat(
        F.lit("topic"), k.cast("string"), F.lit(" deep learning model"), F.when(k % 7 == 0, " attention formula").otherwise("")
    )
    payload = F.to_json(
        F.struct(message.alias("message"), F.concat(F.lit("chapter "), (k % 10).cast("string")).alias("title"))
    )
    return df.select(
        F.col("event_id").alias("id"),
        kind.alias("event_type"),
        F.col("user_id").cast("string").alias("doc_id"),
        F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("section_id"),
        payload.alias("payload"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def learning_events(spark, sf_dir) -> DataFrame:
    return mapped_events(table(spark, sf_dir, "events"))


def user_turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user")


def _concepts_sql(text: str) -> str:
    w = f"regexp_extract_all(lower({text}), '[A-Za-z][A-Za-z0-9-]*')"
    marked = f"list_transform({w}, lambda w: CASE WHEN list_contains({Q.listing(X.CONCEPT_STOPWORDS)}, w) OR length(w) <= 2 THEN '|' ELSE w END)"
    groups = f"list_filter(list_transform(string_split(array_to_string({marked}, ' '), '|'), lambda g: list_filter(string_split(trim(g), ' '), lambda w: w <> '')), lambda g: len(g) > 0)"
    runs = (
        f"flatten(list_transform({groups}, lambda g: list_filter(list_transform(generate_series(1, len(g) - least(3, len(g)) + 1), "
        "lambda i: array_to_string(g[i:i + least(3, len(g)) - 1], ' ')), lambda p: len(g) > 1 OR contains(p, '-') OR length(p) >= 4)))"
    )
    known = ", ".join(f"CASE WHEN contains(lower({text}), {Q.q(p)}) THEN {Q.q(p)} END" for p in X.CONCEPT_PHRASES)
    return f"list_concat(list_filter([{known}], lambda k: k IS NOT NULL), {runs})"


CONCEPTS = f"""
cw AS (SELECT *, {_concepts_sql('message')} AS l FROM evp WHERE event_type IN ({Q.names(X.CONCEPT_EVENTS)})),
cx AS (SELECT *, unnest(list_filter(l, lambda v, i: list_position(l, v) = i)[1:8]) AS concept FROM cw)"""
# the title's words come after the message's in the text an event is read by
EVENT_CONCEPTS = f"{EVENTS}, {CONCEPTS.replace(_concepts_sql('message'), _concepts_sql(chr(40) + 'message || ' + Q.q('  ') + ' || title' + chr(41)))}"
STATUS = f"CASE WHEN event_type IN ('explain_text', 'translate_text') THEN 'learning' WHEN regexp_matches(message || ' ' || title, {Q.q(X.NEEDS_REVIEW)}) THEN 'needs_review' WHEN event_type = 'section_read' THEN 'seen' ELSE 'learning' END"

STATE = f"""{EVENT_CONCEPTS},
cs AS (SELECT concept, doc_id, count(*) AS evidence_count, arg_max({STATUS}, id) AS status, arg_max(section_id, id) AS last_section_id, max(ts) AS last_seen, max(id) AS last_id,
   list_reverse(list(event_type ORDER BY id DESC)[1:20]) AS source_events FROM cx GROUP BY concept, doc_id)"""


# ---------------------------------------------------------------- event log


@query(
    "event_log_latest",
    f"WITH {EVENTS} SELECT id, event_type, doc_id, section_id, message, title FROM evp ORDER BY id DESC LIMIT 50",
)
def event_log_latest(spark, sf_dir):
    rows = memory.latest_events(learning_events(spark, sf_dir), 50)
    return rows.select(
        "id", "event_type", "doc_id", "section_id", memory.payload_field("message").alias("message"), memory.payload_field("title").alias("title")
    )


@query(
    "event_log_latest_per_document",
    f"WITH {EVENTS} SELECT id, doc_id, event_type, row_number() OVER (PARTITION BY doc_id ORDER BY id DESC) AS nth FROM evp QUALIFY nth <= 30",
)
def event_log_latest_per_document(spark, sf_dir):
    rows = memory.latest_per_document(learning_events(spark, sf_dir), 30)
    return rows.select("id", "doc_id", "event_type", F.col("nth").cast("long").alias("nth"))


@query(
    "concept_extraction",
    f"""WITH x AS (SELECT conv_id, turn, {_concepts_sql('text')} AS l FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:8], ',') AS concepts FROM x""",
)
def concept_extraction(spark, sf_dir):
    u = user_turns(spark, sf_dir)
    return u.select("conv_id", "turn", F.array_join(memory.concepts(F.lit("chat_question"), F.col("text")), ",").alias("concepts"))


_STATE_OUT = "concept, doc_id, status, evidence_count, array_to_string(source_events, ',') AS source_events, last_section_id, last_seen"


def state_row(df: DataFrame) -> DataFrame:
    return df.select(
        "concept", "doc_id", "status", "evidence_count", F.array_join("source_events", ",").alias("source_events"),
        "last_section_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
    )


@query("concept_memory", f"WITH {STATE} SELECT {_STATE_OUT} FROM cs")
def concept_memory(spark, sf_dir):
    return state_row(memory.concept_memory(memory.concept_signals(learning_events(spark, sf_dir))))


@query("concept_state_stream", f"WITH {STATE} SELECT {_STATE_OUT} FROM cs")
def concept_state_stream(spark, sf_dir):
    """The same state from a stream of several files, one a batch; the stream stops after some of
    them and goes on when the others have come. The state is folded every third batch."""
    import uuid

    from lectern.streaming import memory_stream

    base = f"{shared_dir(spark).rstrip('/')}/lectern-stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    half = events.agg(F.percentile_approx("event_id", 0.6)).first()[0] or 0
    for early in (True, False):
        part = events.where((F.col("event_id") <= half) if early else (F.col("event_id") > half))
        part.repartition(4, F.xxhash64("event_id")).write.mode("append").parquet(f"{base}/events")
        raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
        memory_stream.run(mapped_events(raw), f"{base}/states", f"{base}/progress", most=3).awaitTermination()
    return state_row(memory_stream.current_state(spark, f"{base}/states"))


@query(
    "session_summary",
    f"""WITH {EVENTS}, a AS (SELECT doc_id, id, CASE event_type WHEN 'section_read' THEN 'Read ' || title[:80] WHEN 'chat_question' THEN 'Asked: ' || message[:120]
   WHEN 'translate_text' THEN 'Translated selected text' WHEN 'explain_text' THEN 'Explained selected text' ELSE 'Reviewed study brief' END AS action FROM evp),
k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id DESC) <= 8)
SELECT doc_id, 'Recent learning actions: ' || string_agg(action, ' | ' ORDER BY id) AS session_summary FROM k GROUP BY doc_id""",
)
def session_summary(spark, sf_dir):
    return memory.session_summary(learning_events(spark, sf_dir), "doc_id")


_HINTS = f"""{STATE}, pos AS (SELECT doc_id, arg_max(section_id, id) AS sec FROM ev GROUP BY doc_id),
rc AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last_seen DESC, last_id DESC, concept) AS n FROM cs QUALIFY n <= 12),
wk AS (SELECT doc_id, array_to_string(list(concept ORDER BY n)[1:8], ';') AS concepts FROM rc WHERE status IN ('needs_review', 'learning') GROUP BY doc_id)"""


@query(
    "retrieval_hints",
    f"WITH {_HINTS} SELECT d.doc_id, pos.sec AS current_section_id, coalesce(concepts, '') AS concepts FROM (SELECT DISTINCT doc_id FROM cs) d LEFT JOIN wk ON wk.doc_id = d.doc_id LEFT JOIN pos ON pos.doc_id = d.doc_id",
)
def retrieval_hints(spark, sf_dir):
    events = learning_events(spark, sf_dir)
    state = memory.concept_memory(memory.concept_signals(events))
    where = memory.reading_position(events.withColumn("owner", F.col("doc_id")), "owner").withColumnRenamed("owner", "doc_id")
    return memory.retrieval_hints(state, where).withColumn("concepts", F.array_join("concepts", ";"))


@query(
    "personalization_context",
    f"""WITH {STATE}, rc AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY last_seen DESC, last_id DESC, concept) AS n FROM cs QUALIFY n <= 8),
ll AS (SELECT doc_id, 'Learning Concepts: ' || string_agg(concept || ' (' || status || ', evidence=' || evidence_count || ')', '; ' ORDER BY n) AS line FROM rc GROUP BY doc_id),
pos AS (SELECT doc_id, doc_id || ':' || arg_max(section_id, id) AS p FROM ev GROUP BY doc_id)
SELECT pos.doc_id, concat_ws(chr(10), 'Current Position: ' || p, line) AS context FROM pos LEFT JOIN ll ON ll.doc_id = pos.doc_id""",
)
def personalization_context(spark, sf_dir):
    events = learning_events(spark, sf_dir)
    state = memory.concept_memory(memory.concept_signals(events))
    where = memory.reading_position(events.withColumn("owner", F.col("doc_id")), "owner").withColumnRenamed("owner", "doc_id")
    core = memory.core_context(F.lit(""), F.col("current_position"), F.array().cast("array<string>"), F.lit(""))
    return where.join(memory.learning_line(state), "doc_id", "left").select(
        "doc_id", F.concat_ws("\n", core, "learning_line").alias("context")
    )


@query(
    "term_log",
    f"""WITH {EVENTS} SELECT 'topic' || k AS term, arg_min(message, id) AS definition, count(*) AS times_explained, max(ts) AS last_seen FROM evp WHERE event_type = 'explain_text' GROUP BY k""",
)
def term_log(spark, sf_dir):
    rows = learning_events(spark, sf_dir).where(F.col("event_type") == "explain_text")
    message = memory.payload_field("message")
    logged = memory.term_log(rows.select("id", "ts", F.substring_index(message, " ", 1).alias("term"), message.alias("definition")))
    return logged.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query(
    "active_glossary",
    f"""WITH {EVENTS}, l AS (SELECT doc_id, 'topic' || k AS term, max(id) AS id, arg_max(title, id) AS tr FROM evp GROUP BY ALL),
k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY id DESC) <= 20)
SELECT doc_id AS owner, string_agg(term || '|||' || tr, ', ' ORDER BY id) AS active_glossary FROM k GROUP BY doc_id""",
)
def active_glossary(spark, sf_dir):
    e = learning_events(spark, sf_dir).select(
        F.col("doc_id").alias("owner"), "id", F.substring_index(memory.payload_field("message"), " ", 1).alias("term"),
        memory.payload_field("title").alias("translation"),
    )
    return memory.glossary(e).withColumn("active_glossary", F.array_join("active_glossary", ", "))


@query(
    "memory_cleared_document",
    f"WITH {EVENTS} SELECT doc_id, count(*) AS n_events FROM ev WHERE doc_id <> '7' GROUP BY doc_id",
)
def memory_cleared_document(spark, sf_dir):
    return memory.cleared(learning_events(spark, sf_dir), "7").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "token_usage_rollup",
    f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, role AS agent, 'model-' || (turn % 3) AS model, {Q.estimate('text')} AS i, CASE WHEN role = 'assistant' THEN {Q.estimate('text')} ELSE 0 END AS o FROM conversations)
SELECT agent, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS calls, arg_max(model, id) AS last_model, sum(i + o) <= 4600 AS within_budget
FROM c GROUP BY ROLLUP (agent)""",
)
def token_usage_rollup(spark, sf_dir):
    n = T.estimate_tokens(F.col("text"))
    calls = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("agent"),
        F.concat(F.lit("model-"), (F.col("turn") % 3).cast("string")).alias("model"), n.alias("input_tokens"),
        F.when(F.col("role") == "assistant", n).otherwise(F.lit(0).cast("long")).alias("output_tokens"),
    )
    return memory.token_usage(calls)


# ---------------------------------------------------------------- knowledge tracing

_TERMS = f"""
tm AS (SELECT conv_id AS doc_id, i AS term_no, w[i] AS english, CASE i % 4 WHEN 0 THEN 'Hyponym-of' WHEN 1 THEN 'Used-for' WHEN 2 THEN 'Part-of' ELSE '' END AS relation_type, CASE WHEN i % 2 = 0 THEN 0.25 ELSE 0.6 END AS p
  FROM (SELECT conv_id, w, unnest(range(1, len(w) + 1)) AS i FROM
    (SELECT conv_id, list_sort(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{{4,}}'))))) AS w FROM conversations GROUP BY conv_id))),
tn AS (SELECT conv_id AS doc_id, CASE WHEN role = 'user' THEN lower(text) ELSE '' END AS question, CASE WHEN role = 'assistant' THEN lower(text) ELSE '' END AS answer FROM conversations),
kn AS (SELECT tm.doc_id, term_no, english, relation_type, least(1.0, p + count(*) FILTER (contains(question, english)) * 0.1 + count(*) FILTER (contains(answer, english)) * 0.05) AS p_known
  FROM tm JOIN tn ON tm.doc_id = tn.doc_id GROUP BY tm.doc_id, term_no, english, relation_type, p)"""


def conversation_terms(spark, sf_dir) -> DataFrame:
    """All words of a conversation from four letters on as its terms."""
    c = table(spark, sf_dir, "conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))
    found = c.select(F.col("conv_id").alias("doc_id"), F.explode(words).alias("english")).distinct()
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("english"))
    return found.select("doc_id", number.alias("term_no"), "english").select(
        "doc_id", "term_no", "english",
        F.element_at(F.array(*[F.lit(v) for v in ("Hyponym-of", "Used-for", "Part-of", "")]), F.col("term_no") % 4 + 1).alias("relation_type"),
        F.when(F.col("term_no") % 2 == 0, 0.25).otherwise(0.6).alias("p_known"),
    )


def conversation_turns(spark, sf_dir) -> DataFrame:
    said = lambda role: F.when(F.col("role") == role, F.col("text")).otherwise("")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), said("user").alias("question"), said("assistant").alias("answer")
    )


@query("knowledge_tracing", f"WITH {_TERMS} SELECT doc_id, CAST(term_no AS BIGINT) AS term_no, english, {Q.settle('p_known')} AS p_known FROM kn")
def knowledge_tracing(spark, sf_dir):
    k = memory.knowledge(conversation_terms(spark, sf_dir), conversation_turns(spark, sf_dir))
    return k.select("doc_id", F.col("term_no").cast("long").alias("term_no"), "english", T.settle(F.col("p_known")).alias("p_known"))


@query(
    "knowledge_propagation",
    f"""WITH RECURSIVE {_TERMS},
ini AS (SELECT doc_id, list({{'n': term_no, 'e': english, 'r': relation_type, 'p': p_known}} ORDER BY term_no) AS ts FROM kn GROUP BY doc_id),
st AS (SELECT doc_id, 1 AS i, ts FROM ini UNION ALL
  SELECT doc_id, i + 1, list_transform(ts, lambda x: {{'n': x.n, 'e': x.e, 'r': x.r, 'p': CASE WHEN ts[i].p >= 0.7 AND ts[i].r <> '' AND x.n <> ts[i].n AND x.r <> '' THEN
     CASE WHEN ts[i].r = 'Hyponym-of' AND contains(x.e, ts[i].e) THEN least(1.0, x.p + 0.05) WHEN x.r IN ('Used-for', 'Part-of') THEN least(1.0, x.p + 0.03) ELSE x.p END ELSE x.p END}})
  FROM st WHERE i <= len(ts)),
fin AS (SELECT doc_id, unnest(ts) AS t FROM st WHERE i = len(ts) + 1)
SELECT doc_id, CAST(t.n AS BIGINT) AS term_no, {Q.settle('t.p')} AS p_known FROM fin""",
)
def knowledge_propagation(spark, sf_dir):
    k = memory.propagate(memory.knowledge(conversation_terms(spark, sf_dir), conversation_turns(spark, sf_dir)))
    return k.select("doc_id", F.col("term_no").cast("long").alias("term_no"), T.settle(F.col("p_known")).alias("p_known"))


@query(
    "knowledge_gaps",
    f"""WITH {_TERMS} SELECT c.conv_id || '|' || c.turn AS request_id, string_agg(english, ', ' ORDER BY term_no) AS weak_terms
FROM conversations c JOIN kn ON kn.doc_id = c.conv_id WHERE c.role = 'user' AND p_known < 0.4 AND contains(lower(text), english) GROUP BY ALL""",
)
def knowledge_gaps(spark, sf_dir):
    k = memory.knowledge(conversation_terms(spark, sf_dir), conversation_turns(spark, sf_dir))
    asked = user_turns(spark, sf_dir).select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("conv_id").alias("doc_id"), F.col("text").alias("message"),
    )
    return memory.knowledge_gaps(k, asked)


# ---------------------------------------------------------------- understanding


def library_chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), F.col("lang").alias("section_id"), F.col("doc_id").alias("pos"), "text"
    )


def library_sections(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("section_id")).distinct().select(
        "*", F.concat(F.lit("Section "), "section_id").alias("title"), F.lit("").alias("gist")
    )


@query(
    "understanding_l0_l1",
    f"""SELECT source AS doc_id, lang AS section_id, {Q.squeeze("string_agg(text, ' ' ORDER BY doc_id)")}[:220] AS l0, {Q.squeeze("string_agg(text, ' ' ORDER BY doc_id)")}[:900] AS l1 FROM documents GROUP BY ALL""",
)
def understanding_l0_l1(spark, sf_dir):
    return analysis.layers(library_sections(spark, sf_dir), library_chunks(spark, sf_dir)).drop("title")


_OPENING = "op AS (SELECT source AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30) GROUP BY source)"


@query(
    "reading_time",
    f"WITH {_OPENING} SELECT doc_id, CAST(greatest(5, least(120, CASE WHEN len({Q.words('t')}) // 180 = 0 THEN 5 ELSE len({Q.words('t')}) // 180 END)) AS BIGINT) AS minutes FROM op",
)
def reading_time(spark, sf_dir):
    o = analysis.opening_text(library_chunks(spark, sf_dir))
    return o.select("doc_id", analysis.reading_minutes(F.col("opening")).cast("long").alias("minutes"))


@query(
    "key_terms",
    rf"""WITH {_OPENING}, w AS (SELECT doc_id, list_concat(list_filter([{', '.join(f"CASE WHEN contains(lower(t), {Q.q(k.lower())}) THEN {Q.q(k)} END" for k in X.TERM_TRANSLATIONS)}], lambda k: k IS NOT NULL),
   regexp_extract_all(regexp_replace(t, '[^\x00-\x7f]', '_', 'g'), '\b[A-Z][A-Za-z0-9-]{{2,}}\b')) AS l FROM op)
SELECT doc_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:12], ',') AS terms FROM w""",
)
def key_terms(spark, sf_dir):
    o = analysis.opening_text(library_chunks(spark, sf_dir))
    return o.select("doc_id", F.array_join(analysis.key_terms(F.col("opening")), ",").alias("terms"))


_SECTION_ROWS = f"sr AS (SELECT doc_id, page_num + 1 AS no, 1 + (page_num * 7 + doc_id) % 3 AS level, CASE WHEN {Q.strip('text')} = '' THEN 'n' || page_num ELSE {Q.strip('text')} END AS title FROM ln WHERE page_num < 30)"


@query(
    "outline",
    f"""WITH {Q.LINES}, {_SECTION_ROWS},
pr AS (SELECT a.doc_id, a.no, a.level, a.title, arg_max({{'no': b.no, 'level': b.level}}, b.no) AS up FROM sr a LEFT JOIN sr b ON b.doc_id = a.doc_id AND b.no < a.no AND b.level < a.level GROUP BY ALL)
SELECT doc_id, 'graph TD' || chr(10) || '  doc["' || doc_id || '"]' || chr(10) || string_agg('  s' || no || '["' || translate(title, '"[]', '''()') || '"]' || chr(10) || '  '
  || CASE WHEN up.level = level - 1 THEN 's' || up.no ELSE 'doc' END || ' --> s' || no, chr(10) ORDER BY no) AS outline FROM pr GROUP BY doc_id""",
)
def outline(spark, sf_dir):
    p = line_pages(spark, sf_dir)
    title = T.strip(F.col("text"))
    sections = p.select(
        "doc_id", (F.col("page_num") + 1).alias("section_no"),
        F.concat(F.lit("n"), F.col("page_num").cast("string")).alias("section_id"), title.alias("title"),
        (1 + (F.col("page_num") * 7 + F.col("doc_id")) % 3).cast("int").alias("level"),
    )
    return analysis.outline(table(spark, sf_dir, "documents").select("doc_id"), sections)


# the layers of understanding, each missing for some documents
_L = f"""SELECT doc_id, section_id, CASE WHEN n % 2 = 0 THEN l0 ELSE '' END AS l0, CASE WHEN n % 3 = 0 THEN l1 ELSE '' END AS l1, n % 5 = 0 AS detail FROM
  (SELECT source AS doc_id, lang AS section_id, CAST(source[4:] AS INTEGER) AS n, {Q.squeeze("string_agg(text, ' ' ORDER BY doc_id)")}[:220] AS l0, {Q.squeeze("string_agg(text, ' ' ORDER BY doc_id)")}[:900] AS l1
   FROM documents GROUP BY ALL)"""


@query(
    "layer_resolution",
    f"""SELECT doc_id, section_id, CASE WHEN l0 <> '' AND NOT detail THEN l0 WHEN l1 <> '' THEN l1 WHEN l0 <> '' THEN l0 ELSE '' END AS content,
 CASE WHEN l0 <> '' AND NOT detail THEN 'L0' WHEN l1 <> '' THEN 'L1' WHEN l0 <> '' THEN 'L0+L2' ELSE 'L2' END AS layer FROM ({_L})""",
)
def layer_resolution(spark, sf_dir):
    made = analysis.layers(library_sections(spark, sf_dir), library_chunks(spark, sf_dir))
    n = F.substring("doc_id", 4, 9).cast("int")
    l0 = F.when(n % 2 == 0, F.col("l0")).otherwise("")
    l1 = F.when(n % 3 == 0, F.col("l1")).otherwise("")
    return made.select("doc_id", "section_id", analysis.resolve_layer(l0, l1, n % 5 == 0).alias("r")).select("doc_id", "section_id", "r.*")


_SECTION_TEXT = f"""WITH {Q.LINES}, k AS (SELECT *, (doc_id + page_num) % 5 AS kind, {Q.strip('text')} AS s FROM ln),
pr AS (SELECT a.doc_id, a.page_num, string_agg(b.s, chr(10) || chr(10) ORDER BY b.page_num) AS ranged FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.page_num BETWEEN a.page_num AND a.page_num + 2 AND b.s <> '' WHERE a.kind = 3 GROUP BY ALL)
SELECT k.doc_id, CASE kind WHEN 2 THEN 'slide_' ELSE 'sec_' END || k.page_num AS section_id,
  CASE kind WHEN 0 THEN s || chr(10) || chr(10) || 'more' WHEN 1 THEN 'parsed ' || s WHEN 2 THEN s WHEN 3 THEN ranged ELSE 'gist ' || s END AS text,
  CASE kind WHEN 0 THEN 'chunks' WHEN 1 THEN 'parsed' WHEN 2 THEN 'slide' WHEN 3 THEN 'pages' ELSE 'gist' END AS text_source
FROM k LEFT JOIN pr ON pr.doc_id = k.doc_id AND pr.page_num = k.page_num WHERE s <> ''"""


def section_sources(spark, sf_dir):
    """Lines as sections whose text stands in their chunks, the parse, a slide, pages, or the gist only."""
    p = line_pages(spark, sf_dir).where(T.strip(F.col("text")) != "").withColumn("kind", (F.col("doc_id") + F.col("page_num")) % 5)
    sid = F.concat(F.when(F.col("kind") == 2, "slide_").otherwise("sec_"), F.col("page_num").cast("string"))
    k = p.withColumn("section_id", sid)
    at = lambda n: k.where(F.col("kind") == n)
    sections = k.select(
        "doc_id", "section_id", F.when(F.col("kind") == 3, F.col("page_num")).alias("page_start"),
        F.when(F.col("kind") == 3, F.col("page_num") + 2).alias("page_end"),
        F.concat(F.lit("gist "), T.strip(F.col("text"))).alias("gist"),
    )
    chunks = at(0).select("doc_id", "section_id", F.lit(0).alias("pos"), "text").unionByName(
        at(0).select("doc_id", "section_id", F.lit(1).alias("pos"), F.lit(" more ").alias("text"))
    )
    parsed = at(1).select("doc_id", "section_id", F.lit(0).alias("section_no"), F.concat(F.lit("parsed "), T.strip(F.col("text"))).alias("text"))
    return (sections, chunks, parsed, p.select("doc_id", "page_num", "text"))


@query("section_text_resolution", _SECTION_TEXT)
def section_text_resolution(spark, sf_dir):
    return analysis.section_text(*section_sources(spark, sf_dir))


#: A text as its pieces, for SQL over (keys, text).
_PIECES = "unnest(range(0, CAST(ceil(length(text) / 4096.0) AS BIGINT))) AS piece_no"


@query(
    "section_text_pieces",
    f"""SELECT doc_id, section_id, text_source, piece_no, substr(text, piece_no * 4096 + 1, 4096) AS piece FROM (SELECT *, {_PIECES} FROM ({_SECTION_TEXT}))""",
)
def section_text_pieces(spark, sf_dir):
    return analysis.section_text_pieces(*section_sources(spark, sf_dir))


@query(
    "document_text_pieces",
    f"""WITH {Q.LINES}, f AS (SELECT doc_id, {Q.strip("string_agg(text, chr(10) || chr(10) ORDER BY page_num)")} AS text FROM ln WHERE text <> '' GROUP BY doc_id)
SELECT doc_id, piece_no, md5(substr(text, piece_no * 4096 + 1, 4096)) AS digest FROM (SELECT *, {_PIECES} FROM f)""",
)
def document_text_pieces(spark, sf_dir):
    p = line_pages(spark, sf_dir).withColumnRenamed("page_num", "pos")
    return analysis.full_text_pieces(p).select("doc_id", "piece_no", F.md5("piece").alias("digest"))


@query(
    "document_full_text",
    f"""WITH {Q.LINES} SELECT doc_id, md5({Q.strip("string_agg(text, chr(10) || chr(10) ORDER BY page_num)")}) AS digest FROM ln WHERE text <> '' GROUP BY doc_id""",
)
def document_full_text(spark, sf_dir):
    p = line_pages(spark, sf_dir).withColumnRenamed("page_num", "pos")
    return analysis.full_text(p).select("doc_id", F.md5("full_text").alias("digest"))


@query(
    "glossary_union",
    """WITH l AS (SELECT DISTINCT lang || (doc_id % 9) AS english, 'logged' AS chinese FROM documents WHERE doc_id % 2 = 0), u AS (SELECT DISTINCT lang || (doc_id % 9) AS english, 'known' AS chinese FROM documents)
SELECT english, chinese, 'log' AS origin FROM l UNION ALL SELECT english, chinese, 'analysis' FROM u WHERE english NOT IN (SELECT english FROM l)""",
)
def glossary_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("english", F.concat("lang", (F.col("doc_id") % 9).cast("string")))
    logged = d.where(F.col("doc_id") % 2 == 0).select("english").distinct().withColumn("chinese", F.lit("logged"))
    known = d.select("english").distinct().withColumn("chinese", F.lit("known"))
    return analysis.glossary(logged, known)


# ---------------------------------------------------------------- answers


_TURN = "conv_id || '|' || turn AS request_id"


def turn_requests(spark, sf_dir) -> DataFrame:
    return user_turns(spark, sf_dir).select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("section_id"),
        F.col("text").alias("message"), "conv_id", "turn",
    )


@query(
    "translation_cache_lookup",
    f"""WITH k AS (SELECT {_TURN}, conv_id, text, CASE turn % 3 WHEN 0 THEN 'translate' WHEN 1 THEN 'explain' ELSE 'chat' END AS mode, turn FROM conversations WHERE role = 'user'),
c AS (SELECT *, CASE WHEN mode = 'translate' THEN conv_id || '|s' || turn || '|translate|m1|translate-section-v1|' || sha256(text) END AS cache_key FROM k)
SELECT request_id, cache_key, CASE WHEN mode = 'chat' THEN 'No text selected for explanation/translation.' WHEN mode = 'translate' AND conv_id % 2 = 0 THEN 'cached ' || length(text) ELSE text[:1000] END AS content,
  mode = 'translate' AND conv_id % 2 = 0 AS from_cache FROM c""",
)
def translation_cache_lookup(spark, sf_dir):
    r = turn_requests(spark, sf_dir).withColumn(
        "mode", F.when(F.col("turn") % 3 == 0, "translate").when(F.col("turn") % 3 == 1, "explain").otherwise("chat")
    )
    stored = r.where((F.col("mode") == "translate") & (F.col("conv_id") % 2 == 0)).select(
        A.translation_key(F.col("doc_id"), F.col("section_id"), F.col("mode"), F.lit("m1"), F.col("message")).alias("cache_key"),
        F.concat(F.lit("cached "), F.length("message").cast("string")).alias("content"),
    ).dropDuplicates(["cache_key"])
    return plan.explain(r, stored, model="m1").select("request_id", "cache_key", "content", "from_cache")


@query(
    "document_gate",
    f"""SELECT {_TURN}, CASE WHEN d.doc_id IS NULL THEN 'Document not found' WHEN d.doc_id % 3 = 0 THEN 'Document status: chunking' ELSE '' END AS error
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 7 WHERE role = 'user'""",
)
def document_gate(spark, sf_dir):
    r = turn_requests(spark, sf_dir).withColumn("doc_id", (F.col("conv_id") * 7).cast("string"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "chunking").otherwise("ready").alias("status")
    )
    return plan.gate(r, docs).select("request_id", "error")


_RAW = """CASE turn % 4 WHEN 0 THEN '{"passed": false, "issues": ["i' || conv_id || '"], "correction": "fixed ' || turn || '"}'
 WHEN 1 THEN 'Sure: ```json' || chr(10) || '{"passed": true}' || chr(10) || '```' WHEN 2 THEN 'text {"passed": false, "issues": [], "correction": ""} end' ELSE 'not json' END"""


@query(
    "validated_answers",
    f"""SELECT {_TURN}, turn % 4 IN (1, 3) AS passed, CASE WHEN turn % 4 = 0 THEN 'i' || conv_id ELSE '' END AS issues,
 CASE turn % 4 WHEN 0 THEN 'fixed ' || turn WHEN 2 THEN 'second ' || turn ELSE text END AS answer FROM conversations WHERE role = 'user'""",
)
def validated_answers(spark, sf_dir):
    r = user_turns(spark, sf_dir).withColumn("raw", F.expr(_RAW.replace("chr(10)", "'\\n'")))
    c = r.withColumn("check", A.validation(F.col("raw")))
    return c.select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("check.passed").alias("passed"), F.array_join("check.issues", ",").alias("issues"),
        A.revised_answer(F.col("text"), F.col("check"), F.concat(F.lit("second "), F.col("turn").cast("string"))).alias("answer"),
    )


_VIS = """CASE turn % 3 WHEN 0 THEN '{"text": "t' || conv_id || '", "visual_type": "TABLE", "key_observations": ["a", " "], "table_summary": "rows ' || turn || '"}'
 WHEN 1 THEN 'raw words ' || turn ELSE '{"visual_type": "poster", "qa_hint": " h "}' END"""


@query(
    "vision_json",
    f"""SELECT {_TURN}, CASE turn % 3 WHEN 0 THEN 't' || conv_id || chr(10) || 'Visual type: table' || chr(10) || 'Key observations:' || chr(10) || '- a' || chr(10) || 'Table summary: rows ' || turn
  WHEN 1 THEN 'raw words ' || turn ELSE 'Visual type: mixed' || chr(10) || 'QA hint: h' END AS text, CASE turn % 3 WHEN 0 THEN 'table' ELSE 'mixed' END AS visual_type FROM conversations WHERE role = 'user'""",
)
def vision_json(spark, sf_dir):
    r = user_turns(spark, sf_dir).withColumn("v", A.vision_fields(F.expr(_VIS)))
    return r.select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), "v.text", "v.visual_type"
    )


@query(
    "fallback_answers",
    f"""SELECT doc_id, CASE WHEN {Q.strip('text[:300]')} <> '' AND doc_id % 4 > 0 THEN {Q.q(A.NO_MODEL_HEAD)} || {Q.strip('text[:300]')}[:240] || {Q.q(A.NO_MODEL_TAIL)} ELSE {Q.q(A.NO_MODEL_NO_EVIDENCE)} END AS answer FROM documents""",
)
def fallback_answers(spark, sf_dir):
    q = F.when(F.col("doc_id") % 4 > 0, F.left("text", F.lit(300)))
    return table(spark, sf_dir, "documents").select("doc_id", A.fallback_answer(q).alias("answer"))


@query(
    "rule_validation",
    f"""SELECT conv_id, turn, NOT (turn % 2 = 0 OR {Q.strip('text')} = '') AS passed, CASE WHEN turn % 2 = 0 THEN 'Empty translation' ELSE '' END AS issues FROM conversations""",
)
def rule_validation(spark, sf_dir):
    v = A.rule_validation(F.when(F.col("turn") % 2 == 0, " ").otherwise("ok"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", v.alias("v")).select(
        "conv_id", "turn", "v.passed", F.array_join("v.issues", ",").alias("issues")
    )


@query(
    "brief_sources",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lecture' ELSE 'paper' END AS brief_type, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 = 0 THEN 'cached' WHEN doc_id % 5 > 0 THEN 'not_generated'
 WHEN doc_id % 10 = 0 THEN 'llm' ELSE 'unavailable' END AS source FROM documents""",
)
def brief_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "slides_pdf").otherwise("research_paper").alias("doc_subtype"))
    return plan.briefs(
        d, d.where(F.col("doc_id") % 3 == 0).select("doc_id"), d.where(F.col("doc_id") % 10 == 0).select("doc_id"), F.col("doc_id") % 5 == 0
    )


@query(
    "section_cache_key",
    f"""WITH RECURSIVE u AS (SELECT conv_id, turn, text AS s FROM conversations),
h AS (SELECT conv_id, turn, s, 0 AS i, CAST(5381 AS BIGINT) AS v FROM u UNION ALL SELECT conv_id, turn, s, i + 1, xor((v * 33) & 4294967295, CAST(unicode(s[i + 1]) AS BIGINT)) FROM h WHERE i < length(s))
SELECT conv_id, turn, length(s) || ':' || lower(to_base(v, 36)) AS section_hash FROM h WHERE i = length(s)""",
)
def section_cache_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", A.section_hash(F.col("text")).alias("section_hash"))


@query(
    "reading_log_export",
    f"""WITH {EVENTS}, p AS (SELECT doc_id, doc_id || ':' || arg_max(section_id, id) AS pos FROM ev GROUP BY doc_id)
SELECT doc_id, '2024-02-01_' || doc_id || '.md' AS log_name, '---' || chr(10) || 'date: 2024-02-01' || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'position: ' || pos || chr(10) || '---' || chr(10) || chr(10)
 || '# Reading Session — ' || doc_id || chr(10) || chr(10) || '## Session Summary' || chr(10) || 'First reading session.' || chr(10) || chr(10) || '## Position' || chr(10) || pos || chr(10) || chr(10)
 || '## Active Terms' || chr(10) || '- a|||b' || chr(10) AS log_text, '# Glossary — ' || doc_id || chr(10) || chr(10) || '- **a**（b）' || chr(10) AS glossary_text FROM p""",
)
def reading_log_export(spark, sf_dir):
    e = learning_events(spark, sf_dir).withColumn("owner", F.col("doc_id"))
    where = memory.reading_position(e, "owner").withColumnRenamed("owner", "doc_id")
    m = where.withColumn("session_summary", F.lit("")).withColumn("active_glossary", F.array(F.lit("a|||b")))
    return plan.reading_log(m, F.lit("2024-02-01"))
