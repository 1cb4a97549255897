"""Queries over documents as a library to search: lexical, vector, fusion, reranking, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.catalog import sql as Q
from lectern.catalog.inputs import addressed, benchmark_queries, benchmark_requests, flat_chunks, table
from lectern.catalog.registry import Area
from lectern.functions import fixed as X
from lectern.functions import notation
from lectern.functions import text as T
from lectern.operators import evaluate, fusion, lexical, rerank, vector
from lectern.operators.stage import written

AREA = Area()
query = AREA.query

DEPTH = 15  # candidates per request: three times five


# ---------------------------------------------------------------- SQL stages

BENCH = f"""
b AS (SELECT item_id, text AS message, source AS asked, CASE WHEN norm <> '' AND norm <> text THEN text || ' ' || norm ELSE text END AS query
      FROM (SELECT item_id, b.text, source, {Q.normalized('b.text')} AS norm FROM benchmark b JOIN documents ON doc_id = item_id))"""


def scoring(tok: str = "SELECT source AS doc, doc_id AS pos, text, lang AS section FROM documents") -> str:
    """tok, st, po, idf: token lists and corpus statistics per scope ``doc``."""
    return f"""
ch AS ({tok}),
tok AS (SELECT doc, pos, {Q.tokens('text')} AS t FROM ch),
st AS (SELECT doc, count(*) AS n, avg(len(t)) AS a FROM tok GROUP BY doc),
po AS (SELECT doc, pos, l, term, count(*) AS tf FROM (SELECT doc, pos, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT doc, term, ln(n - df + 0.5) - ln(df + 0.5) AS v FROM (SELECT doc, term, count(*) AS df FROM po GROUP BY ALL) JOIN st USING (doc)),
idf AS (SELECT doc, term, CASE WHEN v < 0 THEN 0.25 * m ELSE v END AS w FROM raw JOIN (SELECT doc, avg(v) AS m FROM raw GROUP BY doc) USING (doc)),
wt AS (SELECT po.doc, po.pos, po.term, w * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * l / a)) AS impact
       FROM po JOIN idf ON po.doc = idf.doc AND po.term = idf.term JOIN st ON po.doc = st.doc)"""


QUERY_TERMS = f"""
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({Q.tokens('query')}) AS term FROM b) GROUP BY ALL)"""

SCORES = """
sc AS (SELECT item_id, doc, pos, sum(qtf * impact) AS s, count(*) AS nm FROM wt JOIN qt USING (term) GROUP BY ALL)"""


def ranking(k: int, score: str = "coalesce(s, 0.0)", name: str = "lex") -> str:
    return f"""
{name} AS (SELECT b.item_id, ch.doc, ch.pos, {Q.settle(score)} AS score, coalesce(nm, 0) AS nm,
    row_number() OVER (PARTITION BY b.item_id, ch.doc ORDER BY {Q.settle(score)} DESC, ch.pos) AS rank
  FROM b JOIN ch ON ch.doc = b.asked LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc = ch.doc AND sc.pos = ch.pos
  QUALIFY rank <= {k})"""


FLAT_LEX = f"WITH {BENCH}, {scoring()}, {QUERY_TERMS}, {SCORES}"
OUT = "item_id || '|' || doc AS request_id, pos, score, CAST(rank AS BIGINT) AS rank"


def result(df: DataFrame, *more: str) -> DataFrame:
    return df.select("request_id", "pos", "score", F.col("rank").cast("long").alias("rank"), *more)


# ---------------------------------------------------------------- lexical search


def scoped(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("scope_id", F.col("doc_id"))


def lexical_hits(spark, sf_dir, k: int = DEPTH) -> DataFrame:
    requests = scoped(benchmark_requests(spark, sf_dir, k))
    found = lexical.search(scoped(flat_chunks(spark, sf_dir)), requests, section_boost=False)
    return found.withColumnRenamed("scope_id", "doc_id").withColumn("source", F.lit("bm25"))


@query("bm25_topk_by_source", f"{FLAT_LEX}, {ranking(5)} SELECT {OUT}, nm AS n_matched FROM lex")
def bm25_topk_by_source(spark, sf_dir):
    return result(lexical_hits(spark, sf_dir, 5), "n_matched")


# every item asks the whole library, which is one scope
_LIBRARY = f"""WITH b AS (SELECT item_id, 'all' AS asked, CASE WHEN norm <> '' AND norm <> text THEN text || ' ' || norm ELSE text END AS query
      FROM (SELECT item_id, text, {Q.normalized('text')} AS norm FROM benchmark)),
{scoring("SELECT 'all' AS doc, doc_id AS pos, text, lang AS section FROM documents")}, {QUERY_TERMS}, {SCORES}, {ranking(5)}"""


def library_requests(spark, sf_dir, k: int = 5) -> tuple[DataFrame, DataFrame]:
    chunks = flat_chunks(spark, sf_dir).withColumn("scope_id", F.lit("all"))
    asked = benchmark_queries(spark, sf_dir).select(F.col("query_id").alias("request_id"), F.lit("all").alias("scope_id"), "query", F.lit(k).alias("k"))
    return chunks, asked


@query("bm25_library_pruned", f"{_LIBRARY} SELECT item_id AS request_id, pos, score, CAST(rank AS BIGINT) AS rank, nm AS n_matched FROM lex")
def bm25_library_pruned(spark, sf_dir):
    """Exact search of the whole library that skips the blocks which cannot hold a hit."""
    chunks, asked = library_requests(spark, sf_dir)
    return result(lexical.search(chunks, asked, section_boost=False, width=lexical.BLOCK_WIDTH), "n_matched")


@query(
    "corpus_statistics",
    f"WITH {scoring()} SELECT doc AS source, n AS n_chunks, {Q.settle('a')} AS avg_len, count(*) AS n_terms, {Q.settle('avg(w)')} AS mean_weight, {Q.settle('max(w)')} AS top_weight FROM idf JOIN st USING (doc) GROUP BY ALL",
)
def corpus_statistics(spark, sf_dir):
    tokenized = lexical.tokenize(scoped(flat_chunks(spark, sf_dir)))
    stats = lexical.scope_stats(tokenized)
    weights = lexical.term_weights(tokenized, stats)
    per_scope = weights.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        T.settle(F.avg("idf")).alias("mean_weight"),
        T.settle(F.max("idf")).alias("top_weight"),
    )
    return stats.join(per_scope, "scope_id").select(
        F.col("scope_id").alias("source"), "n_chunks", T.settle(F.col("avg_len")).alias("avg_len"),
        "n_terms", "mean_weight", "top_weight",
    )


@query(
    "overlap_topk",
    f"""WITH {BENCH}, ch AS (SELECT source AS doc, doc_id AS pos, text FROM documents),
po AS (SELECT doc, pos, unnest(list_distinct({Q.tokens('text')})) AS term FROM ch),
qt AS (SELECT item_id, unnest(list_distinct({Q.tokens('query')})) AS term FROM b),
sc AS (SELECT item_id, doc, pos, CAST(count(*) AS DOUBLE) AS s, count(*) AS nm FROM po JOIN qt USING (term) GROUP BY ALL),
{ranking(5)} SELECT {OUT} FROM lex""",
)
def overlap_topk(spark, sf_dir):
    found = lexical.search(
        scoped(flat_chunks(spark, sf_dir)), scoped(benchmark_requests(spark, sf_dir)), scoring="overlap", section_boost=False
    )
    return result(found)


_WANTING = f"""
b AS (SELECT item_id, b.text AS message, source AS asked, array_to_string(list_sort({Q.tokens('b.text')}), ' ') AS query,
  CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE '' END AS wanted FROM benchmark b JOIN documents ON doc_id = item_id)"""


def section_requests(spark, sf_dir, k: int = 5) -> DataFrame:
    """Requests that name a section, their words in order."""
    at = F.col("query_id") % 4
    q = benchmark_queries(spark, sf_dir).withColumn("query", F.array_join(F.array_sort(T.tokens(F.col("message"))), " "))
    q = q.withColumn("section_id", F.when(at == 0, "en").when(at == 1, "fr").when(at == 2, "de").otherwise(""))
    return scoped(addressed(q, spark, sf_dir)).withColumn("k", F.lit(k))


_BOOSTED = "coalesce(s, 0.0) + CASE WHEN b.wanted = ch.section THEN 2.0 ELSE 0.0 END"


@query(
    "bm25_section_boost",
    f"WITH {_WANTING}, {scoring()}, {QUERY_TERMS}, {SCORES}, {ranking(5, _BOOSTED)} SELECT {OUT} FROM lex",
)
def bm25_section_boost(spark, sf_dir):
    return result(lexical.search(scoped(flat_chunks(spark, sf_dir)), section_requests(spark, sf_dir)))


@query(
    "bm25_section_only",
    f"""WITH {BENCH}, wanted AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'missing' END AS section FROM benchmark),
scopes AS (SELECT DISTINCT source, lang FROM documents),
{scoring('''SELECT d.source || chr(1) || d.lang AS doc, doc_id AS pos, text FROM documents d
            UNION ALL SELECT source, doc_id, text FROM documents''')},
{QUERY_TERMS}, {SCORES},
rq AS (SELECT w.item_id, s.source, CASE WHEN sc2.lang IS NULL THEN s.source ELSE s.source || chr(1) || w.section END AS scope
  FROM wanted w JOIN documents s ON s.doc_id = w.item_id LEFT JOIN scopes sc2 ON sc2.source = s.source AND sc2.lang = w.section),
x AS (SELECT rq.item_id || '|' || rq.source AS request_id, ch.pos, {Q.settle('coalesce(s, 0.0)')} AS score
  FROM rq JOIN ch ON ch.doc = rq.scope LEFT JOIN sc ON sc.item_id = rq.item_id AND sc.doc = rq.scope AND sc.pos = ch.pos)
SELECT request_id, pos, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rank FROM x QUALIFY rank <= 5""",
)
def bm25_section_only(spark, sf_dir):
    at = F.col("query_id") % 3
    requests = benchmark_requests(spark, sf_dir).withColumn(
        "section_id", F.when(at == 0, "en").when(at == 1, "es").otherwise("missing")
    ).withColumn("section_only", F.lit(True))
    resolved, rows = lexical.scope_chunks(flat_chunks(spark, sf_dir), requests)
    return result(lexical.search(rows, resolved, section_boost=False))


_CORE = f"len(list_filter(list_distinct({Q.tokens('b.query')}), lambda t: NOT list_contains({Q.listing(X.QUERY_STOPWORDS)}, t)))"
_CORE_LIST = f"list_filter(list_distinct({Q.tokens('b.query')}), lambda t: NOT list_contains({Q.listing(X.QUERY_STOPWORDS)}, t))"


@query(
    "courseware_adjust",
    f"""WITH {_WANTING}, {scoring()}, {QUERY_TERMS}, {SCORES},
x AS (SELECT b.item_id, ch.doc, ch.pos, {_BOOSTED} AS s0, {_CORE_LIST} AS core, {Q.tokens('ch.text')} AS tt,
   {Q.tokens("array_to_string(string_split(ch.text, chr(10))[1:3], chr(10))")} AS head, ch.pos % 4 = 0 AS slide, ch.pos % 3 = 0 AS formula
  FROM b JOIN ch ON ch.doc = b.asked LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc = ch.doc AND sc.pos = ch.pos),
y AS (SELECT *, len(list_intersect(core, tt)) AS o, len(list_intersect(core, head)) AS h FROM x),
z AS (SELECT item_id, doc, pos, {Q.settle("CASE WHEN NOT slide OR len(core) = 0 THEN s0 WHEN o = 0 THEN s0 * 0.35 ELSE s0 + o * 0.5 + h * 1.5 + CASE WHEN formula THEN least(2.0, o * 0.35) ELSE 0.0 END END")} AS score FROM y)
SELECT item_id || '|' || doc AS request_id, pos, score, row_number() OVER (PARTITION BY item_id, doc ORDER BY score DESC, pos) AS rank FROM z QUALIFY rank <= 5""",
)
def courseware_adjust(spark, sf_dir):
    return result(lexical.search(scoped(flat_chunks(spark, sf_dir)), section_requests(spark, sf_dir), slides=True))


_VARIANTS = f"""
v AS (SELECT item_id, 0 AS no, text AS variant FROM benchmark
  UNION ALL SELECT item_id, 1, split_part(text, '.', 1) FROM benchmark
  UNION ALL SELECT item_id, 2, array_to_string(string_split(text, ' ')[1:8], ' ') FROM benchmark),
b AS (SELECT item_id * 10 + no AS item_id, item_id AS qid, no, variant, source AS asked, CASE WHEN norm <> '' AND norm <> variant THEN variant || ' ' || norm ELSE variant END AS query
  FROM (SELECT v.*, source, {Q.normalized('variant')} AS norm FROM v JOIN documents ON doc_id = item_id))"""


@query(
    "bm25_multi_variant",
    f"""WITH {_VARIANTS}, {scoring()}, {QUERY_TERMS}, {SCORES}, {ranking(5)},
x AS (SELECT qid, no, lex.doc, lex.pos, rank, CASE WHEN score <= 0 AND len(list_intersect({Q.tokens('variant')}, {Q.tokens('ch.text')})) > 0
   THEN len(list_intersect({Q.tokens('variant')}, {Q.tokens('ch.text')})) ELSE score END AS score FROM lex JOIN b ON lex.item_id = b.item_id JOIN ch ON ch.pos = lex.pos),
y AS (SELECT qid, doc, pos, max(score) AS score, min(no * 1000 + rank) AS seen FROM x GROUP BY ALL)
SELECT qid || '|' || doc AS request_id, pos, score, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, seen) AS rank FROM y QUALIFY rank <= 5""",
)
def bm25_multi_variant(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    wording = b.select(
        F.col("item_id").alias("query_no"),
        F.posexplode(
            F.array(F.col("text"), F.split_part("text", F.lit("."), F.lit(1)), F.array_join(F.slice(F.split("text", " "), 1, 8), " "))
        ).alias("variant_no", "variant"),
    )
    wording = wording.withColumn("query", T.expanded_query(F.col("variant"), notation.normalize(F.col("variant"))))
    asked = scoped(addressed(wording.withColumnRenamed("query_no", "query_id"), spark, sf_dir))
    asked = asked.drop("query_id").withColumnRenamed("request_id", "query_id").withColumn("k", F.lit(5)).withColumn(
        "section_id", F.lit("")
    )
    found = lexical.search_variants(scoped(flat_chunks(spark, sf_dir)), asked)
    return result(found.withColumnRenamed("query_id", "request_id"))


# ---------------------------------------------------------------- vectors

VECTORS = f"""
ve AS (SELECT d.source AS doc, e.vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
qe AS (SELECT item_id, source AS asked, CAST(embedding AS DOUBLE[]) AS qv FROM benchmark JOIN embeddings ON vec_id = item_id JOIN documents ON doc_id = item_id),
vec AS (SELECT item_id, doc, pos, {Q.settle('greatest(0.0, list_cosine_similarity(qv, v))')} AS score,
  row_number() OVER (PARTITION BY item_id, doc ORDER BY {Q.settle('greatest(0.0, list_cosine_similarity(qv, v))')} DESC, pos) AS rank
  FROM qe JOIN ve ON ve.doc = qe.asked QUALIFY rank <= {DEPTH})"""


def vector_hits(spark, sf_dir, k: int = DEPTH) -> DataFrame:
    """A chunk's vector is the embedding of its number; a request's is that of its item."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("scope_id"), "doc_id")
    stored = d.join(e, F.col("doc_id") == F.col("vec_id")).select("scope_id", F.col("doc_id").alias("pos"), "embedding")
    asked = benchmark_requests(spark, sf_dir, k).join(e, F.col("query_id") == F.col("vec_id")).select(
        "request_id", F.col("doc_id").alias("scope_id"), "embedding", "k"
    )
    return vector.nearest(stored, asked).withColumnRenamed("scope_id", "doc_id").withColumn("source", F.lit("vector"))


@query("vector_topk", f"WITH {VECTORS} SELECT {OUT} FROM vec")
def vector_topk(spark, sf_dir):
    return result(vector_hits(spark, sf_dir))


@query(
    "vector_library_cells",
    f"""WITH ve AS (SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qe AS (SELECT pos AS q, v AS qv FROM ve WHERE pos % 20 = 0),
vec AS (SELECT q, pos, {Q.settle('greatest(0.0, list_cosine_similarity(qv, v))')} AS score FROM qe JOIN ve ON true)
SELECT CAST(q AS VARCHAR) AS request_id, pos, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM vec QUALIFY rank <= 8""",
)
def vector_library_cells(spark, sf_dir):
    """Every twentieth vector asks the whole library; cells that cannot hold a neighbour are skipped."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("scope_id"), F.col("vec_id").alias("pos"), "embedding")
    asked = e.where("pos % 20 = 0").select(F.col("pos").cast("string").alias("request_id"), "scope_id", "embedding", F.lit(8).alias("k"))
    return result(vector.nearest_in_cells(vector.in_cells(e), asked)[0])


@query(
    "vector_metadata_roundtrip",
    f"""SELECT doc_id, text, source AS section_id, CASE WHEN n_chars % 2 = 0 THEN CAST(n_chars % 50 AS INTEGER) END AS page_start,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_refs, 'L2' AS layer, 0.5 AS difficulty_score FROM documents""",
)
def vector_metadata_roundtrip(spark, sf_dir):
    """Flattening metadata for a vector store and restoring it keeps every field."""
    none = F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents")
    meta = F.struct(
        F.col("source").alias("section_id"), F.lit("prose").alias("section_type"),
        F.when(F.col("n_chars") % 2 == 0, (F.col("n_chars") % 50).cast("int")).alias("page_start"),
        F.lit(None).cast("int").alias("page_end"), F.lit("").alias("chapter"), F.lit(0.5).alias("difficulty_score"),
        F.lit(False).alias("has_formula"), none.alias("formula_ids"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Figure 1"))).otherwise(none).alias("cross_refs"),
        F.lit("text").alias("content_type"), F.lit("").alias("caption"), none.alias("referenced_by"),
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("contextual_prefix"),
        F.lit("parser").alias("content_source"), F.lit(False).alias("enhanced"),
    )
    chunks = d.select("doc_id", F.lit(0).alias("pos"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit("L2").alias("layer"), meta.alias("metadata"))
    back = vector.restore_metadata(vector.flatten_metadata(chunks))
    return back.select(
        "doc_id", "text", "metadata.section_id", "metadata.page_start", F.size("metadata.cross_refs").cast("long").alias("n_refs"),
        "layer", "metadata.difficulty_score",
    )


# ---------------------------------------------------------------- fusion

FACT = r"len(regexp_extract_all(d.text, '[0-9]+\.?[0-9]*')) >= 2"

LISTS = f"{FLAT_LEX}, {ranking(DEPTH)}, {VECTORS}"

HYBRID = f"""{LISTS},
bv AS (SELECT item_id, doc, pos, s AS score, row_number() OVER (PARTITION BY item_id, doc ORDER BY s DESC, rank) AS rank
  FROM (SELECT item_id, doc, pos, rank, CASE WHEN {FACT} THEN score * 1.3 ELSE score END AS s FROM vec JOIN documents d ON d.doc_id = vec.pos)),
sg AS (SELECT item_id, doc, least(max(score) / 5.0, 1.0) AS signal FROM lex GROUP BY ALL),
ls AS (SELECT lex.item_id, lex.doc, lex.pos, lex.rank, 0 AS no, signal AS w FROM lex JOIN sg USING (item_id, doc) JOIN (SELECT DISTINCT item_id, doc FROM bv) USING (item_id, doc) WHERE signal >= 0.05
  UNION ALL SELECT bv.item_id, bv.doc, bv.pos, bv.rank, 1, 1.0 FROM bv JOIN sg USING (item_id, doc) WHERE signal >= 0.05),
fu AS (SELECT item_id, doc, pos, sum(w / (60 + rank)) AS score, min(no * 100000 + rank) AS seen FROM ls WHERE w > 0.001 GROUP BY ALL),
hy AS (SELECT item_id, doc, pos, score, row_number() OVER (PARTITION BY item_id, doc ORDER BY {Q.settle('score', 12)} DESC, seen) AS rank, 'rrf_fused' AS source FROM fu QUALIFY rank <= {DEPTH}
  UNION ALL SELECT bv.item_id, bv.doc, bv.pos, bv.score, rank, 'vector' FROM bv JOIN sg USING (item_id, doc) WHERE signal < 0.05
  UNION ALL SELECT lex.item_id, lex.doc, lex.pos, lex.score, lex.rank, 'bm25' FROM lex LEFT JOIN (SELECT DISTINCT item_id, doc FROM bv) hv USING (item_id, doc) WHERE hv.item_id IS NULL)"""


def with_content(df: DataFrame, spark, sf_dir, *cols: str) -> DataFrame:
    return df.join(flat_chunks(spark, sf_dir).select("doc_id", "pos", *cols), ["doc_id", "pos"])


@query(
    "rrf_fuse",
    f"""{LISTS}, ls AS (SELECT item_id, doc, pos, rank, 0 AS no FROM lex UNION ALL SELECT item_id, doc, pos, rank, 1 FROM vec),
fu AS (SELECT item_id, doc, pos, sum(1.0 / (60 + rank)) AS s, min(no * 100000 + rank) AS seen FROM ls GROUP BY ALL)
SELECT item_id || '|' || doc AS request_id, pos, {Q.settle('s', 9)} AS score, row_number() OVER (PARTITION BY item_id, doc ORDER BY {Q.settle('s', 12)} DESC, seen) AS rank FROM fu""",
)
def rrf_fuse(spark, sf_dir):
    one = lambda df, no: df.select("request_id", "pos", "rank", F.lit(no).alias("list_no"), F.lit(1.0).alias("weight"))
    fused = fusion.fuse(one(lexical_hits(spark, sf_dir), 0).unionByName(one(vector_hits(spark, sf_dir), 1)))
    return result(fused.withColumn("score", T.settle(F.col("score"), 9)))


@query(
    "weighted_rrf",
    f"""{LISTS}, ls AS (SELECT item_id, doc, pos, rank, 0 AS no, (item_id % 5) * 0.25 AS w FROM lex UNION ALL SELECT item_id, doc, pos, rank, 1, 1.0 FROM vec),
fu AS (SELECT item_id, doc, pos, sum(w / (60 + rank)) AS s, min(no * 100000 + rank) AS seen FROM ls WHERE w > 0.001 GROUP BY ALL)
SELECT item_id || '|' || doc AS request_id, pos, {Q.settle('s', 9)} AS score, row_number() OVER (PARTITION BY item_id, doc ORDER BY {Q.settle('s', 12)} DESC, seen) AS rank FROM fu""",
)
def weighted_rrf(spark, sf_dir):
    weight = (F.split_part("request_id", F.lit("|"), F.lit(1)).cast("int") % 5) * 0.25
    lex = lexical_hits(spark, sf_dir).select("request_id", "pos", "rank", F.lit(0).alias("list_no"), weight.alias("weight"))
    vec = vector_hits(spark, sf_dir).select("request_id", "pos", "rank", F.lit(1).alias("list_no"), F.lit(1.0).alias("weight"))
    return result(fusion.fuse(lex.unionByName(vec)).withColumn("score", T.settle(F.col("score"), 9)))


@query(
    "lexical_signal",
    f"{FLAT_LEX}, {ranking(5)} SELECT item_id || '|' || doc AS request_id, least(max(score) / 5.0, 1.0) AS signal FROM lex GROUP BY ALL",
)
def lexical_signal(spark, sf_dir):
    return fusion.lexical_signal(lexical_hits(spark, sf_dir, 5))


def hybrid_hits(spark, sf_dir) -> DataFrame:
    requests = benchmark_requests(spark, sf_dir, DEPTH)
    vec = with_content(vector_hits(spark, sf_dir), spark, sf_dir, "content_type")
    return fusion.hybrid(lexical_hits(spark, sf_dir), vec, requests).join(
        requests.select("request_id", "doc_id", "query_id", "message"), "request_id"
    )


@query("hybrid_search", f"{HYBRID} SELECT item_id || '|' || doc AS request_id, pos, {Q.settle('score', 9)} AS score, CAST(rank AS BIGINT) AS rank, source FROM hy")
def hybrid_search(spark, sf_dir):
    return result(hybrid_hits(spark, sf_dir).withColumn("score", T.settle(F.col("score"), 9)), "source")


BOOST = f"""{HYBRID},
hn AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END AS cur, coalesce({Q.tokens('text')}[5], '') AS c1,
   coalesce({Q.tokens('text')}[1], '') || ' ' || coalesce({Q.tokens('text')}[2], '') AS c2 FROM benchmark),
bo1 AS (SELECT hy.*, d.text, d.lang, CASE WHEN cur <> '' AND cur = d.lang THEN hy.score * 1.25 + 2.0 ELSE hy.score END AS s1,
   (len({Q.tokens('c1')}) > 0 AND list_has_all({Q.tokens('d.text')}, {Q.tokens('c1')})) OR (c1 <> '' AND contains(lower(d.text), c1))
   OR (len({Q.tokens('c2')}) > 0 AND list_has_all({Q.tokens('d.text')}, {Q.tokens('c2')})) OR contains(lower(d.text), c2) AS known
  FROM hy JOIN hn USING (item_id) JOIN documents d ON d.doc_id = hy.pos),
bo AS (SELECT item_id, doc, pos, text, lang, CASE WHEN known THEN s1 * 1.2 + 2.0 ELSE s1 END AS score, rank AS old FROM bo1),
mb AS (SELECT item_id, doc, pos, text, lang, score, row_number() OVER (PARTITION BY item_id, doc ORDER BY score DESC, old) AS rank FROM bo)"""


def memory_hints(spark, sf_dir) -> DataFrame:
    at = F.col("query_id") % 3
    words = T.tokens(F.col("message"))
    word = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    return benchmark_requests(spark, sf_dir).select(
        "request_id",
        F.when(at == 0, "en").when(at == 1, "fr").otherwise("").alias("current_section_id"),
        F.array(word(5), F.concat(word(1), F.lit(" "), word(2))).alias("concepts"),
    )


def boosted_hits(spark, sf_dir) -> DataFrame:
    hits = with_content(
        hybrid_hits(spark, sf_dir), spark, sf_dir,
        "chunk_id", "text", "section_id", "section_type", "difficulty_score", "content_type", "page_start",
    )
    return fusion.memory_boost(hits, memory_hints(spark, sf_dir))


@query("memory_boost", f"{BOOST} SELECT item_id || '|' || doc AS request_id, pos, {Q.settle('score')} AS score, CAST(rank AS BIGINT) AS rank FROM mb")
def memory_boost(spark, sf_dir):
    return result(boosted_hits(spark, sf_dir).withColumn("score", T.settle(F.col("score"))))


# ---------------------------------------------------------------- reranking

_KIND = "CASE pos % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'results' WHEN 2 THEN 'prose' WHEN 3 THEN 'citation_context' ELSE 'references' END"
_WEIGHT = "CASE pos % 5 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 ELSE 0.3 END"
_NUMS = r"len(regexp_extract_all(text, '[0-9]+\.?[0-9]*'))"

RULES = f"""{BOOST},
r1 AS (SELECT *, score * {_WEIGHT} AS a1, abs(CASE WHEN length(text) < 1000 THEN 0.3 WHEN length(text) < 3000 THEN 0.5 ELSE 0.8 END
   - CASE item_id % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 ELSE 0.5 END) * 0.5 AS pen FROM mb),
r2 AS (SELECT *, CASE WHEN pos % 6 = 0 THEN a1 * (1.0 - pen) * 1.05 ELSE a1 * (1.0 - pen) END AS a2 FROM r1),
r3 AS (SELECT *, CASE WHEN item_id % 2 = 0 AND {_NUMS} >= 2 THEN a2 * 1.2 + 0.05 ELSE a2 END AS a3 FROM r2),
r4 AS (SELECT *, CASE WHEN item_id % 2 = 0 AND {_NUMS} >= 2 THEN a3 * 1.3 + 0.1 ELSE a3 END AS a4 FROM r3),
rr AS (SELECT item_id, doc, pos, text, lang, a4 AS score, row_number() OVER (PARTITION BY item_id, doc ORDER BY {Q.settle('a4', 9)} DESC, rank) AS rank FROM r4)"""


def rule_hits(spark, sf_dir) -> DataFrame:
    level = F.element_at(
        F.array(*[F.lit(v) for v in ("beginner", "intermediate", "advanced", "unknown")]), (F.col("query_id") % 4 + 1).cast("int")
    )
    asked = (
        boosted_hits(spark, sf_dir)
        .withColumn("student_level", level)
        .withColumn("message", F.when(F.col("query_id") % 2 == 0, F.concat("message", F.lit(" accuracy"))).otherwise(F.col("message")))
        .withColumn("cross_refs", F.when(F.col("pos") % 6 == 0, F.array(F.lit("Figure 1"))).otherwise(F.array().cast("array<string>")))
    )
    return rerank.rule_rerank(asked)


@query("rule_rerank", f"{RULES} SELECT item_id || '|' || doc AS request_id, pos, {Q.settle('score')} AS score, CAST(rank AS BIGINT) AS rank FROM rr")
def rule_rerank(spark, sf_dir):
    return result(rule_hits(spark, sf_dir).withColumn("score", T.settle(F.col("score"))))


@query(
    "model_rerank",
    f"""{FLAT_LEX}, {ranking(5)}, m AS (SELECT lex.*, CASE WHEN pos % 7 = 0 THEN NULL ELSE length(d.text[:1500]) / 1500.0 END AS ms FROM lex JOIN documents d ON d.doc_id = lex.pos)
SELECT item_id || '|' || doc AS request_id, pos, coalesce(ms, score) AS score, CASE WHEN ms IS NULL THEN 'bm25' ELSE 'model_reranked' END AS source,
  row_number() OVER (PARTITION BY item_id, doc ORDER BY ms DESC NULLS LAST, rank) AS rank FROM m""",
)
def model_rerank(spark, sf_dir):
    """A stand-in model: the share of 1500 characters a text fills, silent on some chunks."""
    hits = with_content(lexical_hits(spark, sf_dir, 5), spark, sf_dir, "text").withColumn("message", F.col("pos").cast("string"))
    scored = rerank.model_rerank(hits, lambda q, t: F.when(q.cast("long") % 7 != 0, F.length(t) / 1500.0))
    return result(scored, "source")


# one list for several items, and so over several documents, so that the cap and the diversity step have work to do
LISTS_POOLED = 6
POOL = f"""{FLAT_LEX}, {ranking(DEPTH)},
several AS (SELECT item_id % {LISTS_POOLED} AS item_id, doc, pos, lang, max(score) AS score FROM lex JOIN documents d ON d.doc_id = lex.pos GROUP BY ALL),
pool AS (SELECT item_id, doc, pos, lang, {Q.settle('score / 100', 9)} AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS rank FROM several),
cap AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY item_id, doc ORDER BY rank) <= 3)"""


def pooled_hits(spark, sf_dir) -> DataFrame:
    from lectern.operators.ranking import ranked

    hits = with_content(lexical_hits(spark, sf_dir), spark, sf_dir, "chunk_id", "section_id")
    group = (F.split_part("request_id", F.lit("|"), F.lit(1)).cast("long") % LISTS_POOLED).cast("string")
    pool = hits.withColumn("request_id", group).groupBy("request_id", "doc_id", "pos", "chunk_id", "section_id").agg(F.max("score").alias("score"))
    pool = ranked(pool, ["request_id"], [F.col("score").desc(), F.col("pos")])
    return pool.withColumn("score", T.settle(F.col("score") / 100, 9))


@query("diversity_cap", f"{POOL} SELECT CAST(item_id AS VARCHAR) AS request_id, pos, score, CAST(rank AS BIGINT) AS rank FROM cap")
def diversity_cap(spark, sf_dir):
    return result(rerank.diversity_cap(pooled_hits(spark, sf_dir)))


@query(
    "diversify_only",
    f"{POOL} SELECT CAST(item_id AS VARCHAR) AS request_id, pos, score, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM cap QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) <= 20",
)
def diversify_only(spark, sf_dir):
    return result(rerank.cap_only(pooled_hits(spark, sf_dir), 20))


@query(
    "mmr_rerank",
    POOL.replace("WITH", "WITH RECURSIVE", 1)
    + f""",
capm AS MATERIALIZED (SELECT * FROM cap),
sel AS (
  SELECT item_id, 0 AS step, CAST([] AS BIGINT[]) AS picked, CAST([] AS VARCHAR[]) AS docs, CAST([] AS VARCHAR[]) AS secs, CAST(-1 AS BIGINT) AS pos, 0.0 AS score FROM (SELECT DISTINCT item_id FROM capm)
  UNION ALL
  SELECT item_id, step, picked, docs, secs, pos, score FROM (
    SELECT s.item_id, s.step + 1 AS step, list_append(s.picked, c.pos) AS picked, list_append(s.docs, c.doc) AS docs, list_append(s.secs, c.lang) AS secs, c.pos, c.score,
      row_number() OVER (PARTITION BY s.item_id ORDER BY floor((0.7 * c.score - (1.0 - 0.7) * (0.3 * len(list_filter(s.docs, lambda d: d = c.doc)) + 0.1 * len(list_filter(s.secs, lambda d: d = c.lang)))) * 1e9 + 0.5) DESC, c.rank) AS rn
    FROM sel s JOIN capm c ON c.item_id = s.item_id WHERE NOT list_contains(s.picked, c.pos)) WHERE rn = 1
)
SELECT CAST(item_id AS VARCHAR) AS request_id, pos, score, CAST(step AS BIGINT) AS rank FROM sel WHERE step > 0""",
)
def mmr_rerank(spark, sf_dir):
    return result(rerank.diversify(pooled_hits(spark, sf_dir)))


# ---------------------------------------------------------------- evidence and metrics


def top_hits(spark, sf_dir, k: int) -> DataFrame:
    return with_content(
        lexical_hits(spark, sf_dir, k), spark, sf_dir, "chunk_id", "text", "section_id", "page_start", "has_formula"
    ).withColumn("formula_ids", F.array().cast("array<string>"))


@query(
    "evidence",
    f"""{FLAT_LEX}, {ranking(5)} SELECT item_id || '|' || doc AS request_id, doc AS doc_id, d.lang AS section_id, CAST(pos % 97 AS INTEGER) AS page, CAST(pos AS VARCHAR) AS chunk_id,
  d.text[:300] AS quote, {Q.exact('score', 3)} AS score, CAST(rank AS BIGINT) AS citation, pos % 3 = 0 AS has_formula FROM lex JOIN documents d ON d.doc_id = lex.pos""",
)
def evidence(spark, sf_dir):
    from lectern.plans.retrieval import evidence as project

    requests = benchmark_requests(spark, sf_dir).withColumn("top_k", F.lit(5))
    rows = project(top_hits(spark, sf_dir, 5), requests)
    return rows.drop("formula_ids").withColumn("citation", F.col("citation").cast("long"))


@query(
    "retrieval_trace",
    f"""{FLAT_LEX}, {ranking(5)}, {VECTORS}, a AS (SELECT 'bm25' AS stage, item_id, doc, pos, score, rank FROM lex UNION ALL SELECT 'vector', item_id, doc, pos, score, rank FROM vec WHERE rank <= 5)
SELECT stage, item_id || '|' || doc AS request_id, CAST(pos AS VARCHAR) AS chunk_id, CAST(rank AS BIGINT) AS rank, {Q.exact('score', 6)} AS score, CASE stage WHEN 'bm25' THEN 'bm25' ELSE 'vector' END AS source,
  d.lang AS section_id, CAST(pos % 97 AS INTEGER) AS page_start, d.text[:240] AS text_preview FROM a JOIN documents d ON d.doc_id = a.pos""",
)
def retrieval_trace(spark, sf_dir):
    need = ("chunk_id", "text", "section_id", "page_start")
    stages = {
        "bm25": with_content(lexical_hits(spark, sf_dir, 5), spark, sf_dir, *need),
        "vector": with_content(vector_hits(spark, sf_dir, 5), spark, sf_dir, *need),
    }
    return evaluate.trace(stages).withColumn("rank", F.col("rank").cast("long"))


_CASES = f"""{FLAT_LEX}, {ranking(10)},
it AS (SELECT item_id, doc, rank, d.lang, lower({Q.squeeze('d.text')}) AS body, CAST(pos AS VARCHAR) AS cid, pos % 97 AS page FROM lex JOIN documents d ON d.doc_id = lex.pos),
tg AS (SELECT item_id, 1 AS no, lower({Q.squeeze('text')}) AS term, NULL AS lang, NULL AS page, NULL AS cid FROM benchmark
  UNION ALL SELECT item_id, 2, NULL, 'fr', NULL, NULL FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT item_id, 3, NULL, NULL, item_id % 97, CAST(item_id AS VARCHAR) FROM benchmark WHERE item_id % 3 = 0),
mt AS (SELECT it.item_id, it.doc, it.rank, tg.no FROM it JOIN tg ON it.item_id = tg.item_id
  WHERE coalesce(contains(it.body, tg.term), false) OR coalesce(it.lang = tg.lang, false) OR coalesce(it.page = tg.page, false) OR coalesce(it.cid = tg.cid, false)),
cs AS (SELECT item_id, asked AS doc FROM b),
ms AS (SELECT cs.item_id, cs.doc, (SELECT count(*) FROM tg WHERE tg.item_id = cs.item_id) AS nt, min(mt.rank) FILTER (mt.rank <= 5) AS er,
   count(DISTINCT mt.no) FILTER (mt.rank <= 5) AS em, count(DISTINCT mt.no) AS cm FROM cs LEFT JOIN mt ON mt.item_id = cs.item_id AND mt.doc = cs.doc GROUP BY ALL),
mx AS (SELECT item_id || '|' || doc AS case_id, CASE WHEN er IS NULL THEN 0.0 ELSE 1.0 END AS hit_at_k, CASE WHEN cm > 0 THEN 1.0 ELSE 0.0 END AS context_hit_at_k,
  coalesce({Q.exact('1.0 / er', 3)}, 0.0) AS mrr_at_k, {Q.exact('em / nt', 3)} AS recall_at_k, {Q.exact('cm / nt', 3)} AS context_recall_at_k, CAST(er AS BIGINT) AS evidence_rank, 0.0 AS empty_retrieval FROM ms)"""


def case_metrics(spark, sf_dir) -> DataFrame:
    hits = written(top_hits(spark, sf_dir, 10), "case-hits").withColumnRenamed("request_id", "case_id")
    cases = benchmark_requests(spark, sf_dir).withColumnRenamed("request_id", "case_id")
    none = lambda t: F.array().cast(f"array<{t}>")
    item = F.col("query_id")

    def target(no, chunk_ids=None, section_ids=None, pages=None, terms=None):
        return F.struct(
            F.lit(no).alias("target_no"),
            (chunk_ids if chunk_ids is not None else none("string")).alias("chunk_ids"),
            (section_ids if section_ids is not None else none("string")).alias("section_ids"),
            (pages if pages is not None else none("int")).alias("pages"),
            (terms if terms is not None else none("string")).alias("terms"),
        )

    wanted = F.array_compact(
        F.array(
            target(1, terms=F.array("message")),
            F.when(item % 2 == 0, target(2, section_ids=F.array(F.lit("fr")))),
            F.when(item % 3 == 0, target(3, chunk_ids=F.array(item.cast("string")), pages=F.array((item % 97).cast("int")))),
        )
    )
    targets = cases.select("case_id", F.inline(wanted))
    return evaluate.case_metrics(cases, targets, hits.where(F.col("rank") <= 5), hits)


@query("retrieval_metrics_cases", f"{_CASES} SELECT * FROM mx")
def retrieval_metrics_cases(spark, sf_dir):
    return case_metrics(spark, sf_dir).withColumn("evidence_rank", F.col("evidence_rank").cast("long"))


@query(
    "retrieval_metrics",
    f"""{_CASES} SELECT count(*) AS num_cases, {Q.exact(Q.settle('avg(hit_at_k)', 9), 3)} AS hit_at_k, {Q.exact(Q.settle('avg(context_hit_at_k)', 9), 3)} AS context_hit_at_k,
  {Q.exact(Q.settle('avg(mrr_at_k)', 9), 3)} AS mrr_at_k, {Q.exact(Q.settle('avg(recall_at_k)', 9), 3)} AS recall_at_k,
  {Q.exact(Q.settle('avg(context_recall_at_k)', 9), 3)} AS context_recall_at_k, {Q.exact(Q.settle('avg(empty_retrieval)', 9), 3)} AS empty_retrieval_rate FROM mx""",
)
def retrieval_metrics(spark, sf_dir):
    return evaluate.summary(case_metrics(spark, sf_dir))


# ---------------------------------------------------------------- the whole path, both searches

# a chunk without a score that shares words with the message scores their number
_SHARED = f"""lex AS (SELECT item_id, doc, pos, nm, score, row_number() OVER (PARTITION BY item_id, doc ORDER BY score DESC, seen) AS rank FROM
  (SELECT lex0.item_id, doc, pos, nm, rank AS seen, CASE WHEN score <= 0 AND shared > 0 THEN shared ELSE score END AS score FROM
    (SELECT lex0.*, len(list_intersect({Q.tokens('message')}, {Q.tokens('d.text')})) AS shared FROM lex0 JOIN b USING (item_id) JOIN documents d ON d.doc_id = lex0.pos) lex0))"""
HYBRID_PATH = (
    BOOST.replace("WITH", "WITH RECURSIVE", 1).replace(ranking(DEPTH), ranking(20, name="lex0") + ", " + _SHARED).replace(f"rank <= {DEPTH}", "rank <= 20")
    + f""",
ra AS (SELECT *, score * {_WEIGHT} * (1.0 - abs(CASE WHEN length(text) < 1000 THEN 0.3 WHEN length(text) < 3000 THEN 0.5 ELSE 0.8 END - 0.5) * 0.5) AS a FROM mb),
rr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {Q.settle('a', 9)} DESC, rank) AS r2 FROM ra),
capm AS MATERIALIZED (SELECT * FROM rr WHERE r2 <= 3),
sel AS (
  SELECT item_id, doc, 0 AS step, CAST([] AS BIGINT[]) AS picked, CAST([] AS VARCHAR[]) AS secs, CAST(-1 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS score FROM (SELECT DISTINCT item_id, doc FROM capm)
  UNION ALL
  SELECT item_id, doc, step, picked, secs, pos, score FROM (
    SELECT s.item_id, s.doc, s.step + 1 AS step, list_append(s.picked, c.pos) AS picked, list_append(s.secs, c.lang) AS secs, c.pos, c.a AS score,
      row_number() OVER (PARTITION BY s.item_id ORDER BY floor((0.7 * c.a - (1.0 - 0.7) * (0.3 * len(s.picked) + 0.1 * len(list_filter(s.secs, lambda d: d = c.lang)))) * 1e9 + 0.5) DESC, c.r2) AS rn
    FROM sel s JOIN capm c ON c.item_id = s.item_id WHERE NOT list_contains(s.picked, c.pos)) WHERE rn = 1
)
SELECT item_id || '|' || doc AS request_id, pos, {Q.settle('score')} AS score, CAST(step AS BIGINT) AS rank FROM sel WHERE step > 0"""
)


@query("retrieve_hybrid", HYBRID_PATH)
def retrieve_hybrid(spark, sf_dir):
    """Wording, lexical and vector search, fusion, memory boost, rules, cap and diversity through the plan."""
    from lectern.plans.retrieval import retrieve

    none = F.array().cast("array<string>")
    chunks = flat_chunks(spark, sf_dir)
    for name in ("formula_ids", "cross_refs", "referenced_by"):
        chunks = chunks.withColumn(name, none)
    chunks = chunks.withColumn("caption", F.lit("")).withColumn("contextual_prefix", F.lit(""))
    requests = benchmark_requests(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    stored = chunks.select("doc_id", "pos").join(e, F.col("pos") == F.col("vec_id")).select("doc_id", "pos", "embedding")
    asked = requests.join(e, F.col("query_id") == F.col("vec_id")).select("request_id", "embedding")
    got = retrieve(
        chunks, requests.select("request_id", "doc_id", "message"), vectors=stored, request_vectors=asked, hints=memory_hints(spark, sf_dir), slides=False
    )
    return result(got.hits.withColumn("score", T.settle(F.col("score"))))
