"""BM25 and token-overlap search over many scopes at once.

A *scope* is the chunk list one request searches: a document, or one section of it.
Corpus statistics (N, document frequency, mean length, mean idf) belong to a scope.

Chunks   : scope_id, pos, chunk_id, section_id, search_text (+ is_slide, has_formula)
Requests : request_id, scope_id, query (already expanded), k (+ section_id)

Arrays are unnested with the ``outer`` generators: for the plain ones the optimizer adds a
filter on the array's size below, which would compute the tokens a second time.

Work grows with the postings of the requested terms, not with requests x chunks:
chunks that share no token with a request are never paired with it. They can still
fill a result (all their scores are equal), and ``_fill`` fetches just enough of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T
from lectern.operators.ranking import top_k
from lectern.operators.stage import joined_where_dealt, written


#: Positions of a block of postings in a pruned search.
BLOCK_WIDTH = 1024
#: Terms of a request whose strongest postings give it a first floor.
LEADS = 8
#: Tokens and requested terms of a scope that one task may hold whole.
SCOPE_TOKENS, SCOPE_TERMS = 200_000, 200
#: Share of the floor that terms may reach together which are left out where the others are common: nearer to one, most
#: chunks with an essential term could still be hits.
LEFT_OUT = 0.05
#: What a word of a slide request can add beside its impact: overlap, header, formula.
CORE_GAIN = 0.5 + 1.5 + 0.35


def greatest_k(requests: DataFrame) -> int:
    """The largest ``k`` asked for: the literal limit that is pushed below the shuffles."""
    return int(requests.agg(F.max("k")).first()[0] or 1)


def scope_chunks(chunks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve strict-section requests to scopes.

    A strict request searches its section if that section has chunks and the whole
    document otherwise. Returns requests with ``scope_id`` and the chunk rows of the
    requested scopes only.
    """
    if requests.where("section_only").isEmpty():
        whole = requests.withColumn("scope_id", F.col("doc_id"))
        asked = whole.select("doc_id").distinct()
        return whole, chunks.join(asked, "doc_id", "left_semi").withColumn("scope_id", F.col("doc_id"))
    sections = chunks.where(F.col("section_id").isNotNull()).select("doc_id", "section_id").distinct()
    strict = F.col("section_only") & (F.coalesce(F.col("section_id"), F.lit("")) != "")
    resolved = (
        requests.join(sections.withColumn("_found", F.lit(True)), ["doc_id", "section_id"], "left")
        .withColumn("_strict", strict & F.col("_found").isNotNull())
        .withColumn("_scope_section", F.when(F.col("_strict"), F.col("section_id")))
        .withColumn("scope_id", F.concat_ws("\u0001", F.col("doc_id"), F.col("_scope_section")))
        .drop("_found", "_strict")
    )
    wanted = resolved.select("doc_id", "scope_id", "_scope_section").distinct()
    scoped = chunks.join(wanted, "doc_id").where(
        F.col("_scope_section").isNull() | (F.col("_scope_section") == F.col("section_id"))
    )
    return resolved.drop("_scope_section"), scoped.drop("_scope_section")


def scope_stats(tokenized: DataFrame) -> DataFrame:
    return tokenized.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size("tokens")).alias("avg_len")
    )


def term_weights(tokenized: DataFrame, stats: DataFrame) -> DataFrame:
    """idf per scope and term; a negative idf becomes epsilon times the scope's mean idf."""
    df = (
        tokenized.select("scope_id", F.explode_outer(F.array_distinct("tokens")).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("scope_id", "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    raw = df.join(stats.select("scope_id", "n_chunks"), "scope_id").withColumn(
        "raw_idf", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.groupBy("scope_id").agg(F.avg("raw_idf").alias("mean_idf"))
    return raw.join(mean, "scope_id").select(
        "scope_id",
        "term",
        "df",
        F.when(F.col("raw_idf") < 0, F.col("mean_idf") * X.BM25_EPSILON).otherwise(F.col("raw_idf")).alias("idf"),
    )


def tokenize(chunks: DataFrame, slides: bool = False, facts: tuple[str, ...] = ()) -> DataFrame:
    cols = [F.col("scope_id"), F.col("pos"), T.tokens(F.col("search_text")).alias("tokens"), *facts]
    if slides:
        head = F.slice(F.split("search_text", X.LINE_BREAK), 1, 3)
        cols.append(
            F.when(F.col("is_slide"), F.array_distinct(T.tokens(F.array_join(head, "\n"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("header_tokens")
        )
    return chunks.select(*cols)


def postings(tokenized: DataFrame, terms: DataFrame, facts: tuple[str, ...] = ()) -> DataFrame:
    """Term frequencies of the requested terms only (``terms``: scope_id, term)."""
    slides = "header_tokens" in tokenized.columns
    head = F.array_contains("header_tokens", F.col("term")) if slides else F.lit(False)
    exploded = tokenized.select("*", F.explode_outer("tokens").alias("term")).select(
        "scope_id", "pos", "term", F.size("tokens").alias("len"), head.alias("in_header"), *facts
    )
    return (
        exploded.join(terms, ["scope_id", "term"], "left_semi")
        .groupBy("scope_id", "pos", "term", "len", "in_header", *facts)
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def request_terms(requests: DataFrame, facts: tuple[str, ...] = ()) -> DataFrame:
    return (
        requests.select("request_id", "scope_id", *facts, F.explode_outer(T.tokens(F.col("query"))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("request_id", "scope_id", *facts, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
        .withColumn("core", ~F.col("term").isin(*X.QUERY_STOPWORDS))
    )


def impacts(
    chunks: DataFrame, terms: DataFrame, scoring: str = "bm25", slides: bool = False, facts: tuple[str, ...] = ()
) -> DataFrame:
    """Postings of the requested terms with what a posting adds to a score (``impact``)."""
    tokenized = tokenize(chunks, slides, facts)
    post = postings(tokenized, terms.select("scope_id", "term").distinct(), facts)
    if scoring != "bm25":
        return post.withColumn("impact", F.lit(1.0))
    stats = scope_stats(tokenized)
    weights = term_weights(tokenized, stats).select("scope_id", "term", "idf")
    norm = X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * F.col("len") / F.col("avg_len"))
    return (
        post.join(weights, ["scope_id", "term"])
        .join(stats, "scope_id")
        .withColumn("impact", F.col("idf") * (F.col("tf") * (X.BM25_K1 + 1)) / (F.col("tf") + norm))
        .select("scope_id", "pos", "term", "in_header", "impact", *facts)
    )


def scope_sizes(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(scope_id, n_chunks, avg_len, wanted, whole) of the requested scopes: ``whole`` where one task may hold the scope."""
    wanted = requests.select("scope_id", F.explode_outer(F.array_distinct(T.tokens(F.col("query")))).alias("term")).where("term is not null")
    wanted = wanted.groupBy("scope_id").agg(F.collect_set("term").alias("wanted"))
    counted = scope_stats(tokenize(chunks)).join(wanted, "scope_id")
    few = (F.col("n_chunks") * (F.col("avg_len") + 1) <= SCOPE_TOKENS) & (F.size("wanted") <= SCOPE_TERMS)
    return counted.withColumn("whole", F.coalesce(few, F.lit(False)))


def whole_impacts(chunks: DataFrame, sizes: DataFrame, slides: bool = False, facts: tuple[str, ...] = ()) -> DataFrame:
    """``impacts`` in scopes that are whole (``sizes``).

    Texts are dealt out by scope, once, and what is counted is counted where they lie: frequencies by scope and
    term, mean weights by scope. Of the tokens only those asked for keep their place, and leave their task.
    """
    dealt = tokenize(chunks.repartition("scope_id"), slides, facts).join(sizes.select("scope_id", "n_chunks", "avg_len", "wanted"), "scope_id")
    found = dealt.withColumn("_len", F.size("tokens")).select("*", F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term is not null")
    head = F.array_contains("header_tokens", F.col("term")) if slides else F.lit(False)
    tf = (F.col("_len") - F.size(F.array_remove("tokens", F.col("term")))).cast("long")  # no lambda: rows of the generator are not copied
    place = F.struct("pos", F.col("_len").alias("len"), head.alias("in_header"), tf.alias("tf"), *facts)
    found = found.select("scope_id", "n_chunks", "avg_len", "term", F.when(F.array_contains("wanted", F.col("term")), place).alias("place"))
    counted = found.groupBy("scope_id", "n_chunks", "avg_len", "term").agg(F.count(F.lit(1)).alias("df"), F.collect_list("place").alias("places"))
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    asked = F.when(F.size("places") > 0, F.struct("term", "raw_idf", "places"))
    scoped = counted.withColumn("raw_idf", raw).groupBy("scope_id", "avg_len").agg(F.avg("raw_idf").alias("mean_idf"), F.collect_list(asked).alias("asked"))
    post = scoped.select("scope_id", "avg_len", "mean_idf", F.inline("asked")).select("*", F.inline("places"))
    idf = F.when(F.col("raw_idf") < 0, F.col("mean_idf") * X.BM25_EPSILON).otherwise(F.col("raw_idf"))
    norm = X.BM25_K1 * (1 - X.BM25_B + X.BM25_B * F.col("len") / F.col("avg_len"))
    return post.select(
        "scope_id", "pos", "term", "in_header", (idf * (F.col("tf") * (X.BM25_K1 + 1)) / (F.col("tf") + norm)).alias("impact"), *facts
    )


def met(
    post: DataFrame,
    terms: DataFrame,
    scoring: str,
    slides: bool,
    keys: tuple[str, ...],
    on: tuple[str, ...] = ("scope_id", "term"),
) -> DataFrame:
    """Scores of the chunks whose postings meet request terms."""
    score = F.sum(F.col("qtf") * F.col("impact")) if scoring == "bm25" else F.count(F.lit(1)).cast("double")
    extra = []
    if slides:
        extra = [
            F.count_if("core").alias("core_overlap"),
            F.count_if(F.col("core") & F.col("in_header")).alias("header_overlap"),
        ]
    return (
        post.join(terms, list(on))
        .groupBy("request_id", "scope_id", "pos", *keys)
        .agg(score.alias("match_score"), F.count(F.lit(1)).alias("n_matched"), *extra)
    )


def match_scores(
    chunks: DataFrame,
    requests: DataFrame,
    scoring: str = "bm25",
    slides: bool = False,
    facts: tuple[str, ...] = (),
    request_facts: tuple[str, ...] = (),
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Scores of all chunks that share a token with a request, before any boost.

    The weight of a posting is computed once, before postings meet requests. ``facts``
    are chunk columns and ``request_facts`` request columns carried along as grouping
    keys, which saves joining them to all matches. ``sizes``: the scopes, if all are whole.
    """
    terms = request_terms(requests, request_facts)
    post = impacts(chunks, terms, scoring, slides, facts) if sizes is None else whole_impacts(chunks, sizes, slides, facts)
    return met(post, terms, scoring, slides, (*request_facts, *facts))


# --- exact search with pruning ----------------------------------------------------------------


@dataclass
class Pruned:
    """``best``: the hits of a pruned search; ``report``: what it had and what it read per request."""

    best: DataFrame
    report: DataFrame


def pruned_search(
    chunks: DataFrame,
    requests: DataFrame,
    width: int = BLOCK_WIDTH,
    slides: bool = False,
    facts: tuple[str, ...] = (),
    request_facts: tuple[str, ...] = (),
    score: Callable[[DataFrame], DataFrame] | None = None,
    bonus: Column | None = None,
) -> Pruned:
    """The k best matching chunks per request, exact, without pairing requests with all matches.

    Postings lie in blocks: the chunks of a section within ``width`` positions. Of each term and
    block the greatest impact is known.

    1. *Floor.* The ``k`` strongest postings of a request's ``LEADS`` weightiest terms name a few
       chunks; their k-th score is a floor.
    2. *Essential terms.* A block in which all terms together cannot reach the floor is skipped. In the
       others, a request's terms are put in order of what they can add there. Those that cannot reach the
       floor together are not essential: a chunk that matches no other term is no hit. Where the others have so many
       postings that scoring their chunks in full would read more than the block has, only terms that
       cannot reach a share of the floor (``LEFT_OUT``) are left out, and few chunks remain to be scored in full. Only postings of essential terms meet the request; a
       block without any is skipped. A common word is seldom essential, so its postings, which
       are most of all, are rarely touched; where it is, they are spread over its blocks.
    3. *Completion.* Chunks whose essential impacts and the most that the others can add reach
       the floor are scored in full.

    ``score`` turns match scores into scores (columns score, k); ``bonus`` is what it may add at
    most to the sum of impacts, beside ``CORE_GAIN`` for each core word of a slide request.
    """
    terms = request_terms(requests, request_facts)
    post = impacts(chunks, terms, "bm25", slides, (*facts, *(() if "section_id" in facts else ("section_id",))))
    block = F.concat_ws(":", F.coalesce("section_id", F.lit("")), F.floor(F.col("pos") / width))
    post = written(post.withColumn("block", block), "lexical-postings")
    most = greatest_k(requests)
    order = [F.col("score").desc(), F.col("pos")]
    plain = lambda found: found.withColumn("score", T.settle(F.col("match_score"))).join(requests.select("request_id", "k"), "request_id")
    gain = lambda impact: F.col("qtf") * F.greatest(impact, F.lit(0.0)) + (F.when(F.col("core"), CORE_GAIN).otherwise(0.0) if slides else F.lit(0.0))

    def completed(found: DataFrame) -> DataFrame:
        """The k best of the chunks (request_id, scope_id, pos)."""
        wanted = found.join(terms, ["request_id", "scope_id"])
        scored = met(post, wanted, "bm25", slides, (*request_facts, *facts), ("scope_id", "pos", "term"))
        return top_k((score or plain)(scored), ["request_id"], order, "k", "rank", most=most)

    maxima = written(post.groupBy("scope_id", "term", "block").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("n")), "lexical-maxima")
    tops = maxima.groupBy("scope_id", "term").agg(F.max("most").alias("most")).join(terms, ["scope_id", "term"])
    leads = top_k(tops, ["request_id"], [gain(F.col("most")).desc(), F.col("term")], LEADS, "_n").select("request_id", "scope_id", "term")
    champions = top_k(post.select("scope_id", "term", "pos", "impact"), ["scope_id", "term"], [F.col("impact").desc(), F.col("pos")], most, "_n")
    early = completed(champions.join(leads, ["scope_id", "term"]).select("request_id", "scope_id", "pos").distinct())
    extra = F.lit(0.0) if bonus is None else bonus
    # sums may differ in their last digits by the order of adding, and scores are settled at six
    floors = written(early.where(F.col("rank") == F.col("k")).select("request_id", (F.col("score") - 1e-5).alias("_floor")), "lexical-floors")

    carried = ["request_id", "scope_id", "block"]
    inside = Window.partitionBy("request_id", "block").orderBy("_gain", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("request_id", "block")
    weighed = (
        maxima.join(terms, ["scope_id", "term"])
        .select(*carried, "term", "qtf", "core", "n", gain(F.col("most")).alias("_gain"), extra.alias("_extra"))
        .join(floors, "request_id", "left")
        .withColumn("_reach", F.sum("_gain").over(inside))
        .withColumn("_reach", F.col("_reach") + F.col("_extra"))
        .withColumn("_all", F.max("_reach").over(whole))
        .withColumn("_few", F.sum(F.when(F.col("_reach") >= F.col("_floor"), F.col("n")).otherwise(0)).over(whole) * F.count(F.lit(1)).over(whole) <= F.sum("n").over(whole))
        .withColumn("essential", F.col("_floor").isNull() | ((F.col("_all") >= F.col("_floor")) & (F.col("_reach") >= F.when(F.col("_few"), 1.0).otherwise(LEFT_OUT) * F.col("_floor"))))
        .withColumn("_reach", F.col("_reach") - F.col("_extra"))
        .drop("_all", "_few")
    )
    weighed = written(weighed, "lexical-weighed")
    rest = weighed.where("not essential").groupBy("request_id", "block").agg(F.max("_reach").alias("_rest"))
    essential = weighed.where("essential").join(rest, ["request_id", "block"], "left")
    ceiling = F.sum(gain(F.col("impact"))) + F.first("_rest_or_none") + F.first("_extra")
    # all postings of a block are dealt to one task, so that what they add to a chunk is summed up where they meet the requests
    candidates = (
        post.select("scope_id", "term", "block", "pos", "impact")
        .repartition("scope_id", "block")
        .join(essential.withColumn("_rest_or_none", F.coalesce("_rest", F.lit(0.0))), ["scope_id", "term", "block"])
        .groupBy("request_id", "scope_id", "block", "pos")
        .agg(ceiling.alias("_ceiling"), F.first("_floor").alias("_floor"))
        .where("_floor is null or _ceiling >= _floor")
        .select("request_id", "scope_id", "pos")
    )
    with joined_where_dealt(chunks.sparkSession):
        candidates = written(candidates, "lexical-candidates")
    best = written(completed(candidates), "lexical-best")
    report = weighed.groupBy("request_id").agg(
        F.count_distinct("block").alias("n_blocks"),
        F.count_distinct(F.when(F.col("essential"), F.col("block"))).alias("blocks_read"),
        F.sum("n").alias("n_postings"),
        F.sum(F.when(F.col("essential"), F.col("n")).otherwise(0)).alias("postings_read"),
    )
    return Pruned(best, report)


def _range_of(pos: Column) -> Column:
    """Number of the doubling range a storage position falls into."""
    return F.ceil(F.log2(pos.cast("double") + 2.0)).cast("int")


def _matches(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, pos) pairs that share a token."""
    terms = request_terms(requests).select("request_id", "scope_id", "term")
    tokens = chunks.select(
        "scope_id", "pos", F.explode_outer(F.array_distinct(T.tokens(F.col("search_text")))).alias("term")
    )
    return tokens.join(terms, ["scope_id", "term"]).select("request_id", "pos").distinct()


def _fill(chunks: DataFrame, asking: DataFrame, matches: DataFrame, keys: list[str], most: int) -> DataFrame:
    """First k chunks (by pos) of a request's ``keys`` group that share no token with it.

    Positions fall into doubling ranges. Counts per range, made with map-side
    combining, tell up to which range k unmatched chunks exist; only chunks that far
    are joined.
    """
    group = ["request_id", *keys]
    ranged = chunks.select("pos", *keys).withColumn("_range", _range_of(F.col("pos")))
    have = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_have"))
    scoped = matches.join(asking.select("request_id", "scope_id").distinct(), "request_id")
    if keys != ["scope_id"]:
        scoped = scoped.join(chunks.select("pos", *keys), ["scope_id", "pos"])
    taken = scoped.groupBy(*group, _range_of(F.col("pos")).alias("_range")).agg(F.count(F.lit(1)).alias("_taken"))
    running = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        asking.select("k", *group)
        .join(have, keys)
        .join(taken, [*group, "_range"], "left")
        .withColumn("_free", F.col("_have") - F.coalesce(F.col("_taken"), F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum("_free").over(running), F.lit(0)))
        .where((F.col("_before") < F.col("k")) & (F.col("_free") > 0))
        .select("k", *group, "_range")
    )
    rows = needed.join(ranged, [*keys, "_range"]).join(matches, ["request_id", "pos"], "left_anti")
    return top_k(rows, group, [F.col("pos")], "k", "_n", most=most).select("request_id", "pos")


def search(
    chunks: DataFrame,
    requests: DataFrame,
    scoring: str = "bm25",
    slides: bool = False,
    section_boost: bool = True,
    width: int | None = None,
) -> DataFrame:
    """The k best chunks per request, ties in storage order.

    With a block ``width``, blocks of postings that cannot reach a request's k best are skipped
    (``pruned_search``, for scopes of many chunks); results are the same.
    ``slides`` turns on the courseware adjustment (chunks need is_slide, has_formula).
    Returns request_id, scope_id, pos, score, rank, n_matched.

    Scopes that one task may hold are searched whole, the others term by term.
    """
    if width is not None or scoring != "bm25":
        return _search(chunks, requests, scoring, slides, section_boost, width, None)
    requests = written(requests, "lexical-requests")
    sizes = written(scope_sizes(chunks, requests), "lexical-scopes")
    large = sizes.where("not whole").select("scope_id")
    if large.isEmpty():
        return _search(chunks, requests, scoring, slides, section_boost, None, sizes)
    found = _search(chunks.join(large, "scope_id", "left_semi"), requests.join(large, "scope_id", "left_semi"), scoring, slides, section_boost, None, None)
    rest = requests.join(large, "scope_id", "left_anti")
    if rest.isEmpty():
        return found
    return found.unionByName(_search(chunks.join(large, "scope_id", "left_anti"), rest, scoring, slides, section_boost, None, sizes.where("whole")))


def _search(
    chunks: DataFrame, requests: DataFrame, scoring: str, slides: bool, section_boost: bool, width: int | None, sizes: DataFrame | None
) -> DataFrame:
    """``search`` in scopes of any size, or in whole ones (``sizes``)."""
    if not section_boost:
        requests = requests.drop("section_id")
    if "section_id" not in requests.columns:
        requests = requests.withColumn("section_id", F.lit(""))
    requests = requests.select(
        "request_id",
        "scope_id",
        "query",
        F.coalesce("section_id", F.lit("")).alias("section_id"),
        F.when(F.col("k") >= 1, F.col("k")).otherwise(F.raise_error(F.lit("k must be positive"))).alias("k"),
    )
    most = greatest_k(requests)
    facts = (("section_id",) if section_boost else ()) + (("is_slide", "has_formula") if slides else ())
    has_core = F.size(T.core_tokens(F.col("query"))) > 0 if slides else F.lit(False)
    wanted = requests.select(
        "request_id", "scope_id", "k", F.col("section_id").alias("wanted"), has_core.alias("has_core")
    )
    in_section = (
        (F.col("wanted") != "") & (F.col("wanted") == F.col("section_id")) if section_boost else F.lit(False)
    )
    boost = F.when(in_section, X.SECTION_BOOST).otherwise(0.0)
    order = [F.col("score").desc(), F.col("pos")]
    columns = ["request_id", "scope_id", "pos", "score", "n_matched", "k"]

    score = F.col("match_score") + boost
    base = boost
    if slides:
        overlap = F.col("core_overlap")
        untouched = ~F.col("is_slide") | ~F.col("has_core")
        score = (
            F.when(untouched, score)
            .when(overlap == 0, score * 0.35)
            .otherwise(
                score
                + overlap * 0.5
                + F.col("header_overlap") * 1.5
                + F.when(F.col("has_formula"), F.least(F.lit(2.0), overlap * 0.35)).otherwise(0.0)
            )
        )
        base = F.when(untouched, base).otherwise(base * 0.35)
    asked = requests.select(
        "request_id", "scope_id", "query", "k", F.col("section_id").alias("wanted"), has_core.alias("has_core")
    )
    carried = ("k",) + (("wanted",) if section_boost else ()) + (("has_core",) if slides else ())
    if width is None or scoring != "bm25":
        matched = match_scores(chunks, asked, scoring, slides, facts, carried, sizes)
        matched = matched.withColumn("score", T.settle(score)).select(*columns)
        if sizes is not None:  # no more rows than the scopes have chunks, for each request
            matched = written(matched, "lexical-matched")
        best = written(top_k(matched, ["request_id"], order, "k", "rank", most=most), "lexical-best")
    else:
        bonus = F.when(F.col("wanted") != "", X.SECTION_BOOST).otherwise(0.0) if section_boost else None
        settled = lambda found: found.withColumn("score", T.settle(score)).select(*columns)
        best = pruned_search(chunks, asked, width, slides, facts, carried, settled, bonus).best

    # Chunks without a shared token all score alike: 0, or the boost when in the section
    # asked for. They matter only where fewer than k matches score above that.
    good = best.groupBy("request_id").agg(
        F.count_if(F.col("score") > 0).alias("above_zero"),
        F.count_if(F.col("score") > X.SECTION_BOOST).alias("above_boost"),
    )
    state = requests.join(good, "request_id", "left")
    short = state.where(F.coalesce("above_zero", F.lit(0)) < F.col("k"))
    short_in_section = state.where(
        (F.col("section_id") != "") & (F.coalesce("above_boost", F.lit(0)) < F.col("k"))
    )
    unfinished = short.unionByName(short_in_section).select(*requests.columns).distinct()
    if unfinished.isEmpty():
        return best.drop("k")

    matches = _matches(chunks, unfinished) if sizes is None else matched.select("request_id", "pos").join(unfinished.select("request_id"), "request_id", "left_semi")
    extra = _fill(chunks, short, matches, ["scope_id"], most)
    if section_boost:
        keys, asking = ["scope_id", "section_id"], short_in_section
        if slides:
            keys = [*keys, "is_slide"]
            asking = asking.withColumn("is_slide", F.explode(F.array(F.lit(True), F.lit(False))))
        extra = extra.unionByName(_fill(chunks, asking, matches, keys, most)).distinct()
    extra = extra.join(wanted, "request_id")
    if facts:
        extra = extra.join(chunks.select("scope_id", "pos", *facts), ["scope_id", "pos"])
    extra = extra.withColumn("score", T.settle(base)).withColumn("n_matched", F.lit(0).cast("long"))

    pool = best.select(*columns).unionByName(extra.select(*columns))
    return written(top_k(pool, ["request_id"], order, "k", "rank", most=most).drop("k"), "lexical-filled")


def search_variants(chunks: DataFrame, requests: DataFrame, slides: bool = False) -> DataFrame:
    """Best score per chunk over several wordings of a request.

    ``requests`` has one row per wording: query_id, variant_no, variant (as typed), query
    (expanded), scope_id, k (+ section_id). A chunk that scores no more than zero but
    shares tokens with the wording scores the number of shared tokens.
    """
    keyed = requests.withColumn(
        "request_id", F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("variant_no").cast("string"))
    )
    found = search(chunks, keyed, slides=slides)
    text = chunks.select("scope_id", "pos", "text")  # its tokens are cut behind the join, where few are left
    low = found.where(F.col("score") <= 0).join(
        keyed.select("request_id", F.array_distinct(T.tokens(F.col("variant"))).alias("_wording")), "request_id"
    ).join(text, ["scope_id", "pos"]).select(
        "request_id", "pos", F.size(F.array_intersect("_wording", T.tokens(F.col("text")))).cast("double").alias("_shared")
    )
    found = (
        found.join(low, ["request_id", "pos"], "left")
        .withColumn("score", F.when(F.coalesce(F.col("_shared"), F.lit(0.0)) > 0, F.col("_shared")).otherwise(F.col("score")))
        .join(keyed.select("request_id", "query_id", "variant_no", "k"), "request_id")
    )
    first_seen = F.struct(F.col("variant_no"), F.col("rank"))
    best = found.groupBy("query_id", "scope_id", "pos").agg(
        F.max("score").alias("score"),
        F.min(first_seen).alias("_seen"),
        F.max("k").alias("k"),
    )
    return top_k(
        best, ["query_id"], [F.col("score").desc(), F.col("_seen")], "k", "rank", most=greatest_k(requests)
    ).drop("_seen", "k")
