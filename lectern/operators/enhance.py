"""Enhancement of pages by recognised or vision-model text: decide, then merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed as X
from lectern.functions import measures
from lectern.functions import text as T
from lectern.operators.ranking import top_k
from lectern.operators.stage import once


def probes(recognized: DataFrame) -> DataFrame:
    """One row per recognised page: how well its text reads. Of several rows the last one counts.

    Texts are measured where they are read; what is grouped and joined are numbers.
    """
    own = F.coalesce("text", F.lit(""))
    rows = measures.with_counts(
        recognized.select("doc_id", "page", "item_no", F.coalesce("ocr_quality", F.lit("")).alias("_label"), own.alias("_text")), "_text", "_m"
    )
    label, m = F.col("_label"), F.col("_m")
    scored = rows.select("doc_id", "page", "item_no", "_label", measures.readability(m).alias("_raw"),
                         measures.fragmentation(m).alias("frag"), F.length(T.strip(F.col("_text"))).alias("n_stripped"))
    raw = F.col("_raw")
    readable = F.when(label == "good", F.greatest(raw, F.lit(0.75))).when(label == "failed", F.least(raw, F.lit(0.2))).otherwise(raw)
    last = scored.withColumn("readable", readable).groupBy("doc_id", "page").agg(
        *[F.max_by(c, "item_no").alias(c) for c in ("readable", "frag", "n_stripped")]
    )
    return last.fillna({"readable": 0.0, "frag": 1.0, "n_stripped": 0}).withColumn("probe", F.lit(True))


def decisions(quality: DataFrame, recognized: DataFrame | None, vision_enabled: bool) -> DataFrame:
    """What to apply to each page, given its quality row and its recognition probe."""
    if recognized is None:
        joined = quality.select(
            "*", F.lit(False).alias("probe"), F.lit(0.0).alias("readable"), F.lit(0.0).alias("frag"), F.lit(0).alias("n_stripped")
        )
    else:
        joined = quality.join(probes(recognized).withColumnRenamed("page", "page_start"), ["doc_id", "page_start"], "left").withColumn(
            "probe", F.coalesce("probe", F.lit(False))
        )
    had = F.greatest(
        F.lit(1),
        F.floor(F.col("text_score") * F.when(F.col("unit_type") == "slide", 120).otherwise(800)).cast("int"),
    )
    gain = T.clamp((F.col("n_stripped") - had) / F.greatest(F.lit(80), had))
    probe_only = lambda c: F.when(F.col("probe"), c).otherwise(F.lit(0.0))
    probed = {"readability": F.col("readable"), "gain": gain, "frag": F.col("frag")}
    measured = joined.withColumns({name: probe_only(c) for name, c in probed.items()})
    vision = F.lit(vision_enabled)
    visual = F.col("visual_score") >= 0.5
    pair = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    needs_vision = F.arrays_overlap("reasons", T.any_of(X.VISION_REASONS)) & (
        ~F.col("probe") | (F.col("readability") < 0.65) | (F.col("frag") > 0.35)
    )
    choice = (
        F.when(
            (F.col("recommended_action") == "keep") | (F.col("overall_score") >= 0.7),
            pair("use_original", "quality_good"),
        )
        .when(F.array_contains("reasons", "sparse_but_structured"), pair("use_original", "sparse_but_structured"))
        .when(vision & needs_vision, pair("apply_vision", "visual_semantics_need_vision"))
        .when(
            F.col("probe") & (F.col("readability") >= 0.65) & (F.col("gain") >= 0.2),
            pair("apply_ocr", "ocr_readable_gain"),
        )
        .when(F.col("probe") & vision & visual, pair("apply_vision", "ocr_probe_failed_visual_high"))
        .when(F.col("probe"), pair("apply_ocr", "ocr_best_available"))
        .when(vision & visual, pair("apply_ocr_then_maybe_vision", "ocr_first_for_visual_text"))
        .when(F.col("recommended_action") == "ocr", pair("apply_ocr", "parser_recommends_ocr"))
        .otherwise(pair("use_original", "quality_not_low"))
    )
    return measured.withColumn("_choice", choice).select(
        "doc_id",
        F.col("page_start").alias("page"),
        F.col("_choice.action").alias("action"),
        F.col("_choice.reason").alias("reason"),
        "reasons",
        F.col("overall_score").alias("parser_score"),
        "visual_score",
        T.round_exact(F.col("readability"), 3).alias("ocr_readability"),
        T.round_exact(F.col("gain"), 3).alias("ocr_gain"),
        T.round_exact(F.col("frag"), 3).alias("ocr_fragmentation"),
    )


def pages_for_ocr(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("action").isin("apply_ocr", "apply_ocr_then_maybe_vision")).select("doc_id", "page")


def pages_for_vision(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("action") == "apply_vision").select("doc_id", "page")


def routes(decided: DataFrame) -> DataFrame:
    """The pages of both in one pass: (doc_id, page, route)."""
    route = F.when(F.col("action") == "apply_vision", "vision").when(F.col("action") != "use_original", "ocr")
    return decided.select("doc_id", "page", route.alias("route")).where(F.col("route").isNotNull())


FRAGMENT_COLUMNS = (
    "doc_id page fragment_no source text quality reason visual_type key_observations "
    "formula_summary table_summary chart_summary qa_hint"
).split()


def fragments_from_payload(payload: DataFrame, source: str) -> DataFrame:
    """Explode a payload's pages (array of structs) into fragment rows.

    The quality is the source's own field, else ``quality``, else ``failed``; blank
    observations are dropped.
    """
    own = "ocr_quality" if source == "ocr" else "vision_quality"
    rows = payload.select("doc_id", F.posexplode("pages").alias("fragment_no", "p"))
    have = set(payload.schema["pages"].dataType.elementType.names)
    field = lambda name, default="": (
        F.coalesce(F.col(f"p.{name}"), F.lit(default)) if name in have else F.lit(default)
    )
    label = [F.col(f"p.{n}") for n in (own, "quality") if n in have]
    none = F.array().cast("array<string>")
    observed = F.coalesce(F.col("p.key_observations"), none) if "key_observations" in have else none
    return rows.select(
        "doc_id",
        F.coalesce(F.col("p.page"), F.lit(0)).cast("int").alias("page"),
        "fragment_no",
        F.lit(source).alias("source"),
        field("text").alias("text"),
        F.coalesce(*label, F.lit("failed")).alias("quality"),
        field("reason").alias("reason"),
        field("visual_type").alias("visual_type"),
        F.filter(observed, lambda o: T.strip(o) != "").alias("key_observations"),
        *[field(n).alias(n) for n in ("formula_summary", "table_summary", "chart_summary", "qa_hint")],
    )


def has_usable_text(pages: Column) -> Column:
    """Whether any page of a payload carries text."""
    return F.coalesce(F.exists(pages, lambda p: T.strip(F.coalesce(p["text"], F.lit(""))) != ""), F.lit(False))


def fragment_text(f_source: Column, text: Column) -> Column:
    """Text of a fragment; vision fields are appended unless the text already labels them."""
    body = T.strip(F.coalesce(text, F.lit("")))
    labelled = lambda label: body.rlike(f"(?im)^{label}:")
    value = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    observed = F.filter("key_observations", lambda o: T.strip(o) != "")
    fields = [
        F.when((F.coalesce("visual_type", F.lit("")) != "") & ~labelled("Visual type"),
               F.concat(F.lit("Visual type: "), F.col("visual_type"))),
        F.when(
            (F.size("key_observations") > 0) & ~labelled("Key observations"),
            F.array_join(
                F.concat(F.array(F.lit("Key observations:")), F.transform(observed, lambda o: F.concat(F.lit("- "), o))),
                "\n",
            ),
        ),
    ]
    for label, name in zip(X.VISION_LABELS, ("formula_summary", "table_summary", "chart_summary", "qa_hint")):
        fields.append(
            F.when((value(name) != "") & ~labelled(label), F.concat(F.lit(f"{label}: "), value(name)))
        )
    full = T.strip(F.concat_ws("\n", T.blank_to_null(body), *fields))
    return F.when(f_source == "vision", full).otherwise(body)


def candidate_score(m: Column, source: Column, quality: Column) -> Column:
    """Score of a text from its counts."""
    bonus = T.lookup(quality, X.QUALITY_BONUS, 0.0) + T.lookup(source, X.SOURCE_BONUS, 0.0)
    score = T.clamp(
        F.least(F.lit(1.0), measures.length(m) / 180) + bonus - measures.symbol_ratio(m) * 0.5 - measures.fragmentation(m) * 0.4
    )
    return F.when(m["words"] > 0, score).otherwise(0.0)


def merge(pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """Best text per page among parser text, each usable fragment, and text plus fragment."""
    return with_best(pages, best_texts(pages, fragments))


def best_texts(pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc_id, page_num, new_source, c_text) of the pages for which there is a better text than the parser's.

    Candidates keep their order (parser, then per fragment: alone, merged); the first of
    the best wins. Pages without usable fragments pass through untouched. Page and fragment are
    measured before they meet: the counts of a merged text are sums, so no candidate is written out to be scored.
    """
    usable = (
        once(fragments.where(F.col("quality") != "failed"), {"f_text": fragment_text(F.col("source"), F.col("text"))})
        .where(F.col("f_text") != "")
        .select("doc_id", F.col("page").alias("page_num"), "fragment_no", "source", "quality", "f_text",
                F.concat(F.lit("["), F.upper("source"), F.lit("]")).alias("tag"))
    )
    usable = measures.with_counts(measures.with_counts(usable, "f_text", "f_counts"), "tag", "tag_counts")
    parsed = pages.select("doc_id", "page_num", T.strip(F.coalesce("text", F.lit(""))).alias("p_text"))
    joined = measures.with_counts(parsed, "p_text", "p_counts").join(usable, ["doc_id", "page_num"])
    old, own, found = F.col("p_text"), F.col("p_counts"), F.col("f_counts")
    replaced = ((F.col("source") == "ocr") & (F.length(old) < 20)) | (old == "")
    plus = F.when((old != "") & (F.col("quality") == "good"), 0.16).otherwise(0.0)
    scored = joined.withColumn("both_counts", F.when(replaced, found).otherwise(measures.together(own, F.col("tag_counts"), found)))
    settled = lambda c: T.settle(c, 9)
    rated = scored.select(
        "doc_id", "page_num", "fragment_no", "source", "p_text", "f_text", "tag", replaced.alias("replaced"),
        settled(candidate_score(own, F.lit("parser"), F.lit("good"))).alias("s_own"),
        settled(candidate_score(found, F.col("source"), F.col("quality")) + 0.0 - 0.0).alias("s_alone"),
        settled(candidate_score(F.col("both_counts"), F.col("source"), F.col("quality")) + plus - 0.08).alias("s_both"),
    )
    second = F.col("s_both") > F.col("s_alone")
    offers = rated.select(
        "*", second.alias("second"), F.greatest("s_alone", "s_both").alias("score"),
        (F.col("fragment_no") * 2 + second.cast("int") + 1).cast("long").alias("cand_no"),
    )
    first = top_k(offers, ["doc_id", "page_num"], [F.col("score").desc(), F.col("cand_no")], 1, "_n")
    text = F.when(~F.col("second") | F.col("replaced"), F.col("f_text")).otherwise(F.concat(old, F.lit("\n\n"), F.col("tag"), F.lit("\n"), F.col("f_text")))
    return first.where((F.col("score") > F.col("s_own")) & (F.col("source") != "parser")).select(
        "doc_id", "page_num", F.col("source").alias("new_source"), text.alias("c_text")
    )


def with_best(pages: DataFrame, best: DataFrame) -> DataFrame:
    out = pages.join(best, ["doc_id", "page_num"], "left")
    won = F.col("new_source").isNotNull()
    return (
        out.withColumn("content_source", F.coalesce("new_source", "content_source"))
        .withColumn("enhanced", won | F.coalesce("enhanced", F.lit(False)))
        .withColumn("char_count", F.when(won, F.length("c_text")).otherwise(F.col("char_count")))
        .withColumn("text", F.coalesce("c_text", "text"))
        .drop("new_source", "c_text")
    )


def raw_text(pages: DataFrame) -> DataFrame:
    """A document's text again, from its non-blank pages in order."""
    body = T.strip(F.coalesce("text", F.lit("")))
    parts = pages.select("doc_id", F.struct("page_num", body.alias("body")).alias("p")).where(F.col("p.body") != "")
    return parts.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["body"]), "\n\n").alias("raw_text")
    )


def slide_sections(pages: DataFrame) -> DataFrame:
    """One section per slide with text."""
    body = T.strip(F.coalesce("text", F.lit("")))
    return pages.where(body != "").select(
        "doc_id",
        F.concat(F.lit("slide_"), F.col("page_num").cast("string")).alias("section_id"),
        F.concat(F.lit("Slide "), (F.col("page_num") + 1).cast("string")).alias("title"),
        F.lit(1).alias("level"),
        body.alias("text"),
        F.col("page_num").alias("page_start"),
        F.col("page_num").alias("page_end"),
        "content_source",
        "enhanced",
    )
