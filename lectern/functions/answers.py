"""Text around model answers: JSON found in them, prompts, fallbacks, cache keys, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions import fixed as X
from lectern.functions import text as T

# ---- fixed values: sentences shown without a model ----
NO_MODEL_HEAD = "当前未配置可用的 LLM，因此先返回基于检索证据的简要提示：\n\n最相关片段："
NO_MODEL_TAIL = "\n\n请在设置中配置 API Key 和模型后，我可以生成更完整的中文讲解。"
NO_MODEL_NO_EVIDENCE = "当前未配置可用的 LLM，且没有检索到可用文档证据。请先确认文档已解析完成并配置模型。"
EXPLAIN_MODES = ("explain", "translate")


def json_text(c: Column) -> Column:
    """The JSON object inside a model's answer: fenced, the whole text, or the widest braces."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    whole = T.strip(c)
    ok = lambda s: F.when((s != "") & F.try_parse_json(s).isNotNull() & F.startswith(s, F.lit("{")), s)
    return F.coalesce(ok(fenced), ok(whole), ok(braces))


def json_list_text(c: Column) -> Column:
    """A JSON list, bare or fenced."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(bare, F.lit("[")) & F.try_parse_json(bare).isNotNull(), bare)


def quality_verdicts(c: Column) -> Column:
    """Quality items in a model's answer: a list, or an object with ``qualities``."""
    item = "unit_id string, llm_score double, quality string, recommended_action string, llm_reason string"
    from_list = F.from_json(json_list_text(c), f"array<struct<{_typed(item)}>>")
    from_object = F.from_json(json_text(c), f"struct<qualities:array<struct<{_typed(item)}>>>")["qualities"]
    return F.coalesce(from_list, from_object, F.array().cast(f"array<struct<{_typed(item)}>>"))


def _typed(fields: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(","))


def validation(c: Column) -> Column:
    """struct(passed, issues, correction); an answer that is no JSON passes."""
    v = F.from_json(json_text(c), "struct<passed:boolean,issues:array<string>,correction:string>")
    return F.struct(
        F.coalesce(v["passed"], F.lit(True)).alias("passed"),
        F.coalesce(v["issues"], F.array().cast("array<string>")).alias("issues"),
        F.coalesce(v["correction"], F.lit("")).alias("correction"),
    )


def vision_fields(c: Column) -> Column:
    """Structured vision answer; text that is no JSON becomes the text of a mixed page."""
    raw = T.strip(F.coalesce(c, F.lit("")))
    v = F.from_json(
        json_text(raw),
        "struct<text:string,visual_type:string,key_observations:array<string>,formula_summary:string,"
        "table_summary:string,chart_summary:string,qa_hint:string>",
    )
    clean = lambda n: T.strip(F.coalesce(v[n], F.lit("")))
    kind = F.lower(clean("visual_type"))
    kind = F.when(kind.isin(*X.VISUAL_TYPES), kind).otherwise("mixed")
    observed = F.filter(
        F.transform(F.coalesce(v["key_observations"], F.array().cast("array<string>")), T.strip), lambda o: o != ""
    )
    named = list(zip(X.VISION_LABELS, ("formula_summary", "table_summary", "chart_summary", "qa_hint")))
    any_content = (clean("text") != "") | (F.size(observed) > 0)
    for _, field in named:
        any_content = any_content | (clean(field) != "")
    listing = F.when(
        F.size(observed) > 0,
        F.concat(F.lit("Key observations:\n"), F.array_join(F.transform(observed, lambda o: F.concat(F.lit("- "), o)), "\n")),
    )
    text = F.concat_ws(
        "\n",
        T.blank_to_null(clean("text")),
        F.concat(F.lit("Visual type: "), kind),
        listing,
        *[F.when(clean(f) != "", F.concat(F.lit(f"{label}: "), clean(f))) for label, f in named],
    )
    parsed = v.isNotNull()
    return F.struct(
        F.when(~parsed, raw).when(any_content, text).otherwise("").alias("text"),
        F.when(parsed, kind).otherwise("mixed").alias("visual_type"),
        F.when(parsed, observed).otherwise(F.array().cast("array<string>")).alias("key_observations"),
        *[F.when(parsed, clean(f)).otherwise("").alias(f) for _, f in named],
    )


def brief_evidence(items: Column) -> Column:
    """Items with evidence as (title, quote): text evidence cut to 260, blank evidence dropped."""
    return F.transform(
        items,
        lambda i: F.struct(
            i["title"].alias("title"),
            F.when(T.strip(F.coalesce(i["evidence"], F.lit(""))) != "", F.left(T.strip(i["evidence"]), F.lit(260))).alias("quote"),
        ),
    )


def revised_answer(answer: Column, check: Column, second: Column) -> Column:
    """The answer if it passed, else its correction, else a second answer, else itself."""
    return (
        F.when(check["passed"], answer)
        .when(T.strip(check["correction"]) != "", check["correction"])
        .otherwise(F.coalesce(second, answer))
    )


def fallback_answer(first_quote: Column) -> Column:
    q = T.strip(F.coalesce(first_quote, F.lit("")))
    return F.when(
        q != "", F.concat(F.lit(NO_MODEL_HEAD), F.left(q, F.lit(240)), F.lit(NO_MODEL_TAIL))
    ).otherwise(NO_MODEL_NO_EVIDENCE)


def needs_validation(deep: Column, intent: Column) -> Column:
    return deep | intent.isin("formula", "figure")


def rule_validation(translation: Column, explanation: Column) -> Column:
    """struct(passed, confidence, issues) of an explanation, by rules alone."""
    issues = F.array_compact(
        F.array(
            F.when(T.strip(F.coalesce(translation, F.lit(""))) == "", "Empty translation"),
            F.when(T.strip(F.coalesce(explanation, F.lit(""))) == "", "Empty explanation"),
        )
    )
    return F.struct((F.size(issues) == 0).alias("passed"), F.lit("high").alias("confidence"), issues.alias("issues"))


def sampled(key: Column, tenth: int = 1) -> Column:
    """A stable tenth of the rows, by hash of their key."""
    return F.pmod(F.xxhash64(key), F.lit(10)) < tenth


def translation_key(doc_id: Column, section_id: Column, mode: Column, model: Column, message: Column) -> Column:
    return F.concat_ws("|", doc_id, section_id, mode, model, F.lit("translate-section-v1"), F.sha2(message, 256))


def section_hash(c: Column) -> Column:
    """``length:hash`` of a text: a 32-bit multiply-by-33-and-xor hash of its UTF-16 units
    in base 36, as the reading front end keys its section cache."""
    units = F.transform(
        F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)),
        lambda h: F.conv(h, 16, 10).cast("long"),
    )
    value = F.aggregate(
        units,
        F.lit(5381).cast("long"),
        lambda acc, u: (acc * F.lit(33)).bitwiseAND(F.lit(4294967295).cast("long")).bitwiseXOR(u),
    )
    return F.concat(F.size(units).cast("string"), F.lit(":"), F.lower(F.conv(value.cast("string"), 10, 36)))


def document_id(name: Column) -> Column:
    """Eight hex digits that follow from the file name."""
    return F.substring(F.sha2(name, 256), 1, 8)


def brief_type(subtype: Column) -> Column:
    return F.when(subtype == "slides_pdf", "lecture").otherwise("paper")
