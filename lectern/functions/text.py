"""Text functions as Spark columns. Nothing in this module leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lectern.functions import fixed as X

S = X.SPACE


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def any_of(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: dict, default) -> Column:
    """CASE over a small fixed table."""
    items = list(table.items())
    out = F.when(key == items[0][0], F.lit(items[0][1]))
    for name, value in items[1:]:
        out = out.when(key == name, F.lit(value))
    return out.otherwise(default)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def round_exact(c: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal form, so 2.675 gives 2.68 where
    the exact value lies below the tie. The product with 10^digits is formed together
    with its rounding error, and the error decides what looks like a tie.
    """
    p = float(10**digits)
    big = F.lit(134217729.0) * c
    high = big - (big - c)
    product = c * p
    error = (high * p - product) + (c - high) * p
    base = F.floor(product).cast("double")
    up = base + 1.0
    whole = (
        F.when(product - base != 0.5, F.floor(product + 0.5).cast("double"))
        .when(error > 0, up)
        .when(error < 0, base)
        .when(base % 2 == 0, base)
        .otherwise(up)
    )
    return F.when(c.isNotNull(), whole / p)


def settle(c: Column, digits: int = 6) -> Column:
    """Cut away summation noise so that equal scores tie whatever the order of adding."""
    p = float(10**digits)
    return F.floor(c * p + 0.5).cast("double") / p


# ---------------------------------------------------------------- shaping


def squeeze(c: Column) -> Column:
    """Whitespace runs to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{S}]+", " "), F.lit(" "))


#: The characters of ``SPACE``, one by one.
BLANKS = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())


def strip(c: Column) -> Column:
    """Read from the ends only; a pattern would try every character, and white space runs in square time."""
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    s = squeeze(c)
    return F.when(s != "", F.split(s, " ")).otherwise(F.array().cast("array<string>"))


def _parts(c: Column) -> Column:
    """Words, by one pass of a pattern."""
    return F.array_remove(F.split(c, f"[{S}]+"), "")


def word_count(c: Column) -> Column:
    return F.size(_parts(c))


def line_count(c: Column) -> Column:
    """Number of lines that are not blank."""
    return F.size(F.filter(F.split(c, X.LINE_BREAK), lambda line: line.rlike(f"[^{S}]")))


def lines(c: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(c, X.LINE_BREAK), strip), lambda x: x != "")


def first_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(lines(c), F.lit(1)), F.lit(""))


def quote(c: Column, limit: int) -> Column:
    """The first characters of the squeezed text; a long text is squeezed as a whole only where its beginning is mostly white space."""
    head = squeeze(F.left(c, F.lit(2 * limit)))
    long = (F.length(c) > 2 * limit) & (F.length(head) > limit)
    return F.left(F.when(long, head).otherwise(squeeze(c)), F.lit(limit))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# ---------------------------------------------------------------- tokens


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{X.CJK}]"))


def contains_cjk(c: Column) -> Column:
    return c.rlike(f"[{X.CJK}]")


def estimate_tokens(c: Column) -> Column:
    cjk = cjk_count(c)
    return (F.floor(cjk / 2) + F.floor((F.length(c) - cjk) / 4)).cast("long")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(X.TOKEN), F.lit(1))


def core_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), any_of(X.QUERY_STOPWORDS))


def expanded_query(query: Column, normalized: Column) -> Column:
    """The query followed by its normalised form when the two differ."""
    return F.when(
        (normalized != "") & (normalized != query), F.concat_ws(" ", query, normalized)
    ).otherwise(query)


def search_text(text: Column, prefix: Column, formula_ids: Column, sep: str = " ") -> Column:
    return F.concat_ws(
        sep,
        blank_to_null(text),
        blank_to_null(prefix),
        blank_to_null(F.array_join(formula_ids, " ")),
    )


def number_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\d+\.?\d*"))


# ---------------------------------------------------------------- text statistics


def _symbols(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[\\p{{L}}\\p{{N}}{S}]+", ""))


def symbol_ratio(c: Column, empty: float = 0.0) -> Column:
    return F.when(F.length(c) > 0, _symbols(c) / F.length(c)).otherwise(F.lit(empty))


def repetition_ratio(c: Column) -> Column:
    def share(found: Column) -> Column:
        n, distinct = F.size(found), F.size(F.array_distinct(found))
        return F.when(n >= 12, F.greatest(F.lit(0.0), F.lit(0.5) - distinct / n)).otherwise(F.lit(0.0))

    return let(_parts(F.lower(c)), share)


# both begin at the beginning of a word and give nothing back, so that a long word is read once
_EDGE = r"[.,;:()\[\]{}]*+"
SHORT_WORD = f"(?<![^ ]){_EDGE}[^ ]?{_EDGE}(?![^ ])"
NOISY_WORD = "(?<![^ ])[^ ?|\ufffd]*+[?|\ufffd][^ ]*+"


def fragmentation(c: Column, squeezed: bool = False) -> Column:
    """Share of words of at most one character (between punctuation) and of noisy words.

    Counted with patterns on the squeezed text, so no arrays are built.
    """
    def share(s: Column) -> Column:
        odd = F.regexp_count(s, F.lit(SHORT_WORD)) + F.regexp_count(s, F.lit(NOISY_WORD))
        return F.when(s != "", F.least(F.lit(1.0), odd / F.regexp_count(s, F.lit("[^ ]+")))).otherwise(F.lit(1.0))

    return share(c) if squeezed else let(squeeze(c), share)


def readability(c: Column) -> Column:
    def score(s: Column) -> Column:
        return F.when(
            s != "",
            clamp(clamp(F.length(s) / 160) - symbol_ratio(s) * 0.7 - fragmentation(s, squeezed=True) * 0.5),
        ).otherwise(F.lit(0.0))

    return let(squeeze(c), score)


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.35, "weak").otherwise("failed")


# ---------------------------------------------------------------- classification


def first_match(c: Column, rules, default: str) -> Column:
    text = F.lower(c)
    out = F.when(text.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def question_intent(c: Column, formula_evidence: Column | None = None) -> Column:
    base = first_match(c, X.INTENT, X.INTENT_DEFAULT)
    if formula_evidence is None:
        return base
    return F.when(formula_evidence, "formula").otherwise(base)


def answer_depth(c: Column) -> Column:
    return F.when(F.lower(c).rlike(X.DEPTH_EXPANDED), "expanded").otherwise("concise")


def evidence_policy(c: Column) -> Column:
    return first_match(c, X.POLICY, X.POLICY_DEFAULT)


def is_fact_query(c: Column) -> Column:
    text = F.lower(c)
    return text.rlike(X.FACT_QUERY[0]) | text.rlike(X.FACT_QUERY[1]) | text.rlike(X.FACT_QUERY[2])


def section_type(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(t.isin(*X.SECTION_REFERENCES), "references")
        .when(t.rlike(X.SECTION_METHOD), "method")
        .when(t.rlike(X.SECTION_RESULTS), "results")
        .otherwise("prose")
    )


def chapter(section_id: Column) -> Column:
    return F.substring_index(section_id, ".", 1)


def cross_refs(c: Column) -> Column:
    """The pattern tries every character several times, so only texts that hold one of its words and a number meet it."""
    low = F.lower(c)
    numbered = F.contains(low, F.lit("fig")) | F.contains(low, F.lit("eq")) | F.contains(low, F.lit("table"))
    held = F.contains(low, F.lit("section")) | (numbered & c.rlike("[0-9]"))
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | held, F.regexp_extract_all(c, F.lit(X.CROSS_REF), F.lit(1))).otherwise(none)


def has_formula_markup(c: Column) -> Column:
    return (F.contains(c, F.lit("$")) | F.contains(c, F.lit("\\begin{"))) & c.rlike(X.FORMULA_MARKUP)


def fingerprint(c: Column) -> Column:
    flat = F.regexp_replace(squeeze(F.lower(c)), f"[^0-9a-z{X.CJK} ]+", "")
    return F.left(flat, F.lit(320))


def contains_squeezed(text: Column, term: Column) -> Column:
    return F.contains(F.lower(squeeze(text)), F.lower(squeeze(term)))


def is_slide(content_type: Column, section_type_: Column, section_id: Column) -> Column:
    return (
        F.coalesce(content_type == "slide", F.lit(False))
        | F.coalesce(section_type_ == "slide", F.lit(False))
        | F.coalesce(F.startswith(section_id, F.lit("slide_")), F.lit(False))
    )


def slide_budget(intent: Column, rank: Column, query: Column) -> Column:
    """How many neighbour pairs a slide hit may bring along."""
    return (
        F.when(strip(query) == "", 1)
        .when(intent.isin("figure", "detail"), 0)
        .when(intent == "formula", F.when(rank <= 1, 1).otherwise(0))
        .when(intent == "structure", 1)
        .otherwise(F.when(rank <= 2, 1).otherwise(0))
    )


# ---------------------------------------------------------------- vision text


def vision_field(text: Column, label: str) -> Column:
    return strip(F.regexp_extract(text, f"(?im)^{label}:\\s*(.+)$", 1))


def visual_type(text: Column) -> Column:
    return F.lower(
        F.regexp_extract(text, r"(?im)^Visual type:\s*(formula|table|chart|diagram|mixed)\s*$", 1)
    )


def vision_prefix(text: Column, kind: Column) -> Column:
    found = F.array_compact(
        F.array(
            *[
                F.when(vision_field(text, label) != "", F.concat(F.lit(f"{label}: "), vision_field(text, label)))
                for label in X.VISION_LABELS
            ]
        )
    )
    return (
        F.when(kind == "", "")
        .when(F.size(found) == 0, F.concat(F.lit("Vision "), kind, F.lit(" content")))
        .otherwise(
            F.concat(F.lit("Vision "), kind, F.lit(" summary: "), F.array_join(F.slice(found, 1, 3), " | "))
        )
    )


def vision_caption(text: Column, kind: Column) -> Column:
    return (
        F.when(kind == "table", vision_field(text, "Table summary"))
        .when(kind == "chart", vision_field(text, "Chart summary"))
        .when(kind == "formula", vision_field(text, "Formula summary"))
        .otherwise("")
    )
