"""SQL fragments the oracles share. Plain ANSI-like SQL for DuckDB."""

from __future__ import annotations

from lectern.functions import fixed as X

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SYMBOL = r"[\p{L}\p{N}\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"\x{4e00}-\x{9fff}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def listing(values) -> str:
    return f"[{names(values)}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{CJK}]|[a-zA-Z0-9]+')"


def estimate(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '[^{CJK}]', '', 'g'))"
    return f"({cjk} // 2 + (length({x}) - {cjk}) // 4)"


def symbol_ratio(x: str, empty: str = "0.0") -> str:
    return f"(CASE WHEN length({x}) > 0 THEN length(regexp_replace({x}, '{NOT_SYMBOL}', '', 'g')) / length({x}) ELSE {empty} END)"


def repetition(x: str) -> str:
    w = words(f"lower({x})")
    return f"(CASE WHEN len({w}) >= 12 THEN greatest(0.0, 0.5 - len(list_distinct({w})) / len({w})) ELSE 0.0 END)"


def fragmentation(x: str) -> str:
    w = words(x)
    short = f"len(list_filter({w}, lambda t: length(trim(t, '.,;:()[]{{}}')) <= 1))"
    noisy = f"len(list_filter({w}, lambda t: regexp_matches(t, '[?|\\x{{fffd}}]')))"
    return f"(CASE WHEN len({w}) > 0 THEN least(1.0, ({short} + {noisy}) / len({w})) ELSE 1.0 END)"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def readability(x: str) -> str:
    s = squeeze(x)
    return (
        f"(CASE WHEN {s} <> '' THEN {clamp(f'{clamp(f'length({s}) / 160')} - {symbol_ratio(s)} * 0.7 - {fragmentation(s)} * 0.5')}"
        " ELSE 0.0 END)"
    )


def exact(x: str, digits: int) -> str:
    """Correct rounding of the binary value."""
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def settle(x: str, digits: int = 6) -> str:
    p = f"1e{digits}"
    return f"(floor(({x}) * {p} + 0.5) / {p})"


def word(pattern: str) -> str:
    """A pattern between non-word characters, for engines whose \\b knows ASCII only."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])"


def lookup(x: str, table: dict, default) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


def normalized(x: str) -> str:
    """Notation normal form; enough for text whose NFKC form is itself."""
    out = x
    for markup, name in X.LATEX_NAMES:
        out = f"replace({out}, {q(markup)}, {q(name)})"
    out = f"replace(replace({out}, '’', ' prime '), '·', ' dot ')"
    out = f"replace(replace({out}, '^T', ' transpose '), '_', ' ')"
    out = f"regexp_replace({out}, '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return squeeze(out)


# page = line of a document
LINES = """
ln AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS page_num, unnest(parts) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
),
subtype AS (
  SELECT doc_id, CASE WHEN avg(length(text)) < 300 THEN 'slides_pdf' ELSE 'research_paper' END AS doc_subtype
  FROM ln GROUP BY doc_id
),
pg AS (
  SELECT ln.doc_id, page_num, text, length(text) AS n, doc_subtype,
         (page_num + ln.doc_id) % 7 = 0 AS on_image,
         (page_num + ln.doc_id) % 11 = 0 AS on_table,
         (page_num + ln.doc_id) % 13 = 0 AS on_formula
  FROM ln JOIN subtype ON ln.doc_id = subtype.doc_id
)"""

QUALITY = LINES + f""",
m AS (
  SELECT doc_id, page_num, doc_subtype, n, on_image, on_table, on_formula,
         CASE WHEN on_image OR on_table OR on_formula THEN 0.75 ELSE 0.0 END AS vs,
         {symbol_ratio('text')} AS symbols, {repetition('text')} AS repeats,
         CASE WHEN {squeeze('text')} <> '' THEN 1 ELSE 0 END AS n_lines,
         {squeeze('text')}[:180] AS text_preview
  FROM pg
),
s AS (
  SELECT *,
    {clamp(f"{clamp(f'n / {lookup("doc_subtype", X.EXPECTED_CHARS, 400)}')} - symbols * 0.5 - repeats * 0.3")} AS ts,
    least(1.0, 0.3 + CASE WHEN n_lines >= 1 THEN 0.25 ELSE 0.0 END + CASE WHEN n_lines >= 2 THEN 0.2 ELSE 0.0 END
      + CASE WHEN doc_subtype = 'slides_pdf' THEN 0.2 ELSE 0.0 END) AS ss
  FROM m
),
t1 AS (
  SELECT *, ts < 0.3 AND vs < 0.2 AND n_lines >= 1 AS sparse, on_formula AND n >= 20 AS ftext,
    CASE WHEN ts < 0.3 THEN 0.45 ELSE 0.0 END + CASE WHEN vs > 0.4 THEN 0.35 ELSE 0.0 END
      + CASE WHEN ss < 0.3 THEN 0.15 ELSE 0.0 END AS need0,
    {clamp('ts * 0.65 + ss * 0.35')} AS o0
  FROM s
),
t2 AS (
  SELECT *, CASE WHEN sparse THEN greatest(0.0, need0 - 0.35) ELSE need0 END AS need1,
    CASE WHEN vs > 0.5 AND ts < 0.4 THEN {clamp('o0 - 0.25')} ELSE o0 END AS overall
  FROM t1
),
t3 AS (SELECT *, CASE WHEN ftext THEN greatest(0.0, need1 - 0.45) ELSE need1 END AS need FROM t2),
pq AS (
  SELECT doc_id, 'page_' || page_num AS unit_id,
    CASE WHEN doc_subtype = 'slides_pdf' THEN 'slide' ELSE 'page' END AS unit_type,
    page_num AS page_start, page_num AS page_end,
    {exact('ts', 3)} AS text_score, {exact('ss', 3)} AS structure_score, {exact('vs', 3)} AS visual_score,
    {exact('least(1.0, need)', 3)} AS ocr_need_score, {exact('overall', 3)} AS overall_score,
    CASE WHEN overall >= 0.7 THEN 'good' WHEN overall >= 0.35 THEN 'weak' ELSE 'failed' END AS quality,
    CASE WHEN ftext THEN 'keep' WHEN need >= 0.5 AND vs > 0.4 THEN 'ocr'
      WHEN ts < 0.2 AND vs < 0.2 THEN 'keep' WHEN overall < 0.35 AND vs > 0.5 THEN 'ocr' ELSE 'keep' END AS recommended_action,
    list_filter([CASE WHEN ts < 0.3 THEN 'text_low' END, CASE WHEN vs >= 0.5 THEN 'visual_high' END,
      CASE WHEN on_formula AND n < 20 THEN 'formula_signal' END,
      CASE WHEN on_table AND n < 40 THEN 'complex_table_signal' END,
      CASE WHEN on_image AND n < 20 THEN 'diagram_signal' END,
      CASE WHEN sparse THEN 'sparse_but_structured' END,
      CASE WHEN ftext THEN 'formula_text_available' END], lambda r: r IS NOT NULL) AS reasons,
    text_preview
  FROM t3
)"""

# recognised text of a page: the same line of the next document
RECOGNIZED = """
ocr AS (
  SELECT doc_id - 1 AS doc_id, page_num AS page, text,
    CASE (doc_id + page_num) % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'weak' WHEN 2 THEN 'failed' ELSE '' END AS ocr_quality
  FROM ln
)"""


def doubles(sql: str) -> str:
    """Write decimal literals as DOUBLE, the type the scores are defined on."""
    import re

    return re.sub(r"(?<![\w.'\]])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)
