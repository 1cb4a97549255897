"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import ann, decontaminate, infill, language, licences, main_text, manifest, mixing, neardup, quality, sharding, toxicity, urls
from lectern.llm.columns import ascii_lower, crc_remainder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
with d as (select doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select cast(item_id as varchar) item, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from benchmark),
win as (select distinct item, array_to_string(w[i:i + 12], ' ') gram, least(len(w), 13) n
        from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
lens as (select distinct n from win),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) i from d),
hit as (select a.doc_id, a.i, win.n, win.item from pos a join lens on true join win
        on win.n = lens.n and win.gram = array_to_string(a.w[a.i:a.i + lens.n - 1], ' ') where a.i + lens.n - 1 <= len(a.w)),
cover as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
named as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from hit group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(c.n_hit, 0) n_hit, coalesce(n.n_items, 0) n_items,
       sha256(coalesce(n.ids, '')) items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) contaminated
from d left join cover c using (doc_id) left join named n using (doc_id)"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


OP3_SQL = r"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages)
select page_id, host, path,
  case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
       when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
       when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/'
       when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
       when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/' end as rule,
  case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'allow'
       when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'block'
       when (host = 'net' or host like '%.net') and (starts_with(path, '/es/') or starts_with(path, '/fr/')) then 'block'
       else 'allow' end as verdict
from u"""


@query("op3_url_filter", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _learnable(held_out):
    return ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quality.grade(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), _learnable(quality.held_out))
    return graded.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _sql_canonical(text: str) -> str:
    out = f"translate(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, '{licences.COPYRIGHT_LINE}', '', 'g')"
    out = f"'  ' || replace(regexp_replace({out}, '{licences.NOT_WORD}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for spelling, one in licences.SPELLINGS:
        padded = spelling.replace(" ", "  ")
        out = f"replace({out}, ' {padded} ', ' {one} ')"
    return f"trim(regexp_replace({out}, '[ \\n]+', ' ', 'g'), ' ')"


def _sql_texts() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in licences.KNOWN.items() for text in texts)


OP5_SQL = f"""
with known as (select sha256({_sql_canonical('t')}) k, min(l) licence from (values {_sql_texts()}) v(l, t) group by 1),
c as (select doc_id, text, {_sql_canonical('text')} c from documents),
whole as (select doc_id, case when c <> '' then sha256(c) end digest from c),
lines as (select doc_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) line from documents),
said as (select doc_id, string_agg(distinct licence, ',' order by licence) notices, count(*) n_notices
         from (select doc_id, sha256({_sql_canonical('line')}) k from lines) join known using (k) group by doc_id)
select w.doc_id, w.digest, k.licence, coalesce(s.notices, '') notices, coalesce(s.n_notices, 0) n_notices
from whole w left join known k on k.k = w.digest left join said s using (doc_id)"""


@query("op5_licence_scan", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_digests(spark))


@query("op6_mix_sources")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = toxicity.grade(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), _learnable(toxicity.held_out))
    return graded.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(_learnable(language.held_out)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


OP10_SQL = r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select distinct doc_id, hash(list_slice(w, i, i + 4)) g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
r as (select doc_id x, doc_id c from d union select e.y, r.c from r join e on e.x = r.x),
m as (select x, min(c) c from r group by x)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id, d.doc_id = m.c kept
from d join m on m.x = d.doc_id left join n using (doc_id)"""


@query("op10_near_duplicates", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_nearest_vectors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


@query("op2_main_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_shard")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    none = F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", none.alias("grown_shard"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
l as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, cast('0x' || h[1:8] as bigint) h1, cast('0x' || h[9:16] as bigint) h2,
             cast('0x' || h[17:24] as bigint) h3, cast('0x' || h[25:32] as bigint) h4 from d),
c as (select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end form from l),
p as (select *, array_to_string(u[1:a], '') x, array_to_string(u[a + 1:b], '') y, array_to_string(u[b + 1:], '') z from c)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(x) as bigint) end prefix_chars,
       case when form <> 'plain' then cast(length(y) as bigint) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) output_sha256,
       sha256(t) restored_sha256
from p"""


@query("op12_infill", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _sql_leaf(text: str) -> str:
    fields = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


OP13_SQL = f"""
with recursive bits(doc_id, s, i, c) as (
  select doc_id, cast(doc_id as varchar), 0, cast(4294967295 as bigint) from documents where doc_id is not null
  union all
  select doc_id, s, i + 1, list_reduce(range(8), lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, xor(c, cast(ascii(s[i + 1]) as bigint)))
  from bits where i < length(s)),
crc as (select distinct doc_id, xor(c, 4294967295) crc from bits where i = length(s)),
leaves as (select doc_id, lang, {_sql_leaf('text')} leaf, {_sql_leaf(LOWER)} lower_leaf from documents),
placed as (select l.*, coalesce(c.crc % 3 = 0, false) bad, row_number() over (partition by lang order by l.doc_id nulls first, leaf) - 1 pos,
                  count(*) over (partition by lang) n, dense_rank() over (order by encode(lang) nulls first) - 1 tree from leaves l left join crc c on c.doc_id = l.doc_id),
nodes(tree, pos, n, lvl, digest) as (
  select tree, pos, n, 0, leaf from placed
  union all
  select tree, pos // 8, (n + 7) // 8, lvl + 1, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by tree, pos // 8, n, lvl),
tops as (select tree, digest, lvl from nodes where n = 1),
over_(pos, n, lvl, digest) as (
  select tree, count(*) over (), 0, digest from tops
  union all
  select pos // 8, (n + 7) // 8, lvl + 1, sha256(string_agg(digest, '' order by pos)) from over_ where n > 1 group by pos // 8, n, lvl),
every as (select tree, lvl, pos, digest from nodes where n > 1
          union all select t.tree, t.lvl + o.lvl, o.pos, o.digest from tops t join over_ o on o.n > 1),
path(tree, pos, doc_id, leaf, here, lvl, sibs, fold) as (
  select tree, pos, doc_id, leaf, pos, 0, '', case when bad then lower_leaf else leaf end from placed
  union all
  select p.tree, p.pos, p.doc_id, p.leaf, any_value(case when p.lvl + 1 = t.lvl then p.tree else p.here // 8 end), p.lvl + 1,
         any_value(p.sibs) || coalesce(string_agg(e.digest, '' order by e.pos) filter (where e.pos <> p.here), ''),
         sha256(string_agg(case when e.pos = p.here then p.fold else e.digest end, '' order by e.pos))
  from path p join tops t on t.tree = p.tree join every e on e.tree = p.tree and e.lvl = p.lvl and e.pos // 8 = p.here // 8
  group by p.tree, p.pos, p.doc_id, p.leaf, p.lvl),
ends as (select * from path qualify row_number() over (partition by tree, pos order by lvl desc) = 1)
select e.doc_id, e.leaf, t.digest subroot, r.digest root, sha256(e.sibs) proof_sha256, e.fold folded_root, e.fold = r.digest verified
from ends e join tops t on t.tree = e.tree join over_ r on r.n = 1"""


@query("op13_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    tampered = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in manifest.FIELDS]
    presented = F.when(crc_remainder(F.col("doc_id"), 3) == 0, manifest.leaf(tampered))
    proven = manifest.build(docs, presented=presented)
    proven = proven.withColumn("folded_root", manifest.folded(F.col("path"), F.coalesce("presented", "leaf")))
    proof = F.sha2(manifest.siblings(F.col("path")), 256)
    return proven.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
