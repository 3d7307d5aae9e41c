"""Queries on entity linking: resolution, dense candidates, features, prominence, a reranker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import quantise
from ..operators import linking as L
from .base import query, sql_q

# Names of three lengths for each passage, the shorter inside the longer, and the instrument that each stands for.
NAMES = """names as (select substr(b.text, a, n) as alias, c.ts_code from benchmark b join codes c on c.l_suppkey % 40 = b.item_id % 40
  cross join (select 1 as a, 24 as n union all select 1, 12 union all select 6, 7) l)"""
ASKED = "asked as (select doc_id, content || case when doc_id % 3 = 0 then ' ' || lower(c.ts_code) when doc_id % 3 = 1 then ' ' || substr(c.ts_code, 1, 6) || ' ' else ' 1' || substr(c.ts_code, 1, 6) end as q from news n join codes c on c.l_suppkey = n.doc_id % 97 + 1)"


def names(T):
    cuts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in ((1, 24), (1, 12), (6, 7))])
    passages = T("benchmark").withColumns({"c": F.explode(cuts), "slot": F.col("item_id") % 40}).select("slot", F.substring(F.col("text"), F.col("c.a"), F.col("c.n")).alias("alias"))
    return passages.join(T("codes").select("ts_code", (F.col("l_suppkey") % 40).alias("slot")), "slot").select("alias", "ts_code")


@query("f12_resolution", f"""with recursive {NAMES}, {ASKED},
hits as (select doc_id, alias, row_number() over (partition by doc_id order by length(alias) desc, alias) as k from asked join (select distinct alias from names) n on contains(q, alias)),
walk as (select doc_id, q, 0 as k, '' as alias, false as hit from asked where doc_id in (select doc_id from hits)
  union all select w.doc_id, case when strpos(w.q, h.alias) > 0 then substr(w.q, 1, strpos(w.q, h.alias) - 1) || repeat(chr(1), cast(length(h.alias) as integer)) || substr(w.q, strpos(w.q, h.alias) + length(h.alias)) else w.q end,
    w.k + 1, h.alias, strpos(w.q, h.alias) > 0 from walk w join hits h on h.doc_id = w.doc_id and h.k = w.k + 1),
few as (select * from (select alias, ts_code, row_number() over (partition by alias order by ts_code) as sub from (select distinct alias, ts_code from names) x) y where sub <= 3),
named as (select doc_id, k, alias from walk where hit),
code as (select doc_id, unnest(regexp_extract_all(q, '(?i)\\b[036][0-9]{{5}}\\.(SH|SZ)\\b')) as c, generate_subscripts(regexp_extract_all(q, '(?i)\\b[036][0-9]{{5}}\\.(SH|SZ)\\b'), 1) as pos from asked),
digits as (select doc_id, unnest(regexp_extract_all(q, '[0-9]+')) as d, generate_subscripts(regexp_extract_all(q, '[0-9]+'), 1) as pos from asked),
every as (select doc_id, 0 as stage, pos, 0 as sub, upper(c) as entity from code where upper(c) in (select ts_code from codes)
  union all select doc_id, 1, pos, 0, s.ts_code from digits join (select substr(ts_code, 1, 6) as s, min(ts_code) as ts_code from codes group by 1) s on s.s = d where length(d) = 6 and substr(d, 1, 1) in ('0', '3', '6')
  union all select doc_id, 2, k, f.sub, f.ts_code from named join few f on f.alias = named.alias),
once as (select doc_id, entity, min(stage * 1000000000000 + pos * 1000 + sub) as o from every group by 1, 2)
select doc_id, cast(row_number() over (partition by doc_id order by o) as integer) as place, entity from once""")
def f12(T):
    """Instruments that a query names: by code, by symbol, by alias, the longest first."""
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.lower("ts_code"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.substring("ts_code", 1, 6), F.lit(" "))).otherwise(F.concat(F.lit(" 1"), F.substring("ts_code", 1, 6)))
    asked = T("news").join(T("codes"), F.col("l_suppkey") == F.col("doc_id") % 97 + 1).select("doc_id", F.concat("content", tail).alias("q"))
    return L.resolve(asked, T("codes"), names(T), "doc_id", "q")


@query("f07_codes", r"select doc_id, unnest(regexp_extract_all(q, '(?i)\b[036][0-9]{5}\.(SH|SZ)\b')) as code, 'full' as kind from (select doc_id, content || ' ' || c.ts_code as q from news n join codes c on c.l_suppkey = n.doc_id % 97 + 1) x union all select doc_id, d, 'symbol' from (select doc_id, unnest(regexp_extract_all(content, '[0-9]+')) as d from news) y where length(d) = 6 and substr(d, 1, 1) in ('0', '3', '6')")
def f07_codes(T):
    """Codes with their exchange, and bare symbols of exactly six digits."""
    asked = T("news").join(T("codes"), F.col("l_suppkey") == F.col("doc_id") % 97 + 1).withColumn("q", F.concat_ws(" ", "content", "ts_code"))
    full = asked.select("doc_id", F.explode(L.full_codes(F.col("q"))).alias("code"), F.lit("full").alias("kind"))
    return full.unionByName(T("news").select("doc_id", F.explode(L.symbols(F.col("content"))).alias("code"), F.lit("symbol").alias("kind")))


# Texts and entities as vectors: a document has the vector of its number, an entity that of seven times its number.
UNIT = "select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings"
DENSE = f"""unit as ({UNIT}), tv as (select vec_id as doc_id, v, norm from unit where vec_id in (select doc_id from documents)), ev as (select b.item_id as entity, u.v, u.norm from benchmark b join unit u on u.vec_id = b.item_id * 7),
cand as (select * from (select doc_id, entity, cos, cast(row_number() over (partition by doc_id order by cos desc, entity) as integer) as rank from
  (select t.doc_id, e.entity, round(list_dot_product(t.v, e.v) / (t.norm * e.norm), 9) as cos from tv t cross join ev e) x) y where rank <= 10),
truth as (select n.doc_id, a.item_id as entity from news n join alias a on contains(n.content, a.alias))"""


def dense(T):
    vectors = T("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    entities = T("benchmark").select(F.col("item_id").alias("entity"), (F.col("item_id") * 7).alias("id")).join(vectors, "id").select(F.col("entity").alias("id"), "vector")
    return vectors.join(T("documents").select(F.col("doc_id").alias("id")), "id", "left_semi"), entities


def truth(T):
    return L.link_aliases(T("news").select("doc_id", "content"), T("alias"), "content", "alias").select("doc_id", F.col("item_id").alias("entity")).distinct()


@query("j16_resolve_or_search", f"with {DENSE} select doc_id, entity, 'lexical' as how from truth union select doc_id, entity, 'dense' from cand where cos >= 2e-1 and rank <= 3 and doc_id not in (select doc_id from truth)")
def j16(T):
    texts, entities = dense(T)
    return L.resolve_or_search(truth(T), T("news").select("doc_id"), texts, entities, 10, 0.2, 3)


@query("j21_train_pairs", f"with {DENSE} select c.doc_id, c.entity, {sql_q('c.cos', 6)} as cos, case when t.doc_id is null then 0 else 1 end as label from cand c left join truth t on t.doc_id = c.doc_id and t.entity = c.entity where c.doc_id in (select doc_id from truth)")
def j21(T):
    texts, entities = dense(T)
    return L.labelled(L.candidates(texts, entities, 10), truth(T)).select("doc_id", "entity", quantise(F.col("cos"), 6).alias("cos"), "label")


@query("f14_link_features", f"""with {DENSE}, names as (select b.item_id as entity, substr(b.text, a, n) as alias from benchmark b cross join (select 1 as a, 24 as n union all select 1, 12 union all select 1, 4 union all select 30, 4) l)
select c.doc_id, c.entity, {sql_q('c.cos', 6)} as cos, cast(least(3, (select count(distinct alias) from names x where x.entity = c.entity and contains(n.title, x.alias))) as double) as lex_title,
  cast(least(5, (select count(distinct alias) from names x where x.entity = c.entity and contains(n.content, x.alias))) as double) as lex_content,
  {sql_q('ln(1 + length(n.content))', 6)} as log_content, {sql_q('ln(1 + length(n.title))', 6)} as log_title
from cand c join news n on n.doc_id = c.doc_id""")
def f14(T):
    texts, entities = dense(T)
    found = L.features(L.candidates(texts, entities, 10), T("news"), link_names(T))
    return found.select("doc_id", "entity", quantise(F.col("cos"), 6).alias("cos"), "lex_title", "lex_content", quantise(F.col("log_content"), 6).alias("log_content"), quantise(F.col("log_title"), 6).alias("log_title"))


def link_names(T):
    cuts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in ((1, 24), (1, 12), (1, 4), (30, 4))])
    return T("benchmark").withColumn("c", F.explode(cuts)).select(F.col("item_id").alias("entity"), F.substring(F.col("text"), F.col("c.a"), F.col("c.n")).alias("alias"))


@query("f13_prominence", f"""with {DENSE}, counts as (select item_id as entity, (item_id * 13) % 11 as n from benchmark), top as (select ln(1 + max(n)) as t from counts),
s as (select c.doc_id, c.entity, c.cos, c.cos + 25e-2 * (ln(1 + k.n) / greatest(t, 1e-9)) as score from cand c join counts k on k.entity = c.entity cross join top where c.cos >= 1e-1)
select doc_id, entity, {sql_q('score', 5)} as score, cast(place as integer) as place from (select *, row_number() over (partition by doc_id order by score desc, entity) as place from s) x where place <= 3""")
def f13(T):
    texts, entities = dense(T)
    counts = T("benchmark").select(F.col("item_id").alias("entity"), ((F.col("item_id") * 13) % 11).alias("n"))
    found = L.prominent(L.candidates(texts, entities, 10), counts, 3, 0.1)
    return found.select("doc_id", "entity", quantise(F.col("score"), 5).alias("score"), "place")


@query("l23_reranker")
def l23(T):
    """Held-out pairs with the reranker's probability; labels are the documents' aliases and, so that both exist on small tables, near entities by number."""
    texts, entities = dense(T)
    found = L.candidates(texts, entities, 10)
    rows = L.features(found, T("news"), link_names(T)).withColumn("label", ((F.col("rank") <= 2) | (F.col("lex_content") >= 2)).cast("int"))
    _, held = L.train_reranker(rows)
    return held.select("doc_id", "entity", F.col("label").cast("int").alias("label"), F.round("p", 3).alias("p"))
