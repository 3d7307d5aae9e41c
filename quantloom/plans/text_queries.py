"""Queries on news, text and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import quantise
from ..operators import linking as L
from ..operators import text as X
from ..operators import vectors as V
from .base import query, sql_q

NORM = r"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
HASH = f"case when length(substr({NORM.format(c='content')}, 1, 200)) > 0 then substr(md5(substr({NORM.format(c='content')}, 1, 200)), 1, 16) else '' end"


@query("f06_content_hash", f"select doc_id, {HASH} as content_hash from news")
def f06(T):
    return T("news").select("doc_id", X.content_hash(F.col("content")).alias("content_hash"))


@query("d02_dedupe_news", f"""with h as (select *, {HASH} as content_hash, {NORM.format(c='title')} as t from news),
a as (select * from (select *, row_number() over (partition by content_hash order by datetime, doc_id) as n from h) x where n = 1 or content_hash = ''),
b as (select *, row_number() over (partition by t, cast(datetime as date) order by datetime, doc_id) as m from a)
select doc_id, content_hash from b where m = 1 or length(t) < 5""")
def d02(T):
    return X.dedupe_news(T("news")).select("doc_id", "content_hash")


@query("d03_cross_posts", f"select doc_id from (select doc_id, row_number() over (partition by cast(datetime as date), substr({NORM.format(c='title')}, 1, 32) order by datetime, doc_id) as n from news) x where n = 1")
def d03(T):
    d = T("news").withColumn("k", F.concat_ws("|", F.to_date("datetime").cast("string"), F.substring(X.normalise(F.col("title")), 1, 32)))
    return X.keep_earliest(d, "k", ["datetime", "doc_id"], F.lit(False)).select("doc_id")


@query("d04_exact_per_day", r"select cast(datetime as date) as day, count(distinct trim(regexp_replace(content, '\s+', ' ', 'g'))) as n_texts, count(*) as n from news group by 1")
def d04(T):
    d = T("news").withColumn("t", F.trim(F.regexp_replace("content", r"\s+", " ")))
    return d.groupBy(F.to_date("datetime").alias("day")).agg(F.countDistinct("t").alias("n_texts"), F.count("*").alias("n"))


@query("s03_file_dates", "select source, count(*) as n, min(datetime) as first_at from news where datetime >= timestamp '2024-01-05 00:00:00' and datetime < timestamp '2024-01-15 00:00:00' group by 1")
def s03(T):
    d = T("news").where((F.col("datetime") >= "2024-01-05") & (F.col("datetime") < "2024-01-15"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min("datetime").alias("first_at"))


@query("f07_numbers", r"select doc_id, len(regexp_extract_all(content, '[0-9]{6}')) as n_codes from news")
def f07(T):
    return T("news").select("doc_id", F.size(F.regexp_extract_all("content", F.lit("[0-9]{6}"), F.lit(0))).cast("long").alias("n_codes"))


@query("f09_ngrams", "select g as gram, count(*) as n from (select unnest(list_transform(range(1, length(title) - 2), lambda i: substr(title, i, 4))) as g from news where length(title) >= 4) x group by 1 having count(*) >= 20")
def f09(T):
    return T("news").select(F.explode(X.ngrams(F.col("title"), 4, 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 20")


@query("f10_tag_scores", f"""with g as (select source, unnest(list_transform(range(1, length(title) - 2), lambda i: substr(title, i, 4))) as gram from news where length(title) >= 4),
tf as (select source, gram, count(*) as tf from g group by 1, 2), df as (select gram, count(*) as df from tf group by 1)
select tf.source, tf.gram, tf, df, {sql_q('tf * ln((select count(distinct source) from news) / (df * 1e0))', 3)} as score from tf join df on df.gram = tf.gram where tf >= 3 and df >= 2 and df <= 5e-1 * (select count(distinct source) from news)""")
def f10(T):
    return X.tag_scores(T("news"), "source", "title").withColumn("score", quantise(F.col("score"), 3)).select("source", "gram", "tf", "df", "score")


@query("f15_token_estimate", r"select doc_id, cast(ceil(length(regexp_replace(content, '[^\x00-\x7f]', '', 'g')) / 4e0 + (length(content) - length(regexp_replace(content, '[^\x00-\x7f]', '', 'g'))) / 16e-1) as bigint) as tokens from news")
def f15(T):
    ascii_ = F.length(F.regexp_replace("content", r"[^\x00-\x7f]", ""))
    return T("news").select("doc_id", F.ceil(ascii_ / F.lit(4.0) + (F.length("content") - ascii_) / F.lit(1.6)).alias("tokens"))


@query("j14_alias_links", "select n.doc_id, a.item_id from news n join alias a on contains(n.content, a.alias)")
def j14(T):
    return L.link_aliases(T("news").select("doc_id", "content"), T("alias"), "content", "alias").select("doc_id", "item_id").distinct()


@query("f17_norms", f"select vec_id, {sql_q('sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))))', 3)} as norm from embeddings")
def f17(T):
    return T("embeddings").select("vec_id", quantise(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 3).alias("norm"))


@query("j15_vector_top_k", f"""with n as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as norm from embeddings),
p as (select a.vec_id as query_id, b.vec_id as row_id, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) as score from n a join n b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, row_id, cast(rank as integer) as rank, {sql_q('score', 3)} as score from (select *, row_number() over (partition by query_id order by score desc, row_id) as rank from p) x where rank <= 5""")
def j15(T):
    e = T("embeddings")
    return V.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).select("query_id", "row_id", "rank", quantise(F.col("score"), 3).alias("score"))


@query("a08_label_share", "select n.source, cast(n.datetime as date) as day, count(*) as n, avg(case when l.quality = 1 then 1 else 0 end) as good, avg(case when l.toxic = 1 then 1 else 0 end) as toxic from news n join labels l on l.doc_id = n.doc_id group by 1, 2")
def a08(T):
    d = T("news").join(T("labels"), "doc_id")
    return d.groupBy("source", F.to_date("datetime").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("quality") == 1).cast("int")).alias("good"), F.avg((F.col("toxic") == 1).cast("int")).alias("toxic"))


@query("f20_json", "select event_type, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint)) as total from events group by 1")
def f20(T):
    return T("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))
