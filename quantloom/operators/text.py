"""News text: normalisation, dedupe, codes, n-grams, alias linking, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def content_hash(text: Column, prefix: int = 200, digits: int = 16) -> Column:
    """First digits of the MD5 of the normalised text's first characters; empty for texts without any."""
    clean = F.substring(normalise(text), 1, prefix)
    return F.when(F.length(clean) > 0, F.substring(F.md5(clean), 1, digits)).otherwise("")


def keep_earliest(news: DataFrame, key: str, order: list[str], exempt: Column) -> DataFrame:
    """The first row per key; rows that are exempt all stay.

    One pass: an exempt row's window is its own, named by its order columns, so
    that an empty key is no hot group.
    """
    own = F.when(exempt, F.concat_ws("|", F.lit("own"), *[F.col(c).cast("string") for c in order])).otherwise(F.concat(F.lit("key|"), F.col(key)))
    w = Window.partitionBy(own).orderBy(*order)
    return news.withColumns({"_n": F.row_number().over(w), "_exempt": exempt}).where("_n = 1 or _exempt").drop("_n", "_exempt")


def dedupe_news(news: DataFrame) -> DataFrame:
    """Pass 1 by content hash, pass 2 by normalised title and day; short titles stay."""
    hashed = news.withColumn("content_hash", content_hash(F.col("content")))
    once = keep_earliest(hashed, "content_hash", ["datetime", "doc_id"], F.col("content_hash") == "")
    titled = once.withColumn("_title", F.concat_ws("|", normalise(F.col("title")), F.to_date("datetime").cast("string")))
    return keep_earliest(titled, "_title", ["datetime", "doc_id"], F.length(normalise(F.col("title"))) < 5).drop("_title")


def ngrams(text: Column, low: int, high: int) -> Column:
    """All runs of low to high characters."""

    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


#: Characters by which texts and aliases meet: the most that the alias has.
ALIAS_CLASSES = (1, 2, 3, 4, 6, 8, 12, 16)


def link_by_runs(texts: DataFrame, aliases: DataFrame, text: str, alias: str) -> DataFrame:
    """Rows of ``texts`` joined with the aliases they contain, at any character, each pair once.

    Aliases are of a few length classes.  Texts and aliases meet on the first
    characters of the alias, as many as its class has, among all runs of so
    many characters of the text; only hashes of texts travel with the runs.
    The containment test then decides.
    """
    k = F.greatest(*[F.when(F.length(alias) >= n, F.lit(n)).otherwise(F.lit(0)) for n in ALIAS_CLASSES])
    keyed = aliases.where(F.col(alias).isNotNull()).select(F.col(alias).alias("_alias"), k.alias("_k"), F.substring(F.col(alias), F.lit(1), k).alias("_g")).distinct()
    sizes = sorted(r["_k"] for r in keyed.select("_k").distinct().collect())
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) if n else F.array(F.lit("")) for n in sizes] or [F.array().cast("array<string>")]
    grams = texts.select(F.xxhash64(text).alias("_h"), F.explode(F.array_distinct(F.concat(*runs))).alias("_g"))
    met = grams.join(keyed, "_g").select("_h", "_alias").distinct()
    pairs = texts.withColumn("_h", F.xxhash64(text)).join(met, "_h").join(aliases.withColumn("_alias", F.col(alias)), "_alias")
    return pairs.where(F.contains(F.col(text), F.col(alias))).drop("_h", "_alias")


def tag_scores(texts: DataFrame, entity: str, text: str, n: int = 4, least_tf: int = 3, most_df: float = 0.5) -> DataFrame:
    """(entity, gram, tf, df, score): term frequency times log of entities over entities with the gram."""
    grams = texts.select(entity, F.explode(ngrams(F.col(text), n, n)).alias("gram"))
    tf = grams.groupBy(entity, "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    total = texts.agg(F.countDistinct(entity).alias("total"))
    scored = tf.where(F.col("tf") >= least_tf).join(df, "gram").crossJoin(F.broadcast(total)).where((F.col("df") >= 2) & (F.col("df") <= most_df * F.col("total")))
    return scored.withColumn("score", F.col("tf") * F.ln(F.col("total") / F.col("df"))).drop("total")
