"""Entity linking: aliases in texts, query resolution, dense candidates, features and a reranker.

Aliases are found by one automaton per task, whose dictionary is sent to the
tasks after its size has been counted.  A larger dictionary meets the texts by
their runs of characters instead.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from . import vectors as V

#: Aliases, and characters of them all, up to which they are one automaton.
MOST_ALIASES = 200_000
MOST_CHARACTERS = 4_000_000
#: Entities that one alias may stand for; aliases of many entities say little.
PER_ALIAS = 3
MASK = "\0"
#: Bytes of texts that are handed to Python at a time.
BATCH_BYTES = 4 << 20


def lean(spark) -> None:
    """Texts go to Python a few megabytes at a time, however many a task has, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Matcher:
    """All aliases of a dictionary that a text contains, at any character."""

    def __init__(self, aliases: list[str]):
        import ahocorasick

        self.empty = "" in aliases
        self.automaton = ahocorasick.Automaton()
        for a in aliases:
            if a:
                self.automaton.add_word(a, a)
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[str, list[int]]:
        """Starts of every alias, in order."""
        found: dict[str, list[int]] = {"": [0]} if self.empty else {}
        if len(self.automaton):
            for end, alias in self.automaton.iter(text):
                found.setdefault(alias, []).append(end - len(alias) + 1)
        return found


def unmasked(places: dict[str, list[int]], length: int) -> list[str]:
    """Aliases that count when the longest are taken first, each hiding its first place from those after it; equal lengths by code point."""
    hidden, out = bytearray(length), []
    for alias in sorted(places, key=lambda a: (-len(a), a)):
        for at in places[alias]:
            if alias and not any(hidden[at : at + len(alias)]):
                hidden[at : at + len(alias)] = b"\1" * len(alias)
                out.append(alias)
                break
    return out


_MATCHERS: dict[str, Matcher] = {}


def _held(token: str, broadcast) -> Matcher:
    """The worker's automaton for the dictionary of this token; it keeps one."""
    if token not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[token] = Matcher(broadcast.value)
    return _MATCHERS[token]


def dictionary(aliases: DataFrame, alias: str):
    """The distinct aliases as a broadcast value, or None if they are too many to send."""
    names = aliases.select(F.col(alias).alias("a")).where("a is not null").distinct()
    n, size = names.agg(F.count("*"), F.coalesce(F.sum(F.length("a")), F.lit(0))).first()
    if n > MOST_ALIASES or size > MOST_CHARACTERS:
        return None
    return aliases.sparkSession.sparkContext.broadcast(sorted(r["a"] for r in names.collect()))


def contained(texts: DataFrame, aliases: DataFrame, text: str, alias: str, name: str, masked: bool = False) -> DataFrame:
    """``texts`` with ``name``, the distinct aliases that its text contains; ``masked`` takes the longest first (see ``unmasked``), in that order.

    A null text has none; null aliases are left out.
    """
    lean(texts.sparkSession)
    held = dictionary(aliases, alias)
    if held is not None:
        token = uuid.uuid4().hex

        @F.pandas_udf("array<string>")
        def find(column):
            matcher = _held(token, held)
            # One text's places at a time.
            return pd.Series([[] if t is None else unmasked(matcher.places(t), len(t)) if masked else sorted(matcher.places(t)) for t in column])

        return texts.withColumn(name, find(F.col(text)))

    @F.pandas_udf("array<string>")
    def order(column, names):
        return pd.Series([[] if t is None else unmasked(Matcher(list(n)).places(t), len(t)) for t, n in zip(column, names, strict=True)])

    pairs = X.link_by_runs(texts.select(text).distinct(), aliases.select(alias).distinct(), text, alias)
    lists = pairs.groupBy(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).agg(F.sort_array(F.collect_list(alias)).alias("_found"))
    met = texts.join(lists, (F.xxhash64(text) == F.col("_h")) & (F.col(text) == F.col("_t")), "left")
    whole = F.coalesce("_found", F.array().cast("array<string>"))
    return met.withColumn(name, order(F.col(text), whole) if masked else whole).drop("_h", "_t", "_found")


def link_aliases(texts: DataFrame, aliases: DataFrame, text: str, alias: str) -> DataFrame:
    """Rows of ``texts`` joined with the aliases they contain, at any character, each pair of rows once."""
    found = contained(texts, aliases, text, alias, "_aliases")
    return found.withColumn("_alias", F.explode("_aliases")).join(aliases, F.col("_alias") == F.col(alias)).drop("_alias", "_aliases")


def full_codes(text: Column) -> Column:
    """Codes with their exchange, in upper case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b[036][0-9]{5}\.(SH|SZ)\b"), F.lit(0)), F.upper)


def symbols(text: Column) -> Column:
    """Runs of six digits, no more, that can be a symbol, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda s: (F.length(s) == 6) & F.substring(s, 1, 1).isin("0", "3", "6"))


def resolve(queries: DataFrame, codes: DataFrame, aliases: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, place, entity): the instruments that a query names, in order, each once.

    Full codes come first, then bare symbols, then aliases, the longest first,
    with their text masked for shorter ones.  ``codes`` has ts_code, ``aliases`` alias and ts_code;
    an alias of many entities gives its first three.  Queries have one row per id.
    """
    known = codes.select("ts_code").distinct()
    by_symbol = known.groupBy(F.substring("ts_code", 1, 6).alias("s")).agg(F.min("ts_code").alias("entity"))
    full = queries.select(id_, F.posexplode(full_codes(F.col(text))).alias("at", "entity")).join(known.withColumnRenamed("ts_code", "entity"), "entity", "left_semi")
    bare = queries.select(id_, F.posexplode(symbols(F.col(text))).alias("at", "s")).join(by_symbol, "s")
    w = Window.partitionBy("alias").orderBy("ts_code")
    few = aliases.select("alias", "ts_code").distinct().withColumn("sub", F.row_number().over(w)).where(F.col("sub") <= PER_ALIAS)
    named = contained(queries.select(id_, text), aliases, text, "alias", "_names", masked=True).select(id_, F.posexplode("_names").alias("at", "alias")).join(few, "alias")
    stages = [d.select(id_, F.struct(F.lit(k).alias("stage"), F.col("at").alias("at"), sub.alias("sub")).alias("o"), F.col(e).alias("entity")) for k, (d, e, sub) in enumerate([(full, "entity", F.lit(0)), (bare, "entity", F.lit(0)), (named, "ts_code", F.col("sub"))])]
    once = stages[0].unionByName(stages[1]).unionByName(stages[2]).groupBy(id_, "entity").agg(F.min("o").alias("o"))
    return once.select(id_, F.row_number().over(Window.partitionBy(id_).orderBy("o")).alias("place"), "entity")


def flavour(text: Column, news_words: list[str], entity_words: list[str]) -> Column:
    """Whether a query asks for news, for entities, or can't be told."""
    has = lambda ws: F.coalesce(F.lower(text).rlike("|".join(f"\\Q{w.lower()}\\E" for w in ws)), F.lit(False))
    news, entity = has(news_words), has(entity_words)
    return F.when(news & ~entity, "news").when(entity & ~news, "entity").otherwise("neutral")


def candidates(text_vectors: DataFrame, entity_vectors: DataFrame, k: int) -> DataFrame:
    """(doc_id, entity, cos, rank): the k nearest entities of each text vector; both tables have id and vector."""
    found = V.top_k(text_vectors, entity_vectors, "id", "vector", k, others=False)
    return found.select(F.col("query_id").alias("doc_id"), F.col("row_id").alias("entity"), F.col("score").alias("cos"), "rank")


def resolve_or_search(hits: DataFrame, texts: DataFrame, text_vectors: DataFrame, entity_vectors: DataFrame, k: int = 10, least: float = 0.5, cap: int = 3) -> DataFrame:
    """(doc_id, entity, how): lexical hits where a text has any; for the others alone, up to ``cap`` of the k nearest entities with cosine ``least`` or more."""
    missing = texts.select("doc_id").distinct().join(hits, "doc_id", "left_anti")
    near = candidates(text_vectors.join(missing, F.col("id") == F.col("doc_id"), "left_semi"), entity_vectors, k)
    dense = near.where((F.col("cos") >= least) & (F.col("rank") <= cap))
    return hits.select("doc_id", "entity", F.lit("lexical").alias("how")).distinct().unionByName(dense.select("doc_id", "entity", F.lit("dense").alias("how")))


def labelled(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates of the texts that have a true entity, with label 1 where they are one; true entities that are no candidates stay out."""
    seen = found.join(truth.select("doc_id").distinct(), "doc_id", "left_semi")
    return seen.join(truth.select("doc_id", "entity", F.lit(1).alias("label")).distinct(), ["doc_id", "entity"], "left").fillna(0, ["label"])


def features(pairs: DataFrame, texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, entity, cos, ...) with the reranker's features: aliases of the entity in title (3 at most) and content (5 at most), log lengths.

    ``texts`` has doc_id, title, content, one row per id; ``aliases`` entity and alias.
    """
    names = aliases.where(F.length("alias") > 0).groupBy("entity").agg(F.collect_set("alias").alias("_names"))
    met = pairs.join(texts.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content")), "doc_id").join(names, "entity", "left")
    hits = lambda c, most: F.least(F.size(F.filter(F.coalesce("_names", F.array().cast("array<string>")), lambda a: F.contains(F.col(c), a))), F.lit(most)).cast("double")
    out = met.withColumns({"lex_title": hits("title", 3), "lex_content": hits("content", 5), "log_content": F.log1p(F.length("content")), "log_title": F.log1p(F.length("title"))})
    return out.drop("title", "content", "_names")


FEATURES = ["lex_title", "lex_content", "cos", "log_content", "log_title"]


def train_reranker(rows: DataFrame, seed_share: float = 0.85):
    """(model, scored rows held out): logistic regression with classes of equal weight; a hash of the pair holds 15 % out.

    The scored rows have ``p``, the probability of label 1.  A single class can't be fitted: ValueError.
    """
    part = F.pmod(F.xxhash64("doc_id", "entity"), F.lit(10_000)) < int(seed_share * 10_000)
    counts = {r["label"]: r["n"] for r in rows.where(part).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError("both labels are needed")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    frame = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows.withColumns({"_w": weight, "label": F.col("label").cast("double")}))
    model = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=200, probabilityCol="_p").fit(frame.where(part))
    return model, rerank(model, frame.where(~part).drop("_x", "_w"))


def rerank(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the model's probability that the entity is meant."""
    frame = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    return model.transform(frame).withColumn("p", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def prominent(found: DataFrame, news_counts: DataFrame, k: int, least: float, weight: float = 0.25) -> DataFrame:
    """(doc_id, entity, cos, score, place): candidates of cosine ``least`` or more by cosine plus ``weight`` times their share of log news, the first k."""
    top = news_counts.agg(F.log1p(F.max("n")).alias("_top"))
    prior = news_counts.join(F.broadcast(top)).select("entity", (F.log1p("n") / F.greatest(F.col("_top"), F.lit(1e-9))).alias("_prior"))
    scored = found.where(F.col("cos") >= least).join(prior, "entity", "left").withColumn("score", F.col("cos") + weight * F.coalesce("_prior", F.lit(0.0)))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "entity")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("doc_id", "entity", "cos", "score", "place")
