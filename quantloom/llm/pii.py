"""Personal data: base patterns, and identifiers that bootstrapped contexts add to them.

Base matches are the seeds.  Secrets have no base expression: long hexadecimal
words are their seeds, which become spans only where a trusted pattern holds
them.  The words around a match form lexical patterns;
patterns and instances (the matched strings) form a graph with one edge per
distinct pair.  In rounds, a pattern's score for a kind is the mean trust of
its instances: one for seeds, and for an unseen instance the best score among
its *other* patterns that are above the precision, so that no pattern vouches
for itself and none below the precision for another.  Patterns above the
precision with enough trusted instances mark unseen strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, unused, written

KINDS = ("email", "ip", "card", "phone")
#: What patterns may find besides; its seeds are hexadecimal words with letters and digits.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")
SECRET_SEED = r"^[^0-9A-Za-z]*(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}[^0-9A-Za-z]*$"
# The contract's expressions, in forms that scan in linear time.
# A match begins where the last one ended or where its first character's run begins.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
SPACE = r"\x20\x09-\x0D"
#: A word with a digit or an @, from its first character.
CANDIDATE = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
MIN_DIGITS = 4
CONTEXT = 48
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans of a pattern's matches that are valid: what lies between the matches gives their places."""
    none = F.array().cast(SPAN)

    def place(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]

        def step(acc: Column, j: Column) -> Column:
            def put(start: Column) -> Column:
                end = start + F.length(found[j])
                span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), found[j].alias("value")))
                return F.struct(end.alias("at"), F.when(valid(found[j]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

            return let(acc["at"] + F.length(gaps[j]), put)

        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"]))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(both, place)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind as listed; null is empty."""
    found = [F.when(text.rlike(NEEDS[k]), matches(text, PATTERNS[k], i, lambda v, k=k: _valid(k, v))).otherwise(F.array().cast(SPAN)) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _context(text: Column, span: Column) -> Column:
    """Two patterns of a span: the two words before it; the word before and the word after it."""
    left = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    right = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    tidy = lambda x: F.regexp_replace(F.lower(x), "[0-9]", "9")
    word, two = F.regexp_extract(left, rf"([^{SPACE}]+)[{SPACE}]*$", 1), F.regexp_extract(left, rf"([^{SPACE}]+[{SPACE}]+[^{SPACE}]+)[{SPACE}]*$", 1)
    after = F.regexp_extract(right, rf"^[{SPACE}]*([^{SPACE}]+)", 1)
    # A pattern without its words would hold whatever stands at the edge of a text.
    both = F.when(two != "", F.concat(F.lit("B "), tidy(two))), F.when((word != "") & (after != ""), F.concat(F.lit("A "), tidy(word), F.lit(" _ "), tidy(after)))
    return F.array_compact(F.array(*both))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, kind, value, pattern): base spans and seeds of secrets with their kind, candidates with kind null."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = rows.withColumn("base", base_spans(F.col("text")))

    def telling(value: Column) -> Column:
        return (F.length(_digits(value)) >= MIN_DIGITS) | value.contains("@")

    def fresh(span: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    maybe = F.filter(matches(F.col("text"), CANDIDATE, -1, telling), fresh)
    rows = rows.withColumn("span", F.explode(F.concat(F.col("base"), maybe))).withColumn("pattern", F.explode(_context(F.col("text"), F.col("span"))))
    kind = F.when(F.col("span.kind") >= 0, F.col("span.kind")).when(F.col("span.value").rlike(SECRET_SEED), F.lit(SECRET))
    return rows.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        kind.alias("kind"), F.lower("span.value").alias("value"), "pattern",
    )


def score_patterns(found: DataFrame, rounds: int = 3, min_score: float = 0.8, min_seeds: int = 5) -> DataFrame:
    """(pattern, kind, score, seeds) of the patterns to trust, from ``rounds`` passes over the graph."""
    edges = cut(found.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    # A pattern of fewer instances never gets enough that are trusted.
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds)
    edges = cut(edges.join(sizes, "pattern"))
    seeds = edges.where("seed is not null").select("pattern", "n", F.col("seed").alias("kind"), F.lit(1.0).alias("trust"))
    unseen = edges.where("seed is null").select("pattern", "n", "value")

    def judged(trust: DataFrame) -> DataFrame:
        scores = trust.groupBy("pattern", "kind").agg((F.sum("trust") / F.max("n")).alias("score"), F.count("*").alias("seeds"))
        return cut(scores.where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score)))

    scores = judged(seeds)
    for _ in range(rounds - 1):
        given = unseen.join(scores, "pattern").select("value", "kind", "pattern", "score")
        best = given.groupBy("value", "kind").agg(F.max(F.struct("score", "pattern")).alias("best"))
        second = given.join(best, ["value", "kind"]).where(F.col("pattern") != F.col("best.pattern")).groupBy("value", "kind").agg(F.max("score").alias("second"))
        others = best.join(second, ["value", "kind"], "left")
        trust = F.when(F.col("best.pattern") != F.col("pattern"), F.col("best.score")).otherwise(F.col("second"))
        found_by_others = unseen.join(others, "value").select("pattern", "n", "kind", trust.alias("trust")).where("trust is not null")
        scores = judged(seeds.unionByName(found_by_others))
    return scores


def find(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end, value) in code points, end exclusive.

    ``spans`` holds the base spans and those that trusted patterns add; an
    added span never overlaps a base one.  A null text has none; equal rows
    get equal spans; columns of these two names are replaced.
    """
    found = written(occurrences(docs))
    trusted = cut(score_patterns(found, **settings))
    out = docs.drop("base", "spans").withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    if trusted.isEmpty():
        return out.withColumn("spans", F.col("base"))
    best = trusted.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("new_kind"))
    # A seed of a secret is one where a pattern of secrets holds it.
    added = (
        found.where(f"kind is null or kind = {SECRET}").join(best, "pattern").where("kind is null or kind = new_kind")
        .groupBy("doc_id", "text_key", "start", "end").agg(F.min("new_kind").alias("kind"), F.min("value").alias("value"))
    )
    own, key, hashed, more = (unused(out, x) for x in ("own_id", "text_key", "text_hash", "more"))
    added = added.groupBy(F.col("doc_id").alias(own), F.col("text_key").alias(key)).agg(F.collect_set(F.struct("start", "kind", "end", "value")).alias(more))
    joined = out.withColumn(hashed, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(added, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(key)), "left")
    every = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col(more), F.array()).cast(SPAN)))
    return joined.withColumn("spans", every).drop(hashed, own, key, more)


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])
    text = F.coalesce("text", F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), name[s["kind"]])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(F.col("spans"), zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return find(docs, **settings).withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))).drop("base", "spans")


def _digest(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, counts of the base kinds, base_sha256 and all spans, joined."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))
