"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters say yes or nothing about a text: lists of words, lists of word stems
learnt from labelled rows, and patterns.  One ``no`` voter speaks where none
of the lists does.  The label model is a two-class mixture over vote patterns,
fitted by expectation-maximisation on the pattern counts of all documents,
with the labelled training rows held to their class.  Voters whose votes are
still correlated inside a class share one voice.  A sparse logistic regression
over hashed words and stems then learns the posteriors, which for a labelled
training row are its label, and scores texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .quality import _texts, fold
from .vector import BLOCK, blocks, mix, sliced, words_of

THRESHOLD = 0.3
#: Rows to learn from at most: labelled ones for the lists, rows with posteriors for the classifier (half of either side).
LIST_ROWS, FIT_ROWS = 6_000, 8_000
#: Stems of a list and lists of stems.
LIST_SIZE, N_LISTS = 1_200, 6
N_SELECTED = 6_000
#: Sure log-odds of the classifier's features, and of the lists' stems.
SURE, SURE_LIST = 1.0, 2.0
STEMS = (4, 5, 6)
SPLIT = bytes(x for x in range(128) if not (48 <= x < 58 or 65 <= x < 91 or 97 <= x < 123 or x == 95))
# Words of abuse, in groups that vote apart.
LEXICONS = (
    ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "clown", "loser", "retard", "dunce"),
    ("scum", "trash", "garbage", "filth", "vermin", "worthless", "pathetic", "disgusting", "disgrace", "pig"),
    ("hate", "kill", "die", "hurt", "destroy", "shut", "damn", "hell", "bastard", "bitch"),
)
VOTERS = [*(f"words_{k}" for k in range(len(LEXICONS))), *(f"stems_{k}" for k in range(N_LISTS)), "shouting", "exclaiming", "none"]
_SHOUT, _EXCLAIM, _NONE = len(VOTERS) - 3, len(VOTERS) - 2, len(VOTERS) - 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature hash) of the distinct words and stems of each text; capital letters' and exclamation marks' shares."""
    lower = [t.decode().lower().encode() for t in texts]
    w = words_of(lower, SPLIT)
    doc, whole = w.doc, w.hashes()
    found = [(doc, whole)]
    for k in STEMS:
        long = (w.ends - w.starts) > k
        found.append((doc[long], mix(w.hashes(k)[long] ^ np.uint64(k))))
    d, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    size = np.maximum(1, np.array([len(t) for t in texts]))
    capitals = np.array([len(t) - len(t.translate(None, bytes(range(65, 91)))) for t in texts]) / size
    marks = np.array([t.count(b"!") for t in texts]) / size
    return d[fresh], h[fresh], capitals, marks


def word_hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(words_of([" ".join(words).encode()], SPLIT).hashes())


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


@dataclass
class Lists:
    """Sorted feature hashes of each list voter."""

    tables: list[np.ndarray]

    def votes(self, texts: list[bytes]) -> np.ndarray:
        """One bit per voter, as a number per text."""
        d, h, capitals, marks = features(texts)
        out = np.zeros(len(texts), np.int64)
        for k, table in enumerate(self.tables):
            out[np.unique(d[_member(h, table)])] |= 1 << k
        out[out == 0] |= 1 << _NONE
        return out | (capitals > 0.3).astype(np.int64) << _SHOUT | (marks > 0.02).astype(np.int64) << _EXCLAIM


def _presence(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = [np.frombuffer(b, np.uint64) for b in found.column("h").to_pylist()]
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return doc, np.concatenate(rows) if rows else np.zeros(0, np.uint64), found.column("target").to_numpy().astype(np.float64)


def _gather(rows: DataFrame) -> pa.Table:
    """Distinct features of the few rows a model is fitted on, in an order that doesn't depend on tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = _texts(batch, 0)
            for low, high in blocks(texts, BLOCK // 4):
                d, h, _, _ = features(texts[low:high])
                cut = np.searchsorted(d, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), batch.column(1).slice(low, high - low)], ["h", "target"])

    rows = rows.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("target").cast("double"))
    return rows.mapInArrow(run, "h binary, target double").toArrow().sort_by([("target", "ascending"), ("h", "ascending")])


def select(doc: np.ndarray, h: np.ndarray, target: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sure log-odds) of the features that tell the classes apart best.

    Sure are the log-odds less two standard errors, 0 if these reach past it:
    words that a few copies of one document share don't count.
    """
    names, index, rows = np.unique(h, return_inverse=True, return_counts=True)
    yes = np.bincount(index, target[doc], len(names))
    n1, n = target.sum(), len(target)
    no = rows - yes
    a, b, c, e = yes + 0.5, no + 0.5, n1 - yes + 0.5, (n - n1) - no + 0.5
    odds = np.log(a * e / (b * c))
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / e))
    good = np.flatnonzero(np.abs(sure) > SURE)
    good = good[np.lexsort((names[good], -np.abs(sure[good])))][:most]
    return names[good], sure[good]


def learn_lists(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = LIST_ROWS) -> Lists:
    """The fixed lexicons, and the stems that labelled rows of the class have and others hardly, dealt into lists by hash."""
    mean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("target"))
    sides = [mean.where(x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for x in (F.col("target") >= 0.5, F.col("target") < 0.5)]
    found = _gather(docs.select("doc_id", "text").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id"))
    tables = [word_hashes(x) for x in LEXICONS]
    chosen = np.zeros(0, np.uint64)
    if found.num_rows:
        names, odds = select(*_presence(found), LIST_SIZE)
        chosen = names[odds > SURE_LIST]
    tables += [np.sort(chosen[mix(chosen) % np.uint64(N_LISTS) == k]) for k in range(N_LISTS)]
    return Lists(tables)


def vote(docs: DataFrame, lists: Lists) -> DataFrame:
    """``docs`` with ``votes``: bit k is set where voter k speaks."""
    rows = docs.drop("votes")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            votes = [lists.votes(texts[a:b]) for a, b in blocks(texts, BLOCK // 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(votes) if votes else [], pa.int64())], [*batch.schema.names, "votes"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "votes long"]))


@dataclass
class LabelModel:
    """P(class | votes) from each voter's rates in the two classes and its share of voice."""

    prior: float
    rates: np.ndarray
    voice: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.float64)
        with np.errstate(divide="ignore"):
            on, off = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = np.log(self.prior / (1 - self.prior)) + (bits * on + (1 - bits) * off) @ self.voice
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(patterns: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray, steps: int = 40) -> LabelModel:
    """``labelled`` has a column of counts per class; at most two to the number of voters patterns come in."""
    bits = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.float64)
    spoken = bits[:, : len(LEXICONS) + N_LISTS].sum(1)
    q = np.where(spoken >= 2, 0.9, np.where(spoken == 1, 0.5, 0.05))
    model = LabelModel(0.1, np.full((2, len(VOTERS)), 0.5), np.ones(len(VOTERS)))
    for _ in range(steps):
        mass = np.stack([unlabelled * (1 - q) + labelled[:, 0], unlabelled * q + labelled[:, 1]])
        total = mass.sum(1) + 2
        rates = (mass @ bits + 1) / total[:, None]
        corr = np.zeros((len(VOTERS), len(VOTERS)))
        for y in (0, 1):
            off = (bits - rates[y]) * np.sqrt(mass[y] / total[y])[:, None]
            cov = off.T @ off
            sd = np.sqrt(np.diag(cov)) + 1e-6
            corr += np.abs(cov / sd / sd[:, None]) / 2
        np.fill_diagonal(corr, 0)
        model = LabelModel(float(np.clip(total[1] / total.sum(), 1e-4, 0.5)), rates, 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1)))
        q = model.posterior(patterns)
    return model


@dataclass
class Linear:
    names: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        d, h, _, _ = features(texts)
        z = np.full(len(texts), self.bias)
        if len(self.names):
            known = _member(h, self.names)
            z += np.bincount(d[known], self.weights[np.searchsorted(self.names, h[known])], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(doc: np.ndarray, h: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 0.1, l1: float = 2e-5) -> Linear:
    """Logistic regression on soft labels: Adam with soft thresholding over the features that ``select`` keeps."""
    names = np.sort(select(doc, h, target, N_SELECTED)[0])
    known = _member(h, names)
    d, j = doc[known], np.searchsorted(names, h[known])
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for i in range(1, steps + 1):
        z = np.bincount(d, w[j], len(target)) + b
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        g = np.append(np.bincount(j, r[d], len(names)), r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return Linear(names, w, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Lists, LabelModel, Linear]:
    """Lists from labelled rows, label model from the votes of all documents, classifier from a bounded sample of its posteriors.

    ``labels`` holds training rows only.  Without labelled rows the fixed
    lexicons and patterns vote alone; without documents scores are those of
    the prior.
    """
    lists = learn_lists(docs, labels, label)
    mean = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("known"))
    voted = cut(vote(docs.select("doc_id", "text"), lists).drop("text"))
    counts = voted.join(mean, "doc_id", "left").groupBy("votes").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("u", F.col("known").isNull()), ("n0", F.col("known") == 0), ("n1", F.col("known") == 1))]).orderBy("votes").toArrow()
    columns = {n: counts.column(n).to_numpy() for n in ("votes", "u", "n0", "n1")}
    model = fit_label_model(columns["votes"], columns["u"].astype(float), np.stack([columns["n0"], columns["n1"]], 1).astype(float))
    posterior = model.posterior(columns["votes"])
    table = F.broadcast(docs.sparkSession.createDataFrame([(int(v), float(p)) for v, p in zip(columns["votes"], posterior, strict=True)], "votes long, target double"))
    known = F.when(F.col("known").isNotNull(), F.col("known").cast("double")).otherwise(F.col("target"))
    placed = voted.join(table, "votes").join(mean, "doc_id", "left").select("doc_id", known.alias("target"))
    sides = [placed.where(x).groupBy("doc_id").agg(F.max("target").alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS // 2) for x in (F.col("target") >= 0.5, F.col("target") < 0.5)]
    found = _gather(docs.select("doc_id", "text").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id"))
    linear = fit_linear(*_presence(found)) if found.num_rows else Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log(model.prior / (1 - model.prior))))
    return lists, model, linear


def score(docs: DataFrame, linear: Linear) -> DataFrame:
    """``docs`` with ``score``; null texts count as empty, columns of that name are replaced."""
    rows = docs.drop("score")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            ys = [linear.scores(texts[a:b]) for a, b in blocks(texts, BLOCK // 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(ys) if ys else [], pa.float64())], [*batch.schema.names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, held_out, score and predicted."""
    lean(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    scored = score(docs, train(docs, labels)[2]).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
