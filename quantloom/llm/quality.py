"""Quality classifier: gated-attention multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, released
from .vector import BLOCK, blocks, sliced, words_of

PASSAGE = 64
#: Labelled documents to fit on at most; all passages of each count, as in scoring.
FIT_DOCS = 6_000
HIDDEN, GATE = 12, 8
THRESHOLD = 0.3

# Classes of bytes whose shares describe a passage.
CLASSES = [
    bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>", b"|", b".,;:", b"!?", b"\"'()[]{}-_/\\@+=~^`", b"\n", bytes(range(128, 256)),
]
N_FEATURES = len(CLASSES) + 7


def _class_table() -> np.ndarray:
    table = np.zeros((len(CLASSES), 256), np.uint8)
    for k, chars in enumerate(CLASSES):
        table[k, list(chars)] = 1
    return table


_TABLE = _class_table()


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages before each text and after the last).

    A passage is 64 words, the last one shorter; a text without words is one
    passage of zeros.
    """
    w = words_of(texts)
    counts = np.diff(w.first)
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    x = np.zeros((int(bounds[-1]), N_FEATURES), np.float32)
    if not len(w.starts):
        return x, bounds
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per_doc)
    first = np.repeat(w.first[:-1], per_doc) + at * PASSAGE
    last = np.minimum(first + PASSAGE, np.repeat(w.first[1:], per_doc))
    filled = last > first
    low, high = w.starts[first[filled]], w.ends[last[filled] - 1]
    size = np.maximum(1, high - low).astype(np.float32)
    for k in range(len(CLASSES)):
        total = np.concatenate([[0], np.cumsum(_TABLE[k][w.data], dtype=np.int64)])
        x[filled, k] = (total[high] - total[low]) / size
    n = (last - first)[filled].astype(np.float32)
    passage = np.repeat(np.flatnonzero(filled), (last - first)[filled])
    length = (w.ends - w.starts).astype(np.float64)
    sums = lambda v: np.bincount(passage, v, len(x))[filled]
    mean = sums(length) / n
    h = w.hashes()
    order = np.lexsort((h, passage))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    k = len(CLASSES)
    x[filled, k] = mean / 16
    x[filled, k + 1] = np.sqrt(np.maximum(sums(length * length) / n - mean * mean, 0)) / 16
    x[filled, k + 2] = np.bincount(passage[order], fresh, len(x))[filled] / n
    x[filled, k + 3] = sums(same) / n
    x[filled, k + 4] = np.log1p(n) / np.log1p(PASSAGE)
    x[filled, k + 5] = sums((w.data[w.ends - 1] == ord("!")).astype(np.float64)) / n
    x[filled, k + 6] = 1
    return x, bounds


class Model:
    """score = sigmoid(c . sum_k a_k h_k + d), h = tanh(W x + b), a = softmax over passages of w . (tanh(V h) * sigmoid(U h))."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        shapes = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 0.3, s) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, low, per = self.p, bounds[:-1], np.diff(bounds)
        f = {"x": (x - self.mean) / self.scale}
        f["h"] = np.tanh(f["x"] @ p["W"] + p["b"])
        f["t"], f["s"] = np.tanh(f["h"] @ p["V"]), 1 / (1 + np.exp(-(f["h"] @ p["U"])))
        e = (f["t"] * f["s"]) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, low), per))
        f["a"] = e / np.repeat(np.add.reduceat(e, low), per)
        f["z"] = np.add.reduceat(f["a"][:, None] * f["h"], low)
        f["y"] = 1 / (1 + np.exp(-np.clip(f["z"] @ p["c"] + p["d"], -30, 30)))
        return f

    def gradient(self, f: dict[str, np.ndarray], bounds: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the documents."""
        p, per = self.p, np.diff(bounds)
        dy = (f["y"] - target) / len(target)
        dz = np.repeat(dy[:, None] * p["c"], per, 0)
        from_z = (dz * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["a"] * from_z, bounds[:-1]), per)
        de = f["a"] * (from_z - mean)
        dts = de[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
            "w": (de[:, None] * f["t"] * f["s"]).sum(0), "c": f["z"].T @ dy, "d": np.array([dy.sum()]),
        }

    def fit(self, x: np.ndarray, bounds: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Model:
        """Adam on all documents at once."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            g = self.gradient(self.forward(x, bounds), bounds, target)
            for k, a in self.p.items():
                step = g[k].astype(np.float32) + decay / len(target) * a
                m[k], v[k] = 0.9 * m[k] + 0.1 * step, 0.99 * v[k] + 0.01 * step * step
                a -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return self


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents, the first by a hash of the id, with their mean label as ``target``."""
    mean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("target"))
    chosen = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _texts(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in part.column(column).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_DOCS) -> Model | None:
    """Fit on all passages of a bounded sample of documents; None where no document is labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = _texts(batch, 0)
            for low, high in blocks(texts, BLOCK // 4):
                x, bounds = encode(texts[low:high])
                rows = [x[bounds[d] : bounds[d + 1]].tobytes() for d in range(high - low)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(low, high - low)], ["x", "target"])

    lean(docs.sparkSession)
    rows = fit_rows(docs, labels, label, limit).select(F.col("text").cast("binary"), F.col("target").cast("double"))
    found = rows.mapInArrow(released(run), "x binary, target double").toArrow().sort_by([("target", "ascending"), ("x", "ascending")])
    if not found.num_rows:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found.column("x").to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model().fit(np.concatenate(bags), bounds, found.column("target").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` and ``top_passage``, the index of the passage of most weight.

    Every passage counts.  Null and empty texts are one empty passage; without
    a model all scores are 0.5.  Columns of these names are replaced.
    """
    lean(docs.sparkSession)
    rows = docs.drop("score", "top_passage")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, ys, tops = [(t or "").encode() for t in batch.column(at).to_pylist()], [], []
            for low, high in blocks(texts, BLOCK // 4):
                x, bounds = encode(texts[low:high])
                if model is None:
                    ys.append(np.full(high - low, 0.5))
                    tops.append(np.zeros(high - low, np.int64))
                    continue
                f = model.forward(x, bounds)
                ys.append(f["y"].astype(np.float64))
                order = np.lexsort((-f["a"], np.repeat(np.arange(high - low), np.diff(bounds))))
                tops.append(order[bounds[:-1]] - bounds[:-1])
            out = [pa.array(np.concatenate(v) if v else [], t) for v, t in ((ys, pa.float64()), (tops, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "score", "top_passage"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return rows.mapInArrow(released(run), ", ".join([*fields, "score double", "top_passage long"]))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, held_out, score, predicted and the passage of most weight."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    scored = score(docs, train(docs, labels)).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "top_passage")
