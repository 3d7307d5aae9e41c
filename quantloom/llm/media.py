"""Media columns: texts stored as progressive JPEGs, decoded to coefficients and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg

UNIT = 192
ROWS = 64


def _append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names)


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` without the text, with its padded UTF-8 bytes as a progressive JPEG and ``n_bytes``, the bytes before padding.

    Null texts are stored as empty ones, which are one unit of spaces.  Equal
    texts give equal files.  Rows are encoded one by one.
    """
    kept = [c for c in docs.columns if c not in (text, media, "n_bytes")]
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                files = [jpeg.encode_payload(t + b" " * (-len(t) % UNIT if t else UNIT)) for t in texts]
                head = pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])
                yield _append(head, {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), media: pa.array(files, pa.binary())})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "n_bytes long", f"`{media}` binary"]))


def describe(image: jpeg.Image) -> str:
    """Size, mean and deviation of each channel, and which of 16 columns are brighter than the one before."""
    total, squares, count, columns = np.zeros(3), np.zeros(3), 0, np.zeros(17)
    for strip in image.rgb_strips():
        wide = strip.reshape(-1, 3).astype(np.int64)
        total, squares, count = total + wide.sum(0), squares + (wide * wide).sum(0), count + len(wide)
        luma = strip.sum((0, 2), dtype=np.int64)
        edges = np.arange(18) * len(luma) // 17
        columns += [luma[a : max(b, a + 1)].mean() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    mean = total / count
    spread = np.sqrt(np.maximum(squares / count - mean * mean, 0))
    bits = int("".join("1" if x > 0 else "0" for x in np.diff(columns)), 2)
    return f"{image.width}x{image.height}|" + ",".join(f"{x:.3f}" for x in mean) + "|" + ",".join(f"{x:.3f}" for x in spread) + f"|{bits:04x}"


def read_media(stored: DataFrame, media: str = "media", pixels: bool = False) -> DataFrame:
    """``stored`` without the files, with what they hold when read back: payload figures, and a feature of the pixels.

    ``pixels`` adds the RGB tensor as bytes with its height and width.
    A null file gives nulls.
    """
    kept = [c for c in stored.columns if c != media]
    rows = stored.select(*kept, media)
    added = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    if pixels:
        added |= {"height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(added)
        image = jpeg.decode(data)
        payload = image.payload()
        out = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), describe(image))
        return (*out, image.height, image.width, image.rgb().tobytes()) if pixels else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                found = list(zip(*[one(x.as_py()) for x in part.column(part.num_columns - 1)], strict=True))
                head = pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])
                yield _append(head, {name: pa.array(values, kind) for (name, kind), values in zip(added.items(), found, strict=True)})

    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{k} {names[v]}" for k, v in added.items())]))


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its payload read back from a stored progressive JPEG, with digests and a feature."""
    return read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
