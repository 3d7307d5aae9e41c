"""Chat formatting on tokens: segments are encoded apart, reserved ids joined to them, masks are prefix sums."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts

# The control strings of common templates.  Those of TURN have a reserved id each.
TURN = ("<|system|>", "<|user|>", "<|assistant|>", "<|other|>", "<|text|>", "<|end|>")
CONTROLS = (*TURN, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ROLES = {"system": 0, "user": 1, "assistant": 2}
OTHER, TEXT, END = 3, 4, 5
ESCAPE = "\\"

#: The encoder can't take longer runs of white space.
_RUN = re.compile(r"(\s{50000})")
_REST = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")


def escape(text: str) -> str:
    """One backslash more after the first character of each control string and of each that is escaped already."""
    return _PLAIN.sub(lambda m: m[1] + ESCAPE, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Segments to ids and back; the reserved ids follow the vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.reserved = max(ranks.values()) + 1

    def segment(self, text: str) -> list[int]:
        """Ids of a text, escaped and whole; only longer runs of white space than the encoder takes are cut."""
        return [i for part in _RUN.split(escape(text)) if part for i in self.encoding.encode_ordinary(part)]

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a turn: role, text and end, with a mask over the text of an assistant's turn."""
        known = ROLES.get(role)
        head = [self.reserved + (OTHER if known is None else known)]
        if known is None:
            head += self.segment(role)
        head.append(self.reserved + TEXT)
        body = self.segment(text)
        ids = np.array([*head, *body, self.reserved + END], "<u4")
        steps = np.zeros(len(ids) + 1, np.int8)
        if role == "assistant":
            steps[len(head)] += 1
            steps[len(head) + len(body)] -= 1
        return ids, np.cumsum(steps[:-1]).astype(np.uint8)

    def text(self, ids: np.ndarray) -> str:
        return unescape(self.encoding.decode_bytes(ids.tolist()).decode())

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn, from its ids alone."""
        at, end = np.flatnonzero(ids == self.reserved + TEXT)[0], len(ids) - 1
        names = {self.reserved + i: name for name, i in ROLES.items()}
        return names.get(int(ids[0])) or self.text(ids[1:at]), self.text(ids[at + 1 : end])

    def shown(self, ids: np.ndarray) -> str:
        """The formatted text: reserved ids as their control strings, contents escaped."""
        cuts = np.flatnonzero(ids >= self.reserved)
        parts, last = [], 0
        for c in cuts:
            parts += [self.encoding.decode_bytes(ids[last:c].tolist()).decode(), TURN[int(ids[c]) - self.reserved]]
            last = c + 1
        return "".join(parts)


_CODECS: dict[str, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path, pattern)
    return _CODECS[path]


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, ids, mask, n_ids): the tokens of each turn, little-endian unsigned 32-bit.

    Turns are encoded where they lie, before any shuffle.  Null roles and
    texts are empty; roles other than system, user and assistant keep their
    name as a segment of its own.  Repeated rows stay.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                made = [own.turn(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                columns = [pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([m.tobytes() for _, m in made], pa.binary()), pa.array([len(x) for x, _ in made], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], ["conv_id", "turn", "role", "ids", "mask", "n_ids"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, ids binary, mask binary, n_ids long")


def assemble(turns: DataFrame) -> DataFrame:
    """``turns`` with ``position`` and ``start``: the turn's place, and the ids before it, in its conversation.

    By turn, null first, then by role and ids, so that ties have an order.
    A conversation is the concatenation of its rows; none is held whole.  The
    rows of a conversation come out together and in order.
    """
    turns = turns.repartition(shuffle_parts(turns), "conv_id")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "ids")
    before = F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumns({"position": F.row_number().over(w), "start": before})


def read_back(assembled: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per conversation with digests of what the ids and masks hold: a fold over rows in the order of ``assemble``."""
    rows = assembled.select("conv_id", "ids", "mask", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, state = codec(path, pattern), None, None

        def close() -> tuple:
            turns, sha, loss_chars, loss_sha, shown = state
            return key, turns, sha.hexdigest(), loss_chars, loss_sha.hexdigest(), shown

        for batch in batches:
            done = []
            for conv_id, raw, mask, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 1:
                    if state is not None:
                        done.append(close())
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u4")
                role, text = own.read(ids)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learnt = own.text(ids[np.frombuffer(mask, np.uint8) == 1])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(own.shown(ids))
            yield _rows(done)
        if state is not None:
            yield _rows([close()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*done, strict=True) if done else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """Per conversation of ``conversations``, and of probe -1, what is read back from its formatted ids."""
    import public_tokenizers as P

    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    return read_back(assemble(format_turns(given, path, pattern)), path, pattern)
