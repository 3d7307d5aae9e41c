"""Token counts by finite-state transducers that are compiled from a byte-level BPE tokenizer.

Two deterministic transducers run one after the other.  The first reads
characters and marks where words start; chunks of characters become maps from
its states to its states, and a parallel prefix scan composes the maps, so
that every chunk knows the state it starts in.  The second reads the bytes of a
word; each of its transitions carries the number of tokens that it adds to the
encoding so far, which is negative where a longer token takes the place of
several.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, unused
from .vector import blocks, sliced

#: Characters of a chunk, whose map is found on its own.
CHUNK = 256
#: Bytes of texts that are read together, and characters of a longer text that are read at a time.
BLOCK = 1 << 20
#: Words whose counts a worker remembers, and states it has compiled; both are emptied, not trimmed, when full.
REMEMBERED = 300_000
STATES = 200_000
NEVER = 1 << 60

# States of the splitter: nothing open; a word of letters, digits, other marks, white space; a space that the next word
# takes; one or two more characters of a contraction.
FRESH, LETTERS, DIGITS, MARKS, BLANKS, LEAD, ONE_MORE, TWO_MORE = range(8)
# Symbols: classes of characters (a blank that ends its run before a word is LAST, or LAST_SPACE if it is a space), an
# apostrophe before one or two letters of a contraction; nothing.  FIRST is added to the first symbol of a text.
LETTER, DIGIT, MARK, BLANK, LAST_SPACE, LAST, QUOTE_1, QUOTE_2 = range(8)
FIRST, NOTHING = 8, 16
# The contractions that the tokenizer's pattern sets apart, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a word start) per symbol and state."""
    to, starts = np.zeros((17, 8), np.uint8), np.zeros((17, 8), bool)
    opened = {LETTER: LETTERS, DIGIT: DIGITS, MARK: MARKS, BLANK: BLANKS, LAST_SPACE: LEAD, LAST: FRESH, QUOTE_1: ONE_MORE, QUOTE_2: TWO_MORE}
    goes_on = {LETTER: (LETTERS, LEAD), DIGIT: (DIGITS, LEAD), MARK: (MARKS, LEAD), BLANK: (BLANKS,), QUOTE_1: (MARKS, LEAD), QUOTE_2: (MARKS, LEAD)}
    for symbol, new in opened.items():
        for state in range(8):
            if state in (ONE_MORE, TWO_MORE):
                to[symbol, state] = ONE_MORE if state == TWO_MORE else FRESH
            elif state in goes_on.get(symbol, ()):
                to[symbol, state] = MARKS if symbol in (QUOTE_1, QUOTE_2) else new
            else:
                to[symbol, state], starts[symbol, state] = new, True
        to[symbol + FIRST], starts[symbol + FIRST] = new, True
    to[NOTHING] = np.arange(8)
    return to, starts


TO, STARTS = splitter()


def run_chunks(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(does a word start, per symbol; last state) from ``state`` on: chunk maps, their scan, then each chunk from its own first state."""
    lanes = np.full(-(-len(symbols) // CHUNK) * CHUNK, NOTHING, np.uint8)
    lanes[: len(symbols)] = symbols
    steps = np.ascontiguousarray(lanes.reshape(-1, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (steps.shape[1], 1))
    for step in steps:
        maps = TO[step[:, None], maps]
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    now = np.concatenate([[state], maps[:-1, state]]).astype(np.uint8)
    found = np.empty(steps.shape, bool)
    for k, step in enumerate(steps):
        found[k] = STARTS[step, now]
        now = TO[step, now]
    return found.T.ravel()[: len(symbols)], int(maps[-1, state])


class Merges:
    """The merge rules of a vocabulary of bytes, and which tokens may stand side by side."""

    def __init__(self, rules: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(rules)}
        self.parts = {left + right: (left, right) for left, right in rules}
        self.made = {left + right: k for (left, right), k in self.rank.items()}
        self._ends: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.sound = {bytes([b]) for b in range(256)}
        for token in sorted(self.parts, key=self.made.__getitem__):
            left, right = self.parts[token]
            if left in self.sound and right in self.sound and self.first_crossing(left, right) == (left, right):
                self.sound.add(token)

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) end of a token while it is merged, from its byte up, each with the rank of the rule that ends it."""
        key = (token, side)
        if key not in self._ends:
            out, end = [(token, NEVER)], token
            while end in self.parts:
                rank, end = self.made[end], self.parts[end][side]
                out.append((end, rank))
            self._ends[key] = out[::-1]
        return self._ends[key]

    def first_crossing(self, left: bytes, right: bytes) -> tuple[bytes, bytes] | None:
        """The first pair that is merged across the border of two tokens; None if they stay apart.

        Rules apply by rank, equal ones from the left; a token's parts have lower ranks than the token.
        """
        a, b, i, j = self.spine(left, 1), self.spine(right, 0), 0, 0
        while True:
            (x, ends_x), (y, ends_y) = a[i], b[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < ends_x and rank <= ends_y:
                return x, y
            if ends_x == ends_y == NEVER:
                return None
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1


class Joins(dict):
    """Whether two tokens may stand side by side."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, pair: tuple[bytes, bytes]) -> bool:
        self[pair] = found = self.merges.first_crossing(*pair) is None
        return found


class State(dict):
    """A state of the word transducer: byte -> (state, tokens added), compiled when first asked for."""

    __slots__ = ("live", "owner")

    def __missing__(self, byte: int) -> tuple[State, int]:
        self[byte] = found = self.owner.compile(self.live, byte)
        return found


class WordTransducer:
    """Counts the tokens of a word byte by byte.

    The encoding of a prefix ends in the one token that may follow the
    encoding of what is before it.  So a state holds, for every place from
    which a token may still grow to the current end, the path of that token, the token before the place, and the
    tokens counted since.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: dict[tuple[int, int], int] = {}
        self.token: list[bytes | None] = [None]
        self.inner: set[int] = set()
        for token in merges.sound:
            node = 0
            for byte in token:
                if (node, byte) not in self.child:
                    self.child[node, byte] = len(self.token)
                    self.token.append(None)
                    self.inner.add(node)
                node = self.child[node, byte]
            self.token[node] = token
        self.forget()

    def forget(self) -> None:
        self.joins = Joins(self.merges)
        self.states: dict[tuple, State] = {}
        self.start = self.state(((0, None, 0),))

    def state(self, live: tuple) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State()
            found.live, found.owner = live, self
        return found

    def compile(self, live: tuple, byte: int) -> tuple[State, int]:
        if len(self.states) > STATES:
            self.forget()
        last = added = None
        grown = []
        for node, before, counted in live:
            node = self.child.get((node, byte))
            if node is None:
                continue
            grown.append((node, before, counted))
            token = self.token[node]
            if last is None and token is not None and (before is None or self.joins[before, token]):
                last, added = token, 1 - counted
        items = [(node, before, counted + added) for node, before, counted in grown if node in self.inner]
        return self.state((*items, (0, last, 0))), added

    def run(self, state: State, word: bytes) -> tuple[State, int]:
        n = 0
        for byte in word:
            state, added = state[byte]
            n += added
        return state, n


class Counts(dict):
    """Tokens of whole words."""

    def __init__(self, words: WordTransducer):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.words.run(self.words.start, word)[1]
        return n


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenCounter:
    """Counts of tokens for a byte-level BPE file of the ``tokenizers`` library, without special tokens around the texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE without a normalizer is compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings aren't compiled")
        from tokenizers import pre_tokenizers

        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        byte = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.words = WordTransducer(Merges([(bytes(map(byte.__getitem__, a)), bytes(map(byte.__getitem__, b))) for a, b in pairs]))
        self.counts = Counts(self.words)
        added = sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(added)) if added else None
        self.kinds = np.full(0x110000, NOTHING, np.uint8)

    def kind(self, points: np.ndarray) -> np.ndarray:
        """Letter, digit, blank or other mark; a new character's class is how the tokenizer's own splitter joins it."""
        found = self.kinds[points]
        new = found == NOTHING
        if new.any():
            for c in np.unique(points[new]).tolist():
                joins = [k for k, other in ((LETTER, "a"), (DIGIT, "1"), (MARK, "!")) if len(self.split.pre_tokenize_str(other + chr(c))) == 1]
                self.kinds[c] = joins[0] if joins else BLANK
            found = self.kinds[points]
        return found

    def symbols(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The splitter's input: classes with what follows, up to the end of the text."""
        kind = self.kind(points)
        after = np.append(points[1:], 0)
        after[last] = 0
        blank_after = np.append(kind[1:] == BLANK, True) | last
        out = np.where((kind == BLANK) & ~blank_after, np.where(points == 0x20, LAST_SPACE, LAST), kind)
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):
            second = np.append(after[1:], 0)
            one, two = after[quotes], np.where(last[quotes], 0, second[quotes])
            for c in CONTRACTIONS:
                hit = (one == ord(c[0])) & ((len(c) == 1) | (two == ord(c[-1])))
                out[quotes[hit]] = QUOTE_1 if len(c) == 1 else QUOTE_2
        return (out + np.where(first, FIRST, 0)).astype(np.uint8)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, parts, owner = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            own = [text]
            if self.added:
                own = self.added.split(text)
                out[k] = len(own) - 1
            for part in own:
                if len(part) > BLOCK:
                    out[k] += self.long(part)
                elif part:
                    parts.append(part)
                    owner.append(k)
        if parts:
            for k, n in zip(owner, self.short(parts), strict=True):
                out[k] += n
        return out

    def short(self, texts: list[str]) -> list[int]:
        """Tokens of texts that aren't empty, read as one run of characters."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
        last[ends - 1] = True
        first[0], first[1:] = True, last[:-1]
        starts, _ = run_chunks(self.symbols(points, first, last), FRESH)
        at = np.flatnonzero(starts)
        data, edges = whole.encode("utf-8", "surrogatepass"), self.byte_places(points, at)
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        n = [self.counts[data[a:b]] for a, b in pairwise(edges)]
        total = np.concatenate([[0], np.cumsum(n)])
        border = np.concatenate([[0], np.searchsorted(at, ends)])
        return np.diff(total[border]).tolist()

    def long(self, text: str) -> int:
        """Tokens of one text, a block at a time: the states of both transducers are carried over."""
        state, n = FRESH, 0
        word = self.words.start
        for low in range(0, len(text), BLOCK):
            part = text[low : low + BLOCK + 2]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
            size = min(BLOCK, len(text) - low)
            first, last = np.zeros(len(points), bool), np.zeros(len(points), bool)
            first[0], last[-1] = low == 0, low + len(points) == len(text)
            starts, state = run_chunks(self.symbols(points, first, last)[:size], state)
            at = np.flatnonzero(starts)
            data, edges = part[:size].encode("utf-8", "surrogatepass"), self.byte_places(points[:size], at)
            if not len(at):
                word, more = self.words.run(word, data)
                n += more
                continue
            n += self.words.run(word, data[: edges[0]])[1]
            n += sum(self.counts[data[a:b]] for a, b in pairwise(edges[:-1]))
            word, more = self.words.run(self.words.start, data[edges[-2] :])
            n += more
        return n

    @staticmethod
    def byte_places(points: np.ndarray, at: np.ndarray) -> list[int]:
        """Bytes before each of the given characters, and in all."""
        size = np.ones(len(points), np.int64)
        for least in (0x80, 0x800, 0x10000):
            size += points >= least
        ends = np.cumsum(size)
        return [*(ends[at] - size[at]).tolist(), int(ends[-1])]


_COUNTERS: dict[str, TokenCounter] = {}


def counter_of(path: str) -> TokenCounter:
    """The process's counter for a tokenizer: a worker keeps what it has compiled from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` without the text, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null texts count as empty ones: no bytes, no tokens.  Texts are read where
    they lie, without a shuffle; a text of any length is read whole, a block at
    a time.  Strings of added tokens inside a text are one token each, as the
    library has it by default.  Repeated rows are counted each; columns of
    ``docs`` that have the names of the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    body = unused(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for part in sliced(batches):
            texts = part.column(part.num_columns - 1).to_pylist()
            n: list[int] = []
            for low, high in blocks(texts, BLOCK):
                n += counter.count([t.decode("utf-8", "replace") for t in texts[low:high]])
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    lean(docs.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "n_bytes long", "n_tokens long", "over_limit boolean"]))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
