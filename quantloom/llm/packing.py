"""Best-fit packing of token sequences: bounded space, online, open bins in a bitset keyed by free space."""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, released
from .vector import blocks, words_of

SIZE = 2048
#: Bins a task holds open; the fullest closes when one more is needed.
OPEN_BINS = 1024
#: Sequence numbers of a task start at its partition's number times this.
STRIDE = 1 << 40
#: Words a task remembers; the memory is emptied, not trimmed, when full.
REMEMBERED = 800_000
#: Bytes of texts that are encoded together.
BLOCK = 1 << 20
#: A text of these and of letters beyond ASCII has no other marks than full stops and commas.
PLAIN = (string.ascii_lowercase + "., \t\n\x0b\x0c\r").encode()
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Numbers(dict):
    """The number of each word; a word that is asked for the first time gets the next one and is new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Token ids of texts for a word-end BPE that never joins across ASCII white space.

    Each distinct word is encoded once, all ids lie in one array, and the ids
    of a block of texts are gathered from it at once; inside a block, words are
    told apart by 64-bit hashes.  Texts of letters, full
    stops and commas are lower-cased and their marks set apart first, as the
    tokenizer does itself, which leaves fewer distinct words; words of
    lower-case letters are then encoded many at a time, told apart by the
    word-end tokens.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.limit = REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.ids, self.starts, self.lengths = np.empty(1 << 16, "<u4"), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = 0

    def _put(self, numbers: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.lengths[numbers] = lengths
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)

    def learn(self) -> None:
        """Encode the words that are new."""
        new, self.numbers.new = self.numbers.new, []
        text = b"\n".join(new).decode(errors="replace").split("\n")
        first = len(self.numbers) - len(new)
        while len(self.numbers) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        easy = [i for i, x in enumerate(text) if x.isalpha() and x == x.lower() and (x.isascii() or unicodedata.is_normalized("NFC", x))]
        rest = range(len(text))
        if easy:
            words = [text[i] for i in easy]
            encoded = self.letters.encode_batch_fast([" ".join(words[i : i + 512]) for i in range(0, len(words), 512)], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, "<u4") for e in encoded])
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            if len(ends) == len(easy):
                self._put(first + np.array(easy), flat, np.diff(ends, prepend=0))
                done = set(easy)
                rest = [i for i in rest if i not in done]
        if len(rest):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            self._put(first + np.array(rest), np.fromiter(chain.from_iterable(lists), "<u4", int(lengths.sum())), lengths)

    @staticmethod
    def tidy(text: bytes) -> bytes:
        """A text whose words, between white space, are the tokenizer's own or hold them whole."""
        low = text.lower()
        rest = low.translate(None, PLAIN)
        if (not rest or rest.decode(errors="replace").isalpha()) and not any(x in low for x in (b"..", b",,", b".,", b",.")):
            return low.replace(b".", b" . ").replace(b",", b" , ")
        return text

    def encode(self, texts: list[bytes], after: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and after the last); ``after`` is an id put after each text."""
        if len(self.numbers) > self.limit:
            self.forget()
        w = words_of([self.tidy(t) for t in texts])
        data = w.data.tobytes()
        _, one, at = np.unique(w.hashes(), return_index=True, return_inverse=True)
        known = (data[low:high] for low, high in zip(w.starts[one].tolist(), w.ends[one].tolist(), strict=True))
        at = np.fromiter(map(self.numbers.__getitem__, known), np.int64, len(one))[at]
        if self.numbers.new:
            self.learn()
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], lengths)]
        bounds = ends[w.first]
        if after is None:
            return flat, bounds
        return np.insert(flat, bounds[1:], after), bounds + np.arange(len(bounds))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer: a worker keeps the words it has learnt from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class BestFit:
    """Online best fit with at most ``limit`` open bins.

    ``levels`` has a bit for every free space that some open bin has; the bins
    of a level are a stack.  The lowest bit at or above a length is its best
    fit, the lowest bit of all the fullest bin.
    """

    def __init__(self, first: int, size: int = SIZE, limit: int = OPEN_BINS):
        self.size, self.limit, self.next, self.open = size, limit, first, 0
        self.levels, self.stacks = 0, [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        bin_id = self.stacks[free].pop()
        self.open -= 1
        if not self.stacks[free]:
            self.levels &= ~(1 << free)
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        if length == self.size:
            self.next += 1
            return self.next - 1, 0
        fits = self.levels >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._pop(free)
        else:
            free, bin_id = self.size, self.next
            self.next += 1
            if self.open >= self.limit:
                self._pop((self.levels & -self.levels).bit_length() - 1)
        left = free - length
        if left:
            self.stacks[left].append(bin_id)
            self.levels |= 1 << left
            self.open += 1
        return bin_id, self.size - free


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, open_bins: int = OPEN_BINS, separator: int = 0, remembered: int = REMEMBERED, block: int = BLOCK) -> DataFrame:
    """One row per piece of every document's ids and a separator, with its place in a sequence of ``size`` ids.

    Null and empty texts are the separator alone.  Only documents longer than
    ``size`` are cut.  Each task packs the rows of its partition in their
    order and holds ``open_bins`` bins and one batch, so memory is bounded and
    a lost task repeats with the same numbers.  Repeated rows are packed each.
    A worker remembers the ids of ``remembered`` words and encodes ``block`` bytes of texts together;
    less of either takes less memory and more time, and gives the same ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        encoder.limit = remembered
        bins = BestFit(TaskContext.get().partitionId() * STRIDE, size, open_bins)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int32() if n == "piece" else pa.int64() for n in names]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for low, high in blocks(texts, block):
                rows = []
                tokens, bounds = encoder.encode(texts[low:high], separator)
                bounds = bounds.tolist()
                for k, doc_id in enumerate(ids[low:high]):
                    for piece, at in enumerate(range(bounds[k], bounds[k + 1], size)):
                        cut = tokens[at : min(at + size, bounds[k + 1])]
                        rows.append((doc_id, piece, at - bounds[k], len(cut), zlib.crc32(cut), *bins.put(len(cut))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(released(run), SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
