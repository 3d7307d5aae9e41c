"""Token counts against the tokenizer library itself."""

from __future__ import annotations

import random

import pytest

from quantloom.llm import token_counts

P = pytest.importorskip("public_tokenizers")
ODD = [
    "", "a", " ", "  ", "\n\nfoo", "\n foo", " \nfoo", "it's we'll 's  's !'s'S I'm'd 'stuff ''s", "a<|endoftext|>  <|endoftext|>b c", "\u00a0x \u3000y",
    "Ünïcödé 😀👍🏽 日本語テキスト ١٢٣ ²½", "a" * 9_000, "=" * 700, " " * 1_000 + "x", "\t\tif x:\n        return 1\n\n\n", "a'b 'v 've 'ver 'r", "'", "x'", " 're", "\u2028'll", "don’t",
]


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter(path):
    return token_counts.TokenCounter(path)


def test_odd_texts(counter, library):
    assert counter.count(ODD) == [library(x) for x in ODD]


@pytest.mark.parametrize(("block", "n"), [(1 << 20, 1_500), (50, 100), (3, 10)])
def test_random_texts_whole_and_in_blocks(block, n, counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", block)
    dice = random.Random(block)
    letters = [*"abcdeilnorst   'svmr\n\t.,!?01é😀\u00a0ABC", "<|endoftext|>"]
    texts = ["".join(dice.choices(letters, k=dice.randint(0, 120))) for _ in range(n)]
    texts += [dice.randbytes(40).decode("utf-8", "replace") for _ in range(n // 5)]
    assert counter.count(texts) == [library(x) for x in texts]


def test_states_are_compiled_anew_when_full(path, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 20)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counter = token_counts.TokenCounter(path)
    for x in [*ODD, "several words of some length that need more states than there may be"]:
        assert counter.count([x]) == [library(x)]


def test_chunk_maps_equal_one_walk():
    dice = random.Random(3)
    symbols = [dice.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 14]) for _ in range(2_000)]
    import numpy as np

    state, starts = 3, []
    for s in symbols:
        starts.append(bool(token_counts.STARTS[s, state]))
        state = int(token_counts.TO[s, state])
    found, last = token_counts.run_chunks(np.array(symbols, np.uint8), 3)
    assert found.tolist() == starts and last == state


def test_count_tokens_nulls_repeats_clashes_and_no_rows(spark, path, library):
    shape = "doc_id long, text string, n_bytes string, n_tokens string, body int, over_limit string"
    rows = [(i, t, "x", "y", 7, "z") for i, t in enumerate([None, *ODD])] + [(1, "one two", None, None, None, None), (1, "one two", None, None, None, None), (None, "x " * 1_500, None, None, None, None)]
    docs = spark.createDataFrame(rows, shape)
    found = token_counts.count_tokens(docs, path)
    assert found.columns == ["doc_id", "body", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    expected = sorted((i if i is not None else -1, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t, *_ in rows)
    assert got == expected
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_query(spark, sf, library):
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.op11_token_counts(spark, sf).collect()}
    assert found == {i: (len(t.encode()), library(t)) for i, t in text.items()}
