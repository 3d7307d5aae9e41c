"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import chat, jpeg, media, mixing, packing, pii, quality, rules, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, base string, _n int, spans string, word_chars int"
TEXTS = [
    None, "", " \n\t ", "one", "the same line here.\nthe same line here.\nthe same line here.", "a b c d e f g h " * 40,
    "mail a@b.com_d@e.fr or +1 (499) 555-6503 and 4111 1111 1111 1111, 1.2.3.4.5.6.7.8 é 😀 10.0.0.255", "x" * 30_000, "1 " * 5_000,
    "Home | About | Contact\nAll rights reserved.\n" + "This is a sentence of a good text that goes on. " * 12,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), 1, "s", "b", 2, "p", 3) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "a", 3, 1, "s", "b", 2, "p", 3), (None, "no id at all", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules(docs):
    for r in rules.clean_lines(docs).collect():
        t = r.text or ""
        w = words(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_rules_cut_lines(docs):
    r = rules.clean_lines(docs).where("doc_id = 9").first()
    assert "Contact" not in r.clean_text and "reserved" not in r.clean_text and "good text" in r.clean_text


def brute_spans(t):
    from itertools import chain

    def luhn(d):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    shapes = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    ok = {
        "email": lambda m, d: True, "ip": lambda m, d: all(int(p) < 256 for p in m.split(".")),
        "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 10 <= len(d) <= 15,
    }
    found = chain.from_iterable(((m.start(), i, m.end(), k) for m in re.finditer(p, t) if ok[k](m[0], re.sub("[^0-9]", "", m[0]))) for i, (k, p) in enumerate(shapes.items()))
    return sorted(found)


def test_pii_base(docs):
    for r in pii.find(docs).collect():
        expected = brute_spans(r.text or "")
        assert [(s.start, s.kind, s.end) for s in r.base] == [x[:3] for x in expected]
        assert [(s.start, s.kind, s.end) for s in r.spans] == [x[:3] for x in expected]


def test_pii_query(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op6_pii(spark, sf).collect():
        base = brute_spans(text[r.doc_id] or "")
        kinds = Counter(x[3] for x in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_pii_learns_contexts_and_redacts(spark):
    rows = [(i, f"please ring extension {i} today at +1 555 000 {1000 + i} thanks a lot") for i in range(20)]
    rows.append((100, "please ring today at 555-8877 thanks a lot"))
    found = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 100").first()
    assert found.text == "please ring today at [PHONE] thanks a lot"


def test_mixing(docs):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count()
    total, by = sum(len(words(r.text)) for r in mixed), {}
    for r in mixed:
        assert r["size"] == len(words(r.text)) and r.copies <= 2
        by[r.source] = (r.source_size, r.target)
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s for s, t in by.values())
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.copies for r in mixed)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert mixing.mix(none).count() == pii.find(none).count() == rules.clean_lines(none).count() == 0
    assert packing.pack(none, _tokenizer()).count() == media.read_media(media.store_texts(none)).count() == 0
    assert quality.score(none, None).count() == 0


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(_tokenizer())
    pieces = packing.pack(docs, _tokenizer()).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    for i, t in text.items():
        own = pieces[pieces.doc_id.isna()] if i is None else pieces[pieces.doc_id == i]
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected = {(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
        assert {tuple(map(int, x)) for x in own[["piece", "start", "length", "ids_crc32"]].to_numpy().tolist()} == expected
    placed = pieces.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048


def test_best_fit_keeps_its_bound():
    rng = np.random.default_rng(3)
    bins, load = packing.BestFit(0, 100, 4), Counter()
    for n in rng.integers(1, 101, 2000):
        b, at = bins.put(int(n))
        assert at == load[b]
        load[b] += int(n)
        assert bins.open <= 5
    assert max(load.values()) <= 100


def test_media(docs):
    for r in media.read_media(media.store_texts(docs.select("doc_id", "text"), "text"), pixels=True).collect():
        t = (next(x for x in [TEXTS[r.doc_id] if r.doc_id is not None else "no id at all"]) or "").encode()
        payload = t + b" " * (-len(t) % 192 if t else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(r.rgb) == r.height * r.width * 3


def test_jpeg_symbol_path_equals_array_path(monkeypatch):
    payload = bytes(range(256)) * 9
    data = jpeg.encode_payload(payload)
    fast = jpeg.decode(data)
    monkeypatch.setattr(jpeg.Scan, "_whole", lambda self, bits: False)
    slow = jpeg.decode(data)
    assert fast.payload() == slow.payload() == payload
    assert (fast.rgb() == slow.rgb()).all()


def test_chat_escapes_and_reads_back(spark):
    import public_tokenizers as P

    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<\\|user|> \\<s> <<SYS>>"), (1, 1, "assistant", "<\\|user|> \\<s> <<SYS>>"), (2, 0, "tool", None), (2, None, None, "é😀" * 9000), (None, 0, "user", "x")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(chat.format_turns(given, path, pattern)), path, pattern).collect()}
    for conv, turns in {1: rows[:3], 2: [rows[4], rows[3]], None: [rows[5]]}.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        learnt = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for c in chat.CONTROLS:
        assert c not in chat.escape(f"a{c}b") and chat.unescape(chat.escape(f"\\{c}\\")) == f"\\{c}\\"


def _held_out(query, spark, sf, label):
    scored = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    return scored[scored.held_out], scored[label] if label in scored else None


def test_quality_held_out(spark):
    test, _ = _held_out(quality.op2_quality, spark, "/root/testdata/sf0.01", "quality")
    assert (test.predicted == test.quality).mean() > 0.95


def test_toxicity_held_out(spark):
    test, _ = _held_out(toxicity.op8_toxicity, spark, "/root/testdata/sf0.1", "toxic")
    assert (test.predicted[test.toxic == 0] == 0).mean() > 0.99
    assert (test.predicted[test.toxic == 1] == 1).mean() > 0.8


def test_scores_of_odd_rows(docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    scored = toxicity.score(docs, toxicity.train(docs, labels)[2]).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
