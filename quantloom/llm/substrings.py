"""Fuzzy repeated passages: k-mer seeds are joined, chained with gap costs through a tree of maxima, and aligned.

Every word starts two short seeds, four words and four more that follow at once
or after one word between, so that a word replaced, put in or left out every
fifth word still leaves seeds, and a long seed of forty words, which is a
passage by itself.  A first exchange finds the four words in a row that recur at
all; seeds are made of these only, document by document, so that words that no
other place has cost one short row each.  Every occurrence of a seed is matched
with the first of all, by document and place, and with the one before it in the
same text; groups of documents do so among themselves before the shuffle.  So a passage that an earlier document has
word for word is found whatever holds its short seeds.  Passages with edits are
found through short seeds whose first holder has the passage too.
Matches of two documents form chains
that ascend in both; chains are extended at their ends, aligned on the words of
both texts, split at their widest gaps until what is left is alike enough, and
united per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, released, remove, shuffle_parts, small, stored, tidy, word_count
from .near_duplicates import _batch, _texts
from .vector import blocks, mix, runs, sliced, words_of

#: Words of each half of a seed; seeds whose halves lie so many words apart; words of a long seed.
K, APART, LONG = 4, (0, 1), 40
#: Words of a passage at least, united, and of a grown chain that counts towards one; share of equal words.
MIN_WORDS, MIN_CHAIN, SIMILARITY = 40, 12, 0.8
#: Gain of half a seed, cost of a word that a gap skips in either text, longest gap.
GAIN, COST, MAX_GAP = 4.0, 0.05, 48
JOIN_GAP = 4
#: Equal words that one word that differs costs when a chain grows.
LOSS = round(SIMILARITY / (1 - SIMILARITY))
#: Words of growth that are looked at for many chains together; more than MAX_GAP.
WINDOW = 160
#: Words from one half to the next on a diagonal up to which they are one stretch.
STRETCH = K + 1
NONE = (-1e18, -1)
#: Bits of the hash of K words.
HASH = 48
#: Kinds of packed rows: those that may have equals elsewhere, those that stand for equals known to a block, those that are done with.
LONE, KNOWN, DONE = 0, 2, 1
PACKED = "p long, kind long, rows binary"


def starts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, text, word) of every K words in a row of the texts long enough for a passage, by text and word; a run is a hash of HASH bits."""
    w = words_of([t.lower() for t in texts])
    h, at = runs(w.hashes(), w.first, K)
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(len(counts)), np.where(counts > 0, np.maximum(counts - K, 0) + 1, 0))
    keep = counts[doc] >= MIN_WORDS
    doc = doc[keep]
    return h[keep] >> np.uint64(64 - HASH), doc, at[keep] - w.first[doc]


def joined(h: np.ndarray, doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, doc, spot): the seeds all of whose runs are among the given ones, which come by document and word; those of a kind come so too.

    A spot is twice the word where the seed starts, plus the words between its
    halves.  Long seeds are passages by themselves.
    """
    at = (np.cumsum(np.diff(doc, prepend=doc[:1]) != 0) << 33) + word
    factor = np.uint64(0x9E3779B97F4A7C15)

    def after(words: int) -> np.ndarray:
        """The index of the run that starts so many words later, -1 if there is none."""
        out = np.full(len(at), -1)
        for step in range(1, min(words, len(at) - 1) + 1):
            hit = np.flatnonzero(at[step:] - at[:-step] == words)
            out[hit] = hit + step
        return out

    follows = {skip: after(K + skip) for skip in APART}
    keys, rows, spots = [], [], []
    with np.errstate(over="ignore"):
        for kind, skip in enumerate(APART):
            row = np.flatnonzero(follows[skip] >= 0)
            keys.append(mix(h[row] * factor + h[follows[skip][row]]))
            rows.append(row)
            spots.append(2 * word[row] + kind)
        row = last = np.arange(len(h))
        whole = h
        for _ in range(K, LONG, K):
            last = follows[0][last]
            more = last >= 0
            row, last, whole = row[more], last[more], whole[more]
            whole = whole * factor + h[last]
        keys.append(mix(whole + np.uint64(LONG)))
        rows.append(row)
        spots.append(2 * word[row])
    return np.concatenate(keys).view(np.int64), doc[np.concatenate(rows)], np.concatenate(spots)


def seeds(texts: list[bytes], part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, text, spot): all seeds of the texts, in one of several parts of the keys; see ``joined``."""
    key, doc, spot = joined(*starts(texts))
    took = key.view(np.uint64) % np.uint64(parts) == part
    return key[took], doc[took], spot[took]


def _match(key: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loose, matched): the rows (key, doc, spot) of the first document of each key, and the rows (a, spot, b, spot) of matches.

    A row is matched with the first of its key, if that is of another
    document, and with the one before it in its own.
    """
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    lone = np.zeros(len(key), bool)
    lone[order] = ~same[:-1] & ~same[1:]
    # In their first order, which packs well.
    alone = np.stack([key[lone], doc[lone], spot[lone]], 1)
    order = order[same[:-1] | same[1:]]
    key, doc, spot = key[order], doc[order], spot[order]
    # Rows that came by document and place still do under each key.
    back = (key[1:] == key[:-1]) & ((doc[1:] < doc[:-1]) | ((doc[1:] == doc[:-1]) & (spot[1:] < spot[:-1])))
    if back.any():
        order = np.lexsort((spot, doc, key))
        key, doc, spot = key[order], doc[order], spot[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1])
    key, doc, spot = key[fresh], doc[fresh], spot[fresh]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    own = doc == doc[first]
    # One place may start both kinds of seeds with one key, where a word follows itself; it is no repeat of itself.
    again = np.flatnonzero(~head[1:] & (doc[1:] == doc[:-1]) & (spot[1:] // 2 != spot[:-1] // 2)) + 1
    loose = np.concatenate([alone, np.stack([key[own], doc[own], spot[own]], 1)])
    pairs = [(np.flatnonzero(~own), first[~own]), (again, again - 1)]
    matched = np.concatenate([np.stack([doc[x], spot[x], doc[y], spot[y]], 1) for x, y in pairs])
    return loose, matched[np.lexsort((matched[:, 1], matched[:, 2], matched[:, 0]))]


def _packed(kind: int, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """(p, kind, rows): rows of numbers dealt by the first of them and packed, one row per part.

    A packed row holds the smallest number of each column and how many bytes
    it takes to tell the others from it; then the first of these bytes of all
    rows, then the second and so on, so that what is alike lies together and
    compresses.
    """
    with np.errstate(over="ignore"):
        p = (mix(rows[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    # Few names are sorted as short numbers, which takes one pass.
    order = np.argsort(p.astype(np.uint16) if parts <= 1 << 16 else p, kind="stable")
    rows, p = rows[order], p[order]
    cuts = np.flatnonzero(np.diff(p)) + 1
    names = p[np.concatenate([[0], cuts])] if len(p) else p
    packed = []
    if len(p):
        low = rows.min(0)
        above = [np.ascontiguousarray(column).view(np.uint64) for column in (rows - low).T]
        sizes = [max(1, -(-int(column.max()).bit_length() // 8)) for column in above]
        planes = np.stack([column.view(np.uint8)[byte::8] for column, size in zip(above, sizes, strict=True) for byte in range(size)])
        head = np.array([*low, *sizes], np.int64).tobytes()
        packed = [head + planes[:, x:y].tobytes() for x, y in zip([0, *cuts], [*cuts, len(p)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), kind)), pa.array(packed, pa.binary())], ["p", "kind", "rows"])


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    packed = column.to_pylist()
    heads = [np.frombuffer(x, np.int64, 2 * width).tolist() for x in packed]
    counts = [(len(x) - 16 * width) // sum(head[width:]) for x, head in zip(packed, heads, strict=True)]
    out = np.zeros((sum(counts), width), np.int64)
    at = 0
    for x, head, n in zip(packed, heads, counts, strict=True):
        here, planes = out[at : at + n], np.frombuffer(x, np.uint8, offset=16 * width).reshape(-1, n)
        wide = here.view(np.uint8)
        for plane, place in zip(planes, (8 * k + byte for k in range(width) for byte in range(head[width + k])), strict=True):
            wide[:, place] = plane
        here += np.array(head[:width])
        at += n
    return out


def recurring(docs: DataFrame) -> tuple[DataFrame, str]:
    """(p, kind, rows): packed rows (document, word, run) of the runs that occur twice or more, dealt by the document; and the path of the table.

    What a block holds twice is known to recur and goes to no other block;
    one row stands for it there, so a run that all texts share sends one row
    per block.
    """
    parts = shuffle_parts(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _texts(batch, 1)
            for low, high in blocks(texts):
                h, doc, word = starts(texts[low:high])
                again, head = _again(h)
                rows = np.stack([h.view(np.int64), ids[low:high][doc], word], 1)
                yield _packed(LONE, rows[~again], parts)
                yield _packed(KNOWN, rows[head, :1], parts)
                yield _packed(DONE, rows[again][:, [1, 2, 0]], parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone, known = [], []
        for batch in batches:
            kind = batch.column(1)
            lone.append(_unpacked(batch.column(2).filter(pa.compute.equal(kind, LONE)), 3))
            known.append(_unpacked(batch.column(2).filter(pa.compute.equal(kind, KNOWN)), 1))
            yield batch.filter(pa.compute.equal(kind, DONE))
        if lone:
            rows = np.concatenate(lone)
            lone.clear()
            again = _again(np.concatenate([rows[:, 0], *(k[:, 0] for k in known)]))[0][: len(rows)]
            yield _packed(DONE, rows[again][:, [1, 2, 0]], parts)

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInArrow(released(emit), PACKED).repartitionById(parts, F.col("p").cast("int")).mapInArrow(released(meet), PACKED))


def _again(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which numbers occur twice or more, as a mask, and the places of one of each of them."""
    order = np.argsort(h)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order] = same[:-1] | same[1:]
    return out, order[same[1:] & ~same[:-1]]


def anchors(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(p, kind, rows): packed rows (a, spot, b, spot), dealt by a: a seed of document a that an earlier place, in b, holds.

    Only seeds whose runs all recur are made, as no other seed does.  Also
    returns the paths of the stored tables that hold the rows.
    """
    parts = shuffle_parts(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(batch.column(2), 3) for batch in batches]
        if held:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            loose, matched = _match(*joined(rows[:, 2].copy().view(np.uint64), rows[:, 0].copy(), rows[:, 1].copy()))
            yield _packed(LONE, loose, parts)
            yield _packed(DONE, matched, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            loose = pa.compute.equal(batch.column(1), LONE)
            held.append(_unpacked(batch.column(2).filter(loose), 3))
            yield batch.filter(pa.compute.invert(loose))
        if held:
            rows = np.concatenate(held)
            held.clear()
            matched = _match(rows[:, 0], rows[:, 1], rows[:, 2])[1]
            # The repeats inside one document have been matched already.
            yield _packed(DONE, matched[matched[:, 0] != matched[:, 2]], parts)

    found, path = recurring(docs)
    tidy(docs.sparkSession, wait=True)
    dealt = found.repartitionById(parts, F.col("p").cast("int")).mapInArrow(released(emit), PACKED)
    matched, last = stored(dealt.repartitionById(parts, F.col("p").cast("int")).mapInArrow(released(meet), PACKED))
    del dealt, found
    remove(docs.sparkSession, path, wait=True)
    return matched, [last]


class Reach:
    """Largest (value, index) over a range of places, as a tree; entries can be taken out again."""

    def __init__(self, n: int):
        self.n = n
        self.best = [NONE] * (2 * n)

    def put(self, i: int, item: tuple[float, int]) -> None:
        i += self.n
        self.best[i] = item
        while i > 1:
            i >>= 1
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def between(self, low: int, high: int) -> tuple[float, int]:
        """Over the places from low to before high."""
        found, low, high = NONE, low + self.n, high + self.n
        while low < high:
            if low & 1:
                found, low = max(found, self.best[low]), low + 1
            if high & 1:
                high -= 1
                found = max(found, self.best[high])
            low, high = low >> 1, high >> 1
        return found


def chain(pa_: np.ndarray, pb: np.ndarray) -> list[list[list[int]]]:
    """The chains of one pair's anchors, sorted by pa, then pb: the (a start, a end, b start, b end) of their stretches.

    Anchors on one diagonal that are close are one stretch.  A stretch gains
    by its seeds, a link costs by the words it skips in either text, which is
    a sum of terms of its two ends: so the best predecessor is the largest of
    those that end in reach before it in both texts.  Places are the ends in
    b; those out of reach in a have been taken out.
    """
    order = np.lexsort((pa_, pb - pa_))
    a, b = pa_[order], pb[order]
    new = np.ones(len(a), bool)
    new[1:] = ((b - a)[1:] != (b - a)[:-1]) | (np.diff(a) > STRETCH)
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(a)) - 1
    a0, a1, b0, b1 = a[first], a[last] + K, b[first], b[last] + K
    wide = np.stack([a0, a1, b0, b1], 1)
    if len(first) == 1:
        return [wide.tolist()]
    by_end = np.argsort(b1, kind="stable")
    place = np.empty(len(first), np.int64)
    place[by_end] = np.arange(len(first))
    low, high = np.searchsorted(b1[by_end], b0 - MAX_GAP), np.searchsorted(b1[by_end], b0, side="right")
    tree, score, before = Reach(len(first)), GAIN * (last - first + 1.0), np.full(len(first), -1)
    events = sorted([(int(x), 1, i) for i, x in enumerate(a0)] + [(int(x), 0, i) for i, x in enumerate(a1)] + [(int(x) + MAX_GAP, 2, i) for i, x in enumerate(a1)])
    for at, kind, i in events:
        if kind == 0:
            tree.put(int(place[i]), (score[i] + COST * (at + b1[i]), i))
        elif kind == 2:
            tree.put(int(place[i]), NONE)
        else:
            value, j = tree.between(int(low[i]), int(high[i]))
            if j >= 0 and value - COST * (at + b0[i]) > 0:
                score[i] += value - COST * (at + b0[i])
                before[i] = j
    out, used = [], np.zeros(len(first), bool)
    for i in np.argsort(-score, kind="stable"):
        if used[i]:
            continue
        own = [int(i)]
        used[i] = True
        while before[own[-1]] >= 0 and not used[before[own[-1]]]:
            own.append(int(before[own[-1]]))
            used[own[-1]] = True
        out.append(wide[own[::-1]].tolist())
    return out


def chains(found: DataFrame) -> DataFrame:
    """(a, b, parts): the chains of each pair, from packed anchors; a chain is its stretches of four numbers each, after their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(batch.column(2), 4) for batch in batches]
        if not held:
            return
        rows = np.concatenate(held)
        held.clear()
        a, sa, b, sb = rows.T
        halves = [np.stack([a, b, sa // 2, sb // 2], 1), np.stack([a, b, sa // 2 + sa % 2 + K, sb // 2 + sb % 2 + K], 1)]
        rows = np.concatenate(halves)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(1)
        rows = rows[fresh]
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        edges = np.concatenate([[0], cuts, [len(rows)]])
        for low in range(0, len(edges) - 1, 4096):
            ids, parts = [], []
            for x, y in zip(edges[low : low + 4096], edges[low + 1 : low + 4097], strict=False):
                if x < y:
                    ids.append(rows[x, :2])
                    parts.append(b"".join(np.array([len(c), *np.ravel(c)], np.int64).tobytes() for c in chain(rows[x:y, 2], rows[x:y, 3])))
            ids = np.array(ids, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(parts, pa.binary())], ["a", "b", "parts"])

    return found.repartitionById(shuffle_parts(found), F.col("p").cast("int")).mapInArrow(released(run), "a long, b long, parts binary")


def chains_of(packed: bytes) -> Iterator[np.ndarray]:
    numbers, at = np.frombuffer(packed, np.int64), 0
    while at < len(numbers):
        n = 4 * int(numbers[at])
        yield numbers[at + 1 : at + 1 + n].reshape(-1, 4)
        at += 1 + n


def align(x: np.ndarray, y: np.ndarray) -> int:
    """Words in common of the best alignment; equal ends are taken off first."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    if len(x) == len(y):
        equal = int(np.count_nonzero(same))
        if equal == n:
            return n
        ends = int(same.argmin()) + int(same[::-1].argmin())
        if equal - ends >= SIMILARITY * (n - ends):
            return equal
    head = n if same.all() else int(same.argmin())
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    same = x[::-1][:n] == y[::-1][:n]
    tail = n if same.all() else int(same.argmin())
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    common = head + tail
    if not len(x) or not len(y):
        return common
    # A row of the table of common words is a number whose bits are unset where the row rises.
    places: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x.tolist():
        here = row & places.get(v, 0)
        if here:
            row = ((row + here) | (row - here)) & full
    return common + len(y) - row.bit_count()


def _grow(x: np.ndarray, y: np.ndarray) -> int:
    """Words to go on: as far as equal words gain most, if one that differs costs what SIMILARITY sets against it.

    Growth ends for good where it has lost more than MAX_GAP differing words cost.
    """
    n, at, size, total, best, end = min(len(x), len(y)), 0, 512, 0, 0, 0
    while at < n:
        gain = total + np.cumsum(np.where(x[at : at + size][: n - at] == y[at : at + size][: n - at], 1, -LOSS))
        lost = gain < np.maximum(np.maximum.accumulate(gain), best) - LOSS * MAX_GAP
        over = bool(lost.any())
        if over:
            gain = gain[: int(lost.argmax())]
        if len(gain) and gain.max() >= best:
            best = int(gain.max())
            end = at + int(np.flatnonzero(gain == best)[-1]) + 1
        if over:
            break
        at, total, size = at + len(gain), int(gain[-1]), 2 * size
    return end


def extend(x: np.ndarray, y: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A chain grown at both ends, over words that differ where enough equal ones follow."""
    left, right = _grow(x[:a0][::-1], y[:b0][::-1]), _grow(x[a1:], y[b1:])
    return a0 - left, a1 + right, b0 - left, b1 + right


def _grow_many(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, step: int) -> np.ndarray:
    """What ``_grow`` finds from many places at once, forwards or backwards; -1 where WINDOW words don't settle it."""
    out = np.empty(len(at_x), np.int64)
    way = step * np.arange(WINDOW)
    for low in range(0, len(at_x), 4096):
        ax, ay = at_x[low : low + 4096, None] + way, at_y[low : low + 4096, None] + way
        gain = np.cumsum(np.where(x[ax] == y[ay], 1, -LOSS), axis=1)
        lost = gain < np.maximum(np.maximum.accumulate(gain, axis=1), 0) - LOSS * MAX_GAP
        gain[np.maximum.accumulate(lost, axis=1)] = -1
        end = WINDOW - gain[:, ::-1].argmax(axis=1)
        out[low : low + 4096] = np.where(lost[:, -1] | lost.any(axis=1), np.where(gain.max(axis=1) >= 0, end, 0), -1)
    return out


def judge_many(items: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[list[tuple[int, int, int]]]:
    """``judge`` of every (words of a, words of b, chain), the first growth of all together."""
    if not items:
        return
    # Around each text, words that equal none of the other side.
    flat, start = [], []
    for side, fence in ((0, 0), (1, 1)):
        at, pieces, places, known = WINDOW, [np.full(WINDOW, fence, np.uint64)], [], None
        for item in items:
            if item[side] is not known:
                known, here = item[side], at
                pieces += [known, np.full(WINDOW, fence, np.uint64)]
                at += len(known) + WINDOW
            places.append(here)
        flat.append(np.concatenate(pieces))
        start.append(np.array(places))
    ends = np.array([(c[0, 0], c[-1, 1], c[0, 2], c[-1, 3]) for _, _, c in items], np.int64)
    left = _grow_many(*flat, start[0] + ends[:, 0] - 1, start[1] + ends[:, 2] - 1, -1)
    right = _grow_many(*flat, start[0] + ends[:, 1], start[1] + ends[:, 3], 1)
    grown = ends + np.stack([-left, right, -left, right], 1)
    settled = (left >= 0) & (right >= 0)
    # Chains of one stretch, whose two sides are equally long, need no alignment where all their words are equal.
    one = np.flatnonzero(settled & np.array([len(c) == 1 for _, _, c in items]))
    sizes = (grown[:, 1] - grown[:, 0])[one]
    way = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at_x, at_y = np.repeat((start[0] + grown[:, 0])[one], sizes) + way, np.repeat((start[1] + grown[:, 2])[one], sizes) + way
    plain = np.zeros(len(items), bool)
    if len(one):
        plain[one] = (sizes < MIN_CHAIN) | (np.add.reduceat((flat[0][at_x] == flat[1][at_y]).astype(np.int64), np.cumsum(sizes) - sizes) == sizes)
    for (x, y, c), now, known, same in zip(items, grown.tolist(), settled.tolist(), plain.tolist(), strict=True):
        if same:
            yield [(now[0], now[1], now[1] - now[0])] if now[1] - now[0] >= MIN_CHAIN else []
        else:
            yield judge(x, y, c, now if known else None)


def judge(x: np.ndarray, y: np.ndarray, parts: np.ndarray, grown: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(a start, a end, equal words) of a chain that is alike enough, or else of the parts of it that are, split at the widest gaps.

    ``grown`` are the ends of the whole chain after growth, if known.
    """
    out, todo = [], [parts]
    while todo:
        now = todo.pop()
        a0, a1, b0, b1 = grown or extend(x, y, *(int(v) for v in (now[0, 0], now[-1, 1], now[0, 2], now[-1, 3])))
        grown = None
        if len(now) == 1 and a1 - a0 < MIN_CHAIN:
            continue
        equal = align(x[a0:a1], y[b0:b1])
        if equal >= SIMILARITY * max(a1 - a0, b1 - b0):
            out += [(a0, a1, equal)] if a1 - a0 >= MIN_CHAIN else []
        elif len(now) > 1:
            gap = np.maximum(now[1:, 0] - now[:-1, 1], now[1:, 2] - now[:-1, 3])
            at = int(gap.argmax()) + 1
            todo += [now[at:], now[:at]]
    return out


def _hashes(texts: dict[int, bytes]) -> dict[int, np.ndarray]:
    """The hashes of the words of each text."""
    out, names, lower = {}, list(texts), [t.lower() for t in texts.values()]
    for low, high in blocks(lower):
        w = words_of(lower[low:high])
        out |= zip(names[low:high], np.split(w.hashes(), w.first[1:-1]), strict=True)
    return out


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of numbers, marked for broadcast if it is small."""
    return small(cut(ids))


def _single(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per doc_id: of several texts under one, the smallest."""
    again = cut(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs
    again = small(again)
    return docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, first, n_words): texts that an earlier document has as a whole, told apart by a 256-bit digest."""
    keyed = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = _few(keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    sizes = docs.join(groups.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("first"), word_count(F.col("text")).alias("n_words"))
    return cut(keyed.join(groups, "digest").where("doc_id > first").select("doc_id", "first").join(_few(sizes), "first").select("doc_id", "first", "n_words"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, n_equal, others): passages that occur, nearly alike, in an earlier document or earlier in this one.

    ``start`` and ``length`` count words.  ``others`` are the documents the
    passage was matched with.  The first occurrence is no row of its own; it
    is among the others.  A text that equals an earlier one is a passage as a
    whole, matched with the first of them, and seeds nothing itself.  Texts
    under 40 words, null and empty ones have none; of several texts under one
    doc_id the smallest counts, rows without one have none.
    """
    spark = docs.sparkSession
    lean(spark)
    docs = _single(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"))
    copies = _copies(docs)
    docs = docs.join(small(copies.select("doc_id")), "doc_id", "left_anti")
    matched, paths = anchors(docs)
    found = stored(chains(matched))[0]
    del matched
    remove(spark, *paths, wait=True)
    sides = docs.join(_few(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"))
    joined = found.join(sides.toDF("a", "ta"), "a").join(sides.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                names, items = [], []
                found = batch.slice(low, 256).to_pylist()
                hashes = _hashes({r[i]: r[t] for r in found for i, t in (("a", "ta"), ("b", "tb"))})
                for r in found:
                    x, y = hashes[r["a"]], hashes[r["b"]]
                    own = [(x, y, parts) for parts in chains_of(r["parts"])]
                    items += own
                    names += [(r["a"], r["b"])] * len(own)
                rows = [(a, *part, b) for (a, b), found in zip(names, judge_many(items), strict=True) for part in found]
                wide = np.array(rows, np.int64).reshape(-1, 5)
                yield _batch(dict(zip(("doc_id", "low", "high", "n_equal", "other"), wide.T, strict=True)))

    aligned = joined.select("a", "b", "parts", "ta", "tb").mapInArrow(released(run), "doc_id long, low long, high long, n_equal long, other long")
    w = Window.partitionBy("doc_id").orderBy("low", "high", "other", "n_equal")
    fresh = F.coalesce(F.col("low") > F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)) + JOIN_GAP, F.lit(True))
    island = aligned.withColumn("new", fresh.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    united = island.groupBy("doc_id", "island").agg(F.min("low").alias("start"), F.max("high").alias("end"), F.max("n_equal").alias("n_equal"), F.array_sort(F.collect_set("other")).alias("others"))
    united = united.select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "n_equal", "others")
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"), F.col("n_words").alias("n_equal"), F.array("first").alias("others"))
    return united.unionByName(whole).where(F.col("length") >= MIN_WORDS)


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of all passages but first occurrences taken out of ``text``, other words joined by spaces; untouched texts stay as they are."""
    cuts = passages(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "length")).alias("_cuts"))
    joined = docs.join(cuts, F.col("doc_id") == F.col("_id"), "left")
    kept = F.filter(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), lambda x, i: ~F.exists("_cuts", lambda c: (i >= c["start"]) & (i < c["start"] + c["length"])))
    return joined.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))).drop("_id", "_cuts")


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """The repeated passages of ``documents``; see ``passages``."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
