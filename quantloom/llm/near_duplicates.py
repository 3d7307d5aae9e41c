"""Exact Jaccard self-join of documents on word shingles, by partitioning the universe of shingles.

A document's set is its distinct runs of five words, as 64-bit hashes.  Two
sets of Jaccard 0.8 or more differ in at most (|x| + |y|) / 9 shingles.  For
each band of sizes the universe is hashed into segments; by the pigeonhole
principle linked sets agree, nearly or wholly, in some of them:

* small sets: few segments, indexed with their one-deletion neighbourhoods, so
  that one shingle more or less still meets (weight 2 each);
* larger sets: many segments, indexed as they are (weight 1 each).

The weights of a band sum to its largest distance, plus one, plus spare.  A set
whose empty segments may take all of that meets others by its smallest shingles as well.
So linked sets of weight 1 meet in more buckets than a band has spare, less what
empty segments cost: a set that meets others in fewer is linked with none and
leaves (``narrowed``), long before pairs are made.

Texts of one word sequence, told apart by a 128-bit digest, are represented by
their first document.  The sets that are left are compared with one partner a
bucket, twice; the links found make components.  What then still meets across
components is narrowed again, by buckets and by shingles, and each set compared
with all members of the components that it may be linked into, block by block.
Links that join components are confirmed on the words themselves.  Nothing is
capped: a step that leaves a pair out leaves it to the last one, which is
complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, released, shuffle_parts, small, tidy, unused, written
from .components import components
from .vector import BLOCK, blocks, mix, runs, sliced, words_of

SHINGLE = 5
NUM, DEN = 8, 10
#: Keys of buckets are below this; rows of members already matched carry it on top.
MATCHED = 1 << 62
BAND_BITS = 7
#: Rows with this key hold a set's size.
SIZES = -(1 << 20)
#: Largest distance up to which a band's segments are indexed with their neighbourhoods.
DELETIONS_TO = 8
SHARE = 0.25
#: Members from which a component counts as a family, whose outsiders are compared with members at random first.
FAMILY = 8
#: Pairs of sets, and bytes of texts, that are unpacked at a time; shingles of a block of sets.
PAIRS, TEXT_BLOCK, SET_BLOCK = 512, 1 << 19, 1 << 14
#: Labels from which a bucket is hot: its sets are not paired there but compared with their whole cluster.
HOT = 32
#: Rounds of comparing each set with a partner a bucket, before the complete step.
ROUNDS = 2


@lru_cache(1)
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per band: largest size, smallest size of a partner, distance, segments, spare weight.  The first band takes all small sets; those under 4 link with equal ones only."""
    high, top = [], 4
    while top < 1 << 40:
        top = max(top + 1, top * DEN // NUM)
        high.append(top)
    high = np.array(high, np.int64)
    low = np.concatenate([[4], high[:-1]])
    partner = -(-(low + 1) * NUM // DEN)
    partner[0] = 1
    distance = 2 * high * (DEN - NUM) // (DEN + NUM)
    double = distance <= DELETIONS_TO
    segments = np.where(double, (distance + 2) // 2 + 1, distance + 2 + np.ceil(SHARE * (distance + 1)).astype(np.int64))
    spare = np.where(double, 2 * segments, segments) - distance - 1
    return high, partner, distance, segments, spare


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, shingles before each text and after the last): distinct and sorted in each text."""
    w = words_of([t.lower() for t in texts])
    h, at = runs(w.hashes(), w.first, SHINGLE)
    doc = np.searchsorted(w.first, at, side="right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.searchsorted(doc[fresh], np.arange(len(texts) + 1))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def word_digest(text: bytes | None) -> bytes | None:
    """A 128-bit name of a text's lower-cased word sequence; None without words."""
    words = b" ".join(text.lower().split()) if text else b""
    return hashlib.blake2b(words, digest_size=16).digest() if words else None


def names(docs: DataFrame) -> DataFrame:
    """(doc_id, name): the digest of each document's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([word_digest(t.as_py()) for t in part.column(1)], pa.binary())], ["doc_id", "name"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(released(run), "doc_id long, name binary")


def _ranges(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, loss or -1) of the segments of all sets in all their bands.

    Rows with a loss carry the band as -1 - band: the weight that empty and
    one-shingle segments take from the set's spare.  Where they may take more
    than it, two linked sets may agree in nothing but segments without a
    bucket; such sets also meet by their smallest shingles, a fifth and one.
    Any two linked sets share one of these, and both of a pair are such sets.
    """
    top, partner, distance, segments, spare = bands()
    sizes = np.diff(first)
    own = np.searchsorted(top, sizes)
    keys, docs, losses = [], [], []
    salt = mix(np.arange(len(top), dtype=np.uint64) + np.uint64(77))
    for ahead in range(3):
        band = np.minimum(own + ahead, len(top) - 1)
        d = np.flatnonzero((sizes >= partner[band]) & (sizes <= top[band]))
        if not len(d):
            continue
        b, n = band[d], sizes[d]
        token = h[_ranges(n, first[:-1][d])]
        with np.errstate(over="ignore"):
            bt = np.repeat(b, n)
            count = segments[b]
            offset = np.cumsum(count) - count
            place = np.repeat(offset, n) + (mix(token + salt[bt]) % segments[bt].astype(np.uint64)).astype(np.int64)
            value = mix(token ^ np.uint64(0x5EED))
            total = np.zeros(int(count.sum()), np.uint64)
            np.add.at(total, place, value)
            filled = np.bincount(place, minlength=len(total))
            owner = np.repeat(np.arange(len(d)), count)
            name = mix((np.arange(len(total)) - offset[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[b[owner]])

            def key(content: np.ndarray, at: np.ndarray, b=b, owner=owner, name=name) -> np.ndarray:
                return ((mix(content + name[at]) >> np.uint64(9)).astype(np.int64) << BAND_BITS) | b[owner[at]]

            full = np.flatnonzero(filled)
            keys.append(key(total[full], full))
            docs.append(d[owner[full]])
            near = np.flatnonzero((distance[bt] <= DELETIONS_TO) & (filled[place] > 1))
            keys.append(key(total[place[near]] - value[near], place[near]))
            docs.append(d[owner[place[near]]])
        double = distance[b] <= DELETIONS_TO
        empty = np.bincount(owner, filled == 0, len(d)) * np.where(double, 2, 1) + np.bincount(owner, filled == 1, len(d)) * double
        # Equal sets meet in any segment that isn't empty, so those under 4 need no more.
        weak = np.flatnonzero((empty > spare[b]) & (n >= 4))
        few = n[weak] + n[weak] * -NUM // DEN + 1
        with np.errstate(over="ignore"):
            smallest = mix(h[_ranges(few, first[:-1][d[weak]])] ^ mix(np.repeat(salt[b[weak]], few)))
        keys.append(((smallest >> np.uint64(9)).astype(np.int64) << BAND_BITS) | np.repeat(b[weak], few))
        docs.append(np.repeat(d[weak], few))
        lossy = np.flatnonzero(empty)
        losses.append((-1 - b[lossy], d[lossy], empty[lossy].astype(np.int64)))
    k = np.concatenate([*keys, *(x[0] for x in losses)]) if keys else np.zeros(0, np.int64)
    d = np.concatenate([*docs, *(x[1] for x in losses)]) if keys else np.zeros(0, np.int64)
    loss = np.concatenate([*(np.full(len(x), -1) for x in keys), *(x[2] for x in losses)]) if keys else np.zeros(0, np.int64)
    return k, d, loss


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, smallest node) of each bucket, and (key, member, smallest) of the other members."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[fresh], node[fresh]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    centre = node[head][np.cumsum(head) - 1] if len(key) else node
    return key[head], node[head], (key[~head], node[~head], centre[~head])


def index(docs: DataFrame) -> DataFrame:
    """(k, a, b): bucket k holds a and its smallest member b; for k = -1 - band, set a loses weight b in that band; for k = SIZES, set a has b shingles.

    Blocks of texts match their own members first, so that a bucket receives a
    row of each block at most.  Buckets are streamed in the order of their
    keys; nothing but the current bucket's smallest member is held.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_numpy(), _texts(batch, 1)
            for low, high in blocks(texts, TEXT_BLOCK):
                h, first = shingles(texts[low:high])
                own = ids[low:high]
                k, d, loss = signatures(h, first)
                lost = loss >= 0
                key, smallest, star = _stars(k[~lost], own[d[~lost]])
                yield _batch({
                    "k": np.concatenate([key, star[0] | MATCHED, k[lost], np.full(len(own), SIZES)]),
                    "a": np.concatenate([smallest, star[1], own[d[lost]], own]),
                    "b": np.concatenate([np.zeros(len(key), np.int64), star[2], loss[lost], np.diff(first)]),
                })

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, smallest = None, 0
        for batch in batches:
            k, a, b = (c.to_numpy() for c in batch.columns)
            loose = (k >= 0) & (k < MATCHED)
            yield _batch({"k": np.where(k < 0, k, k & (MATCHED - 1))[~loose], "a": a[~loose], "b": b[~loose]})
            k, a = k[loose], a[loose]
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = k[0] != bucket
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            centre = np.where(at >= 0, a[at], smallest)
            member = a != centre
            yield _batch({"k": k[member], "a": a[member], "b": centre[member]})
            bucket, smallest = k[-1], centre[-1]

    shape = "k long, a long, b long"
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(released(emit), shape)
    # Rows that are matched already needn't come to their bucket: they are dealt by document.
    place = F.when((F.col("k") >= 0) & (F.col("k") < MATCHED), F.col("k")).otherwise(F.col("a"))
    return rows.repartition(shuffle_parts(docs), place).sortWithinPartitions("k", "a").mapInArrow(released(meet), shape)


def _band(k: str = "k"):
    return F.col(k).bitwiseAND((1 << BAND_BITS) - 1).cast("int")


def _of_band(values) -> F.Column:
    """The value of a row's band, from a constant list."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("band") + 1)


def narrowed(members: DataFrame, losses: DataFrame) -> DataFrame:
    """(k, node, label, band, lost) of ``members`` (k, node, label) in buckets of several labels, of sets that meet other labels in enough of them.

    A linked set of weight 1 agrees in more segments than its band has spare;
    those that are empty in both sets, ``lost`` at most, have no bucket.
    """
    _, _, distance, _, spare = bands()
    least = [1 if d <= DELETIONS_TO else s + 1 for s, d in zip(spare, distance, strict=True)]
    several = members.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("k")
    rows = members.join(several, "k").select("k", "node", "label", _band().alias("band"), F.lit(None).cast("long").alias("gone"))
    both = rows.unionByName(losses.select(F.lit(None).cast("long").alias("k"), F.col("a").alias("node"), F.lit(None).cast("long").alias("label"), (-1 - F.col("k")).cast("int").alias("band"), F.col("b").alias("gone")))
    w = Window.partitionBy("node", "band")
    counted = both.withColumns({"meets": F.count("k").over(w), "lost": F.coalesce(F.sum("gone").over(w), F.lit(0))})
    return counted.where(F.col("k").isNotNull() & (F.col("meets") + F.col("lost") >= _of_band(least))).select("k", "node", "label", "band", "lost")


def members_of(stars: DataFrame) -> DataFrame:
    """(k, node, label) of all members of the buckets; each is its own label."""
    of = lambda c: stars.select("k", F.col(c).alias("node"))
    return of("a").union(of("b")).distinct().withColumn("label", F.col("node"))


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the labels of their nodes; nodes without one stand for themselves."""
    return rows.select("k", "node").join(labels, "node", "left").select("k", "node", F.coalesce("label", "node").alias("label"))


def packed_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, tokens): the sorted shingles of the documents named, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = _texts(batch, 1)
            for low, high in blocks(texts, TEXT_BLOCK):
                h, first = shingles(texts[low:high])
                tokens = [h[first[d] : first[d + 1]].tobytes() for d in range(high - low)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(first)), pa.array(tokens, pa.binary())], ["node", "n", "tokens"])

    wanted = small(cut(nodes.distinct().withColumnRenamed("node", "doc_id")))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(wanted, "doc_id", "left_semi")
    return rows.mapInArrow(released(run), "node long, n long, tokens binary").dropDuplicates(["node", "tokens"])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, numbers before each row and after the last) of a column of packed numbers."""
    rows = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(rows), np.uint64), np.cumsum([0, *(len(x) // 8 for x in rows)])


def _fit(a: str = "sa", b: str = "sb"):
    return (NUM * F.col(a) <= DEN * F.col(b)) & (NUM * F.col(b) <= DEN * F.col(a))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose packed sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, PAIRS):
            (x, fx), (y, fy), m = _numbers(part.column(2)), _numbers(part.column(3)), part.num_rows
            pair = np.concatenate([np.repeat(np.arange(m), np.diff(fx)), np.repeat(np.arange(m), np.diff(fy))])
            h = np.concatenate([x, y])
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            common = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=m)
            union = np.diff(fx) + np.diff(fy) - common
            yield part.select(["a", "b"]).take(pa.array(np.flatnonzero((DEN * common >= NUM * union) & (union > 0))))

    left, right = sets.toDF("a", "sa", "ta"), sets.toDF("b", "sb", "tb")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").where(_fit()).select("a", "b", "ta", "tb")
    return joined.mapInArrow(released(run), "a long, b long")


def with_smallest(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and the smallest of its bucket that meet in several buckets.

    What this leaves out isn't lost: its buckets stay in several components.
    """
    _, _, distance, _, spare = bands()
    least = [1 if d <= DELETIONS_TO else s // 2 + 1 for s, d in zip(spare, distance, strict=True)]
    centre = rows.groupBy("k").agg(F.min("node").alias("b"))
    met = rows.join(centre, "k").where("node <> b").groupBy(F.col("node").alias("a"), "b", "band").agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= _of_band(least)).select("a", "b").distinct()


def with_family(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket's members outside its largest component with a member of it at random, where that one is a family.

    An outsider meets another member in every bucket, so one that has links
    into the family finds some here.
    """
    per_label = rows.groupBy("k", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "k")).alias("one"))
    main = per_label.groupBy("k").agg(F.max_by(F.struct("label", "one", "n"), F.struct("n", "label")).alias("main")).where(F.col("main.n") >= FAMILY)
    return rows.join(main, "k").where("label <> main.label").select(F.col("node").alias("a"), F.col("main.one").alias("b")).distinct()


def with_tokens_elsewhere(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` of the sets of which 0.8 or more of the shingles occur under other labels too, among ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, PAIRS):
            h, first = _numbers(part.column(2))
            n = np.diff(first)
            yield _batch({"node": np.repeat(part.column(0).to_numpy(), n), "label": np.repeat(part.column(1).to_numpy(), n), "n": np.repeat(n, n), "token": h.view(np.int64)})

    nodes = rows.select("node", "label").distinct()
    tokens = nodes.join(sets, "node").select("node", "label", "tokens").mapInArrow(released(run), "node long, label long, n long, token long")
    tokens = written(tokens)
    shared = tokens.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    good = tokens.join(shared, "token").groupBy("node").agg(F.count("*").alias("found"), F.min("n").alias("n")).where(DEN * F.col("found") >= NUM * F.col("n"))
    return rows.join(good.select("node"), "node", "left_semi")


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of buckets of few labels, (node, cluster) of the sets that hot buckets bring together)."""
    labels = rows.select("k", "label").distinct().groupBy("k").agg(F.count("*").alias("labels"))
    hot = cut(labels.where(F.col("labels") > HOT).select("k"))
    together = rows.select("k", "node").join(hot, "k")
    centre = together.groupBy("k").agg(F.min("node").alias("b"))
    clusters = components(together.join(centre, "k").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    return rows.join(hot, "k", "left_anti"), clusters.withColumnRenamed("label", "cluster")


def into(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (node, other) of a set and a larger component whose members it meets in as many buckets as linked sets must.

    A bucket has at most HOT labels, so a row meets no more.  ``nodes`` are
    all (node, label).
    """
    _, _, distance, _, spare = bands()
    least = [1 if d <= DELETIONS_TO else s + 1 for s, d in zip(spare, distance, strict=True)]
    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"))
    sized = rows.join(nodes.join(sizes, "label").select("node", "size"), "node")
    others = sized.select("k", F.col("label").alias("other"), F.col("size").alias("most")).distinct()
    meets = sized.join(others, "k").where(F.struct("size", "label") < F.struct("most", "other"))
    often = meets.groupBy("node", "other", "band").agg(F.count("*").alias("n"), F.max("lost").alias("lost"))
    return often.where(F.col("n") + F.col("lost") >= _of_band(least)).select("node", "other").distinct()


def in_blocks(left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the sets of ``left`` with those of ``right`` of the same group and another label; both are (kind, name, node, label).

    Either side of a group is packed in blocks of about SET_BLOCK shingles;
    blocks are compared whole inside tasks, and only links become rows.
    """

    def side(row: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array([r["node"] for r in row]), np.array([r["label"] for r in row]), *_numbers(pa.array([r["tokens"] for r in row], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            (xs, lx, tx, fx), (ys, ly, ty, fy) = (side(part.column(c)[0].as_py()) for c in (0, 1))
            order, found, ny = np.argsort(ty, kind="stable"), [], np.diff(fy)
            tokens, owner = ty[order], np.repeat(np.arange(len(ys)), ny)[order]
            for i, node in enumerate(xs):
                x = tx[fx[i] : fx[i + 1]]
                low, high = np.searchsorted(tokens, x), np.searchsorted(tokens, x, side="right")
                common = np.bincount(owner[_ranges(high - low, low)], minlength=len(ys))
                found += [(node, b) for b in ys[(DEN * common >= NUM * (len(x) + ny - common)) & (ly != lx[i])]]
            wide = np.array(found, np.int64).reshape(-1, 2)
            yield _batch({"a": wide[:, 0], "b": wide[:, 1]})

    def packs(group: DataFrame, to: str) -> DataFrame:
        sized = group.join(sets, "node")
        total = sized.groupBy("kind", "name").agg(F.ceil(F.sum("n") / SET_BLOCK).alias("blocks"))
        dealt = sized.join(total, ["kind", "name"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        return dealt.groupBy("kind", "name", "block").agg(F.collect_list(F.struct("node", "label", "tokens")).alias(to)).drop("block")

    return packs(left, "x").join(packs(right, "y"), ["kind", "name"]).select("x", "y").mapInArrow(released(run), "a long, b long")


def remaining(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) across the labels of ``rows``: the complete step.

    Sets that meet in a hot bucket are of one cluster, where each set outside
    the largest component is compared with all.  Others meet in buckets of few
    labels only, in as many as linked sets must, and are compared with the
    whole of the component.
    """
    nodes = cut(rows.select("node", "label").distinct())
    few, clusters = apart(rows)
    inside = cut(nodes.join(clusters, "node").select(F.lit(1).alias("kind"), F.col("cluster").alias("name"), "node", "label"))
    main = inside.groupBy("name", "label").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = inside.join(main, "name").where("label <> main").drop("main")
    wanted = cut(into(few, nodes)).join(nodes, "node").select(F.lit(0).alias("kind"), F.col("other").alias("name"), "node", "label")
    whole = nodes.select(F.lit(0).alias("kind"), F.col("label").alias("name"), "node", "label")
    return in_blocks(wanted.unionByName(outside), whole.unionByName(inside), sets)


def confirmed(links: DataFrame, docs: DataFrame) -> DataFrame:
    """``links`` (a, b) that hold on the words themselves."""

    def runs_of(text: bytes) -> set[tuple[bytes, ...]]:
        w = text.lower().split()
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, bytes, set] = (None, b"", set())
        for part in sliced(batches, 64):
            b, good = part.column(1).to_pylist(), []
            for i, (tx, ty) in enumerate(zip(_texts(part, 2), _texts(part, 3), strict=True)):
                if (b[i], ty) != last[:2]:
                    last = (b[i], ty, runs_of(ty))
                x, y = runs_of(tx), last[2]
                common = len(x & y)
                if DEN * common >= NUM * (len(x) + len(y) - common):
                    good.append(i)
            yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

    ends = small(cut(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    texts = cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ends, "doc_id", "left_semi").distinct())
    joined = links.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(released(run), "a long, b long")


def links_of(docs: DataFrame, met: DataFrame, given: DataFrame) -> DataFrame:
    """(node, label) of the sets that have links: the smallest node reachable.

    ``docs`` holds the sets' texts, ``met`` their index; ``given`` (a, b) are
    links besides.
    """
    stars, losses = met.where("k >= 0"), met.where(f"k < 0 and k <> {SIZES}").distinct()
    rows = written(narrowed(members_of(stars), losses))
    sets = written(packed_sets(docs, rows.select("node")))
    tidy(docs.sparkSession)
    found = cut(confirmed(cut(verify(with_smallest(rows), sets)), docs).unionByName(given))
    labels = components(found)
    for _ in range(ROUNDS):
        rows = written(narrowed(relabelled(rows, labels), losses))
        more = cut(verify(with_family(rows), sets))
        if more.isEmpty():
            break
        found = cut(found.unionByName(confirmed(forest(more, labels), docs)))
        labels = components(found)
    rows = narrowed(relabelled(rows, labels), losses)
    for _ in range(ROUNDS):
        rows = written(narrowed(with_tokens_elsewhere(written(rows), sets), losses))
        tidy(docs.sparkSession)
    more = cut(remaining(rows, sets))
    return labels if more.isEmpty() else components(found.unionByName(confirmed(forest(more, labels), docs)))


def forest(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One of the ``links`` for each pair of components that they join."""
    name = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    ends = links.join(name("a", "la"), "a", "left").join(name("b", "lb"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    one = ends.where("la <> lb").groupBy(F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high")).agg(F.min(F.struct("a", "b")).alias("link"))
    return cut(one.select("link.a", "link.b"))


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links.  Null and
    blank texts have no shingles and stand alone; a text of fewer than five
    words is one shingle; rows of one doc_id are one document, whose texts'
    groups are one; rows without an id have no component and link with
    nothing.  An empty table gives none.  Other columns are not looked at.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = written(names(docs))
    classes = named.where("name is not null and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("rep"))
    owned = written(named.join(cut(classes), "name", "left").select("doc_id", "rep"))
    each = cut(owned.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("rep <=> doc_id")).alias("first"), F.min("rep").alias("low"), F.max("rep").alias("high")))
    firsts = docs.where("doc_id is not null").join(small(each.where("not first").select("doc_id")), "doc_id", "left_anti")
    bridges = owned.join(each.where("low <> high").select("doc_id", "low"), "doc_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    met = written(index(firsts))
    tidy(docs.sparkSession)
    labels = links_of(firsts, met, bridges)
    least = labels.groupBy("label").agg(F.min("node").alias("component_id"))
    of_node = labels.join(least, "label").select(F.col("node").alias("rep"), "component_id")
    size = met.where(F.col("k") == SIZES).groupBy(F.col("a").alias("rep")).agg(F.max("b").alias("n_shingles"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id")).alias("component_id")
    return owned.join(size.join(of_node, "rep", "left"), "rep", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), component)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the one of the smallest id; of rows with one id, the first by text.

    Documents without an id or without shingles stay.  Other columns are
    untouched, whatever their names; only the ids of what goes are joined with
    the texts.
    """
    rows, first = unused(docs, "rows"), unused(docs, "first")
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(rows)).where(F.col(rows) > 1).select("doc_id"))
    if not again.isEmpty():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in sorted(docs.columns, key=lambda c: c != "text")]))
        once = docs.join(small(again), "doc_id", "left_anti")
        docs = once.unionByName(docs.join(small(again), "doc_id", "left_semi").withColumn(first, place).where(F.col(first) == 1).drop(first))
    goes = cut(link(docs).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(small(goes), "doc_id", "left_anti").select(*docs.columns)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, n_shingles, component_id, the smallest doc_id that links reach from it."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
