"""Merkle manifests of a dataset: digests of rows, trees per language and over languages, proofs, and their check.

A level of a tree is a table of nodes that are numbered within their group.
Per level, lag and lead columns of fixed offsets, masked by a node's slot in its
run and by the run's length, supply its siblings; the first child of each run
hashes the parent.  A window covers a block of nodes, so no group is sorted in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_parts, stored, written

#: Nodes that become one parent, and nodes of a window.
FAN = 8
BLOCK = FAN**3
# What stands for null, and what separates a value's length from it.
NULL, MARK = "-", ":"


def digest(text: Column) -> Column:
    """SHA-256 in lower-case hexadecimal; stored as bytes by the tables below."""
    return F.sha2(text.cast("binary"), 256)


def packed(text: Column) -> Column:
    return F.unhex(text)


def shown(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def field(value: Column) -> Column:
    """A value with its UTF-8 length in front."""
    text = value.cast("string")
    return F.when(text.isNull(), NULL).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(MARK), text))


def row_digest(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the CRC of the number, else as it is."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``idx``, the place from 0 within the group, and ``n``, the group's rows; and the largest ``n``.

    Rows are sorted by range over all tasks and kept as a table; each task's
    counts per group, added up, say where its rows start.  Null is a group of
    its own.
    """
    dealt = rows.repartitionByRange(shuffle_parts(rows), group, *order).sortWithinPartitions(group, *order)
    kept, sorted_at = stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    counts = kept.groupBy(F.col(group).alias("_g"), task.alias("_task")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_g")
    before = F.sum("_c").over(w.orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    starts, starts_at = stored(counts.select("_g", "_task", (before - F.col("_from")).alias("_shift"), F.sum("_c").over(w).alias("n")))
    most = starts.agg(F.max("n")).first()[0] or 0
    met = kept.withColumn("_task", task).join(starts.withColumnRenamed("_task", "_t"), (F.col("_task") == F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")))
    out = written(met.withColumn("idx", F.col("_at") + F.col("_shift")).select(*rows.columns, "idx", "n"))
    discard(rows.sparkSession, sorted_at, starts_at)
    return out, most


def siblings(nodes: DataFrame, group: str) -> DataFrame:
    """``nodes`` with ``left`` and ``right``: the digests of the other nodes of the run, before and after, as one text each."""
    w = Window.partitionBy(group, F.floor(F.col("idx") / BLOCK)).orderBy("idx")
    slot = F.col("idx") % FAN
    length = F.least(F.lit(FAN), F.col("n") - (F.col("idx") - slot))
    lags = [F.when(slot >= k, shown(F.lag("digest", k).over(w))) for k in range(FAN - 1, 0, -1)]
    leads = [F.when(slot + k < length, shown(F.lead("digest", k).over(w))) for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat_ws("", *lags), "right": F.concat_ws("", *leads)})


def parents(nodes: DataFrame, group: str) -> DataFrame:
    """The next level: the first child of each run hashes the run.  A group of one node stays as it is."""
    own = shown(F.col("digest"))
    up = F.when(F.col("n") > 1, packed(digest(F.concat(own, "right")))).otherwise(F.col("digest"))
    first = siblings(nodes, group).where(F.col("idx") % FAN == 0)
    return first.select(group, F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), up.alias("digest"))


def levels(nodes: DataFrame, group: str, most: int) -> list[DataFrame]:
    """All levels of the trees of ``nodes``, from the leaves to the roots, each a table."""
    out = [nodes.select(group, "idx", "n", "digest")]
    while most > 1:
        out.append(written(parents(out[-1], group)))
        most = -(-most // FAN)
    return out


STEP = "array<struct<left: string, right: string>>"


def paths(above: list[DataFrame], group: str, top: DataFrame | None) -> DataFrame:
    """(group, idx, root, path) of the lowest level of ``above``: siblings level by level up to the group's root, then those of ``top`` by group.

    Each level takes what its parents have; tables get smaller by the fan from
    level to level, and only roots, one a group, meet ``top``.
    """
    roots = above[-1].select(group, "idx", F.col("digest").alias("root"))
    found = roots.withColumn("path", F.array().cast(STEP)) if top is None else roots.join(top, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    for nodes in reversed(above[:-1]):
        found = add_level(nodes, found, group)
    return found.select(group, "idx", "root", "path")


def add_level(nodes: DataFrame, parent_paths: DataFrame, group: str) -> DataFrame:
    """``nodes`` with the root above them and their path: their own siblings, then their parent's path."""
    up = parent_paths.select(F.col(group).alias("_pg"), F.col("idx").alias("_pi"), F.col("path").alias("_up"), "root")
    met = siblings(nodes, group).join(up, (F.floor(F.col("idx") / FAN) == F.col("_pi")) & F.col(group).eqNullSafe(F.col("_pg")))
    own = F.array(F.struct("left", "right")).cast(STEP)
    return met.withColumn("path", F.when(F.col("n") > 1, F.concat(own, F.col("_up"))).otherwise(F.col("_up"))).drop("_pg", "_pi", "_up", "left", "right")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: Column | None = None) -> DataFrame:
    """Per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes the named columns.  Leaves of a group stand by key, null
    first, rows of one key by digest; so equal rows have neighbouring leaves of
    equal digest, and any order of them gives the same tree.  Groups stand by their UTF-8 bytes, null first.
    ``changed`` is the text as it is found when the proof is checked; without it, nothing has
    been changed.  An empty table has no rows and no root.
    """
    old = [F.col(f"`{c}`") for c in columns]
    new = [changed if changed is not None and c == columns[-1] else F.col(f"`{c}`") for c in columns]
    leaves = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("grp"), packed(row_digest(*old)).alias("digest"), packed(row_digest(*new)).alias("seen"))
    leaves, leaves_at = stored(leaves)
    rows, most = numbered(leaves, "grp", ["key", "digest"])
    discard(docs.sparkSession, leaves_at)
    trees = levels(rows, "grp", most)
    subroots, n_groups = numbered(trees[-1].select(F.lit(0).alias("all"), F.col("grp").alias("sub"), "digest"), "all", ["sub"])
    tops = levels(subroots, "all", n_groups)
    whole = tops[-1].first()
    root = F.lit(whole["digest"] if whole else None).cast("binary")
    top_paths = paths(tops, "all", None)
    top = subroots.join(top_paths.select(F.col("idx").alias("_i"), "path"), F.col("idx") == F.col("_i")).select(F.col("sub").alias("_g"), "path")
    if len(trees) > 1:
        found = add_level(rows, paths(trees[1:], "grp", top), "grp")
    else:
        found = rows.withColumn("root", F.col("digest")).join(top, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    leaf, path = shown(F.col("digest")), F.col("path")
    sides = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(F.col("key").alias(key), leaf.alias("leaf"), shown(F.col("root")).alias("subroot"), shown(root).alias("root"), digest(sides).alias("proof_sha256"), folded(shown(F.col("seen")), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: its leaf, the roots above it, its proof's digest, and the root that the tampered copy leads to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(docs, changed=tampered(F.col("doc_id"), F.col("text")))


OP12_SQL = """with recursive
table_of(i, k, c) as (
  select i, 0, cast(i as bigint) from range(256) t(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from table_of where k < 8),
crc(s, p, c) as (
  select s, 1, cast(4294967295 as bigint) from (select distinct cast(doc_id as varchar) as s from documents where doc_id is not null) x
  union all select s, p + 1, xor(c // 256, t.v) from crc join (select i, c as v from table_of where k = 8) t on t.i = xor(c, ascii(substr(s, p, 1))) % 256 where p <= length(s)),
hit as (select s from crc where p = length(s) + 1 and xor(c, 4294967295) % 3 = 0),
docs as (
  select d.*, case when h.s is null then text else translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as seen
  from documents d left join hit h on h.s = cast(d.doc_id as varchar)),
parts as (
  select doc_id, lang, seen, text, {head} as head from docs),
leaves as (
  select doc_id, lang, sha256(head || {text}) as leaf, sha256(head || {seen}) as seen_leaf from parts),
numbered as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from leaves),
tree(level, lang, idx, n, digest) as (
  select 0, lang, idx, n, leaf from numbered
  union all select max(level) + 1, lang, idx // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' order by idx)) from tree where n > 1 group by lang, idx // 8),
subroots as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from tree where n = 1),
top(level, idx, n, digest) as (
  select 0, idx, n, digest from subroots
  union all select max(level) + 1, idx // 8, (max(n) + 7) // 8, sha256(string_agg(digest, '' order by idx)) from top where n > 1 group by idx // 8),
node as (
  select level, 0 as upper, lang, idx, n, digest from tree
  union all select level, 1, null, idx, n, digest from top),
sides as (
  select a.level, a.upper, a.lang, a.idx, max(a.n) as n, coalesce(string_agg(b.digest, '' order by b.idx) filter (where b.idx < a.idx), '') as l,
         coalesce(string_agg(b.digest, '' order by b.idx) filter (where b.idx > a.idx), '') as r
  from node a join node b on b.level = a.level and b.upper = a.upper and b.lang is not distinct from a.lang and b.idx // 8 = a.idx // 8
  group by a.level, a.upper, a.lang, a.idx),
walk(leaf_idx, leaf_lang, upper, level, idx, proof, acc) as (
  select idx, lang, 0, 0, idx, '', seen_leaf from numbered
  union all
  select w.leaf_idx, w.leaf_lang, case when s.n > 1 then w.upper else w.upper + 1 end, case when s.n > 1 then w.level + 1 else 0 end,
         case when s.n > 1 then w.idx // 8 else coalesce(sub.idx, 0) end,
         case when s.n > 1 then w.proof || s.l || s.r else w.proof end,
         case when s.n > 1 then sha256(s.l || w.acc || s.r) else w.acc end
  from walk w join sides s on s.upper = w.upper and s.level = w.level and s.idx = w.idx and (w.upper = 1 or s.lang is not distinct from w.leaf_lang)
  left join subroots sub on sub.lang is not distinct from w.leaf_lang
  where w.upper < 2)
select n.doc_id, n.leaf, s.digest as subroot, r.digest as root, sha256(w.proof) as proof_sha256, w.acc as folded_root, w.acc = r.digest as verified
from numbered n join walk w on w.leaf_idx = n.idx and w.leaf_lang is not distinct from n.lang and w.upper = 2
join subroots s on s.lang is not distinct from n.lang cross join (select digest from top where n = 1) r"""


def _sql_field(c: str) -> str:
    return f"case when {c} is null then '-' else cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar) end"


OP12_SQL = OP12_SQL.format(head=" || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars")), text=_sql_field("text"), seen=_sql_field("seen"))
