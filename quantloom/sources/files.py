"""Panels and news in folders of CSV files: read with ragged columns and bad lines, pruned by file name, written and laid out anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = ("ts_code", "trade_date", "open", "high", "low", "close", "pre_close", "pct_chg", "vol", "amount")
BOM = "\ufeff"
#: Ways in which files write days and times; the first that fits counts.
DAYS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")
TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")
#: A file's day ends its name, or the name of its folder.
DAY_IN_NAME = r"(\d{8})(?:\.csv|/[^/]*\.csv)$"


def day(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DAYS]).cast("date")


def moment(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIMES])


def number(text: Column, finite: bool = True) -> Column:
    """A finite number, or without ``finite`` any, null for anything else."""
    x = F.trim(text).try_cast("double")
    return x if not finite else F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def listed(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, name, size) of the files below a folder; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))


def ragged_csv(spark: SparkSession, folder: str, columns: tuple[str, ...], pattern: str = "*.csv", names: list[str] | None = None, between: tuple[str, str] | None = None, days: list[str] | None = None) -> DataFrame:
    """The given columns of all CSV files below a folder, as strings, with ``_file`` and ``_order``, a row's place in its file.

    A column that a file doesn't have is null in its rows; ``names`` are columns that a file must
    have to be read.  Rows with more fields than the header are left out, missing ones at the end are
    null; quoted fields may span lines.  Files differ in few headers; those of one are read by its columns.
    ``between`` (two yyyymmdd, inclusive) and ``days`` (a list of them) select files by the day in their names, or their folders', before any is opened.
    """
    reader = lambda: spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    at = F.regexp_extract(F.col("_metadata.file_path"), DAY_IN_NAME, 1)

    def chosen(df: DataFrame) -> DataFrame:
        if between:
            df = df.where((at >= between[0]) & (at <= between[1]))
        return df.where(at.isin(days)) if days is not None else df

    lines = chosen(reader().text(folder)).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_i"), "value")
    first = lines.groupBy("_path").agg(F.min_by("value", "_i").alias("head"))
    heads = first.select("_path", F.regexp_replace(F.regexp_replace("head", BOM, ""), '["\r]', "").alias("head"))
    kinds = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    shape = ", ".join(f"`{c}` string" for c in columns)
    out = spark.createDataFrame([], f"{shape}, _file string, _order struct<block: bigint, i: bigint>")
    for head in kinds:
        own = [c.strip() for c in head.split(",")]
        if not set(names or ()) <= set(own):
            continue
        # Fields beyond the header land in the last column.
        schema = ", ".join([*(f"`c{k}` string" for k in range(len(own))), "`_more` string"])
        rows = reader().schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').option("mode", "PERMISSIVE").csv(folder)
        rows = chosen(rows).withColumns({"_path": F.col("_metadata.file_path"), "_order": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))})
        rows = rows.where("_more is null").join(heads.where(F.col("head") == head).select("_path"), "_path", "left_semi")
        out = out.unionByName(rows.select(*[(F.col(f"c{own.index(c)}") if c in own else F.lit(None).cast("string")).alias(c) for c in columns], F.col("_path").alias("_file"), "_order"))
    return out


def read_series(spark: SparkSession, folder: str, least: int = 60, once: bool = True, finite: bool = True) -> DataFrame:
    """Bars from files of one instrument each, typed, one row per day, the last of the file; all rows of a day without ``once``.

    Numbers that aren't finite count as missing, without ``finite`` as they are.

    Files need all columns of ``BARS`` and ``least`` rows, before and after
    rows without a day, a close, a previous close or a change are left out.
    """
    raw = ragged_csv(spark, folder, BARS, names=list(BARS))
    whole = raw.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_file"))).where(F.col("_n") >= least)
    typed = whole.select("ts_code", day(F.col("trade_date")).alias("trade_date"), *[number(F.col(c), finite).alias(c) for c in BARS[2:]], "_file", "_order").where("trade_date is not null and close is not null and pre_close is not null and pct_chg is not null")
    w = Window.partitionBy("_file", "trade_date").orderBy(F.desc("_order"))
    rows = typed.withColumn("_k", F.row_number().over(w)).where("_k = 1") if once else typed
    kept = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_file"))).where(F.col("_n") >= least)
    return kept.select(*BARS)


def read_days(spark: SparkSession, folder: str, prefix: str | None, columns: tuple[str, ...], since: str | None = None, until: str | None = None, last: int | None = None) -> DataFrame:
    """(ts_code, trade_date, columns as numbers) of the files ``<prefix>_<yyyymmdd>.csv``, or without a prefix of all that a folder of a day holds; rows without a key are left out.

    ``since`` and ``until`` prune files by name, ``last`` takes the last so many days that have a file.
    """
    days, pattern = None, f"{prefix}_*.csv" if prefix else "*.csv"
    if last is not None:
        names = listed(spark, folder, pattern).select(F.regexp_extract("path", DAY_IN_NAME, 1).alias("d")).where("d <> ''").distinct()
        days = [r["d"] for r in names.orderBy(F.desc("d")).limit(last).collect()]
    between = (since or "00000000", until or "99999999") if since or until else None
    raw = ragged_csv(spark, folder, ("ts_code", "trade_date", *columns), pattern, between=between, days=days)
    return raw.select("ts_code", day(F.col("trade_date")).alias("trade_date"), *[number(F.col(c)).alias(c) for c in columns]).dropna(subset=["ts_code", "trade_date"])


def read_news(spark: SparkSession, folder: str, start: str, end: str, pattern: str = "[0-9]*.csv", source: str = r"([^/]+)/[^/]+$", by_month: bool = False) -> DataFrame:
    """(source, datetime, title, content) of ``<source>/<yyyymmdd>.csv`` between two days (yyyymmdd); the source is what ``source`` finds in the path, the file's folder.

    ``by_month``: a file holds the month that begins on the day in its name.  Times are read in several ways; rows without one, or outside the days, are left out.  Missing texts are empty.
    """
    raw = ragged_csv(spark, folder, ("datetime", "title", "content"), pattern, between=(f"{start[:6]}01" if by_month else start, end))
    rows = raw.select(F.regexp_extract(F.url_decode("_file"), source, 1).alias("source"), moment(F.col("datetime")).cast("timestamp_ntz").alias("datetime"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "content")])
    return rows.where(F.date_format("datetime", "yyyyMMdd").between(start, end))


def read_reports(spark: SparkSession, folder: str, columns: tuple[str, ...], key: tuple[str, ...] = ("ts_code", "ann_date")) -> DataFrame:
    """Statements by instrument: key and columns as numbers, without rows that have no announcement day, the last of each key in file order."""
    raw = ragged_csv(spark, folder, (*key, *columns))
    typed = raw.select(*[(day(F.col(k)) if k.endswith("date") else F.col(k)).alias(k) for k in key], *[number(F.col(c)).alias(c) for c in columns], "_file", "_order").dropna(subset=list(key))
    w = Window.partitionBy(*key).orderBy(F.desc("_file"), F.desc("_order"))
    return typed.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_file", "_order")


def write_by(df: DataFrame, folder: str, by: list[str], kind: str = "csv", mode: str = "append") -> None:
    """``df`` in one folder per value of ``by``, its columns kept in the files too; rows of one value lie together.

    CSV files begin with a byte order mark, as spreadsheets want it; ``parquet`` and ``json`` are the other kinds.
    """
    copies = {f"by_{c}": F.col(c).cast("string") for c in by}
    rows = df.withColumns(copies).repartition(*copies)
    names = df.columns
    if kind == "csv":
        rows = rows.withColumnRenamed(names[0], BOM + names[0])
    writer = rows.write.mode(mode).partitionBy(*copies)
    if kind == "csv":
        writer.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("dateFormat", "yyyyMMdd").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(folder)
    elif kind in ("parquet", "json"):
        writer.format(kind).save(folder)
    else:
        raise ValueError(f"no such kind of file: {kind}")


def by_instrument(spark: SparkSession, days: str, series: str, prefix: str, columns: tuple[str, ...]) -> None:
    """Files by day laid out anew by instrument."""
    write_by(read_days(spark, days, prefix, columns), series, ["ts_code"])
