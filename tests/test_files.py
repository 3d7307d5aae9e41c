"""Folders of CSV files with what real ones hold: marks, other columns, bad lines, repeats, short series."""

from __future__ import annotations

import datetime as dt

import pytest

from quantloom.plans import file_queries
from quantloom.sources import files

HEAD = ",".join(files.BARS)


def put(path, *lines, mark="\ufeff"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(mark + "\n".join(lines) + "\n", encoding="utf-8")


def bar(code, d, close, pct="1.0"):
    return f"{code},{d},1,2,0.5,{close},9,{pct},100,1e3"


def test_series(spark, tmp_path):
    put(tmp_path / "sh/600000.csv", HEAD, *[bar("600000.SH", f"202401{i:02d}", i) for i in range(1, 7)], bar("600000.SH", "2024-01-03", 33), bar("600000.SH", "never", 1), bar("600000.SH", "20240108", "n/a"), bar("600000.SH", "20240109", 5) + ",7,8")
    swapped = ["trade_date", "ts_code", *files.BARS[2:]]
    put(tmp_path / "sz/000001.csv", ",".join([*swapped, "extra"]), *[f"2024010{i},000001.SZ,1,2,.5,{i},9,1,100,1000,x" for i in range(1, 6)], mark="")
    put(tmp_path / "sz/000002.csv", HEAD, *[bar("000002.SZ", f"2024010{i}", i) for i in range(1, 4)])
    put(tmp_path / "sz/000003.csv", "ts_code,trade_date,close", *[f"000003.SZ,2024010{i},1" for i in range(1, 8)])
    put(tmp_path / "sz/000004.csv", HEAD, *[bar("000004.SZ", "20240101", i) for i in range(1, 8)])
    got = sorted((r.ts_code, r.trade_date.day, r.close) for r in files.read_series(spark, str(tmp_path), 5).collect())
    assert got == [("000001.SZ", i, float(i)) for i in range(1, 6)] + [("600000.SH", i, 33.0 if i == 3 else float(i)) for i in range(1, 7)]


def test_days_pruned_by_name(spark, tmp_path):
    for i in range(1, 8):
        put(tmp_path / f"basic_2024010{i}.csv", "ts_code,trade_date,pe" if i % 2 else "pe,pb,ts_code,trade_date", *[f"c{k},2024010{i},{k + i}" if i % 2 else f"{k + i},inf,c{k},2024010{i}" for k in range(3)], ",20240101,5" if i % 2 else "5,1,,20240101")
    put(tmp_path / "other_20240101.csv", "ts_code,trade_date,pe", "zz,20240101,1")
    whole = files.read_days(spark, str(tmp_path), "basic", ("pe", "pb"))
    assert sorted((r.ts_code, r.trade_date.day, r.pe, r.pb) for r in whole.collect()) == sorted((f"c{k}", i, float(k + i), None) for i in range(1, 8) for k in range(3))
    assert {r.trade_date.day for r in files.read_days(spark, str(tmp_path), "basic", ("pe",), since="20240103", until="20240105").collect()} == {3, 4, 5}
    assert {r.trade_date.day for r in files.read_days(spark, str(tmp_path), "basic", ("pe",), last=2).collect()} == {6, 7}
    files.by_instrument(spark, str(tmp_path), str(tmp_path / "series"), "basic", ("pe",))
    again = files.ragged_csv(spark, str(tmp_path / "series"), ("ts_code", "trade_date", "pe"), "part-*")
    assert again.count() == 21 and {r["_file"].split("by_ts_code=")[1][:2] == r.ts_code for r in again.collect()} == {True}


def test_files_outside_the_days_are_not_opened(spark, tmp_path):
    put(tmp_path / "basic_20240101.csv", "ts_code,trade_date,pe", "c,20240101,1")
    bad = tmp_path / "basic_20240301.csv"
    put(bad, "ts_code,trade_date,pe", "c,20240301,1")
    plan = files.ragged_csv(spark, str(tmp_path), ("ts_code", "trade_date"), between=("20240101", "20240131"))
    bad.unlink()
    assert [r.trade_date for r in plan.collect()] == ["20240101"]


def test_news(spark, tmp_path):
    put(tmp_path / "site a/20240102.csv", "datetime,title,content", '2024-01-02 02:59,"a, ""b""","two\nlines"', "2024-01-02 03:00:01,t", "nonsense,t,c", "2024-01-09 00:00:00,late,c")
    put(tmp_path / "b/20240103.csv", "content,datetime", "only,20240103 01:02:03", mark="")
    put(tmp_path / "b/20240110.csv", "content,datetime", "after,2024-01-10 01:02:03")
    put(tmp_path / "b/_done.csv", "content,datetime", "ledger,2024-01-03 01:02:03")
    got = sorted(tuple(r) for r in files.read_news(spark, str(tmp_path), "20240101", "20240105").collect())
    assert got == [("b", dt.datetime(2024, 1, 3, 1, 2, 3), "", "only"), ("site a", dt.datetime(2024, 1, 2, 2, 59), 'a, "b"', "two\nlines"), ("site a", dt.datetime(2024, 1, 2, 3, 0, 1), "t", "")]


def test_reports_keep_the_last(spark, tmp_path):
    put(tmp_path / "f1.csv", "ts_code,ann_date,roe", "a,20240101,1", "a,20240101,2", "a,,3", "b,20240101,x")
    put(tmp_path / "f2.csv", "ann_date,ts_code,roe,eps", "20240101,a,4,0.5")
    got = sorted(((r.ts_code, r.roe, r.eps) for r in files.read_reports(spark, str(tmp_path), ("roe", "eps")).collect()), key=str)
    assert got == [("a", 4.0, 0.5), ("b", None, None)]


@pytest.mark.parametrize("kind", ["csv", "parquet", "json"])
def test_written_by_key(kind, spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x, "y"\nz'), ("b", 2, "é")], "k string, n int, t string")
    files.write_by(df, str(tmp_path / "out"), ["k"], kind)
    if kind == "csv":
        raw = [p.read_bytes() for p in (tmp_path / "out").rglob("*.csv")]
        assert len(raw) == 2 and all(r.startswith(b"\xef\xbb\xbf") for r in raw)
        got = files.ragged_csv(spark, str(tmp_path / "out"), ("k", "n", "t")).select("k", "n", "t")
    else:
        got = spark.read.format(kind).load(str(tmp_path / "out")).select("k", "n", "t")
    assert sorted((r.k, int(r.n), r.t) for r in got.collect()) == [("a", 1, 'x, "y"\nz'), ("b", 2, "é")]
    with pytest.raises(ValueError, match="no such kind"):
        files.write_by(df, str(tmp_path / "no"), ["k"], "xml")


def test_news_files_are_few(spark, sf, tmp_path, monkeypatch):
    """A file per source and month, not per source and day, which is a file for every other document."""
    monkeypatch.setattr(file_queries, "place_of", lambda _: str(tmp_path))
    assert file_queries.s04(spark, sf).count() > 0
    written = list(tmp_path.rglob("*.csv"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("count(*) as n", "count(distinct source) as sources", "max(doc_id) * 37 / (28 * 1440) + 2 as months").first()
    assert len(written) <= (rows["sources"] + 1) * rows["months"] and 2 * len(written) < rows["n"]


def test_news_of_days_from_files_by_month(spark, tmp_path):
    for name, days in (("20240101", ("2024-01-02", "2024-01-31")), ("20240201", ("2024-02-01", "2024-02-03"))):
        folder = tmp_path / "s" / name
        folder.mkdir(parents=True)
        (folder / "part.csv").write_text("datetime,title,content\n" + "".join(f"{d} 10:00:00,t,c\n" for d in days))
    found = files.read_news(spark, str(tmp_path), "20240131", "20240202", "*.csv", r"([^/]+)/[0-9]+/[^/]+$", by_month=True)
    assert sorted(str(r["datetime"])[:10] for r in found.collect()) == ["2024-01-31", "2024-02-01"]


def test_series_of_instruments_that_share_a_code_stay_whole(spark, tmp_path, monkeypatch):
    """Suppliers 1000 and 10000 have one code; bars of both on one day are two rows, as in SQL."""
    days = [dt.datetime(1994, 1, 1) + dt.timedelta(days=k) for k in range(300)]
    rows = [(s, d, 5.0, 100.0, 0.05, 0.04) for s in (1000, 10000) for d in days]
    place = tmp_path / "sf"
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{place}/lineitem.parquet")
    monkeypatch.setattr(file_queries, "place_of", lambda _: str(tmp_path))
    assert file_queries.s01(spark, str(place)).count() == 600
