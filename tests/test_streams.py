"""Keyed state and upserts of streams: restarts, late rows, replays, broken batches."""

from __future__ import annotations

import datetime as dt

import pytest

from quantloom.streaming import jobs, state
from quantloom.streaming.upsert import KeyedTable

SHAPE = "ts_code string, trade_date date, close double, pct_chg double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def walk(rows):
    """The indicators of each instrument's rows, by loops."""
    out = {}
    for code in {r[0] for r in rows}:
        held = None
        for _, d, close, change in sorted(r for r in rows if r[0] == code):
            held = state.step(held, close, change)
            out[code, d] = (held[0] - held[1], held[2], held[3])
    return out


def test_state_carries_over_and_late_rows_leave(spark):
    rows = [(c, day(n), 10.0 + (n * 7 + k * 3) % 11, float((n + k) % 3 - 1)) for k, c in enumerate("abc") for n in range(30)]
    slices = [[r for r in rows if r[1] < day(12)], [r for r in rows if day(12) <= r[1] < day(13)], [r for r in rows if r[1] >= day(13)]]
    late = [("a", day(3), 99.0, 5.0), ("b", day(12), 98.0, 5.0)]
    frames = [spark.createDataFrame(s, SHAPE).repartition(3) for s in (slices[0], slices[1], slices[2] + late)]
    empty = spark.createDataFrame([(None, day(1), 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", day(90), None, 1.0)], SHAPE)
    main, side = state.feed(spark, [*frames, empty])
    got = {(r.ts_code, r.trade_date): (r.macd, r.macd_signal, r.up_days) for r in main.collect()}
    expected = walk(rows)
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in expected)
    assert sorted((r.ts_code, r.trade_date, r.close) for r in side.collect()) == sorted(r[:3] for r in late)


KEYED = "code string, day string, n long, value double"


def table(spark, place):
    return KeyedTable(spark, place, KEYED, ["code", "day"], ["n"], buckets=4)


def rows_of(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


def test_merge_keeps_the_last_and_replays_change_nothing(spark):
    t = table(spark, jobs.place_of(spark))
    assert rows_of(t) == []
    first = spark.createDataFrame([("a", "20240101", 1, 1.0), ("a", "20240101", 2, 2.0), ("b", "20240101", 1, 3.0), (None, None, 1, 4.0)], KEYED)
    second = spark.createDataFrame([("a", "20240101", 1, 9.0), ("c", "20240102", 1, None), (None, None, 0, 5.0)], KEYED)
    assert t.merge(first, 0) and t.merge(second, 1)
    expected = sorted([("a", "20240101", 1, 9.0), ("b", "20240101", 1, 3.0), ("c", "20240102", 1, None), (None, None, 0, 5.0)], key=str)
    assert rows_of(t) == expected
    assert not t.merge(first, 0) and not t.merge(first, 1)
    assert rows_of(t) == expected
    assert t.vacuum()
    assert rows_of(table(spark, t.path)) == expected


def test_a_broken_batch_is_not_read_and_can_be_repeated(spark, monkeypatch):
    t = table(spark, jobs.place_of(spark))
    t.merge(spark.createDataFrame([("a", "1", 1, 1.0)], KEYED), 0)
    batch = spark.createDataFrame([("a", "1", 2, 7.0), ("d", "1", 1, 8.0)], KEYED)
    real = spark.createDataFrame

    def broken(data, schema=None, *args, **kwargs):
        if schema == "bucket int, version int":
            raise OSError("lost before the ledger")
        return real(data, schema, *args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", broken)
        with pytest.raises(OSError, match="lost"):
            t.merge(batch, 1)
    assert rows_of(t) == [("a", "1", 1, 1.0)]
    assert t.merge(batch, 1)
    assert rows_of(t) == [("a", "1", 2, 7.0), ("d", "1", 1, 8.0)]


def test_a_batch_without_rows(spark):
    t = table(spark, jobs.place_of(spark))
    assert t.merge(spark.createDataFrame([], KEYED), 0)
    assert rows_of(t) == [] and t.done(0)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_of(spark, place, *slices):
    """Events in slices; each is a file of its own that one batch reads, in order."""
    for rows in slices:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(place)


def at(d, hour=0, minute=0):
    return dt.datetime(2024, 1, d, hour, minute)


def test_closed_windows_drop_late_rows_and_emit_all_else_once(spark):
    first = [(1, at(1, 5), 1, "a", 1.0, None), (2, at(2, 7), 1, "a", 2.0, None)]
    second = [(3, at(3, 12), 1, "a", 4.0, None)]
    late = [(4, at(1, 6), 1, "a", 100.0, None), (5, at(3, 13), 2, "b", 8.0, None)]
    events = stream_of(spark, f"{jobs.place_of(spark)}/events", first, second, late)
    got = sorted((r.day.day, r.event_type, r.n, r.cents) for r in jobs.closed(events, jobs.daily_rollup, at(3, 13)).collect())
    assert got == [(1, "a", 1, 100), (2, "a", 1, 200), (3, "a", 1, 400), (3, "b", 1, 800)]


def test_sessions_are_closed_by_the_gap(spark):
    rows = [(i, at(1, 0, m), u, "a", 1.0, None) for i, (u, m) in enumerate([(1, 0), (1, 20), (1, 55), (2, 10)])]
    events = stream_of(spark, f"{jobs.place_of(spark)}/events", rows)
    got = sorted((r.user_id, r.started.minute, r.n) for r in jobs.closed(events, jobs.sessions, at(1, 0, 55)).collect())
    assert got == [(1, 0, 2), (1, 55, 1), (2, 10, 1)]


def test_first_of_content_forgets_beyond_its_horizon(spark):
    rows = [[(1, at(1), 1, "a", 1.0, None), (2, at(1, 1), 1, "a", 1.0, None)], [(3, at(10), 9, "z", 1.0, None)], [(5, at(10, 1), 8, "y", 1.0, None)], [(4, at(11), 1, "a", 1.0, None)]]
    events = stream_of(spark, f"{jobs.place_of(spark)}/events", *rows)
    got = jobs.drained(jobs.first_of_content(events, "event_type", "ts", "2 days").select("event_id", "event_type")).collect()
    assert sorted(r.event_type for r in got) == ["a", "a", "y", "z"] and {3, 4} <= {r.event_id for r in got}


def test_bars_of_one_day_all_count(spark):
    rows = [("a", day(n), 10.0 + n % 5 + k, float(n % 3 - 1)) for n in range(9) for k in range(2)]
    main, side = state.feed(spark, [spark.createDataFrame([r for r in rows if (r[1] < day(4)) == early], SHAPE).repartition(3) for early in (True, False)])
    held, expected = None, []
    for code, d, close, change in sorted(rows):
        held = state.step(held, close, change)
        expected.append((code, d, held[0] - held[1], held[2], held[3]))
    got = sorted((r.ts_code, r.trade_date, r.macd, r.macd_signal, r.up_days) for r in main.collect())
    assert len(got) == 18 and side.count() == 0
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in zip(got, sorted(expected), strict=True))


def test_keyed_state_equals_its_sql_where_codes_repeat(spark, tmp_path):
    import duckdb

    from quantloom.plans import registry

    # Suppliers 1000 and 10000 have the code of four places in common. On days of both the price stays, so that their order makes no difference.
    duckdb.sql(f"""copy (select s as l_suppkey, cast(1 + d % 3 as double) as l_quantity, 100e0 + d as l_extendedprice, case when d % 2 = 0 then 5e-2 else (d * 7 % 11) / 1e2 end as l_discount, (d % 9) / 1e2 as l_tax,
      timestamp '1994-05-01' + d * interval 1 day as l_shipdate from (values (1000), (10000), (1001)) t(s), range(60) r(d) where s < 10000 or d % 2 = 0) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    got = sorted(tuple(r) for r in registry.QUERIES["ts7_keyed_state"](spark, str(tmp_path)).collect())
    expected = sorted(duckdb.sql(registry.ORACLE_SQL["ts7_keyed_state"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet'")).fetchall())
    assert len(got) == 30 + 30 * 4 + 60
    assert all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9) for a, b in zip(got, expected, strict=True))
