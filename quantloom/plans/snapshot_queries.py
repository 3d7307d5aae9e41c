"""Queries on what is known of each instrument at a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import quantise
from ..operators import snapshots as S
from .base import query, sql_q

KEYS = ["ts_code", "trade_date"]
W = "over (partition by ts_code order by trade_date)"


def _before(k: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {k} preceding and 1 preceding)"


def _last(k: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {k - 1} preceding and current row)"


@query("w42_histories", "with r as (select *, row_number() over (partition by ts_code order by trade_date desc) as n from bars) select ts_code, max(trade_date) as trade_date, cast(count(*) as integer) as n, array_to_string(list(close order by trade_date), ',') as closes, cast(sum(vol) as bigint) as vol from r where n <= 30 group by 1")
def w42(T):
    """Thirty bars of history of each instrument, as arrays (here joined to a text)."""
    d = S.histories(T("bars"), ["close", "vol"], 30)
    return d.select(*KEYS, "n", F.array_join(F.transform("close_path", lambda x: x.cast("string")), ",").alias("closes"), F.aggregate("vol_path", F.lit(0).cast("long"), lambda a, x: a + x).alias("vol"))


@query("w44_quarter_starts", f"""with r as (select *, close / nullif(lag(close) {W}, 0) - 1 as r, date_trunc('quarter', trade_date) as q, row_number() {W} as listed_bars from bars),
f as (select *, {', '.join(f'lag(close, 1) {W} / nullif(lag(close, {k + 1}) {W}, 0) - 1 as ret_{k}' for k in (20, 60, 250))},
  {', '.join(f'lag(close, 1) {W} / nullif(case when count(close) {_before(k)} = {k} then max(close) {_before(k)} end, 0) - 1 as drawdown_{k}' for k in (60, 250))},
  case when count(close) {_before(60)} = 60 then stddev_samp(r) {_before(60)} end as spread_60, case when count(close) {_before(20)} = 20 then avg(amount) {_before(20)} end as turnover_20, lag(q) {W} as pq from (select *, date_trunc('quarter', trade_date) as q2 from r) x)
select ts_code, trade_date, cast(q as date) as quarter, cast(listed_bars as integer) as listed_bars, {', '.join(f'{sql_q(c)} as {c}' for c in ('ret_20', 'ret_60', 'ret_250', 'drawdown_60', 'drawdown_250', 'spread_60'))}, {sql_q('turnover_20', 4)} as turnover_20 from f where pq is null or pq <> q""")
def w44(T):
    """Features at the first bar of every quarter."""
    d = S.quarter_starts(T("bars"))
    return d.select(*KEYS, "quarter", "listed_bars", *[quantise(F.col(c)).alias(c) for c in ("ret_20", "ret_60", "ret_250", "drawdown_60", "drawdown_250", "spread_60")], quantise(F.col("turnover_20"), 4).alias("turnover_20"))


_DAYS = """with e as (select label as key, cast(timestamp '2024-01-01 00:00:00' + vec_id % 40 * interval '7' hour as date) as day, list_transform(embedding[1:8], lambda x: cast(x as double)) as v from embeddings where label is not null),
p as (select key, day, generate_subscripts(v, 1) as i, unnest(v) as x from e), m as (select key, day, i, avg(x) as m, count(*) as n from p group by 1, 2, 3)
"""


def _news_days(T):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("vec_id") % 40 * 7 / 24).cast("int"))
    items = T("embeddings").where("label is not null").select(F.col("label").alias("key"), day.alias("day"), F.slice("embedding", 1, 8).alias("v"))
    return S.day_vectors(items, "key", "day", "v", 8)


@query("f21_day_vectors", _DAYS + f"select key, day, max(n) as n, {sql_q('sum(m * i)', 4)} as weighed from m group by 1, 2")
def f21(T):
    """Mean vector of each key and day (here as a weighted sum)."""
    return _news_days(T).select("key", "day", "n", quantise(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)).alias("weighed"))


@query("f21_vector_windows", _DAYS + f""", d as (select key, day, list(m order by i) as v from m group by 1, 2), s as (select d.key, d.day, cast(g.s as date) as slot, 5 - datediff('day', cast(g.s as date), d.day) as k from d, unnest(generate_series(d.day - interval 4 day, d.day, interval 1 day)) g(s))
select s.key, s.day, count(x.day) as n_days, {sql_q('sum(s.k * coalesce(x.v[1] + 2 * x.v[8], 0))', 4)} as weighed from s left join d x on x.key = s.key and x.day = s.slot group by 1, 2""")
def f21_windows(T):
    """Five calendar days of vectors, zeros where there was nothing."""
    d = S.vector_window(_news_days(T), "key", "day", "v", 8, 5)
    weighed = F.aggregate(F.transform("window", lambda v, i: (i + 1) * (v[0] + 2 * v[7])), F.lit(0.0), lambda a, x: a + x)
    return d.select("key", "day", F.size(F.filter("window", lambda v: F.exists(v, lambda x: x != 0))).cast("long").alias("n_days"), quantise(weighed).alias("weighed"))


@query("a07_resampled", f"""with m as (select symbol, time_bucket(interval '6 hours', ts) as ts, avg({'cast(floor(price * 1e2 + 5e-1) as bigint)'}) as cents from tick where price is not null group by 1, 2), s as (select symbol, min(ts) as a, max(ts) as b from m group by 1),
g as (select symbol, unnest(generate_series(a, b, interval 6 hour)) as ts from s)
select g.symbol, g.ts, {sql_q('last_value(m.cents ignore nulls) over (partition by g.symbol order by g.ts rows between unbounded preceding and current row)', 3)} as cents, m.cents is null as filled from g left join m on m.symbol = g.symbol and m.ts = g.ts""")
def a07(T):
    """Six-hour means of ticks on a whole grid, empty intervals filled from before."""
    ticks = T("tick").select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("price") * 100 + 0.5).cast("long").alias("cents"))
    return S.resampled(ticks, "symbol", "ts", "cents", "6 hours", 21_600).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), quantise(F.col("cents"), 3).alias("cents"), "filled")


def _mean(x: str, k: int) -> str:
    return f"case when count({x}) {_last(k)} = {k} then avg({x}) {_last(k)} end"


@query("w36_setups", f"""with b as (select *, high - low as span, cast(vol as double) as dv from bars), r as (select *, case when count(high) {_before(20)} = 20 then max(high) {_before(20)} end as hi, {_mean('close', 20)} as m, {_mean('close', 60)} as l, {_mean('span', 5)} as s5, {_mean('span', 20)} as s20, {_mean('dv', 20)} as v20, row_number() over (partition by ts_code order by trade_date desc) as n from b),
f as (select *, lag(m, 5) {W} as pm from r)
select ts_code, trade_date, close, coalesce(close > hi, false) as breakout, coalesce(m > pm and close > l and abs(close / nullif(m, 0) - 1) < 2e-2, false) as pullback, coalesce(s5 < 6e-1 * s20 and vol < v20, false) as squeeze from f where n = 1""")
def w36(T):
    """Setups at the last bar of each instrument."""
    return S.setups(T("bars"))
