"""Queries on whole feature sets and on the reports of models and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import quantise, safe_div
from ..operators import intraday as I
from ..operators import reports as R
from ..operators import scoring as C
from ..operators import technicals as X
from ..operators import timeseries as S
from .base import query, scaled, sql_q, sql_scaled

KEYS = ["ts_code", "trade_date"]
W = "over (partition by ts_code order by trade_date)"


def _w(k: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {k - 1} preceding and current row)"


def _full(fn: str, x: str, k: int) -> str:
    return f"case when count({x}) {_w(k)} = {k} then {fn}({x}) {_w(k)} end"


_BASE = """b as (select *, (close - open) / nullif(pre_close, 0) as oc_ratio, (high - low) / nullif(pre_close, 0) as hl_ratio, (high - greatest(close, open)) / nullif(pre_close, 0) as uppershadow,
  (least(close, open) - low) / nullif(pre_close, 0) as lowershadow, (open - pre_close) / nullif(pre_close, 0) as overnight_gap, ln(close / nullif(pre_close, 0)) as log_ret, ln(high / nullif(low, 0)) as hl,
  greatest(high - low, abs(high - pre_close), abs(low - pre_close)) as tr, sign(pct_chg) * vol as flow, case when pct_chg >= 97e-1 then 1 else 0 end as hit_up_limit, case when pct_chg <= -97e-1 then 1 else 0 end as hit_down_limit from bars)"""
_MEANS = f"m as (select *, {', '.join(f'{_full('avg', 'close', k)} as ma_{k}' for k in X.MEANS)}, {', '.join(f'sum(1 - hit_{s}_limit) over (partition by ts_code order by trade_date rows between unbounded preceding and current row) as island_{s}' for s in ('up', 'down'))} from b)"
_SET = {"oc_ratio": "oc_ratio", "hl_ratio": "hl_ratio", "uppershadow": "uppershadow", "lowershadow": "lowershadow", "overnight_gap": "overnight_gap", "log_ret": "log_ret"}
_SET |= {f"ret_lag_{k}": f"lag(pct_chg, {k}) {W}" for k in X.LAGS} | {f"momentum_{k}": _full("sum", "log_ret", k) for k in X.MOMENTUM}
_SET |= {f"close_ma_{k}_ratio": f"close / nullif(ma_{k}, 0)" for k in X.MEANS} | {f"ma_{k}_slope": f"(ma_{k} - lag(ma_{k}, {k}) {W}) / nullif(ma_{k}, 0)" for k in X.MEANS}
_SET |= {f"vol_pct_{k}": _full("stddev_samp", "pct_chg", k) for k in X.SPREADS} | {f"parkinson_{k}": _full("avg", "hl", k) for k in X.SPREADS}
for _k in (20, 60):
    _hi, _lo = _full("max", "high", _k), _full("min", "low", _k)
    _SET |= {f"dist_from_high_{_k}": f"(close - {_hi}) / nullif({_hi}, 0)", f"dist_from_low_{_k}": f"(close - {_lo}) / nullif({_lo}, 0)"}
for _k in (5, 20):
    _SET |= {f"vol_ratio_{_k}": f"vol / nullif({_full('avg', 'vol', _k)}, 0)", f"amt_ratio_{_k}": f"amount / nullif({_full('avg', 'amount', _k)}, 0)", f"obv_flow_ma{_k}": _full("avg", "flow", _k)}
_SD = _full("stddev_samp", "close", 20)
_SET |= {"bbpct_20": f"(close - (ma_20 - 2 * {_SD})) / nullif(4 * {_SD}, 0)", "atr_14_pct": f"{_full('avg', 'tr', 14)} / nullif(close, 0)"}
_COUNTS = {f"hit_{s}_limit": f"hit_{s}_limit" for s in ("up", "down")} | {f"limit_{s}_count_20": f"cast(case when count(*) {_w(20)} = 20 then sum(hit_{s}_limit) {_w(20)} end as bigint)" for s in ("up", "down")}
_COUNTS |= {f"limit_{s}_streak": f"cast(sum(hit_{s}_limit) over (partition by ts_code, island_{s} order by trade_date rows between unbounded preceding and current row) as integer)" for s in ("up", "down")}


@query("w57_feature_set", f"with {_BASE}, {_MEANS} select ts_code, trade_date, {', '.join(f'{sql_q(v, 3)} as {n}' for n, v in _SET.items())}, {', '.join(f'{v} as {n}' for n, v in _COUNTS.items())} from m")
def w57(T):
    """The whole projection of price and volume features, from one exchange; recursive ones and patterns are in w15_wilder and w34."""
    d = X.price_set(T("bars"))
    return d.select(*KEYS, *[quantise(F.col(n), 3).alias(n) for n in _SET], *_COUNTS)


_A = "1e0 / 14"
_STEP = "case when e.{s} is null then b.{x} when b.{x} is null then e.{s} else (1 - 1e0 / 14) * e.{s} + 1e0 / 14 * b.{x} end"


@query("w15_wilder", f"""with recursive b as (select *, case when du is null then null when du > dd and du > 0 then du else 0e0 end as pdm, case when du is null then null when dd > du and dd > 0 then dd else 0e0 end as mdm from
  (select ts_code, trade_date, row_number() {W} as i, greatest(high - low, coalesce(abs(high - lag(close) {W}), 0e0), coalesce(abs(low - lag(close) {W}), 0e0)) as tr, high - lag(high) {W} as du, lag(low) {W} - low as dd,
     case when lag(close) {W} is not null then greatest(close - lag(close) {W}, 0e0) end as g, case when lag(close) {W} is not null then greatest(lag(close) {W} - close, 0e0) end as l from bars) x),
e as (select ts_code, i, tr as atr, cast(null as double) as p, cast(null as double) as m, cast(null as double) as up, cast(null as double) as dn, cast(null as double) as adx from b where i = 1
  union all select ts_code, i, atr, p, m, up, dn, case when dx is null then adx when adx is null then dx else (1 - {_A}) * adx + {_A} * dx end from (
    select *, 1e2 * abs(1e2 * p / nullif(atr, 0) - 1e2 * m / nullif(atr, 0)) / nullif(1e2 * p / nullif(atr, 0) + 1e2 * m / nullif(atr, 0), 0) as dx from (
      select b.ts_code, b.i, (1 - {_A}) * e.atr + {_A} * b.tr as atr, {_STEP.format(s='p', x='pdm')} as p, {_STEP.format(s='m', x='mdm')} as m, {_STEP.format(s='up', x='g')} as up, {_STEP.format(s='dn', x='l')} as dn, e.adx
      from e join b on b.ts_code = e.ts_code and b.i = e.i + 1) y) z),
r as (select ts_code, i, case when count(g) {_w(14).replace('trade_date', 'i')} = 14 then avg(g) {_w(14).replace('trade_date', 'i')} end as mg, case when count(l) {_w(14).replace('trade_date', 'i')} = 14 then avg(l) {_w(14).replace('trade_date', 'i')} end as ml from b)
select b.ts_code, b.trade_date, {sql_q('case when e.dn > 0 then 1e2 - 1e2 / (1 + e.up / e.dn) when e.up > 0 then 1e2 end', 2)} as rsi_open, {sql_q('case when b.i > 14 then 1e2 - 1e2 / (1 + e.up / nullif(e.dn, 0)) end', 2)} as rsi_guarded,
  {sql_q('1e2 - 1e2 / (1 + r.mg / nullif(r.ml, 0))', 2)} as rsi_mean, {sql_q('case when b.i >= 14 then e.atr end', 3)} as atr_wilder, {sql_q('1e2 * e.p / nullif(e.atr, 0)', 2)} as plus_di, {sql_q('1e2 * e.m / nullif(e.atr, 0)', 2)} as minus_di, {sql_q('e.adx', 2)} as adx
from b join e on e.ts_code = b.ts_code and e.i = b.i join r on r.ts_code = b.ts_code and r.i = b.i""")
def w15_wilder(T):
    """RSI in three definitions, Wilder's ATR, directional indices and ADX."""
    d = X.recursive_set(T("bars").select(*KEYS, "high", "low", "close"))
    digits = {"rsi_open": 2, "rsi_guarded": 2, "rsi_mean": 2, "atr_wilder": 3, "plus_di": 2, "minus_di": 2, "adx": 2}
    return d.select(*KEYS, *[quantise(F.col(c), n).alias(c) for c, n in digits.items()])


# Real horizons: the single-day value h rows ahead, forecast by the model's mean of the last twenty.
_HORIZONS = (1, 2, 3, 5)
_TARGETS = f"t as (select ts_code, trade_date, pred_a, pred_b, {', '.join(f'lead(target, {h - 1}) {W} as target_d{h}' for h in _HORIZONS)} from preds)"
_LONG = "h as (" + " union all ".join(f"select {h} as horizon, ts_code, trade_date, pred_a as pred, target_d{h} as target from t" for h in _HORIZONS) + ")"
_RANK = "rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2e0"


def _horizons(T):
    p = T("preds").select(*KEYS, "pred_a", "target")
    d = p.withColumns({f"target_d{h}": F.lead("target", h - 1).over(S.series()) for h in _HORIZONS})
    return R.by_horizon(d, {h: ("pred_a", f"target_d{h}") for h in _HORIZONS})


@query("a17_real_horizons", f"""with {_TARGETS}, {_LONG}, r as (select *, {_RANK.format(by='horizon', c='pred')} as rp, {_RANK.format(by='horizon', c='target')} as rt from h where pred is not null and target is not null)
select horizon, count(*) as n, {sql_q('corr(rp, rt)')} as ic, {sql_q('avg(abs(pred - target))')} as mae, {sql_q('sqrt(avg((pred - target) * (pred - target)))')} as rmse, avg(case when sign(pred) = sign(target) then 1 else 0 end) as hit_rate from r group by 1""")
def a17_horizons(T):
    """Rank IC, errors and hit rate per horizon, on the targets of each."""
    d = R.horizon_metrics(_horizons(T))
    return d.select("horizon", "n", *[quantise(F.col(c)).alias(c) for c in ("ic", "mae", "rmse")], "hit_rate")


_DAILY = f"""r as (select *, {_RANK.format(by='horizon, trade_date', c='pred')} as rp, {_RANK.format(by='horizon, trade_date', c='target')} as rt from h where pred is not null and target is not null),
ic as (select horizon, trade_date, count(*) as n, {sql_q('corr(rp, rt)', 9)} as ic from r group by 1, 2 having count(*) >= 5 and min(pred) < max(pred) and min(target) < max(target))"""


@query("a12_ic_summary", f"with {_TARGETS}, {_LONG}, {_DAILY} select horizon, count(*) as days, {sql_q('avg(ic)')} as mean, {sql_q('stddev_samp(ic)')} as std, {sql_q('avg(ic) / nullif(stddev_samp(ic), 0)', 3)} as icir, avg(case when ic > 0 then 1 else 0 end) as share_positive from ic group by 1")
def a12_summary(T):
    """Mean, deviation, ratio and share of positive days of the daily rank IC, per horizon."""
    daily = R.daily_ic(_horizons(T), ["horizon"], 5).withColumn("ic", quantise(F.col("ic"), 9))
    d = R.ic_summary(daily, ["horizon"])
    return d.select("horizon", "days", quantise(F.col("mean")).alias("mean"), quantise(F.col("std")).alias("std"), quantise(F.col("icir"), 3).alias("icir"), "share_positive")


@query("a16_month_horizon", f"with {_TARGETS}, {_LONG}, {_DAILY} select horizon, cast(date_trunc('month', trade_date) as date) as month, count(*) as days, {sql_q('avg(ic)')} as mean from ic group by 1, 2")
def a16_month_horizon(T):
    """Mean daily rank IC per calendar month and horizon."""
    d = R.daily_ic(_horizons(T), ["horizon"], 5).groupBy("horizon", F.trunc("trade_date", "month").alias("month"))
    return d.agg(F.count("*").alias("days"), quantise(F.avg("ic")).alias("mean"))


@query("a14_ten_bins", f"""with e as (select trade_date, list_sort(list_distinct(quantile_cont(pred_b, [{', '.join(f'{i}e-1' for i in range(11))}]))) as edges from preds where pred_b is not null and target is not null group by 1),
d as (select p.trade_date, target, cast(len(list_filter(edges[2:len(edges) - 1], lambda x: x < pred_b)) as integer) as bin from preds p join e on e.trade_date = p.trade_date where pred_b is not null and target is not null),
s as (select bin, count(*) as n, avg(target) as mean, stddev_samp(target) as std from d group by 1)
select bin, n, {sql_q('mean', 3)} as mean, {sql_q('std', 3)} as std, {sql_q('(select max_by(mean, bin) - min_by(mean, bin) from s)', 3)} as spread from s""")
def a14_ten_bins(T):
    """Targets by tenths of each day's forecasts, and the top's mean over the bottom's."""
    d = R.bin_report(T("preds"), "pred_b", "target", ["trade_date"], 10)
    return d.select("bin", "n", *[quantise(F.col(c), 3).alias(c) for c in ("mean", "std", "spread")])


_NAV = """r as (select trade_date, nav, nav / lag(nav) over (order by trade_date) - 1 as r, max(nav) over (order by trade_date rows between unbounded preceding and current row) as top from equity),
d as (select *, nav / top - 1 as dd, row_number() over (order by nav / top - 1, trade_date) as k from r), t as (select trade_date as trough, top, dd from d where k = 1),
p as (select min(trade_date) as peak from r, t where nav = t.top and trade_date <= t.trough), s as (select count(r) as n, avg(r) as m, stddev_samp(r) as sd, sqrt(avg(case when r < 0 then r * r when r is not null then 0e0 end)) as down, min_by(nav, trade_date) as a, max_by(nav, trade_date) as z,
  datediff('day', min(trade_date), max(trade_date)) as days, max(r) as best, min(r) as worst, avg(case when r > 0 then 1e0 when r is not null then 0e0 end) as up from r)"""


@query("a26_nav_report", f"""with {_NAV} select n, {sql_q('z / a - 1')} as total, {sql_q('pow(z / a, 36525e-2 / days) - 1')} as cagr, {sql_q('pow(z / a, 252e0 / n) - 1')} as cagr_bars, {sql_q('sd * sqrt(252e0)')} as vol, {sql_q('m / nullif(sd, 0) * sqrt(252e0)', 3)} as sharpe,
  {sql_q('(m - 2e-2 / 252) / nullif(sd, 0) * sqrt(252e0)', 3)} as sharpe_rf, {sql_q('m / nullif(down, 0) * sqrt(252e0)', 3)} as sortino, {sql_q('dd')} as max_drawdown, peak, trough, {sql_q('best')} as best, {sql_q('worst')} as worst, {sql_q('up')} as share_up from s, t, p""")
def a26_report(T):
    """Growth, risk and the deepest drawdown of the equity curve, with the days of its peak and trough."""
    d = R.nav_report(T("equity"), rf=0.02)
    digits = {"total": 4, "cagr": 4, "cagr_bars": 4, "vol": 4, "sharpe": 3, "sharpe_rf": 3, "sortino": 3, "max_drawdown": 4, "best": 4, "worst": 4, "share_up": 4}
    return d.select("n", "peak", "trough", *[quantise(F.col(c), k).alias(c) for c, k in digits.items()])


_TICKS = """k as (select symbol, time_bucket(interval '30 minutes', ts) as bar_at, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as close, cast(count(*) as double) as volume, sum(cast(taker as double)) as taker_buy from tick where price is not null group by 1, 2),
r as (select *, ln(close / lag(close) over (partition by symbol order by bar_at)) as r from k), a as (select *, cast(bar_at as date) as day, abs(r) as a, abs(r) * lag(abs(r)) over (partition by symbol order by bar_at) as bp,
  case when count(r) over (partition by symbol order by bar_at rows between 287 preceding and current row) >= 50 then quantile_cont(abs(r), 5e-1) over (partition by symbol order by bar_at rows between 287 preceding and current row) end as med from r),
d as (select symbol, day, count(*) as bars, count(r) as n, coalesce(sum(r * r), 0) as rv2, coalesce(sum(bp), 0) * pi() / 2 as bp2, sum(case when r > 0 then r * r else 0 end) as up2, sum(case when r < 0 then r * r else 0 end) as down2, case when count(r) > 2 and min(r) < max(r) then skewness(r) end as skew, case when count(r) > 3 and min(r) < max(r) then kurtosis(r) end as kurt,
  sum(case when a > 4 * med then 1 else 0 end) as jump_count, max(high) as high, min(low) as low, arg_min(open, bar_at) as open, arg_max(close, bar_at) as close, max(close) as top, min(close) as bottom, sum(volume) as volume, sum(taker_buy) as buy, sum(volume * volume) as v2 from a group by 1, 2)"""
_MICRO = {
    "rv": "sqrt(rv2)", "bipower": "sqrt(bp2)", "jump": "sqrt(greatest(rv2 - bp2, 0))", "rv_up": "sqrt(up2)", "rv_down": "sqrt(down2)", "semi_skew": "(up2 - down2) / nullif(rv2, 0)", "skew": "skew", "kurt": "kurt", "range_pct": "(high - low) / nullif(open, 0)",
    "efficiency": "abs(close - open) / nullif(high - low, 0)", "taker_ratio": "buy / nullif(volume, 0)", "imbalance": "(2 * buy - volume) / nullif(volume, 0)", "drawup": "top / nullif(open, 0) - 1", "drawdown": "bottom / nullif(open, 0) - 1", "concentration": "v2 * bars / nullif(volume * volume, 0)",
}


@query("a06_microstructure", f"with {_TICKS} select symbol, day, bars, cast(jump_count as bigint) as jump_count, {', '.join(f'{sql_q(v, 5)} as {n}' for n, v in _MICRO.items())} from d")
def a06_micro(T):
    """Half-hour bars of each symbol rolled up to days."""
    ticks = T("tick").withColumn("ts", F.col("ts").cast("timestamp"))
    d = I.daily_microstructure(I.tick_bars(ticks, "symbol", "ts", "30 minutes", "price", F.col("taker"), ["event_id"]), "symbol", "ts")
    return d.select("symbol", "day", "bars", "jump_count", *[quantise(F.col(c), 5).alias(c) for c in _MICRO])


_TREND = f"""m as (select *, {_full('avg', 'close', 20)} as m20, {_full('avg', 'close', 50)} as m50, {_full('avg', 'close', 200)} as m200, row_number() {W} as n, row_number() over (partition by ts_code order by trade_date desc) as back from a),
p as (select *, case when close > m20 then 1 else 0 end + case when close > m50 then 1 else 0 end + case when close > m200 then 2 else 0 end + case when m20 > m50 then 1 else 0 end + case when m50 > m200 then 2 else 0 end as trend_points from m),
s as (select *, case when n < 200 then 'neutral' when trend_points >= 6 and coalesce(adx > 25, false) then 'strong_uptrend' when trend_points >= 4 then 'uptrend' when trend_points <= 1 and coalesce(adx > 25, false) then 'strong_downtrend' when trend_points <= 2 then 'downtrend' else 'neutral' end as trend_state from p)"""
# The strength that the trend reads, here the size of the last bar's change in tenths, so that SQL has it without a recursion.
_A = "a as (select *, abs(pct_chg) * 1e1 as adx, close / nullif(lag(close) over (partition by ts_code order by trade_date), 0) - 1 as chg from bars)"


def _strength(T):
    return T("bars").withColumn("adx", F.abs("pct_chg") * 10.0)


@query("w37_trend_state", f"with {_A}, {_TREND} select ts_code, trade_date, cast(trend_points as integer) as trend_points, trend_state from s")
def w37_state(T):
    """Points and state of each bar's trend on means of 20, 50 and 200 bars."""
    return C.trend(_strength(T)).select(*KEYS, "trend_points", "trend_state")


_BETWEEN = "over (partition by ts_code order by trade_date rows between 250 preceding and 21 preceding)"


@query("w40_ranking", f"""with {_A}, {_TREND}, f as (select *, (lag(close, 21) {W} / nullif(lag(close, 251) {W}, 0) - 1) / nullif(stddev_samp(chg) {_BETWEEN} * sqrt(23e1), 0) as momentum, {_full('avg', 'amount', 20)} as amt, case when pct_chg >= 97e-1 then 5e-1 else 0e0 end as pattern from s),
l as (select *, case trend_state when 'strong_uptrend' then 1e0 when 'uptrend' then 7e-1 when 'neutral' then 3e-1 when 'downtrend' then 0e0 else -5e-1 end as trend, least(amt / 2e4 / 10, 1e0) as liquidity from f where back = 1 and n >= 252 and amt >= 2e4),
t as (select *, momentum * 4e-1 + trend * 3e-1 + pattern * 2e-1 + liquidity * 1e-1 as total, coalesce(momentum > 0 and trend_state in ('uptrend', 'strong_uptrend'), false) as good from l)
select ts_code, trade_date, {sql_q('momentum')} as momentum, trend_state, trend, pattern, {sql_q('liquidity')} as liquidity, {sql_q('total')} as total, case when good then cast(row_number() over (partition by good order by total desc, ts_code) as integer) end as place from t""")
def w40_ranking(T):
    """Momentum, trend, pattern and liquidity of each instrument's last bar, weighed 40, 30, 20 and 10."""
    d = C.composite(_strength(T), F.when(F.col("pct_chg") >= 9.7, 0.5).otherwise(0.0), 2e4)
    return d.select(*KEYS, quantise(F.col("momentum")).alias("momentum"), "trend_state", "trend", "pattern", quantise(F.col("liquidity")).alias("liquidity"), quantise(F.col("total")).alias("total"), "place")


@query("w53_horizon_trajectory", f"""with t as (select ts_code, trade_date, {', '.join(f"case when count(pct_chg) {_w(5 * h)} = {5 * h} then avg({sql_scaled('pct_chg')}) {_w(5 * h)} end as h{h}" for h in range(1, 6))} from bars)
select ts_code, trade_date, {sql_q('(h1 + h2 + h3 + h4 + h5) / 5', 3)} as mean, {sql_q('case when h1 is not null and h2 is not null and h3 is not null and h4 is not null and h5 is not null then greatest(h1, h2, h3, h4, h5) end', 3)} as top, {sql_q('(2 * h5 + h4 - h2 - 2 * h1) / 1e1', 3)} as slope from t""")
def w53_horizons(T):
    """Forecasts for horizons 1 to 5, each from five times as many bars: mean, largest, slope."""
    d = T("bars").withColumns({f"h{h}": S.rolling(F.avg, scaled("pct_chg"), 5 * h) for h in range(1, 6)})
    return d.select(*KEYS, *[quantise(v, 3).alias(n) for n, v in C.trajectory([f"h{h}" for h in range(1, 6)]).items()])


_FEATURES = ("pct_chg", "vol", "amount", "close", "gap")


@query("a50_refit_stability", "with x as (select year(b.trade_date) as refit, b.pct_chg, b.vol, b.amount, b.close, b.open / nullif(b.pre_close, 0) - 1 as gap, p.target from bars b join preds p on p.ts_code = b.ts_code and p.trade_date = b.trade_date where p.target is not null),\n"
       "i as (" + " union all ".join(f"select refit, '{c}' as feature, abs({sql_q(f'corr({c}, target)', 6)}) as importance from x group by 1" for c in _FEATURES) + "),\n"
       f"k as (select *, case when row_number() over (partition by refit order by importance desc, feature) <= 2 then 1 else 0 end as top from i) select feature, count(*) as refits, {sql_q('avg(importance)', 5)} as mean, {sql_q('stddev_pop(importance)', 5)} as std, cast(sum(top) as bigint) as top_count, avg(top) as top_share from k group by 1")
def a50_stability(T):
    """Importance of features over yearly refits: size of each one's correlation with the target."""
    from ..functions.columns import correlation

    x = T("bars").join(T("preds").select(*KEYS, "target"), KEYS).where("target is not null").withColumns({"gap": safe_div(F.col("open"), F.col("pre_close")) - 1, "refit": F.year("trade_date")})
    fitted = x.groupBy("refit").agg(*[F.abs(quantise(correlation(c, "target"), 6)).alias(c) for c in _FEATURES])
    long = fitted.select("refit", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in _FEATURES])).alias("i")).select("refit", "i.feature", "i.importance")
    d = C.stability(long, 2)
    return d.select("feature", "refits", quantise(F.col("mean"), 5).alias("mean"), quantise(F.col("std"), 5).alias("std"), "top_count", "top_share")


_FACTORS = ("size", "flow", "gap")


@query("a25_factor_attribution", f"""with e as (select trade_date, avg({sql_scaled('close', 2)}) / 1e4 as size, avg({sql_scaled('pct_chg')}) / 1e6 as flow, avg({sql_scaled('(open / nullif(pre_close, 0) - 1)')}) / 1e4 as gap from bars where day(trade_date) % 3 <> 0 group by 1),
f as (select trade_date, stddev_pop(pct_chg) / 1e2 as size, avg({sql_scaled('pct_chg')}) / 1e5 as flow, max(pct_chg) / 1e2 as gap from bars where day(trade_date) % 4 <> 0 group by 1),
j as (select q.trade_date, nav, invested, {', '.join(f'last_value(e.{c} ignore nulls) over (order by q.trade_date) as e_{c}, last_value(f.{c} ignore nulls) over (order by q.trade_date) as f_{c}' for c in _FACTORS)} from equity q left join e on e.trade_date = q.trade_date left join f on f.trade_date = q.trade_date),
c as (select trade_date, nav / nullif(lag(nav) over (order by trade_date), 0) - 1 as own, {', '.join(f'coalesce(lag(e_{c}) over (order by trade_date) * f_{c} / 100 * greatest(least(invested / nullif(nav, 0), 1e0), 0e0), 0) as {c}' for c in _FACTORS)} from j),
a as (select *, coalesce(own - (size + flow + gap), 0) as alpha from c)
select trade_date, {', '.join(f'{sql_q(c, 6)} as {c}' for c in (*_FACTORS, 'alpha'))}, {', '.join(f"{sql_q(f'exp(sum(ln(1 + coalesce({c}, 0))) over (order by trade_date rows between unbounded preceding and current row)) - 1', 5)} as cum_{n}" for n, c in [*((x, x) for x in (*_FACTORS, 'alpha')), ('total', 'own')])} from a""")
def a25_factors(T):
    """Three factors' contributions to the equity curve, alpha, and all of them compounded."""
    bars = T("bars")
    mean = lambda x, k=4: F.avg(scaled(x, k))
    e = bars.where(F.dayofmonth("trade_date") % 3 != 0).groupBy("trade_date").agg((mean("close", 2) / 1e4).alias("size"), (mean("pct_chg") / 1e6).alias("flow"), (mean(safe_div(F.col("open"), F.col("pre_close")) - 1) / 1e4).alias("gap"))
    f = bars.where(F.dayofmonth("trade_date") % 4 != 0).groupBy("trade_date").agg((F.stddev_pop("pct_chg") / 100).alias("size"), (mean("pct_chg") / 1e5).alias("flow"), (F.max("pct_chg") / 100).alias("gap"))
    d = C.attribution(e, f, T("equity"), list(_FACTORS))
    return d.select("trade_date", *[quantise(F.col(c), 6).alias(c) for c in (*_FACTORS, "alpha")], *[quantise(F.col(f"cum_{c}"), 5).alias(f"cum_{c}") for c in (*_FACTORS, "alpha", "total")])
