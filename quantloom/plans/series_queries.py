"""Queries on windows per instrument and across instruments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import board, clip, quantise, safe_div
from ..operators import cross_section as X
from ..operators import timeseries as S
from .base import query, scaled, sql_q, sql_scaled

KEYS = ("ts_code", "trade_date")
PX = f"select *, {sql_scaled('close')} as px, {sql_scaled('high')} as hx, {sql_scaled('low')} as lx, {sql_scaled('open')} as ox, {sql_scaled('pct_chg')} as rx from bars"
W = "over (partition by ts_code order by trade_date)"


def over(k: int, last: int = 0) -> str:
    end = "current row" if last == 0 else f"{last} preceding"
    return f"over (partition by ts_code order by trade_date rows between {k} preceding and {end})"


def px(bars):
    return bars.withColumns({"px": scaled("close"), "hx": scaled("high"), "lx": scaled("low"), "ox": scaled("open"), "rx": scaled("pct_chg")})


@query("w01_lags", f"select ts_code, trade_date, lag(pct_chg, 1) {W} as lag_1, lag(pct_chg, 5) {W} as lag_5, lead(pct_chg, 1) {W} as lead_1 from bars")
def w01(T):
    w = S.series()
    return T("bars").select(*KEYS, F.lag("pct_chg", 1).over(w).alias("lag_1"), F.lag("pct_chg", 5).over(w).alias("lag_5"), F.lead("pct_chg", 1).over(w).alias("lead_1"))


@query("w02_returns", f"select ts_code, trade_date, {sql_q(f'close / nullif(lag(close, 5) {W}, 0) - 1')} as ret_5, {sql_q(f'close - lag(close, 5) {W}', 3)} as diff_5, {sql_q(f'ln(close / nullif(lag(close, 5) {W}, 0))')} as log_ret_5 from bars")
def w02(T):
    d = S.returns(T("bars"), "close", (5,))
    return d.select(*KEYS, quantise(F.col("ret_5")).alias("ret_5"), quantise(F.col("diff_5"), 3).alias("diff_5"), quantise(F.col("log_ret_5")).alias("log_ret_5"))


@query("w03_sma", f"with p as ({PX}) select ts_code, trade_date, case when count(px) {over(4)} = 5 then avg(px) {over(4)} end as sma_5, case when count(px) {over(19)} = 20 then avg(px) {over(19)} end as sma_20, {sql_q(f'case when count(px) {over(19)} = 20 then px / avg(px) {over(19)} end')} as to_sma_20 from p")
def w03(T):
    d = px(T("bars"))
    m = S.rolling(F.avg, "px", 20)
    return d.select(*KEYS, S.rolling(F.avg, "px", 5).alias("sma_5"), m.alias("sma_20"), quantise(F.col("px") / m).alias("to_sma_20"))


@query("w04_momentum", f"with p as ({PX}) select ts_code, trade_date, case when count(rx) {over(19)} >= 5 then sum(rx) {over(19)} end / 1e4 as momentum_20 from p")
def w04(T):
    return px(T("bars")).select(*KEYS, (S.rolling(F.sum, "rx", 20, 5) / F.lit(1e4)).alias("momentum_20"))


@query("w05_volatility", f"with p as ({PX}) select ts_code, trade_date, {sql_q(f'case when count(rx) {over(19)} = 20 then stddev_samp(rx) {over(19)} end / 1e4', 3)} as vol_samp, {sql_q(f'case when count(rx) {over(19)} = 20 then stddev_pop(rx) {over(19)} end / 1e4', 3)} as vol_pop from p")
def w05(T):
    d = px(T("bars"))
    return d.select(*KEYS, quantise(S.rolling(F.stddev_samp, "rx", 20) / F.lit(1e4), 3).alias("vol_samp"), quantise(S.rolling(F.stddev_pop, "rx", 20) / F.lit(1e4), 3).alias("vol_pop"))


@query("w06_range", f"""with p as ({PX}), r as (select ts_code, trade_date, px, case when count(hx) {over(19)} = 20 then max(hx) {over(19)} end as hi, case when count(lx) {over(19)} = 20 then min(lx) {over(19)} end as lo from p)
select ts_code, trade_date, hi / 1e4 as high_20, lo / 1e4 as low_20, {sql_q('px / cast(hi as double) - 1')} as from_high, {sql_q('(px - lo) / cast(nullif(hi - lo, 0) as double)')} as position from r""")
def w06(T):
    d = px(T("bars")).withColumns({"hi": S.rolling(F.max, "hx", 20), "lo": S.rolling(F.min, "lx", 20)})
    return d.select(*KEYS, (F.col("hi") / F.lit(1e4)).alias("high_20"), (F.col("lo") / F.lit(1e4)).alias("low_20"), quantise(F.col("px") / F.col("hi").cast("double") - 1).alias("from_high"), quantise(safe_div(F.col("px") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("position"))


@query("w07_volume_ratio", f"select ts_code, trade_date, {sql_q(f'vol / cast(nullif(avg(vol) {over(19)}, 0) as double)')} as vol_ratio_20 from bars")
def w07(T):
    return T("bars").select(*KEYS, quantise(safe_div(F.col("vol"), F.avg("vol").over(S.last(20)))).alias("vol_ratio_20"))


@query("w08_parkinson", f"select ts_code, trade_date, {sql_q(f'case when count(high) {over(9)} = 10 then avg(ln(high / low)) {over(9)} end', 5)} as parkinson_10 from bars")
def w08(T):
    return T("bars").select(*KEYS, quantise(S.rolling(F.avg, F.ln(F.col("high") / F.col("low")), 10), 5).alias("parkinson_10"))


_EWM = """with recursive b as (select ts_code, trade_date, close, row_number() over (partition by ts_code order by trade_date) as i from bars),
e as (select ts_code, i, close, close as f, close as s, cast(0 as double) as sig from b where i = 1
  union all
  select b.ts_code, b.i, b.close, (1 - 2e0 / 13) * e.f + 2e0 / 13 * b.close, (1 - 2e0 / 27) * e.s + 2e0 / 27 * b.close,
         (1 - 2e0 / 10) * e.sig + 2e0 / 10 * (((1 - 2e0 / 13) * e.f + 2e0 / 13 * b.close) - ((1 - 2e0 / 27) * e.s + 2e0 / 27 * b.close))
  from e join b on b.ts_code = e.ts_code and b.i = e.i + 1)
"""


@query("w11_macd", _EWM + f"select b.ts_code, b.trade_date, {sql_q('e.f - e.s', 3)} as macd, {sql_q('e.sig', 3)} as macd_signal from e join b on b.ts_code = e.ts_code and b.i = e.i")
def w11(T):
    d = S.macd(T("bars").select(*KEYS, "close"), "close")
    return d.select(*KEYS, quantise(F.col("macd"), 3).alias("macd"), quantise(F.col("macd_signal"), 3).alias("macd_signal"))


@query("w10_wilder_rsi", f"""with recursive b as (select ts_code, trade_date, greatest(close - lag(close) {W}, 0e0) as g, greatest(lag(close) {W} - close, 0e0) as l, row_number() {W} as i from bars),
e as (select ts_code, i, g as sg, l as sl from b where i = 2
  union all select b.ts_code, b.i, (1 - 1e0 / 14) * e.sg + 1e0 / 14 * b.g, (1 - 1e0 / 14) * e.sl + 1e0 / 14 * b.l from e join b on b.ts_code = e.ts_code and b.i = e.i + 1)
select b.ts_code, b.trade_date, {sql_q('case when sl > 0 then 100 - 100 / (1 + sg / sl) when sg > 0 then 1e2 end', 2)} as rsi from b left join e on b.ts_code = e.ts_code and b.i = e.i""")
def w10(T):
    return S.wilder_rsi(T("bars").select(*KEYS, "close"), "close").select(*KEYS, quantise(F.col("rsi"), 2).alias("rsi"))


@query("w12_bollinger", f"""with p as ({PX}), r as (select ts_code, trade_date, px, case when count(px) {over(19)} = 20 then avg(px) {over(19)} end as m, case when count(px) {over(19)} = 20 then stddev_samp(px) {over(19)} end as s from p)
select ts_code, trade_date, {sql_q('(px - (m - 2 * s)) / nullif(4 * s, 0)', 3)} as pct_b, {sql_q('4 * s / m', 3)} as bandwidth from r""")
def w12(T):
    d = px(T("bars")).withColumns({"m": S.rolling(F.avg, "px", 20), "s": S.rolling(F.stddev_samp, "px", 20)})
    return d.select(*KEYS, quantise(safe_div(F.col("px") - (F.col("m") - 2 * F.col("s")), 4 * F.col("s")), 3).alias("pct_b"), quantise(4 * F.col("s") / F.col("m"), 3).alias("bandwidth"))


@query("w13_atr", f"with p as ({PX}), r as (select *, greatest(hx - lx, abs(hx - {sql_scaled('pre_close')}), abs(lx - {sql_scaled('pre_close')})) as tr from p) select ts_code, trade_date, tr / 1e4 as true_range, case when count(tr) {over(13)} = 14 then avg(tr) {over(13)} end as atr_14 from r")
def w13(T):
    d = px(T("bars")).withColumn("tr", S.true_range(F.col("hx"), F.col("lx"), scaled("pre_close")))
    return d.select(*KEYS, (F.col("tr") / F.lit(1e4)).alias("true_range"), S.rolling(F.avg, "tr", 14).alias("atr_14"))


@query("w14_stochastic", f"""with p as ({PX}), r as (select ts_code, trade_date, px, case when count(px) {over(13)} = 14 then max(hx) {over(13)} end as hi, case when count(px) {over(13)} = 14 then min(lx) {over(13)} end as lo from p)
select ts_code, trade_date, {sql_q('1e2 * (px - lo) / nullif(hi - lo, 0)', 2)} as k_14, {sql_q('-1e2 * (hi - px) / nullif(hi - lo, 0)', 2)} as williams_r from r""")
def w14(T):
    d = px(T("bars")).withColumns({"hi": S.rolling(F.max, "hx", 14), "lo": S.rolling(F.min, "lx", 14)})
    span = F.col("hi") - F.col("lo")
    return d.select(*KEYS, quantise(safe_div(100.0 * (F.col("px") - F.col("lo")), span), 2).alias("k_14"), quantise(safe_div(-100.0 * (F.col("hi") - F.col("px")), span), 2).alias("williams_r"))


@query("w16_cci", f"""with p as ({PX}), t as (select ts_code, trade_date, hx + lx + px as tp from p), r as (select ts_code, trade_date, tp, avg(tp) {over(19)} as m, count(tp) {over(19)} as n, list(tp) {over(19)} as l from t)
select ts_code, trade_date, {sql_q('case when n = 20 then (tp - m) / nullif(15e-3 * list_avg(list_transform(l, lambda x: abs(x - m))), 0) end', 2)} as cci_20 from r""")
def w16(T):
    """True mean absolute deviation of the window: the window's values travel as an array of twenty."""
    w = S.last(20)
    d = px(T("bars")).withColumn("tp", F.col("hx") + F.col("lx") + F.col("px"))
    d = d.withColumns({"m": F.avg("tp").over(w), "n": F.count("tp").over(w), "l": F.collect_list("tp").over(w)})
    mad = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("m"))) / F.size("l")
    return d.select(*KEYS, quantise(F.when(F.col("n") == 20, safe_div(F.col("tp") - F.col("m"), F.lit(0.015) * mad)), 2).alias("cci_20"))


@query("w17_obv", f"with s as (select ts_code, trade_date, cast(sign(pct_chg) as bigint) * vol as flow from bars) select ts_code, trade_date, sum(flow) over (partition by ts_code order by trade_date rows between unbounded preceding and current row) as obv, avg(flow) {over(4)} as obv_5 from s")
def w17(T):
    d = T("bars").withColumn("flow", F.signum("pct_chg").cast("long") * F.col("vol"))
    return d.select(*KEYS, F.sum("flow").over(S.series().rowsBetween(Window.unboundedPreceding, 0)).alias("obv"), F.avg("flow").over(S.last(5)).alias("obv_5"))


@query("w18_streaks", """with f as (select *, sum(case when pct_chg > 0 then 0 else 1 end) over (partition by ts_code order by trade_date rows between unbounded preceding and current row) as island from bars)
select ts_code, trade_date, cast(sum(case when pct_chg > 0 then 1 else 0 end) over (partition by ts_code, island order by trade_date rows between unbounded preceding and current row) as integer) as up_days from f""")
def w18(T):
    return S.with_streak(T("bars"), F.col("pct_chg") > 0, "up_days").select(*KEYS, "up_days")


@query("w19_days_since", f"with r as (select ts_code, trade_date, pct_chg, row_number() {W} as n from bars) select ts_code, trade_date, cast(n - max(case when pct_chg >= 97e-1 then n end) over (partition by ts_code order by trade_date rows between unbounded preceding and current row) as integer) as since_limit_up from r")
def w19(T):
    return S.rows_since(T("bars"), F.col("pct_chg") >= 9.7, "since_limit_up").select(*KEYS, "since_limit_up")


@query("w20_percent_rank", """with r as (select ts_code, trade_date, turnover_rate_f, pe_ttm, rank() over (partition by trade_date, pe_ttm is null order by pe_ttm) as k, count(*) over (partition by trade_date, pe_ttm) as ties, count(pe_ttm) over (partition by trade_date) as n from basic)
select ts_code, trade_date, case when pe_ttm is null then 5e-1 else (k + (ties - 1) / 2e0) / n end as pe_rank from r""")
def w20(T):
    return X.percent_rank(T("basic"), "pe_ttm", ["trade_date"], "pe_rank").select(*KEYS, "pe_rank")


@query("w21_cross_section", f"with p as ({PX}) select ts_code, trade_date, {sql_q('rx - avg(rx) over (partition by trade_date)', 2)} as demeaned, avg(case when rx > 0 then 1 else 0 end) over (partition by trade_date) as breadth, {sql_q('stddev_samp(rx) over (partition by trade_date)', 2)} as dispersion from p")
def w21(T):
    w = Window.partitionBy("trade_date")
    d = px(T("bars"))
    return d.select(*KEYS, quantise(F.col("rx") - F.avg("rx").over(w), 2).alias("demeaned"), F.avg(F.when(F.col("rx") > 0, 1).otherwise(0)).over(w).alias("breadth"), quantise(F.stddev_samp("rx").over(w), 2).alias("dispersion"))


@query("w22_quantile_bins", """with e as (select trade_date, list_sort(list_distinct([quantile_cont(vol, 0e0), quantile_cont(vol, 2e-1), quantile_cont(vol, 4e-1), quantile_cont(vol, 6e-1), quantile_cont(vol, 8e-1), quantile_cont(vol, 1e0)])) as edges from (select trade_date, cast(vol as double) as vol from bars) group by 1)
select b.ts_code, b.trade_date, cast(len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < b.vol)) as integer) as bin from bars b join e on e.trade_date = b.trade_date""")
def w22(T):
    return X.quantile_bins(T("bars"), "vol", ["trade_date"], 5, "bin").select(*KEYS, "bin")


@query("w23_winsor_zscore", f"""with e as (select trade_date, quantile_cont(v, 1e-2) as lo, quantile_cont(v, 99e-2) as hi from (select trade_date, cast(vol as double) as v from bars) group by 1),
c as (select b.ts_code, b.trade_date, least(greatest(cast(b.vol as double), lo), hi) as x from bars b join e on e.trade_date = b.trade_date),
z as (select *, avg(x) over (partition by trade_date) as m, stddev_samp(x) over (partition by trade_date) as s from c)
select ts_code, trade_date, {sql_q('case when coalesce(s, 0) = 0 then 0e0 else (x - m) / s end', 3)} as z from z""")
def w23(T):
    return X.winsor_zscore(T("bars").withColumn("v", F.col("vol").cast("double")), "v", ["trade_date"], "z").select(*KEYS, quantise(F.col("z"), 3).alias("z"))


@query("w24_lagged_stats", f"with p as ({PX}) select ts_code, trade_date, {sql_q(f'case when count(rx) {over(60, 1)} >= 30 then stddev_samp(rx) {over(60, 1)} end', 2)} as sigma_60, case when count(vol) {over(20, 1)} >= 10 then avg(vol) {over(20, 1)} end as adv_20 from p")
def w24(T):
    d = px(T("bars"))
    return d.select(*KEYS, quantise(S.rolling(F.stddev_samp, "rx", 60, 30, S.before(60)), 2).alias("sigma_60"), S.rolling(F.avg, "vol", 20, 10, S.before(20)).alias("adv_20"))


_R = over(29)
_N = f"cast(30 * sum(px * vol) {_R} - sum(px) {_R} * sum(vol) {_R} as double)"
_D = f"(sqrt(cast(30 * sum(px * px) {_R} - sum(px) {_R} * sum(px) {_R} as double)) * sqrt(cast(30 * sum(vol * vol) {_R} - sum(vol) {_R} * sum(vol) {_R} as double)))"


@query("w27_rolling_corr", f"with p as (select ts_code, trade_date, {sql_scaled('close', 2)} as px, vol from bars) select ts_code, trade_date, {sql_q(f'case when count(px) {_R} = 30 then {_N} / nullif({_D}, 0) end', 3)} as corr_30 from p")
def w27(T):
    """Correlation from exact integer moments; null where a side doesn't vary.

    Products are added as longs in two halves and put together as decimals: 900 squares of a high price don't fit a long.
    """
    w = S.last(30)
    wide = lambda c: c.cast("decimal(19,0)")
    s = lambda c: wide(F.sum(c).over(w))
    twice = lambda a, b: s(F.shiftright(a * b, 31)) * F.lit(1 << 31).cast("decimal(10,0)") + s((a * b).bitwiseAND(F.lit((1 << 31) - 1)))
    x, y = F.col("px"), F.col("vol").cast("long")
    d = T("bars").withColumn("px", scaled("close", 2))
    top = (30 * twice(x, y) - s(x) * s(y)).cast("double")
    low = F.sqrt((30 * twice(x, x) - s(x) * s(x)).cast("double")) * F.sqrt((30 * twice(y, y) - s(y) * s(y)).cast("double"))
    return d.select(*KEYS, quantise(F.when(F.count(x).over(w) == 30, safe_div(top, low)), 3).alias("corr_30"))


@query("w28_rolling_zscore", f"select ts_code, trade_date, {sql_q(f'case when count(vol) {over(19)} = 20 then (vol - avg(vol) {over(19)}) / nullif(stddev_samp(vol) {over(19)}, 0) end', 3)} as vol_z_20 from bars")
def w28(T):
    w = S.last(20)
    z = safe_div(F.col("vol") - F.avg("vol").over(w), F.stddev_samp("vol").over(w))
    return T("bars").select(*KEYS, quantise(F.when(F.count("vol").over(w) == 20, z), 3).alias("vol_z_20"))


@query("w32_drawdown", "with n as (select trade_date, nav, max(nav) over (order by trade_date rows between unbounded preceding and current row) as peak from equity) select trade_date, nav, peak, floor((nav / peak - 1) * 1e6 + 5e-1) / 1e6 as drawdown from n")
def w32(T):
    """One portfolio's daily series: the ordering is global because the series is."""
    peak = F.max("nav").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    return T("equity").select("trade_date", "nav", peak.alias("peak"), quantise(F.col("nav") / peak - 1, 6).alias("drawdown"))


@query("w33_fill_forward", "select ts_code, trade_date, last_value(pe_ttm ignore nulls) over (partition by ts_code order by trade_date rows between unbounded preceding and current row) as pe_ttm from basic")
def w33(T):
    return S.fill_forward(T("basic"), "pe_ttm").select(*KEYS, "pe_ttm")


@query("w38_momentum_12_1", f"select ts_code, trade_date, {sql_q(f'lag(close, 21) {W} / nullif(lag(close, 252) {W}, 0) - 1')} as momentum_12_1 from bars")
def w38(T):
    w = S.series()
    return T("bars").select(*KEYS, quantise(safe_div(F.lag("close", 21).over(w), F.lag("close", 252).over(w)) - 1).alias("momentum_12_1"))


@query("w43_limit_flags", """select ts_code, trade_date, abs(close - up) <= 5e-3 as at_up, abs(close - down) <= 5e-3 as at_down, high = low and abs(close - up) <= 5e-3 as one_line,
abs(close - up) <= 5e-3 and abs(open - up) <= 5e-3 and low < up - 5e-3 as t_shape
from (select *, floor(pre_close * (1 + b) * 1e2 + 5e-1) / 1e2 as up, floor(pre_close * (1 - b) * 1e2 + 5e-1) / 1e2 as down
from (select *, case when substr(ts_code, 1, 3) in ('300', '688') then 2e-1 else 1e-1 end as b from bars) x) y""")
def w43(T):
    d = T("bars").join(T("limits"), list(KEYS))
    up = F.abs(F.col("close") - F.col("up_limit")) <= 0.005
    return d.select(*KEYS, up.alias("at_up"), (F.abs(F.col("close") - F.col("down_limit")) <= 0.005).alias("at_down"), ((F.col("high") == F.col("low")) & up).alias("one_line"),
                    (up & (F.abs(F.col("open") - F.col("up_limit")) <= 0.005) & (F.col("low") < F.col("up_limit") - 0.005)).alias("t_shape"))


@query("w49_bar_shape", f"select ts_code, trade_date, {sql_q('(close - open) / nullif(open, 0)')} as body, {sql_q('(high - low) / nullif(open, 0)')} as range, {sql_q('(high - greatest(open, close)) / nullif(open, 0)')} as upper, {sql_q('open / nullif(pre_close, 0) - 1')} as gap from bars")
def w49(T):
    o, c = F.col("open"), F.col("close")
    return T("bars").select(*KEYS, quantise(safe_div(c - o, o)).alias("body"), quantise(safe_div(F.col("high") - F.col("low"), o)).alias("range"), quantise(safe_div(F.col("high") - F.greatest(o, c), o)).alias("upper"), quantise(safe_div(o, F.col("pre_close")) - 1).alias("gap"))


@query("p05_board", "select case when ts_code like '688%' then 'STAR' when ts_code like '300%' then 'ChiNext' when ts_code like '8%' or ts_code like '4%' then 'BSE' else 'Main' end as board, count(*) as n from bars group by 1")
def p05(T):
    return T("bars").groupBy(board(F.col("ts_code")).alias("board")).agg(F.count("*").alias("n"))


@query("p04_clip", "select ts_code, trade_date, greatest(least(pct_chg, 11e0), -11e0) as target from bars")
def p04(T):
    return T("bars").select(*KEYS, clip(F.col("pct_chg"), -11.0, 11.0).alias("target"))


@query("p11_locked", "select ts_code, trade_date, case when high = low and pct_chg >= 97e-1 then 'locked_up' when high = low and pct_chg <= -97e-1 then 'locked_down' else '' end as locked from bars")
def p11(T):
    flat = F.col("high") == F.col("low")
    return T("bars").select(*KEYS, F.when(flat & (F.col("pct_chg") >= 9.7), "locked_up").when(flat & (F.col("pct_chg") <= -9.7), "locked_down").otherwise("").alias("locked"))


@query("f01_calendar", "select distinct trade_date, cast(isodow(trade_date) - 1 as integer) as dow, cast(month(trade_date) as integer) as month, cast(quarter(trade_date) as integer) as quarter, last_day(trade_date) = trade_date as month_end from bars")
def f01(T):
    d = T("bars").select("trade_date").distinct()
    return d.select("trade_date", F.weekday("trade_date").alias("dow"), F.month("trade_date").alias("month"), F.quarter("trade_date").alias("quarter"), (F.last_day("trade_date") == F.col("trade_date")).alias("month_end"))
