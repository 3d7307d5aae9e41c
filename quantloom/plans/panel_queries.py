"""Joins, dedupe, panel assembly, targets and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import quantise, safe_div
from ..operators import joins as J
from ..operators import labels as L
from ..operators import timeseries as S
from .base import query, scaled, sql_q, sql_scaled

KEYS = ["ts_code", "trade_date"]


@query("j01_panel", """select b.ts_code, b.trade_date, b.close, s.pe_ttm, s.pb, f.buy_lg_amount, l.up_limit from bars b
left join basic s on s.ts_code = b.ts_code and s.trade_date = b.trade_date left join flow f on f.ts_code = b.ts_code and f.trade_date = b.trade_date left join limits l on l.ts_code = b.ts_code and l.trade_date = b.trade_date""")
def j01(T):
    d = T("bars").select(*KEYS, "close").join(T("basic").select(*KEYS, "pe_ttm", "pb"), KEYS, "left")
    return d.join(T("flow").select(*KEYS, "buy_lg_amount"), KEYS, "left").join(T("limits").select(*KEYS, "up_limit"), KEYS, "left")


@query("j02_market", "select b.ts_code, b.trade_date, b.pct_chg, m.csi300_pct_chg from bars b left join mkt m on m.trade_date = b.trade_date")
def j02(T):
    """The market series has one row per date; adaptive execution broadcasts it when it is small."""
    return T("bars").select(*KEYS, "pct_chg").join(T("mkt").select("trade_date", "csi300_pct_chg"), "trade_date", "left").select(*KEYS, "pct_chg", "csi300_pct_chg")


_FUND = "select ts_code, ann_date, eps, roe from (select *, row_number() over (partition by ts_code, ann_date order by end_date desc, seq desc) as n from fund) x where n = 1"


@query("j03_asof", f"with r as ({_FUND}) select b.ts_code, b.trade_date, r.ann_date, r.eps, r.roe from bars b asof left join r on b.ts_code = r.ts_code and b.trade_date >= r.ann_date")
def j03(T):
    fund = J.keep_last(T("fund"), ["ts_code", "ann_date"], ["end_date", "seq"]).select("ts_code", "ann_date", "eps", "roe")
    return J.asof_join(T("bars").select(*KEYS), fund, "ts_code", "trade_date", "ann_date", ["eps", "roe"])


@query("j05_asof_max_age", f"""with r as ({_FUND}), m as (select b.ts_code, b.trade_date, r.ann_date, r.eps from bars b asof left join r on b.ts_code = r.ts_code and b.trade_date >= r.ann_date)
select ts_code, trade_date, case when datediff('day', ann_date, trade_date) <= 3 then ann_date end as ann_date, case when datediff('day', ann_date, trade_date) <= 3 then eps end as eps from m""")
def j05(T):
    fund = J.keep_last(T("fund"), ["ts_code", "ann_date"], ["end_date", "seq"]).select("ts_code", "ann_date", "eps")
    return J.asof_join(T("bars").select(*KEYS), fund, "ts_code", "trade_date", "ann_date", ["eps"], max_age=3)


@query("j06_interval", "select b.ts_code, b.trade_date, exists (select 1 from st s where s.ts_code = b.ts_code and s.start_date <= b.trade_date and coalesce(s.end_date, date '9999-12-31') >= b.trade_date) as is_st from bars b")
def j06(T):
    return J.in_interval(T("bars").select(*KEYS), T("st"), "ts_code", "trade_date", "start_date", "end_date", "is_st")


@query("j07_held_days", "select t.trade_id, t.ts_code, d.trade_date from trades t join (select distinct trade_date from bars) d on d.trade_date >= t.entry_date and d.trade_date < t.exit_date")
def j07(T):
    return J.held_days(T("trades"), T("bars").select("trade_date")).select("trade_id", "ts_code", "trade_date")


@query("j08_outer_pivot", "select trade_date, max(case when board = 'A' then n end) as n_a, max(case when board = 'B' then n end) as n_b from (select trade_date, case when ts_code like '%SH' then 'A' else 'B' end as board, count(*) as n from bars group by 1, 2) x group by 1")
def j08(T):
    """A full outer join of series by date as one long table and one pivot."""
    long = T("bars").withColumn("board", F.when(F.col("ts_code").like("%SH"), "n_a").otherwise("n_b"))
    return long.groupBy("trade_date").pivot("board", ["n_a", "n_b"]).count()


@query("j11_semi", "select ts_code, trade_date, close from bars b where exists (select 1 from trades t where t.ts_code = b.ts_code and t.entry_date = b.trade_date)")
def j11(T):
    keys = T("trades").select("ts_code", F.col("entry_date").alias("trade_date"))
    return T("bars").select(*KEYS, "close").join(keys, KEYS, "left_semi")


@query("j12_gaps", "select b.ts_code, b.trade_date from bars b where not exists (select 1 from basic s where s.ts_code = b.ts_code and s.trade_date = b.trade_date)")
def j12(T):
    return T("bars").select(*KEYS).join(T("basic"), KEYS, "left_anti")


@query("j13_snapshots", """with q as (select max(trade_date) as snap from bars group by year(trade_date), quarter(trade_date)), c as (select ts_code, min(trade_date) as first, max(trade_date) as last from bars group by 1)
select c.ts_code, q.snap from c join q on q.snap between c.first and c.last""")
def j13(T):
    """Instruments by quarter ends: each lists the quarters of its life and meets their ends by equality."""
    bars = T("bars")
    q = bars.groupBy(F.date_trunc("quarter", "trade_date").alias("q")).agg(F.max("trade_date").alias("snap"))
    c = bars.groupBy("ts_code").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    each = c.withColumn("q", F.explode(F.sequence(F.date_trunc("quarter", "first"), F.date_trunc("quarter", "last"), F.expr("interval 3 months"))))
    return each.join(q, "q").where(F.col("snap").between(F.col("first"), F.col("last"))).select("ts_code", "snap")


@query("j19_sector_size", "select s.coarse_sector, s.sector, count(*) as n_codes, sum(b.n) as n_bars from sector s join (select ts_code, count(*) as n from bars group by 1) b on b.ts_code = s.ts_code group by 1, 2")
def j19(T):
    return T("sector").join(T("bars").groupBy("ts_code").agg(F.count("*").alias("n")), "ts_code").groupBy("coarse_sector", "sector").agg(F.count("*").alias("n_codes"), F.sum("n").alias("n_bars"))


@query("d01_keep_last", "select ts_code, start_date, st_kind, end_date from (select *, row_number() over (partition by ts_code, start_date order by end_date desc nulls last, st_kind desc) as n from st) x where n = 1")
def d01(T):
    return J.keep_last(T("st"), ["ts_code", "start_date"], ["end_date", "st_kind"]).select("ts_code", "start_date", "st_kind", "end_date")


@query("s05_upsert", "select ts_code, end_date, seq, eps from (select *, row_number() over (partition by ts_code, end_date order by seq % 2 desc, seq desc) as n from fund) x where n = 1")
def s05(T):
    """Old rows (even seq) and new rows (odd), new over old per key."""
    fund = T("fund").withColumn("batch", F.col("seq") % 2)
    old, new = fund.where("batch = 0"), fund.where("batch = 1")
    return J.keep_last(old.unionByName(new), ["ts_code", "end_date"], ["batch", "seq"]).select("ts_code", "end_date", "seq", "eps")


@query("s06_high_water", "select ts_code, min(trade_date) as first_date, max(trade_date) as last_date, count(*) as n from bars group by 1")
def s06(T):
    return T("bars").groupBy("ts_code").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("n"))


@query("d07_common_dates", "select distinct trade_date from bars where day(trade_date) % 2 = 0 intersect select distinct trade_date from basic")
def d07(T):
    return T("bars").where(F.dayofmonth("trade_date") % 2 == 0).select("trade_date").intersect(T("basic").select("trade_date"))


@query("d08_calendar", "select c.ts_code, count(*) as n_missing, min(d.day) as first_missing from (select ts_code, min(trade_date) as a, max(trade_date) as b from bars group by 1) c join (select cast(unnest(generate_series(date '1992-01-01', date '2010-12-31', interval 1 day)) as date) as day) d on d.day between c.a and c.b where isodow(d.day) <= 5 and not exists (select 1 from bars b where b.ts_code = c.ts_code and b.trade_date = d.day) group by 1")
def d08(T):
    """Weekdays of an instrument's life without a bar."""
    life = T("bars").groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = life.select("ts_code", F.explode(F.sequence("a", "b")).alias("trade_date")).where(F.weekday("trade_date") < 5)
    return days.join(T("bars").select(*KEYS), KEYS, "left_anti").groupBy("ts_code").agg(F.count("*").alias("n_missing"), F.min("trade_date").alias("first_missing"))


@query("l01_targets", "select ts_code, trade_date, lead(ex, 1) over (partition by ts_code order by trade_date) as target_d1, lead(ex, 5) over (partition by ts_code order by trade_date) as target_d5 from (select b.ts_code, b.trade_date, greatest(least(pct_chg - csi300_pct_chg, 11e0), -11e0) as ex from bars b join mkt m on m.trade_date = b.trade_date) x")
def l01(T):
    d = T("bars").join(T("mkt"), "trade_date").withColumn("ex", F.greatest(F.least(F.col("pct_chg") - F.col("csi300_pct_chg"), F.lit(11.0)), F.lit(-11.0)))
    return L.forward_returns(d, "ex", (1, 5)).select(*KEYS, "target_d1", "target_d5")


@query("l02_cumulative", f"select ts_code, trade_date, {sql_q('lead(close, 5) over (partition by ts_code order by trade_date) / nullif(close, 0) - 1')} as fwd_5 from bars")
def l02(T):
    return T("bars").select(*KEYS, quantise(safe_div(F.lead("close", 5).over(S.series()), F.col("close")) - 1).alias("fwd_5"))


@query("l03_buckets", "select bucket, count(*) as n from (select case when pct_chg < -5 then 0 when pct_chg < -2 then 1 when pct_chg < 0 then 2 when pct_chg < 2 then 3 when pct_chg < 5 then 4 else 5 end as bucket from bars) x group by 1")
def l03(T):
    return T("bars").groupBy(L.bucket(F.col("pct_chg"), [-5.0, -2.0, 0.0, 2.0, 5.0]).alias("bucket")).agg(F.count("*").alias("n"))


@query("l08_walk_forward", """with d as (select trade_date, row_number() over (order by trade_date) - 1 as i, count(*) over () as n from (select distinct trade_date from bars) x),
f as (select unnest(range(0, greatest(0, cast(floor((max(n) - 280) / 20e0) as bigint) + 1))) as fold from d)
select cast(fold as integer) as fold, case when i - fold * 20 < 200 then 'train' when i - fold * 20 < 205 then 'gap' when i - fold * 20 < 245 then 'val' when i - fold * 20 < 260 then 'gap' else 'test' end as split, count(*) as n_days, min(trade_date) as first_day
from f join d on i >= fold * 20 and i < fold * 20 + 280 group by 1, 2""")
def l08(T):
    f = L.walk_forward(T("bars").select("trade_date"), 200, 5, 40, 15, 20, 5)
    return f.groupBy("fold", "split").agg(F.count("*").alias("n_days"), F.min("trade_date").alias("first_day"))


@query("l09_temporal", """with d as (select trade_date, row_number() over (order by trade_date) - 1 as i, count(*) over () as n from (select distinct trade_date from bars) x)
select trade_date, case when i < floor(n * 7e-1) - 5 then 'train' when i < floor(n * 7e-1) then 'gap' when i < floor(n * 85e-2) - 5 then 'val' when i < floor(n * 85e-2) then 'gap' else 'test' end as split from d""")
def l09(T):
    return L.temporal_split(T("bars").select("trade_date"))


@query("l13_windows", f"with p as (select ts_code, trade_date, {sql_scaled('close')} as px, count(*) over (partition by ts_code order by trade_date rows between 9 preceding and current row) as n, list(cast({sql_scaled('close')} as varchar)) over (partition by ts_code order by trade_date rows between 9 preceding and current row) as l from bars) select ts_code, trade_date, array_to_string(l, ',') as window_10 from p where n = 10")
def l13(T):
    d = T("bars").withColumn("px", scaled("close")).withColumns({"n": F.count("*").over(S.last(10)), "l": F.collect_list(F.col("px").cast("string")).over(S.last(10))})
    return d.where("n = 10").select(*KEYS, F.array_join("l", ",").alias("window_10"))


@query("w45_block_ratio", f"""with a as (select ts_code, trade_date, count(*) as n, sum(cast(vol as bigint)) as bvol, sum(case when buyer = 'inst' then cast(vol as bigint) else 0 end) - sum(case when seller = 'inst' then cast(vol as bigint) else 0 end) as inst_net from block group by 1, 2)
select b.ts_code, b.trade_date, coalesce(a.n, 0) as n_blocks, {sql_q('coalesce(a.bvol, 0) / avg(b.vol) over (partition by b.ts_code order by b.trade_date rows between 19 preceding and current row)')} as block_ratio, coalesce(a.inst_net, 0) as inst_net
from bars b left join a on a.ts_code = b.ts_code and a.trade_date = b.trade_date""")
def w45(T):
    v = F.col("vol").cast("long")
    a = T("block").groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(v).alias("bvol"), (F.sum(F.when(F.col("buyer") == "inst", v).otherwise(0)) - F.sum(F.when(F.col("seller") == "inst", v).otherwise(0))).alias("inst_net"))
    d = T("bars").select(*KEYS, "vol").join(a, KEYS, "left")
    return d.select(*KEYS, F.coalesce("n", F.lit(0)).alias("n_blocks"), quantise(F.coalesce("bvol", F.lit(0)) / F.avg("vol").over(S.last(20))).alias("block_ratio"), F.coalesce("inst_net", F.lit(0)).alias("inst_net"))


@query("w46_flow_ratio", f"select ts_code, trade_date, {sql_q('(buy_sm_amount - sell_sm_amount + buy_lg_amount - sell_lg_amount) / nullif(buy_sm_amount + sell_sm_amount + buy_lg_amount + sell_lg_amount, 0)')} as net_ratio from flow")
def w46(T):
    bs, ss, bl, sl = (F.col(c) for c in ("buy_sm_amount", "sell_sm_amount", "buy_lg_amount", "sell_lg_amount"))
    return T("flow").select(*KEYS, quantise(safe_div(bs - ss + bl - sl, bs + ss + bl + sl)).alias("net_ratio"))


@query("k05_last_rows", "select ts_code, trade_date, close from (select *, row_number() over (partition by ts_code order by trade_date desc) as n from bars) x where n <= 3")
def k05(T):
    w = Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))
    return T("bars").withColumn("n", F.row_number().over(w)).where("n <= 3").select(*KEYS, "close")


@query("k01_top_gainers", "select ts_code, trade_date, pct_chg from bars order by pct_chg desc, ts_code, trade_date limit 20")
def k01(T):
    return T("bars").orderBy(F.desc("pct_chg"), "ts_code", "trade_date").limit(20).select(*KEYS, "pct_chg")


@query("k02_daily_pool", """with s as (select p.ts_code, p.trade_date, p.pred_a, abs(b.close - l.up_limit) <= 5e-3 as at_limit from preds p join bars b on b.ts_code = p.ts_code and b.trade_date = p.trade_date join limits l on l.ts_code = p.ts_code and l.trade_date = p.trade_date)
select ts_code, trade_date, cast(rank as integer) as rank from (select *, row_number() over (partition by trade_date order by pred_a desc, ts_code) as rank from s where not at_limit) x where rank <= 10""")
def k02(T):
    d = T("preds").join(T("bars").select(*KEYS, "close"), KEYS).join(T("limits"), KEYS).where(F.abs(F.col("close") - F.col("up_limit")) > 0.005)
    w = Window.partitionBy("trade_date").orderBy(F.desc("pred_a"), "ts_code")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(*KEYS, "rank")
