"""Further windows, studies, label fits and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, quantise, safe_div
from ..operators import cross_section as X
from ..operators import timeseries as S
from .base import query, scaled, sql_q, sql_scaled

KEYS = ["ts_code", "trade_date"]


def over(k: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {k - 1} preceding and current row)"


@query("j04_keyless_asof", "with c as (select distinct ann_date as d from fund), m as (select trade_date, csi300_pct_chg from mkt) select c.d as day, m.trade_date, m.csi300_pct_chg from c asof left join m on c.d >= m.trade_date")
def j04(T):
    """A series without a key onto a list of days: one row per day on both sides, ordered once."""
    days = T("fund").select(F.col("ann_date").alias("day")).distinct()
    both = days.withColumns({"side": F.lit(1), "m": F.lit(None).cast("struct<trade_date:date,csi300_pct_chg:double>")}).unionByName(
        T("mkt").select(F.col("trade_date").alias("day"), F.lit(0).alias("side"), F.struct("trade_date", "csi300_pct_chg").alias("m")))
    w = Window.orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("m", F.last("m", ignorenulls=True).over(w)).where("side = 1").select("day", "m.trade_date", "m.csi300_pct_chg")


@query("j17_archive_diff", f"""with a as (select ts_code, {sql_scaled('pred_b')} as x from preds where trade_date = (select max(trade_date) from preds)), b as (select ts_code, max_by({sql_scaled('pred_b')}, trade_date) as y from preds where trade_date < (select max(trade_date) from preds) group by 1)
select count(*) as n_common, avg(abs(x - y)) as mean_diff, max(abs(x - y)) as max_diff, count(case when x = y then 1 end) as n_same from a join b on a.ts_code = b.ts_code""")
def j17(T):
    p = T("preds").withColumn("v", scaled("pred_b"))
    last = p.agg(F.max("trade_date").alias("last"))
    tagged = p.crossJoin(F.broadcast(last))
    now = tagged.where("trade_date = last").select("ts_code", F.col("v").alias("x"))
    old = tagged.where("trade_date < last").groupBy("ts_code").agg(F.max_by("v", "trade_date").alias("y"))
    d = F.abs(F.col("x") - F.col("y"))
    return now.join(old, "ts_code").agg(F.count("*").alias("n_common"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.count(F.when(d == 0, 1)).alias("n_same"))


@query("w15_adx_rolling", f"""with d as (select ts_code, trade_date, {sql_scaled('high')} as h, {sql_scaled('low')} as l, {sql_scaled('pre_close')} as pc from bars),
m as (select *, h - lag(h) over (partition by ts_code order by trade_date) as up, lag(l) over (partition by ts_code order by trade_date) - l as dn from d),
s as (select ts_code, trade_date, sum(case when up > dn and up > 0 then up else 0 end) {over(14)} as p, sum(case when dn > up and dn > 0 then dn else 0 end) {over(14)} as n, sum(greatest(h - l, abs(h - pc), abs(l - pc))) {over(14)} as tr, count(up) {over(14)} as k from m)
select ts_code, trade_date, {sql_q('case when k = 14 then 1e2 * p / nullif(tr, 0) end', 2)} as plus_di, {sql_q('case when k = 14 then 1e2 * n / nullif(tr, 0) end', 2)} as minus_di from s""")
def w15(T):
    """Directional indicators on rolling sums of fourteen."""
    w = S.series()
    d = T("bars").select(*KEYS, scaled("high").alias("h"), scaled("low").alias("l"), scaled("pre_close").alias("pc"))
    d = d.withColumns({"up": F.col("h") - F.lag("h").over(w), "dn": F.lag("l").over(w) - F.col("l")})
    plus, minus = F.when((F.col("up") > F.col("dn")) & (F.col("up") > 0), F.col("up")).otherwise(0), F.when((F.col("dn") > F.col("up")) & (F.col("dn") > 0), F.col("dn")).otherwise(0)
    k = S.last(14)
    tr = F.sum(S.true_range(F.col("h"), F.col("l"), F.col("pc"))).over(k)
    full = F.count("up").over(k) == 14
    out = lambda x: quantise(F.when(full, safe_div(100.0 * F.sum(x).over(k), tr)), 2)
    return d.select(*KEYS, out(plus).alias("plus_di"), out(minus).alias("minus_di"))


@query("w26_rolling_median", f"select ts_code, trade_date, case when count(vol) {over(60)} >= 20 then quantile_cont(cast(vol as double), 5e-1) {over(60)} end as median_60 from bars")
def w26(T):
    w = S.last(60)
    return T("bars").select(*KEYS, F.when(F.count("vol").over(w) >= 20, F.percentile(F.col("vol").cast("double"), F.lit(0.5)).over(w)).alias("median_60"))


@query("w50_vwap", f"select ts_code, trade_date, {sql_q(f'sum({sql_scaled('amount', 2)}) {over(5)} / cast(nullif(sum(vol) {over(5)}, 0) as double)', 2)} as vwap_5 from bars")
def w50(T):
    w = S.last(5)
    return T("bars").select(*KEYS, quantise(safe_div(F.sum(scaled("amount", 2)).over(w), F.sum("vol").over(w)), 2).alias("vwap_5"))


@query("w54_size_decile", """with m as (select ts_code, quantile_cont(circ_mv, 5e-1) as mv from basic group by 1), e as (select list_sort(list_distinct(quantile_cont(mv, [0e0, 1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 1e0]))) as edges from m)
select ts_code, cast(len(list_filter(edges[2:len(edges) - 1], lambda x: x < mv)) as integer) as decile from m, e""")
def w54(T):
    m = T("basic").groupBy("ts_code").agg(F.percentile("circ_mv", F.lit(0.5)).alias("mv"))
    return X.quantile_bins(m, "mv", [], 10, "decile").select("ts_code", "decile")


@query("w55_decay_weights", "select ts_code, trade_date, floor(exp(0 - ln(2e0) / 60 * (row_number() over (partition by ts_code order by trade_date desc) - 1)) * 1e6 + 5e-1) / 1e6 as weight from bars")
def w55(T):
    age = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))) - 1
    return T("bars").select(*KEYS, quantise(F.exp(-F.ln(F.lit(2.0)) / 60 * age), 6).alias("weight"))


@query("a10_lift", """with l as (select ts_code, trade_date, vol, lead(case when pct_chg >= 97e-1 then 1 else 0 end) over (partition by ts_code order by trade_date) as nxt from bars), v as (select * from l where nxt is not null),
e as (select list_sort(list_distinct(quantile_cont(cast(vol as double), [0e0, 2e-1, 4e-1, 6e-1, 8e-1, 1e0]))) as edges from v), b as (select len(list_filter(edges[2:len(edges) - 1], lambda x: x < vol)) as bin, nxt from v, e)
select cast(bin as integer) as bin, count(*) as n, avg(nxt) as p_next from b group by 1""")
def a10(T):
    nxt = F.lead(F.when(F.col("pct_chg") >= 9.7, 1).otherwise(0)).over(S.series())
    d = T("bars").select(F.col("vol").cast("double").alias("vol"), nxt.alias("nxt")).where("nxt is not null")
    return X.quantile_bins(d, "vol", [], 5, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.avg("nxt").alias("p_next"))


@query("a23_long_short", f"""with j as (select b.trade_date, b.pb, {sql_scaled('r.pct_chg')} as x from basic b join bars r on r.ts_code = b.ts_code and r.trade_date = b.trade_date), e as (select trade_date, quantile_cont(pb, 2e-1) as lo, quantile_cont(pb, 8e-1) as hi, count(*) as n from j group by 1)
select j.trade_date, avg(case when pb >= hi then x end) - avg(case when pb <= lo then x end) as spread from j join e on e.trade_date = j.trade_date where n >= 10 group by 1""")
def a23(T):
    j = T("basic").select(*KEYS, "pb").join(T("bars").select(*KEYS, scaled("pct_chg").alias("x")), KEYS)
    e = j.groupBy("trade_date").agg(F.percentile("pb", F.array(F.lit(0.2), F.lit(0.8))).alias("e"), F.count("*").alias("n")).where("n >= 10")
    return j.join(e, "trade_date").groupBy("trade_date").agg((F.avg(F.when(F.col("pb") >= F.col("e")[1], F.col("x"))) - F.avg(F.when(F.col("pb") <= F.col("e")[0], F.col("x")))).alias("spread"))


@query("a46_sector_momentum", f"select s.sector, avg({sql_scaled('b.pct_chg')}) as momentum, count(*) as n from bars b join sector s on s.ts_code = b.ts_code where year(b.trade_date) = 1996 group by 1 order by momentum desc, s.sector limit 5")
def a46(T):
    d = T("bars").where(F.year("trade_date") == 1996).join(T("sector"), "ts_code").groupBy("sector").agg(F.avg(scaled("pct_chg")).alias("momentum"), F.count("*").alias("n"))
    return d.orderBy(F.desc("momentum"), "sector").limit(5)


@query("a52_leakage_scan", f"select {sql_q('corr(pred_a, target)', 3)} as pred_a, {sql_q('corr(pred_b, target)', 3)} as pred_b, {sql_q('corr(pred_c, target)', 3)} as pred_c from preds")
def a52(T):
    return T("preds").agg(*[quantise(correlation(c, "target"), 3).alias(c) for c in ("pred_a", "pred_b", "pred_c")])


@query("a53_checks", "select count(case when abs(pct_chg) > 25 then 1 end) as wild_bars, count(distinct case when abs(pct_chg) > 25 then ts_code end) as wild_codes, (select count(*) from fund where ann_date < end_date) as early_reports from bars")
def a53(T):
    wild = F.abs(F.col("pct_chg")) > 25
    early = T("fund").agg(F.count(F.when(F.col("ann_date") < F.col("end_date"), 1)).alias("early_reports"))
    return T("bars").agg(F.count(F.when(wild, 1)).alias("wild_bars"), F.countDistinct(F.when(wild, F.col("ts_code"))).alias("wild_codes")).crossJoin(early)


@query("a55_covariance", f"""with r as (select ts_code, trade_date, {sql_scaled('pct_chg', 2)} as x from bars where ts_code in (select ts_code from (select ts_code, count(*) as n from bars group by 1 order by n desc, ts_code limit 8) y))
select a.ts_code as a, b.ts_code as b, count(*) as n, {sql_q('(sum(a.x * b.x) - sum(a.x) * sum(b.x) / cast(count(*) as double)) / nullif(count(*) - 1, 0)', 1)} as cov from r a join r b on b.trade_date = a.trade_date and a.ts_code <= b.ts_code group by 1, 2 having count(*) >= 2""")
def a55(T):
    """Covariances of eight candidates: pairs form inside a date, of at most eight names."""
    bars = T("bars")
    top = bars.groupBy("ts_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ts_code").limit(8).select("ts_code")
    r = bars.join(F.broadcast(top), "ts_code", "left_semi").select("trade_date", "ts_code", scaled("pct_chg", 2).alias("x"))
    one, two = r.toDF("trade_date", "a", "x"), r.toDF("trade_date", "b", "y")
    j = one.join(two, "trade_date").where("a <= b")
    n = F.count("*")
    cov = (F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y") / n.cast("double")) / F.nullif(n - 1, F.lit(0))
    return j.groupBy("a", "b").agg(n.alias("n"), quantise(cov, 1).alias("cov")).where("n >= 2")


@query("f02_cyclical", f"select distinct trade_date, {sql_q('sin(2e0 * pi() * month(trade_date) / 12)')} as month_sin, {sql_q('cos(2e0 * pi() * dayofyear(trade_date) / 365)')} as day_cos from bars")
def f02(T):
    d = T("bars").select("trade_date").distinct()
    turn = lambda x, n: F.lit(2.0) * F.pi() * x / n
    return d.select("trade_date", quantise(F.sin(turn(F.month("trade_date"), 12))).alias("month_sin"), quantise(F.cos(turn(F.dayofyear("trade_date"), 365))).alias("day_cos"))


@query("f05_quarter_ends", "select cast(unnest(generate_series(date_trunc('quarter', min(trade_date)), date_trunc('quarter', max(trade_date)), interval 3 month)) + interval 3 month - interval 1 day as date) as period from bars")
def f05(T):
    q = F.sequence(F.date_trunc("quarter", F.min("trade_date")), F.date_trunc("quarter", F.max("trade_date")), F.expr("interval 3 months"))
    return T("bars").agg(q.alias("q")).select(F.explode("q").alias("q")).select(F.last_day(F.add_months("q", 2)).alias("period"))


@query("f22_category_ids", "select s.ts_code, cast(dense_rank() over (order by sector) as integer) as sector_id from sector s")
def f22(T):
    """Ids by name over one row per distinct name, joined back."""
    ids = T("sector").select("sector").distinct().withColumn("sector_id", F.row_number().over(Window.orderBy("sector")))
    return T("sector").join(ids, "sector").select("ts_code", "sector_id")


@query("f19_direction", "select doc_id, case when regexp_matches(lower(content), 'trash|worthless|stupid') then -1 when regexp_matches(lower(content), 'license|rights') then 1 else 0 end as direction from news")
def f19(T):
    low = F.lower("content")
    return T("news").select("doc_id", F.when(low.rlike("trash|worthless|stupid"), -1).when(low.rlike("license|rights"), 1).otherwise(0).alias("direction"))


@query("l07_date_split", "select split, count(*) as n, min(trade_date) as first_day from (select trade_date, case when trade_date < date '1996-01-01' then 'train' when trade_date < date '1997-01-01' then 'val' else 'test' end as split from bars) x group by 1")
def l07(T):
    s = F.when(F.col("trade_date") < "1996-01-01", "train").when(F.col("trade_date") < "1997-01-01", "val").otherwise("test")
    return T("bars").groupBy(s.alias("split")).agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"))


@query("k04_hash_sample", "select ts_code, trade_date from (select ts_code, trade_date, row_number() over (partition by pct_chg > 0 order by md5(ts_code || cast(trade_date as varchar) || ':7'), ts_code, trade_date) as n from bars) x where n <= 50")
def k04(T):
    """Fifty of either class in the order of a seeded hash: the same rows on every run."""
    order = F.md5(F.concat("ts_code", F.col("trade_date").cast("string"), F.lit(":7")))
    w = Window.partitionBy(F.col("pct_chg") > 0).orderBy(order, "ts_code", "trade_date")
    return T("bars").withColumn("n", F.row_number().over(w)).where("n <= 50").select(*KEYS)


@query("k09_recent_articles", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by datetime desc, doc_id) as n from news) x where n <= 5")
def k09(T):
    w = Window.partitionBy("source").orderBy(F.desc("datetime"), "doc_id")
    return T("news").withColumn("n", F.row_number().over(w)).where("n <= 5").select("source", "doc_id")


@query("p08_universe_filter", "select ts_code from bars group by 1 having count(*) >= 500 and avg(vol) >= 20 and min(trade_date) < date '1996-01-01'")
def p08(T):
    d = T("bars").groupBy("ts_code").agg(F.count("*").alias("n"), F.avg("vol").alias("v"), F.min("trade_date").alias("first"))
    return d.where((F.col("n") >= 500) & (F.col("v") >= 20) & (F.col("first") < "1996-01-01")).select("ts_code")


@query("p13_st_kind", "select case when st_kind like '*ST%' then '*ST' when st_kind like 'ST%' then 'ST' end as kind, count(*) as n from st group by 1")
def p13(T):
    kind = F.when(F.col("st_kind").startswith("*ST"), "*ST").when(F.col("st_kind").startswith("ST"), "ST")
    return T("st").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("p14_band", f"select ts_code, trade_date, {sql_q('(up_limit - (up_limit + down_limit) / 2) / ((up_limit + down_limit) / 2) * 1e2', 3)} as band_pct from limits")
def p14(T):
    """Half the band in percent of its middle; NaN, as in the twin, where a price is so low that both limits round to 0."""
    mid = (F.col("up_limit") + F.col("down_limit")) / 2
    share = quantise(safe_div(F.col("up_limit") - mid, mid) * F.lit(100.0), 3)
    return T("limits").select(*KEYS, F.when(mid == 0, F.lit(float("nan"))).otherwise(share).alias("band_pct"))
