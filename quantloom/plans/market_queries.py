"""Preparation of panels, ensembles, attribution, fundamentals, samples, splits and labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import clip, correlation, quantise, safe_div
from ..operators import ordering as O
from ..operators import timeseries as S
from ..streaming.jobs import kept
from .base import query, scaled, sql_q, sql_scaled

KEYS = ["ts_code", "trade_date"]
W = "over (partition by ts_code order by trade_date)"
TRAIN_TO = date(1997, 1, 1)


def over(k: int) -> str:
    return f"over (partition by ts_code order by trade_date rows between {k - 1} preceding and current row)"


@query("p01_safe_divide", f"select ts_code, trade_date, {sql_q('amount / nullif(cast(vol as double), 0)')} as price, {sql_q('pct_chg / nullif(high - low, 0)', 2)} as per_range from bars")
def p01(T):
    return T("bars").select(*KEYS, quantise(safe_div(F.col("amount"), F.col("vol"))).alias("price"), quantise(safe_div(F.col("pct_chg"), F.col("high") - F.col("low")), 2).alias("per_range"))


@query("p02_fill_features", "select p.ts_code, p.trade_date, coalesce(case when isnan(pe_ttm) or isinf(pe_ttm) then null else pe_ttm end, 0) as pe_ttm, coalesce(case when isnan(pb) or isinf(pb) then null else pb end, 0) as pb, p.target from preds p left join basic b on b.ts_code = p.ts_code and b.trade_date = p.trade_date")
def p02(T):
    """Features get 0 for what isn't finite; targets keep their nulls."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))
    j = T("preds").select(*KEYS, "target").join(T("basic").select(*KEYS, "pe_ttm", "pb"), KEYS, "left")
    return j.select(*KEYS, *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in ("pe_ttm", "pb")], "target")


@query("p03_warm_up", f"select ts_code, trade_date, mean_20 from (select *, case when count(*) {over(20)} = 20 then avg({sql_scaled('close', 2)}) {over(20)} end as mean_20 from bars) x where mean_20 is not null")
def p03(T):
    return T("bars").withColumn("mean_20", S.rolling(F.avg, scaled("close", 2), 20)).dropna(subset=["mean_20"]).select(*KEYS, "mean_20")


@query("p06_identity_breaks", "select b.ts_code, count(*) as n, min(b.trade_date) as first_day from bars b left join (select ts_code, min(start_date) as brk from st group by 1) s on s.ts_code = b.ts_code where s.brk is null or b.trade_date >= s.brk group by 1")
def p06(T):
    breaks = T("st").groupBy("ts_code").agg(F.min("start_date").alias("brk"))
    return T("bars").join(breaks, "ts_code", "left").where("brk is null or trade_date >= brk").groupBy("ts_code").agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"))


# Words that mark an event.
EVENTS = ("license", "rights", "the", "que")


@query("p09_event_news", "select doc_id, title from (select *, row_number() over (partition by title order by datetime, doc_id) as k from news where " + " or ".join(f"contains(title, '{w}') or contains(content, '{w}')" for w in EVENTS) + ") x where k = 1")
def p09(T):
    hit = F.lit(False)
    for w in EVENTS:
        hit = hit | F.col("title").contains(w) | F.col("content").contains(w)
    first = T("news").where(hit).groupBy("title").agg(F.min_by("doc_id", F.struct("datetime", "doc_id")).alias("doc_id"))
    return first.select("doc_id", "title")


# A keyword in a name and the sector it stands for; the first that fits counts.
SECTORS = (("bolt", "metal"), ("widget", "device"), ("gear", "machine"), ("small", "light"))


@query("p10_sector_keyword", "select case " + " ".join(f"when contains(p_name, '{k}') then '{v}'" for k, v in SECTORS) + " else 'Unknown' end as sector, count(*) as n, max(p_retailprice) as top from part group by 1")
def p10(T):
    sector = F.lit("Unknown")
    for k, v in reversed(SECTORS):
        sector = F.when(F.col("p_name").contains(k), v).otherwise(sector)
    return T("part").groupBy(sector.alias("sector")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))


@query("p12_open_at_limit", "select b.ts_code, b.trade_date, open >= up_limit - 5e-3 as open_up, open <= down_limit + 5e-3 as open_down from bars b join limits l on l.ts_code = b.ts_code and l.trade_date = b.trade_date where open >= up_limit - 5e-3 or open <= down_limit + 5e-3")
def p12(T):
    d = T("bars").join(T("limits"), KEYS).select(*KEYS, (F.col("open") >= F.col("up_limit") - 0.005).alias("open_up"), (F.col("open") <= F.col("down_limit") + 0.005).alias("open_down"))
    return d.where("open_up or open_down")


# Features and the group each belongs to.
CATALOGUE = (("pe_ttm", "valuation"), ("pb", "valuation"), ("circ_mv", "size"), ("turnover_rate_f", "liquidity"), ("dv_ttm", "valuation"))
HAVE = ("pe_ttm", "pb", "circ_mv", "turnover_rate_f")


@query("p15_feature_groups", " union all ".join(f"select '{f}' as feature, '{g}' as grp, " + (f"count({f}) * 1e0 / count(*)" if f in HAVE else "cast(null as double)") + " as filled from basic" + ("" if f in HAVE else " having count(*) >= 0") for f, g in CATALOGUE))
def p15(T):
    """Each feature of the catalogue with its group and share of values; null where the table lacks it."""
    filled = T("basic").agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in HAVE])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(g).alias("grp"), (F.col(f) if f in HAVE else F.lit(None)).cast("double").alias("filled")) for f, g in CATALOGUE])
    return filled.select(F.inline(pairs))


@query("p16_align", "select ts_code, trade_date, pb, 0e0 as dv_ttm, circ_mv, 0e0 as ps_ttm from basic")
def p16(T):
    d = T("basic")
    return d.select(*KEYS, *[F.col(c) if c in d.columns else F.lit(0.0).alias(c) for c in ("pb", "dv_ttm", "circ_mv", "ps_ttm")])


_MODELS = "a as (select ts_code, trade_date, pred_a from preds where fold <= 7), b as (select ts_code, trade_date, pred_b from preds where fold >= 2), c as (select ts_code, trade_date, pred_c from preds where pred_c is not null)"


def _frames(T):
    return [T("preds").where(rows).select(*KEYS, c) for c, rows in (("pred_a", "fold <= 7"), ("pred_b", "fold >= 2"), ("pred_c", "pred_c is not null"))]


@query("j09_inner_models", f"with {_MODELS} select ts_code, trade_date, pred_a, pred_b, pred_c from a join b using (ts_code, trade_date) join c using (ts_code, trade_date)")
def j09(T):
    a, b, c = _frames(T)
    return a.join(b, KEYS).join(c, KEYS)


@query("j10_outer_models", f"with {_MODELS} select ts_code, trade_date, pred_a, pred_b, pred_c, (pred_a is not null)::int + (pred_b is not null)::int + (pred_c is not null)::int as engines from a full join b using (ts_code, trade_date) full join c using (ts_code, trade_date)")
def j10(T):
    """A row for each key that any engine has: the union in long form, gathered once."""
    long = None
    for f in _frames(T):
        long = f if long is None else long.unionByName(f, allowMissingColumns=True)
    return long.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in ("pred_a", "pred_b", "pred_c")], F.count("*").cast("int").alias("engines"))


@query("j18_benchmark_fill", "select e.trade_date, last_value(m.csi300_close ignore nulls) over (order by e.trade_date rows between unbounded preceding and current row) as benchmark from equity e left join (select * from mkt where day(trade_date) <= 10) m on m.trade_date = e.trade_date")
def j18(T):
    bench = T("mkt").where(F.dayofmonth("trade_date") <= 10).select("trade_date", "csi300_close")
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return T("equity").select("trade_date").join(bench, "trade_date", "left").select("trade_date", F.last("csi300_close", ignorenulls=True).over(w).alias("benchmark"))


@query("j20_alias_master", "select c.ts_code, s.sector, coalesce(s.coarse_sector, 'Unknown') as coarse_sector, m.weight, m.day from codes c left join sector s on s.ts_code = c.ts_code left join (select ts_code, max_by(in_index, snapshot_date) as weight, max(snapshot_date) as day from idxw group by 1) m on m.ts_code = c.ts_code")
def j20(T):
    latest = T("idxw").groupBy("ts_code").agg(F.max_by("in_index", "snapshot_date").alias("weight"), F.max("snapshot_date").alias("day"))
    j = T("codes").select("ts_code").join(T("sector"), "ts_code", "left").join(latest, "ts_code", "left")
    return j.select("ts_code", "sector", F.coalesce("coarse_sector", F.lit("Unknown")).alias("coarse_sector"), "weight", "day")


@query("a02_institution_flow", f"select ts_code, trade_date, sum(case when contains(buyer, 'inst') then {sql_scaled('amount', 2)} else 0 end) as bought, sum(case when contains(seller, 'inst') then {sql_scaled('amount', 2)} else 0 end) as sold, count(*) as n from block group by 1, 2")
def a02(T):
    side = lambda c: F.sum(F.when(F.col(c).contains("inst"), scaled("amount", 2)).otherwise(0))
    return T("block").groupBy(*KEYS).agg(side("buyer").alias("bought"), side("seller").alias("sold"), F.count("*").alias("n"))


@query("a03_net_ratio", f"with x as (select trade_date, sum(case when buyer = 'inst' then {sql_scaled('amount', 2)} else -{sql_scaled('amount', 2)} end) as net, sum({sql_scaled('amount', 2)}) as total from block group by 1) select trade_date, {sql_q('greatest(least(cast(net as double) / nullif(cast(total as double), 0), 1), -1)')} as net_ratio from x")
def a03(T):
    a = scaled("amount", 2)
    d = T("block").groupBy("trade_date").agg(F.sum(F.when(F.col("buyer") == "inst", a).otherwise(-a)).alias("net"), F.sum(a).alias("total"))
    return d.select("trade_date", quantise(clip(safe_div(F.col("net").cast("double"), F.col("total")), -1.0, 1.0)).alias("net_ratio"))


@query("a05_cross_section_stats", f"select trade_date, count(*) as n, avg({sql_scaled('pct_chg')}) as mean_chg, {sql_q('stddev_samp(pct_chg)', 3)} as std_chg from bars group by 1 having count(*) >= 3")
def a05(T):
    d = T("bars").groupBy("trade_date").agg(F.count("*").alias("n"), F.avg(scaled("pct_chg")).alias("mean_chg"), quantise(F.stddev_samp("pct_chg"), 3).alias("std_chg"))
    return d.where("n >= 3")


_LONG = "with x as (select fold, ts_code, unnest([1, 2, 3]) as h, unnest([pred_a, pred_b, pred_c]) as pred, target from preds)"


def _long(T):
    """A row for each horizon of a prediction."""
    each = F.array(*[F.struct(F.lit(i + 1).alias("h"), F.col(c).alias("pred")) for i, c in enumerate(("pred_a", "pred_b", "pred_c"))])
    return T("preds").select("fold", *KEYS, "target", F.inline(each))


@query("a17_horizons", f"{_LONG} select h, count(*) as n, {sql_q('avg(abs(pred - target))', 3)} as mae, {sql_q('sqrt(avg((pred - target) * (pred - target)))', 3)} as rmse, avg(case when sign(pred) = sign(target) then 1 else 0 end) as hit_rate, {sql_q('corr(pred, target)', 3)} as ic from x where pred is not null and target is not null group by 1")
def a17(T):
    e = F.col("pred") - F.col("target")
    hit = F.avg(F.when(F.signum("pred") == F.signum("target"), 1).otherwise(0))
    d = _long(T).where("pred is not null and target is not null")
    return d.groupBy("h").agg(F.count("*").alias("n"), quantise(F.avg(F.abs(e)), 3).alias("mae"), quantise(F.sqrt(F.avg(e * e)), 3).alias("rmse"), hit.alias("hit_rate"), quantise(correlation("pred", "target"), 3).alias("ic"))


@query("a20_sector_class", "select s.sector, cast(sign(p.target) as int) as class, count(*) as n, sum(case when sign(pred_a) = sign(target) then 1 else 0 end) as n_right from preds p join sector s on s.ts_code = p.ts_code where target is not null group by 1, 2")
def a20(T):
    d = T("preds").where("target is not null").join(T("sector").select("ts_code", "sector"), "ts_code")
    return d.groupBy("sector", F.signum("target").cast("int").alias("class")).agg(F.count("*").alias("n"), F.sum(F.when(F.signum("pred_a") == F.signum("target"), 1).otherwise(0)).alias("n_right"))


_EXPOSURE = f"x as (select b.trade_date, avg({sql_scaled('b.pb')}) as exposure, count(*) as held from trades t join basic b on b.ts_code = t.ts_code and b.trade_date >= t.entry_date and b.trade_date < t.exit_date group by 1)"


def _exposure(T):
    """Mean factor over holdings: each trade's days are listed, so the join is one of equality."""
    days = T("trades").where("exit_date > entry_date").select("ts_code", F.explode(F.sequence("entry_date", F.date_sub("exit_date", 1))).alias("trade_date"))
    return days.join(T("basic").select(*KEYS, "pb"), KEYS).groupBy("trade_date").agg(F.avg(scaled("pb")).alias("exposure"), F.count("*").alias("held"))


@query("a24_exposure", f"with {_EXPOSURE} select * from x")
def a24(T):
    return _exposure(T)


@query("a25_attribution", f"""with {_EXPOSURE}, y as (select e.trade_date, lag(x.exposure) over (order by e.trade_date) as held, m.csi300_pct_chg as factor, e.invested / e.nav as share, (e.nav / lag(e.nav) over (order by e.trade_date) - 1) * 100 as total
from equity e left join x on x.trade_date = e.trade_date left join mkt m on m.trade_date = e.trade_date)
select trade_date, {sql_q('coalesce(held, 0) / 1e4 * factor * share', 2)} as explained, {sql_q('total - coalesce(held, 0) / 1e4 * factor * share', 2)} as alpha from y where total is not null and factor is not null""")
def a25(T):
    """Yesterday's exposure times today's factor return times the invested share; what is left is alpha."""
    w = Window.orderBy("trade_date")
    j = T("equity").join(_exposure(T), "trade_date", "left").join(T("mkt").select("trade_date", "csi300_pct_chg"), "trade_date", "left")
    d = j.withColumns({"lagged": F.lag("exposure").over(w), "before": F.lag("nav").over(w)})
    total = (safe_div(F.col("nav"), F.col("before")) - 1) * 100
    explained = F.coalesce("lagged", F.lit(0.0)) / 1e4 * F.col("csi300_pct_chg") * safe_div(F.col("invested"), F.col("nav"))
    return d.where(total.isNotNull() & F.col("csi300_pct_chg").isNotNull()).select("trade_date", quantise(explained, 2).alias("explained"), quantise(total - explained, 2).alias("alpha"))


@query("a27_nav_variants", f"""with r as (select ln(nav / lag(nav) over (order by trade_date)) as r from equity)
select count(r) as n, {sql_q('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252)', 2)} as log_sharpe, {sql_q('avg(r) / nullif(sqrt(avg(case when r < 0 then r * r else 0 end)), 0) * sqrt(252)', 2)} as sortino, {sql_q('exp(sum(r)) - 1', 3)} as total from r where r is not null""")
def a27(T):
    r = T("equity").select(F.ln(safe_div(F.col("nav"), F.lag("nav").over(Window.orderBy("trade_date")))).alias("r")).where("r is not null")
    down = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)))
    year = F.sqrt(F.lit(252.0))
    return r.agg(F.count("r").alias("n"), quantise(safe_div(F.avg("r"), F.stddev_samp("r")) * year, 2).alias("log_sharpe"), quantise(safe_div(F.avg("r"), down) * year, 2).alias("sortino"), quantise(F.exp(F.sum("r")) - 1, 3).alias("total"))


@query("a37_statement_medians", "with x as (select *, row_number() over (partition by ts_code order by end_date desc, seq desc) as k from fund) select ts_code, count(*) as n, quantile_cont(eps, 0.5) as eps, quantile_cont(cast(roe as double), 0.5) as roe from x where k <= 8 group by 1")
def a37(T):
    w = Window.partitionBy("ts_code").orderBy(F.desc("end_date"), F.desc("seq"))
    return T("fund").withColumn("k", F.row_number().over(w)).where("k <= 8").groupBy("ts_code").agg(F.count("*").alias("n"), F.percentile("eps", 0.5).alias("eps"), F.percentile(F.col("roe").cast("double"), 0.5).alias("roe"))


@query("a38_consistency", "select ts_code, count(distinct year(end_date)) as years, max(year(end_date)) - min(year(end_date)) + 1 as span, count(distinct year(end_date)) * 1e0 / (max(year(end_date)) - min(year(end_date)) + 1) as consistency from fund group by 1")
def a38(T):
    y = F.year("end_date")
    d = T("fund").groupBy("ts_code").agg(F.countDistinct(y).alias("years"), (F.max(y) - F.min(y) + 1).alias("span"))
    return d.withColumn("consistency", safe_div(F.col("years").cast("double"), F.col("span")))


@query("a39_membership_counts", "select ts_code, least(count(distinct snapshot_date), 20) as snapshots, sum(in_index) as member, sum(in_index) >= 5 as hot from idxw group by 1")
def a39(T):
    return T("idxw").groupBy("ts_code").agg(F.least(F.countDistinct("snapshot_date"), F.lit(20)).alias("snapshots"), F.sum("in_index").alias("member"), (F.sum("in_index") >= 5).alias("hot"))


@query("a40_holder_summary", f"with h as (select ts_code, buyer, year(trade_date) as y, sum({sql_scaled('vol', 0)}) as v, min(trade_date) as d from block group by 1, 2, 3), t as (select *, sum(v) over (partition by ts_code, y) as total, row_number() over (partition by ts_code, y order by v desc, buyer) as k from h) select ts_code, y, {sql_q('sum(cast(v as double) * v) / nullif(max(cast(total as double) * total), 0)', 3)} as hhi, max(v) as most, count(case when contains(buyer, 'inst') then 1 end) as n_inst, min(d) as first_day from t where k <= 10 group by 1, 2")
def a40(T):
    """The ten largest holders of a year: concentration, largest, institutions."""
    h = T("block").groupBy("ts_code", "buyer", F.year("trade_date").alias("y")).agg(F.sum(scaled("vol", 0)).alias("v"), F.min("trade_date").alias("d"))
    w = Window.partitionBy("ts_code", "y")
    t = h.withColumns({"total": F.sum("v").over(w), "k": F.row_number().over(w.orderBy(F.desc("v"), "buyer"))}).where("k <= 10")
    hhi = safe_div(F.sum(F.col("v").cast("double") * F.col("v")), F.max(F.col("total").cast("double") * F.col("total")))
    return t.groupBy("ts_code", "y").agg(quantise(hhi, 3).alias("hhi"), F.max("v").alias("most"), F.count(F.when(F.col("buyer").contains("inst"), 1)).alias("n_inst"), F.min("d").alias("first_day"))


@query("a43_latest_membership", "select ts_code, max_by(in_index, snapshot_date) as weight, max(snapshot_date) as day from idxw group by 1")
def a43(T):
    return T("idxw").groupBy("ts_code").agg(F.max_by("in_index", "snapshot_date").alias("weight"), F.max("snapshot_date").alias("day"))


@query("a47_equal_weight", f"with x as (select year(trade_date) as y, ts_code, {sql_q('max_by(close, trade_date) / nullif(min_by(close, trade_date), 0) - 1')} as r from bars group by 1, 2) select y, count(*) as n, avg({sql_scaled('r')}) as mean_return, quantile_cont(r, 0.5) as median_return from x where r is not null group by 1")
def a47(T):
    r = quantise(safe_div(F.max_by("close", "trade_date"), F.min_by("close", "trade_date")) - 1)
    x = T("bars").groupBy(F.year("trade_date").alias("y"), "ts_code").agg(r.alias("r")).where("r is not null")
    return x.groupBy("y").agg(F.count("*").alias("n"), F.avg(scaled("r")).alias("mean_return"), F.percentile("r", 0.5).alias("median_return"))


@query("a48_bucket_hits", "select ts_code, reason, count(*) as n, sum(case when ret >= 2e-2 then 1 else 0 end) as n_hit, max(ret) as best, min(ret) as worst from trades where exit_date >= date '1993-01-01' group by 1, 2")
def a48(T):
    return T("trades").where(F.col("exit_date") >= date(1993, 1, 1)).groupBy("ts_code", "reason").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ret") >= 0.02, 1).otherwise(0)).alias("n_hit"), F.max("ret").alias("best"), F.min("ret").alias("worst"))


@query("a49_model_votes", "with x as (select ts_code, max_by(pred_a, trade_date) as a, max_by(pred_b, trade_date) as b, max_by(pred_c, trade_date) as c, max(trade_date) as day from preds where pred_a is not null and pred_b is not null and pred_c is not null group by 1) select ts_code, day, 3 as n_models, (a > 0)::int + (b > 0)::int + (c > 0)::int as n_up, " + sql_q("(a + b + c) / 3", 3) + " as mean_pred from x")
def a49(T):
    models = ("pred_a", "pred_b", "pred_c")
    x = T("preds").dropna(subset=list(models)).groupBy("ts_code").agg(F.max_by(F.struct(*models), "trade_date").alias("p"), F.max("trade_date").alias("day"))
    up = sum(((F.col(f"p.{m}") > 0).cast("int") for m in models[1:]), (F.col("p.pred_a") > 0).cast("int"))
    return x.select("ts_code", "day", F.lit(3).alias("n_models"), up.alias("n_up"), quantise((F.col("p.pred_a") + F.col("p.pred_b") + F.col("p.pred_c")) / 3, 3).alias("mean_pred"))


@query("a50_importance_stability", f"{_LONG}, i as (select fold, h, abs({sql_q('corr(pred, target)', 3)}) as imp from x where pred is not null and target is not null group by 1, 2), k as (select *, row_number() over (partition by fold order by imp desc, h) as r from i) select h, count(*) as folds, avg({sql_scaled('imp', 3)}) as mean_imp, avg(case when r = 1 then 1 else 0 end) as top_share from k group by 1")
def a50(T):
    i = _long(T).where("pred is not null and target is not null").groupBy("fold", "h").agg(F.abs(quantise(correlation("pred", "target"), 3)).alias("imp"))
    k = i.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("imp"), "h")))
    return k.groupBy("h").agg(F.count("*").alias("folds"), F.avg(scaled("imp", 3)).alias("mean_imp"), F.avg(F.when(F.col("r") == 1, 1).otherwise(0)).alias("top_share"))


@query("a58_distinct_counts", "select count(distinct ts_code) as stocks, count(distinct trade_date) as dates, count(distinct fold) as folds, min(trade_date) as first_day, max(trade_date) as last_day from preds")
def a58(T):
    return T("preds").agg(F.countDistinct("ts_code").alias("stocks"), F.countDistinct("trade_date").alias("dates"), F.countDistinct("fold").alias("folds"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


@query("w25_regime", f"select ts_code, trade_date, v > q as wild from (select ts_code, trade_date, {sql_scaled('abs(pct_chg)')} as v, quantile_disc({sql_scaled('abs(pct_chg)')}, 0.8) {over(40)} as q, count(*) {over(40)} as n from bars) x where n = 40")
def w25(T):
    """Bars that move more than four fifths of the last forty: the sorted window's 32nd value."""
    w = S.last(40)
    v = scaled(F.abs("pct_chg"))
    d = T("bars").select(*KEYS, v.alias("v"), F.array_sort(F.collect_list(v).over(w)).alias("s")).where(F.size("s") == 40)
    return d.select(*KEYS, (F.col("v") > F.element_at("s", 32)).alias("wild"))


@query("w37_trend_score", f"""with x as (select ts_code, trade_date, {sql_scaled('close', 2)} as c from bars), y as (select *, avg(c) {over(5)} as m5, avg(c) {over(20)} as m20, avg(c) {over(60)} as m60, count(*) {over(60)} as n from x)
select ts_code, trade_date, (c > m5)::int + (c > m20)::int + (m5 > m20)::int + (m20 > m60)::int as score, case when c > m20 and m20 > m60 then 'up' when c < m20 and m20 < m60 then 'down' else 'flat' end as state from y where n = 60""")
def w37(T):
    c = scaled("close", 2)
    d = T("bars").select(*KEYS, c.alias("c"), *[S.rolling(F.avg, c, k).alias(f"m{k}") for k in (5, 20, 60)]).where("m60 is not null")
    score = F.expr("cast(c > m5 as int) + cast(c > m20 as int) + cast(m5 > m20 as int) + cast(m20 > m60 as int)")
    return d.select(*KEYS, score.alias("score"), F.expr("case when c > m20 and m20 > m60 then 'up' when c < m20 and m20 < m60 then 'down' else 'flat' end").alias("state"))


@query("w40_composite", f"""with x as (select ts_code, trade_date, {sql_scaled('close', 2)} as c, {sql_scaled('close', 2)} - lag({sql_scaled('close', 2)}, 20) {W} as mom, {sql_scaled('pct_chg')} as chg, row_number() over (partition by ts_code order by trade_date desc) as k from bars)
select ts_code, trade_date, 40 * coalesce(mom, 0) + 30 * chg + 20 * c + 10 * k as composite from x where k = 1 order by composite desc, ts_code limit 5""")
def w40(T):
    c, w = scaled("close", 2), Window.partitionBy("ts_code").orderBy("trade_date")
    x = T("bars").select(*KEYS, c.alias("c"), (c - F.lag(c, 20).over(w)).alias("mom"), scaled("pct_chg").alias("chg"))
    last = x.groupBy("ts_code").agg(F.max_by(F.struct(*x.columns), "trade_date").alias("x")).select("x.*")
    return last.select(*KEYS, (40 * F.coalesce("mom", F.lit(0)) + 30 * F.col("chg") + 20 * F.col("c") + 10).alias("composite")).orderBy(F.desc("composite"), "ts_code").limit(5)


@query("w47_limit_ratios", f"select b.ts_code, b.trade_date, {sql_q('up_limit / nullif(close, 0) - 1')} as up_to_close, {sql_q('greatest(least(coalesce(up_limit / nullif(pre_close, 0) - 1, 0.1), 0.3), 0)')} as up_ratio, {sql_q('greatest(least(coalesce(down_limit / nullif(pre_close, 0) - 1, -0.1), 0), -0.3)')} as down_ratio from bars b left join limits l on l.ts_code = b.ts_code and l.trade_date = b.trade_date")
def w47(T):
    """Room to the limits; where they are unknown, a tenth either way."""
    j = T("bars").join(T("limits"), KEYS, "left")
    ratio = lambda c, miss, low, high: quantise(clip(F.coalesce(safe_div(F.col(c), F.col("pre_close")) - 1, F.lit(miss)), low, high))
    return j.select(*KEYS, quantise(safe_div(F.col("up_limit"), F.col("close")) - 1).alias("up_to_close"), ratio("up_limit", 0.1, 0.0, 0.3).alias("up_ratio"), ratio("down_limit", -0.1, -0.3, 0.0).alias("down_ratio"))


@query("w51_cross_asset", f"with x as (select ts_code, trade_date, {sql_scaled('pct_chg')} as r from bars) select x.trade_date, avg(r) as mean_r, max(r) - min(r) as dispersion, avg(r) - max({sql_scaled('m.csi300_pct_chg')}) as spread from x join mkt m on m.trade_date = x.trade_date group by 1")
def w51(T):
    r = scaled("pct_chg")
    x = T("bars").groupBy("trade_date").agg(F.avg(r).alias("mean_r"), (F.max(r) - F.min(r)).alias("dispersion")).join(T("mkt"), "trade_date")
    return x.select("trade_date", "mean_r", "dispersion", (F.col("mean_r") - scaled("csi300_pct_chg")).alias("spread"))


@query("w52_interactions", f"with x as (select ts_code, trade_date, {sql_scaled('pct_chg', 2)} as r from bars) select ts_code, trade_date, lag(r, 1) {W} as r_1, lag(r, 2) {W} as r_2, r * lag(r, 1) {W} as r_x_r_1, r * lag(r, 2) {W} as r_x_r_2, sum(r) {over(5)} as momentum from x")
def w52(T):
    r, w = scaled("pct_chg", 2), S.series()
    lags = {f"r_{k}": F.lag(r, k).over(w) for k in (1, 2)}
    return T("bars").select(*KEYS, *[v.alias(k) for k, v in lags.items()], *[(r * v).alias(f"r_x_{k}") for k, v in lags.items()], F.sum(r).over(S.last(5)).alias("momentum"))


@query("w53_trajectory", f"select ts_code, trade_date, {sql_q('(pred_a + pred_b + pred_c) / 3', 3)} as mean_pred, greatest(pred_a, pred_b, pred_c) as max_pred, {sql_q('(pred_c - pred_a) / 2', 3)} as slope from preds where pred_a is not null and pred_b is not null and pred_c is not null")
def w53(T):
    """Mean, maximum and least-squares slope over the horizons 1 to 3: the dot product with (-1, 0, 1) / 2."""
    d = T("preds").dropna(subset=["pred_a", "pred_b", "pred_c"])
    return d.select(*KEYS, quantise((F.col("pred_a") + F.col("pred_b") + F.col("pred_c")) / 3, 3).alias("mean_pred"), F.greatest("pred_a", "pred_b", "pred_c").alias("max_pred"), quantise((F.col("pred_c") - F.col("pred_a")) / 2, 3).alias("slope"))


@query("w56_valuation", f"""with j as (select b.ts_code, b.trade_date, v.pe_ttm, v.circ_mv from bars b left join basic v on v.ts_code = b.ts_code and v.trade_date = b.trade_date),
f as (select ts_code, trade_date, coalesce(last_value(pe_ttm ignore nulls) over (partition by ts_code order by trade_date rows between unbounded preceding and current row), first_value(pe_ttm ignore nulls) over (partition by ts_code order by trade_date rows between current row and unbounded following), 0) as pe, circ_mv from j)
select ts_code, trade_date, greatest(least(pe, 1000), -1000) as pe, {sql_q('ln(circ_mv + 1) / 20')} as log_cap from f""")
def w56(T):
    """Valuations carried forward, then back, then 0, within a thousand; the log of the capital, scaled."""
    w = S.series()
    j = T("bars").select(*KEYS).join(T("basic").select(*KEYS, "pe_ttm", "circ_mv"), KEYS, "left")
    # What has none before it takes the first of its series, which is found once; a frame from each row to the last would be read anew for every row.
    pe = F.coalesce(F.last("pe_ttm", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("pe_ttm", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    return j.select(*KEYS, clip(pe, -1000.0, 1000.0).alias("pe"), quantise(F.ln(F.col("circ_mv") + 1) / 20).alias("log_cap"))


@query("w58_net_flow", f"select ts_code, trade_date, {sql_scaled('buy_sm_amount', 2)} - {sql_scaled('sell_sm_amount', 2)} as net_sm, {sql_scaled('buy_lg_amount', 2)} - {sql_scaled('sell_lg_amount', 2)} as net_lg from flow")
def w58(T):
    return T("flow").select(*KEYS, *[(scaled(f"buy_{t}_amount", 2) - scaled(f"sell_{t}_amount", 2)).alias(f"net_{t}") for t in ("sm", "lg")])


@query("k06_stratified", "with x as (select p.ts_code, p.trade_date, s.sector, row_number() over (partition by s.sector order by md5(p.ts_code || cast(p.trade_date as varchar)), p.ts_code, p.trade_date) as k, count(*) over (partition by s.sector) as n from preds p join sector s on s.ts_code = p.ts_code) select ts_code, trade_date, sector from x where k <= greatest(1, n // 50)")
def k06(T):
    """A fiftieth of each sector, one row at least, first in the order of a hash."""
    j = kept(T("preds").select(*KEYS).join(T("sector").select("ts_code", "sector"), "ts_code"))
    return O.first_share(j, "sector", F.concat("ts_code", F.col("trade_date").cast("string")), KEYS, F.expr("greatest(1, n div 50)")).select(*KEYS, "sector")


@query("k07_uniform_sample", "select ts_code, trade_date, pred_a from preds order by md5(ts_code || cast(trade_date as varchar)), ts_code, trade_date limit 50")
def k07(T):
    return T("preds").select(*KEYS, "pred_a").orderBy(F.md5(F.concat("ts_code", F.col("trade_date").cast("string"))), *KEYS).limit(50)


@query("k08_timelines", "select ts_code, count(*) as n, string_agg(cast(entry_date as varchar) || ':' || reason, ' ' order by entry_date, trade_id) as events from trades group by 1")
def k08(T):
    events = F.array_sort(F.collect_list(F.struct("entry_date", "trade_id", "reason")))
    line = F.array_join(F.transform(events, lambda e: F.concat(e["entry_date"].cast("string"), F.lit(":"), e["reason"])), " ")
    return T("trades").groupBy("ts_code").agg(F.count("*").alias("n"), line.alias("events"))


@query("d05_ragged_union", "select ts_code, trade_date, amount, buyer, null::double as pnl from block union all select ts_code, entry_date as trade_date, null as amount, null as buyer, pnl from trades")
def d05(T):
    block, trades = T("block").select(*KEYS, "amount", "buyer"), T("trades").select("ts_code", F.col("entry_date").alias("trade_date"), "pnl")
    return block.unionByName(trades, allowMissingColumns=True)


_H = [(0, 1, 1), (0, 5, 1), (0, 10, 1), (1, 1, 1)]


@query("f03_holidays", "with d as (select distinct trade_date as d from bars), x as (select d, greatest(" + ", ".join(f"case when make_date(year(d) + {y}, {m}, {k}) <= d then make_date(year(d) + {y}, {m}, {k}) end" for y, m, k in _H) + ") as past, least(" + ", ".join(f"case when make_date(year(d) + {y}, {m}, {k}) >= d then make_date(year(d) + {y}, {m}, {k}) end" for y, m, k in _H) + ") as next from d) select d as trade_date, least(next - d, 30) as to_next, least(d - past, 30) as since_last, next - d between 1 and 7 as pre, d - past between 1 and 5 as post from x")
def f03(T):
    """Days to the next and since the last holiday, 30 at most, and flags of the week before and the days after."""
    d = F.col("trade_date")
    days = F.array(*[F.make_date(F.year(d) + y, F.lit(m), F.lit(k)) for y, m, k in _H])
    to, since = F.datediff(F.array_min(F.filter(days, lambda x: x >= d)), d), F.datediff(d, F.array_max(F.filter(days, lambda x: x <= d)))
    out = T("bars").select("trade_date").distinct()
    return out.select("trade_date", F.least(to, F.lit(30)).alias("to_next"), F.least(since, F.lit(30)).alias("since_last"), to.between(1, 7).alias("pre"), since.between(1, 5).alias("post"))


@query("f04_age_bucket", "with x as (select ts_code, (date '1999-01-01' - min(trade_date)) / 365.25e0 as age from bars group by 1) select case when age < 1 then 'new' when age < 3 then 'young' when age < 6 then 'grown' else 'old' end as bucket, count(*) as n from x group by 1")
def f04(T):
    age = F.datediff(F.lit(date(1999, 1, 1)), F.min("trade_date")) / 365.25
    bucket = F.expr("case when age < 1 then 'new' when age < 3 then 'young' when age < 6 then 'grown' else 'old' end")
    return T("bars").groupBy("ts_code").agg(age.alias("age")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("f08_short_names", r"with x as (select s_suppkey, trim(regexp_replace(regexp_replace(s_name, '\([^)]*\)', '', 'g'), '^Supplier#0*', '')) as short from supplier) select s_suppkey, short from x where short in (select short from x group by 1 having count(*) = 1)")
def f08(T):
    """Names without brackets and prefix; those that several share are dropped."""
    x = T("supplier").select("s_suppkey", F.trim(F.regexp_replace(F.regexp_replace("s_name", r"\([^)]*\)", ""), "^Supplier#0*", "")).alias("short"))
    once = x.groupBy("short").agg(F.count("*").alias("n")).where("n = 1").select("short")
    return x.join(once, "short").select("s_suppkey", "short")


@query("f18_math", f"select ts_code, trade_date, {sql_q('ln(close)')} as ln_close, {sql_q('ln(1 + cast(vol as double))')} as log1p_vol, {sql_q('exp(pct_chg / 100)')} as growth, {sql_q('sqrt(high)')} as root, cast(sign(pct_chg) as int) as direction, {sql_q('pow(low, 2)', 2)} as square from bars where close > 0")
def f18(T):
    d = T("bars").where("close > 0")
    return d.select(*KEYS, quantise(F.ln("close")).alias("ln_close"), quantise(F.log1p(F.col("vol").cast("double"))).alias("log1p_vol"), quantise(F.exp(F.col("pct_chg") / 100)).alias("growth"), quantise(F.sqrt("high")).alias("root"), F.signum("pct_chg").cast("int").alias("direction"), quantise(F.pow("low", F.lit(2)), 2).alias("square"))


@query("l04_vol_target", f"select ts_code, trade_date, {sql_q('greatest(least(r / greatest(s, 5e-3), 5), -5)', 3)} as target, cast(sign(r) as int) as up from (select ts_code, trade_date, ln(lead(close) {W} / close) as r, case when count(*) {over(20)} = 20 then stddev_pop(pct_chg / 100) {over(20)} end as s from bars where close > 0) x where r is not null and s is not null")
def l04(T):
    r = F.ln(safe_div(F.lead("close").over(S.series()), F.col("close")))
    d = T("bars").where("close > 0").select(*KEYS, r.alias("r"), S.rolling(F.stddev_pop, F.col("pct_chg") / 100, 20).alias("s")).dropna(subset=["r", "s"])
    return d.select(*KEYS, quantise(clip(F.col("r") / F.greatest("s", F.lit(0.005)), -5.0, 5.0), 3).alias("target"), F.signum("r").cast("int").alias("up"))


@query("l05_continuation", f"with x as (select b.ts_code, b.trade_date, abs(close - up_limit) <= 5e-3 as at_up from bars b join limits l on l.ts_code = b.ts_code and l.trade_date = b.trade_date) select * from (select ts_code, trade_date, at_up, lead(at_up) {W} as continues from x) y where at_up and continues is not null")
def l05(T):
    up = F.abs(F.col("close") - F.col("up_limit")) <= 0.005
    d = T("bars").join(T("limits"), KEYS).select(*KEYS, up.alias("at_up"))
    return d.withColumn("continues", F.lead("at_up").over(S.series())).where("at_up and continues is not null")


@query("l06_delist_label", "select i.ts_code, i.snapshot_date, max(case when s.start_date > i.snapshot_date and s.start_date <= i.snapshot_date + 365 then 1 else 0 end) as label from idxw i left join st s on s.ts_code = i.ts_code group by 1, 2")
def l06(T):
    soon = (F.col("start_date") > F.col("snapshot_date")) & (F.col("start_date") <= F.date_add("snapshot_date", 365))
    j = T("idxw").select("ts_code", "snapshot_date").join(T("st").select("ts_code", "start_date"), "ts_code", "left")
    return j.groupBy("ts_code", "snapshot_date").agg(F.max(F.when(soon, 1).otherwise(0)).alias("label"))


@query("l14_winsor_global", f"with e as (select quantile_cont(pct_chg, 0.01) as lo, quantile_cont(pct_chg, 0.99) as hi from bars), c as (select ts_code, trade_date, greatest(least(pct_chg, hi), lo) as x from bars, e where pct_chg is not null), s as (select avg(x) as m, stddev_samp(x) as d from c) select ts_code, trade_date, {sql_q('(x - m) / d', 3)} as z from c, s")
def l14(T):
    """Fitted on all rows, then applied: the bounds and the moments are one row each."""
    bars = T("bars").where("pct_chg is not null").select(*KEYS, "pct_chg")
    edges = O.exact_quantiles(bars, "pct_chg", [0.01, 0.99], []).withColumnRenamed("quantiles", "e")
    c = bars.crossJoin(F.broadcast(edges)).select(*KEYS, F.greatest(F.least("pct_chg", F.col("e")[1]), F.col("e")[0]).alias("x"))
    return c.crossJoin(F.broadcast(c.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("d")))).select(*KEYS, quantise(safe_div(F.col("x") - F.col("m"), F.col("d")), 3).alias("z"))


@query("l15_two_tier", f"with e as (select quantile_cont(pct_chg, 0.05) as lo, quantile_cont(pct_chg, 0.95) as hi, quantile_cont(pct_chg, 0.5) as mid from bars where trade_date < date '1997-01-01') select ts_code, trade_date, {sql_q('(greatest(least(pct_chg, hi), lo) - mid) / nullif((hi - lo) / 3.92, 0)', 3)} as z from bars, e where pct_chg is not null")
def l15(T):
    """Clip and scale by the training rows' central nine tenths, as if normal."""
    bars = T("bars").where("pct_chg is not null").select(*KEYS, "pct_chg")
    e = O.exact_quantiles(bars.where(F.col("trade_date") < TRAIN_TO), "pct_chg", [0.05, 0.95, 0.5], []).withColumnRenamed("quantiles", "e")
    low, high, mid = (F.col("e")[i] for i in range(3))
    return bars.crossJoin(F.broadcast(e)).select(*KEYS, quantise(safe_div(F.greatest(F.least("pct_chg", high), low) - mid, (high - low) / 3.92), 3).alias("z"))


@query("l16_train_scaler", f"with s as (select avg(pct_chg) as m, stddev_pop(pct_chg) as d from bars where trade_date < date '1997-01-01') select ts_code, trade_date, {sql_q('(pct_chg - m) / nullif(d, 0)', 3)} as z from bars, s where pct_chg is not null")
def l16(T):
    bars = T("bars").where("pct_chg is not null").select(*KEYS, "pct_chg")
    s = bars.where(F.col("trade_date") < TRAIN_TO).agg(F.avg("pct_chg").alias("m"), F.stddev_pop("pct_chg").alias("d"))
    return bars.crossJoin(F.broadcast(s)).select(*KEYS, quantise(safe_div(F.col("pct_chg") - F.col("m"), F.col("d")), 3).alias("z"))


@query("l21_latest_rows", "select ts_code, max(trade_date) as trade_date, max_by(greatest(least(pct_chg, 10), -10), trade_date) as pct_chg, max_by(close, trade_date) as close from bars group by 1")
def l21(T):
    d = T("bars").groupBy("ts_code").agg(F.max("trade_date").alias("trade_date"), F.max_by(F.struct("pct_chg", "close"), "trade_date").alias("x"))
    return d.select(*KEYS, clip(F.col("x.pct_chg"), -10.0, 10.0).alias("pct_chg"), "x.close")


@query("l22_split_by_count", "with x as (select ts_code, trade_date, row_number() over (order by trade_date, ts_code) as k, count(*) over () as n from preds) select case when k <= floor(n * 0.7e0) then 'train' when k <= floor(n * 0.85e0) then 'val' else 'test' end as split, count(*) as n, min(trade_date) as first_day, max(trade_date) as last_day from x group by 1")
def l22(T):
    """Places in time order from counts of each date, so that no task sorts all rows; a date can straddle a cut."""
    p = T("preds").select(*KEYS)
    days = p.groupBy("trade_date").agg(F.count("*").alias("rows"))
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    before = days.withColumns({"before": F.coalesce(F.sum("rows").over(w), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy())})
    k = F.col("before") + F.row_number().over(Window.partitionBy("trade_date").orderBy("ts_code"))
    split = F.when(F.col("k") <= F.floor(F.col("n") * 0.7), "train").when(F.col("k") <= F.floor(F.col("n") * 0.85), "val").otherwise("test")
    return p.join(before, "trade_date").withColumn("k", k).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


@query("s09_epoch_bars", "select user_id, make_timestamp(epoch_us(ts) // 1000 * 1000) as at, count(*) as n, max(event_id) as last_id from events group by 1, 2")
def s09(T):
    """Rows stamped in epoch milliseconds as typed rows, one for each key and time: the last loaded."""
    raw = T("events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"))
    return raw.groupBy("user_id", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("s10_covered_columns", "with j as (select b.ts_code, b.trade_date, v.pe_ttm, v.pb, k.amount from bars b left join basic v on v.ts_code = b.ts_code and v.trade_date = b.trade_date left join (select ts_code, trade_date, max(amount) as amount from block group by 1, 2) k on k.ts_code = b.ts_code and k.trade_date = b.trade_date) select count(*) as n, count(pe_ttm) >= 0.5 * count(*) as has_pe, count(pb) >= 0.5 * count(*) as has_pb, count(amount) >= 0.5 * count(*) as has_block, count(case when (pe_ttm is not null or (select count(pe_ttm) < 0.5 * count(*) from j)) and (pb is not null or (select count(pb) < 0.5 * count(*) from j)) and (amount is not null or (select count(amount) < 0.5 * count(*) from j)) then 1 end) as complete from j")
def s10(T):
    """Columns filled in at least half of the rows, and the rows that are complete in those: one pass over counts of null patterns."""
    block = T("block").groupBy(*KEYS).agg(F.max("amount").alias("amount"))
    j = T("bars").select(*KEYS).join(T("basic").select(*KEYS, "pe_ttm", "pb"), KEYS, "left").join(block, KEYS, "left")
    columns = {"pe_ttm": "has_pe", "pb": "has_pb", "amount": "has_block"}
    patterns = j.groupBy(*[F.col(c).isNotNull().alias(c) for c in columns]).agg(F.count("*").alias("rows"))
    every = Window.partitionBy()
    n = F.sum("rows").over(every)
    kept = patterns.withColumns({"n": n} | {to: F.sum(F.when(F.col(c), F.col("rows")).otherwise(0)).over(every) >= 0.5 * n for c, to in columns.items()})
    whole = F.lit(True)
    for c, to in columns.items():
        whole = whole & (F.col(c) | ~F.col(to))
    return kept.groupBy("n", *columns.values()).agg(F.sum(F.when(whole, F.col("rows")).otherwise(0)).alias("complete"))
