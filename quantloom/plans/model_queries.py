"""Queries on models over time: trailing accuracy, blends, stacks, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import quantise
from ..operators import ensembles as E
from ..operators import patterns as P
from ..operators import regimes as R
from ..operators import residuals as D
from ..operators import timeseries as S
from ..streaming.jobs import kept
from .base import query, sql_q

KEYS = ["ts_code", "trade_date"]
#: Horizon of each model's target, in rows: a and b forecast the next bar, c the fifth.
MODELS = {"ic_a": ("pred_a", "target", 1), "ic_b": ("pred_b", "target", 1), "ic_c": ("pred_c", "target5", 5)}
LOOKBACK, LEAST = 60, 20

GAPPY = """g as (select ts_code, trade_date, case when day(trade_date) % 9 = 0 then null else pred_a end as pred_a, case when day(trade_date) % 11 = 0 then null else pred_b end as pred_b, pred_c,
  target, lead(target, 4) over (partition by ts_code order by trade_date) as target5 from preds)"""


def _ic(name: str) -> str:
    x, y, h = MODELS[name]
    w = f"over (partition by ts_code, ({x} is not null and {y} is not null) order by trade_date rows between {LOOKBACK - 1} preceding and current row)"
    varies = " and ".join(f"min({c}) {w} < max({c}) {w}" for c in (x, y))
    return f"""{name}_m as (select ts_code, trade_date, case when {x} is not null and {y} is not null then 1 end as whole,
  case when count(*) {w} >= {LEAST} and {varies} then (avg({x} * {y}) {w} - avg({x}) {w} * avg({y}) {w}) / (stddev_pop({x}) {w} * stddev_pop({y}) {w}) end as ic from g),
{name}_n as (select ts_code, trade_date, max(case when whole = 1 then trade_date end) over (partition by ts_code order by trade_date rows between unbounded preceding and {h + 1} preceding) as at from {name}_m),
{name}_k as (select n.ts_code, n.trade_date, m.ic as {name} from {name}_n n left join {name}_m m on m.ts_code = n.ts_code and m.trade_date = n.at)"""


IC = f"{GAPPY}, {', '.join(map(_ic, MODELS))}, ic as (select g.*, ic_a, ic_b, ic_c from g {' '.join(f'join {n}_k on {n}_k.ts_code = g.ts_code and {n}_k.trade_date = g.trade_date' for n in MODELS)})"


def gappy(T):
    """Predictions with holes, and a target five rows on for the third model."""
    p = T("preds").select(*KEYS, "pred_a", "pred_b", "pred_c", "target")
    hole = lambda c, n: F.when(F.dayofmonth("trade_date") % n == 0, F.lit(None)).otherwise(F.col(c))
    return p.withColumns({"pred_a": hole("pred_a", 9), "pred_b": hole("pred_b", 11), "target5": F.lead("target", 4).over(S.series())})


@query("w29_trailing_ic", f"with {IC} select ts_code, trade_date, {', '.join(f'{sql_q(n)} as {n}' for n in MODELS)}, {sql_q('case when abs(ic_a) >= 4e-2 and ic_a < 0 then 0 - pred_a else pred_a end')} as corrected from ic")
def w29(T):
    d = E.trailing_ic(gappy(T), MODELS, LOOKBACK, LEAST)
    return d.select(*KEYS, *[quantise(F.col(n)).alias(n) for n in MODELS], quantise(E.sign_corrected(F.col("pred_a"), F.col("ic_a"))).alias("corrected"))


def _blend_sql(weights: list[str]) -> str:
    total = " + ".join(f"case when {p} is null then 0 else {w} end" for p, w in zip(("pred_a", "pred_b", "pred_c"), weights, strict=True))
    value = " + ".join(f"case when {p} is null then 0 else ({w}) * {p} end" for p, w in zip(("pred_a", "pred_b", "pred_c"), weights, strict=True))
    return sql_q(f"({value}) / nullif({total}, 0)", 6)


_NONE = "coalesce(ic_a, ic_b, ic_c) is null"
_RANK = "select *, " + ", ".join(f"case when ic_{m} is not null and pred_{m} is not null then abs(ic_{m}) else -1 end as s_{m}" for m in "abc") + " from ic"


@query("w30_blends", f"""with {IC}, r as ({_RANK}), t as (select *, greatest(s_a, s_b, s_c) as top from r)
select ts_code, trade_date, {_blend_sql(['1e0'] * 3)} as mean, {_blend_sql([f'case when {_NONE} then 1e0 else coalesce(abs(ic_{m}), 0) end' for m in 'abc'])} as ic_weighted,
  {_blend_sql([f'case when {_NONE} or abs(ic_{m}) >= 1e-1 then 1e0 else 0 end' for m in 'abc'])} as ic_filter,
  {_blend_sql(["case when top < 0 or s_a = top then 1e0 else 0 end", "case when top < 0 or (s_b = top and s_a < top) then 1e0 else 0 end", "case when top < 0 or (s_c = top and s_a < top and s_b < top) then 1e0 else 0 end"])} as top_1
from t""")
def w30(T):
    d = E.trailing_ic(gappy(T), MODELS, LOOKBACK, LEAST)
    p, ics = ["pred_a", "pred_b", "pred_c"], list(MODELS)
    wanted = {"mean": "mean", "ic_weighted": "ic_weighted", "ic_filter": "ic_filter", "top_1": "top_k"}
    return E.with_blends(d, p, ics, {n: (m, 1, 0.1) for n, m in wanted.items()}).select(*KEYS, *[quantise(F.col(n), 6).alias(n) for n in wanted])


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_X = ("pred_a", "pred_b", "pred_c")
_KNOWN = "over (partition by ts_code order by trade_date rows between unbounded preceding and 2 preceding)"
_OK = "pred_a is not null and pred_b is not null and pred_c is not null and target is not null"
_C = [[f"(s_{i}{j} - s_{i} * s_{j} / n)" + (" + 5e0" if i == j else "") for j in range(3)] for i in range(3)]
_M = [[f"({v})" for v in row] for row in _C]
_Y = [f"(s_{i}y - s_{i} * s_y / n)" for i in range(3)]


@query("l18_ridge_stack", f"""with {GAPPY}, sums as (select *, row_number() over (partition by ts_code order by trade_date) as row, count(case when {_OK} then 1 end) {_KNOWN} as n,
  {', '.join(f'sum(case when {_OK} then {_X[i]} * {_X[j]} end) {_KNOWN} as s_{i}{j}' for i in range(3) for j in range(3))},
  {', '.join(f'sum(case when {_OK} then {_X[i]} * target end) {_KNOWN} as s_{i}y, sum(case when {_OK} then {_X[i]} end) {_KNOWN} as s_{i}' for i in range(3))}, sum(case when {_OK} then target end) {_KNOWN} as s_y from g),
f as (select *, min(case when n >= 80 then row end) over (partition by ts_code) as first from sums),
d as (select ts_code, row, {_det(_M)} as det, {', '.join(f'{_det([[_Y[r] if k == c else _M[r][k] for k in range(3)] for r in range(3)])} as d{c}' for c in range(3))}, s_0 / n as m0, s_1 / n as m1, s_2 / n as m2, s_y / n as my
  from f where row >= first and (row - first) % 15 = 0),
c as (select ts_code, row, d0 / det as c0, d1 / det as c1, d2 / det as c2, my - (d0 * m0 + d1 * m1 + d2 * m2) / det as b from d)
select f.ts_code, f.trade_date, {sql_q('c0 * pred_a + c1 * pred_b + c2 * pred_c + b', 3)} as stack, {sql_q('b', 3)} as intercept
from f left join c on c.ts_code = f.ts_code and c.row = f.first + ((f.row - f.first) // 15) * 15 and f.row >= f.first""")
def l18(T):
    d = E.ridge_stack(gappy(T), ["pred_a", "pred_b", "pred_c"], "target")
    return d.select(*KEYS, quantise(F.col("stack"), 3).alias("stack"), quantise(F.col("coefs")[3], 3).alias("intercept"))


def _regimes(bars):
    averaged = bars.select(*KEYS, "close").withColumn("mean", S.rolling(F.avg, "close", 60))
    return R.merge_short(R.raw_blocks(averaged, F.col("close") > F.col("mean"), "ts_code"), "ts_code", 20)


@query("l12_regime_blocks")
def l12(T):
    """Blocks of each instrument above and below its 60-bar mean, none shorter than 20 bars, with their splits."""
    return R.assign(_regimes(T("bars")), "ts_code", 100, 90)


@query("l12_regime_split")
def l12_split(T):
    """Every bar's split by its block, purged before each change."""
    bars = kept(T("bars").select(*KEYS, "close"))
    return R.split_days(bars, R.assign(_regimes(bars), "ts_code", 100, 90), "ts_code", 15)


def _halves(name: str, window: int, top: bool) -> str:
    """The steps of a pattern of two halves, as common table expressions."""
    half, worst, best = window // 2, "max" if top else "min", "min" if top else "max"
    out, back = ("<", "1 - 2e-2") if top else (">", "1 + 2e-2")
    seg = f"over (partition by ts_code order by trade_date rows between {window} preceding and 1 preceding)"
    return f"""{name}_s as (select ts_code, trade_date, case when count(*) {seg} = {window} then list(close) {seg} end as s from bars),
{name}_h as (select *, list_position(s[1:{half}], list_{worst}(s[1:{half}])) as l, list_position(s[{half + 1}:{window}], list_{worst}(s[{half + 1}:{window}])) + {half} as r from {name}_s),
{name}_m as (select *, list_position(s[l + 1:r], list_{best}(s[l + 1:r])) + l as m from {name}_h),
{name} as (select ts_code, trade_date, case when s is null then 0e0 when l < m and m < r and abs(s[l] - s[r]) / (s[l] + 1e-10) < 2e-2 and s[m] {out} s[l] * ({back}) and s[m] {out} s[r] * ({back})
  then case when s[{window}] {out} s[m] then 1e0 when s[{window}] {out} (s[l] + s[m]) / 2 then 5e-1 else 0e0 end else 0e0 end as {name} from {name}_m)"""


_SHAPES = {"w_short": (10, False), "w_long": (20, False), "m_short": (10, True), "m_long": (20, True)}


@query("w34_two_halves", f"with {', '.join(_halves(n, *a) for n, a in _SHAPES.items())} select w_short.ts_code, w_short.trade_date, w_short, w_long, m_short, m_long from w_short {' '.join(f'join {n} on {n}.ts_code = w_short.ts_code and {n}.trade_date = w_short.trade_date' for n in list(_SHAPES)[1:])}")
def w34(T):
    """W bottoms and M tops in the 10 and the 20 bars before."""
    d = T("bars").select(*KEYS, "close")
    for name, (window, top) in _SHAPES.items():
        d = P.with_pattern(d, "close", window, name, top)
    return d.select(*KEYS, *_SHAPES)


@query("w35_double_patterns")
def w35(T):
    """Double bottoms and tops by prominence that the bar breaks out of, in the 60 bars before."""
    return P.double_patterns(T("bars").select(*KEYS, "close"))


_FIT = """with e as (select fold, target - pred_b as e from preds where target is not null and pred_b is not null),
f as (select fold, count(*) as n, avg(e) as mu, stddev_pop(e) as s, kurtosis_pop(e) as k from e group by 1 having count(*) >= 200),
d as (select *, case when k > 0 then greatest(4 + 6 / k, 25e-1) end as df from f)
"""


@query("a56_residual_fit", _FIT + f"select fold, n, {sql_q('mu')} as mu, {sql_q('greatest(case when df is null then s else s * sqrt((df - 2) / df) end, 1e-6)')} as sigma, {sql_q('df', 2)} as df from d")
def a56(T):
    """Student t of each fold's errors."""
    found = D.fit(T("preds"), "pred_b", "target", ["fold"], 200)
    return found.select("fold", "n", quantise(F.col("mu")).alias("mu"), quantise(F.col("sigma")).alias("sigma"), quantise(F.col("df"), 2).alias("df"))


@query("a56_probabilities")
def a56_chances(T):
    """Chances of every forecast by its fold's distribution, and its 80 % interval."""
    p = T("preds").select(*KEYS, "fold", "pred_b", "target")
    return D.probabilities(p, D.fit(p, "pred_b", "target", ["fold"], 200), "pred_b", ["fold"]).drop("target")
