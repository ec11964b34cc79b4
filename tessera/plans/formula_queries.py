"""Queries of formulas and factor families over weekly bars, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.families import GTJA, WINDOWS, alpha158
from tessera.functions.formula import with_formulas
from tessera.plans.queries import AVG_RANK, BARS, QUERIES, SQL, lagged, over, rnd, roll, rounded, snapped, week

BASE = f"""{BARS}, lagging AS (SELECT *, close AS raw_close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, {lagged("close")} AS c1, {lagged("volume")} AS v1 FROM bars),
b AS (SELECT *, greatest(close - c1, 0) AS up_c, greatest(c1 - close, 0) AS down_c, abs(close - c1) AS move_c, greatest(volume - v1, 0) AS up_v, greatest(v1 - volume, 0) AS down_v, abs(volume - v1) AS move_v,
  close / nullif(c1, 0) AS ratio, ln(volume + 1) AS log_v, ln(volume / nullif(v1, 0) + 1) AS log_r, abs(close / nullif(c1, 0) - 1) * volume AS flow, CAST(close > c1 AS DOUBLE) AS rose, CAST(close < c1 AS DOUBLE) AS fell FROM lagging)"""


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


def _corr(x: str, y: str, n: int) -> str:
    return _full(x, n, f"covar_samp({x}, {y}) {over(n)} / nullif(stddev_samp({x}) {over(n)} * stddev_samp({y}) {over(n)}, 0)")


def _pctrank(x: str, n: int) -> str:
    values = f"list({x}) {over(n)}"
    return _full(x, n, f"(len(list_filter({values}, lambda y: y < {x})) + len(list_filter({values}, lambda y: y <= {x})) + 1) / {2 * n}")


def _position(x: str, best: str, n: int) -> str:
    return _full(x, n, f"list_position(list({x}) {over(n)}, {best}({x}) {over(n)})")


ONE = {
    "kmid": "(close - open) / open", "klen": "(high - low) / open", "kmid_2": "(close - open) / (high - low + 1e-12)", "kup": "(high - greatest(open, close)) / open", "kup_2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "klow": "(least(open, close) - low) / open", "klow_2": "(least(open, close) - low) / (high - low + 1e-12)", "ksft": "(close * 2 - high - low) / open", "ksft_2": "(close * 2 - high - low) / (high - low + 1e-12)",
    "open_0": "open / close", "high_0": "high / close", "low_0": "low / close",
    "vwap_0": "CASE WHEN volume > 0 AND close > 0 AND abs(amount / (volume * 100) / close - 1) > 0.2 THEN 1 ELSE amount / (volume * 100) / close END",
}


def windowed_sql(n: int) -> dict[str, str]:
    gap = lambda a, b, m: f"({roll('sum', a, n)}{' - ' + roll('sum', b, n) if b else ''}) / ({roll('sum', m, n)} + 1e-12)"
    return {
        "roc": f"{lagged('close', n)} / close", "ma": f"{roll('avg', 'close', n)} / close", "std": f"{roll('stddev_pop', 'close', n)} / close", "beta": f"{_full('close', n, f'regr_slope(close, rn) {over(n)}')} / close",
        "rsqr": f"CASE WHEN count(close) {over(n)} = {n} AND stddev_pop(close) {over(n)} > 0 THEN regr_r2(close, rn) {over(n)} END",
        "resi": f"{_full('close', n, f'close - (regr_intercept(close, rn) {over(n)} + regr_slope(close, rn) {over(n)} * rn)')} / close", "max": f"{roll('max', 'high', n)} / close", "min": f"{roll('min', 'low', n)} / close",
        "qtlu": f"{_full('close', n, f'quantile_cont(close, 0.8) {over(n)}')} / close", "qtld": f"{_full('close', n, f'quantile_cont(close, 0.2) {over(n)}')} / close", "rank": _pctrank("close", n),
        "rsv": f"(close - {roll('min', 'low', n)}) / ({roll('max', 'high', n)} - {roll('min', 'low', n)} + 1e-12)", "imax": f"{_position('high', 'max', n)} / {n}", "imin": f"{_position('low', 'min', n)} / {n}",
        "imxd": f"({_position('high', 'max', n)} - {_position('low', 'min', n)}) / {n}", "corr": _corr("close", "log_v", n), "cord": _corr("ratio", "log_r", n), "cntp": roll("avg", "rose", n), "cntn": roll("avg", "fell", n),
        "cntd": f"{roll('avg', 'rose', n)} - {roll('avg', 'fell', n)}", "sump": gap("up_c", "", "move_c"), "sumn": gap("down_c", "", "move_c"), "sumd": gap("up_c", "down_c", "move_c"),
        "vma": f"{roll('avg', 'volume', n)} / (volume + 1e-12)", "vstd": f"{roll('stddev_pop', 'volume', n)} / (volume + 1e-12)", "wvma": f"{roll('stddev_pop', 'flow', n)} / ({roll('avg', 'flow', n)} + 1e-12)",
        "vsump": gap("up_v", "", "move_v"), "vsumn": gap("down_v", "", "move_v"), "vsumd": gap("up_v", "down_v", "move_v"),
    }


def _register(name: str, doc: str, formulas: dict[str, str], sql: str, digits: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = week(spark, sf_dir).withColumn("raw_close", F.col("close"))
        made = with_formulas(panel, formulas).select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in formulas])
        return rounded(made, digits=digits)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], SQL[name] = run, snapped(sql)


_register("alpha158_bar", "The factors of one bar.", {k: v for k, v in alpha158(()).items()}, f"WITH {BARS} SELECT symbol, date, {', '.join(f'{rnd(v, 5)} AS a158_{k}' for k, v in ONE.items())} FROM bars", 5)
for _n in WINDOWS:
    _names = {k: v for k, v in alpha158((_n,)).items() if k.endswith(f"_{_n}") and k[5:] not in ONE}
    _sql = ", ".join(f"{rnd(v, 5)} AS a158_{k}_{_n}" for k, v in windowed_sql(_n).items())
    _register(f"alpha158_{_n}", f"The factors over {_n} bars.", _names, f"WITH {BASE} SELECT symbol, date, {_sql} FROM b", 5)


def _share(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {AVG_RANK.format(x=x)} / count({x}) OVER (PARTITION BY date) END"


_PLACE = "((close - low) - (high - close)) / (high - low + 1e-12) * volume"
GTJA_SQL = f"""WITH {BARS}, b AS (SELECT *, {lagged("close", 5)} AS c5, {lagged("close", 6)} AS c6, {lagged("volume")} AS v1, {lagged("high")} AS h1, {lagged("low")} AS l1, {roll("max", "high", 6)} AS m6, {roll("min", "low", 6)} AS n6,
  {_pctrank("volume", 5)} AS pv, {_pctrank("high", 5)} AS ph, {_corr("high", "volume", 10)} AS hv, {_PLACE} AS place, (close - low) - (high - close) AS p, 0.85 * open + 0.15 * high AS oh, {roll("max", "close", 10)} AS m10, {roll("sum", "volume", 15)} AS v15 FROM bars),
c AS (SELECT *, CAST(close = m6 AS DOUBLE) AS at_top, CAST(close = n6 AS DOUBLE) AS at_bottom, {_corr("pv", "ph", 5)} AS pc, oh - {lagged("oh", 4)} AS d4, {roll("sum", "place", 6)} AS s6, open - {lagged("open")} AS d1,
  ((high + low) / 2 - (h1 + l1) / 2) / (high - low + 1e-12) * (volume - v1) AS turn FROM b)
SELECT symbol, date, {", ".join(f"{rnd(v, 4)} AS {k}" for k, v in {
    "gtja_2": f"-1 * (p - {lagged('p')}) / (high - low + 1e-12)", "gtja_3": f"{roll('sum', 'at_top', 6)} + {roll('sum', 'at_bottom', 6)}", "gtja_5": f"-1 * {roll('max', 'pc', 3)}", "gtja_6": f"-1 * {_share('d4')}",
    "gtja_11": f"{_share('s6')} / ({_share('(s6 + 1e-12)')}) * 100", "gtja_14": f"close - c5 + (hv - {lagged('hv')})", "gtja_18": "close / nullif(c5, 0) * pv",
    "gtja_19": "CAST(close < c5 AS DOUBLE) + CAST(close = c5 AS DOUBLE) - CAST(close > c5 AS DOUBLE) + CAST(close <= c5 AS DOUBLE)", "gtja_20": "(close - c6) / nullif(c6, 0) * 100", "gtja_34": f"{roll('avg', 'close', 12)} / close",
    "gtja_37": f"-1 * {_share('d1')} * ({_share('v15')} / ({_share('(v15 + 1e-12)')}))", "gtja_49": f"{roll('sum', 'turn', 12)} / ({roll('sum', 'volume', 12)} + 1e-12)", "gtja_54": "-1 * (m10 - close) / ((m10 + 1e-12) * (close + 1e-12))",
}.items())} FROM c"""  # fmt: skip
_register("gtja_factors", "The factors of the set of 191 that daily bars allow.", GTJA, GTJA_SQL, 4)

USER = {
    "f_if": "if_else(close > open and volume >= ts_mean(volume, 5), close / open - 1, -0.5)",
    "f_minmax": "max(close - ts_mean(close, 10), 0) / min(high, ts_max(high, 3)) + abs(-open) * sign(close - open) * 0",
    "f_nested": "zscore(ts_delta(ts_mean(close, 5), 5)) + rank(volume) - 2 * (close > open or low < ts_min(low, 20))",
    "f_power": "power(clamp(close / open, 0.5, 1.5), 2) + sqrt(volume) - log(amount)",
}
USER_SQL = f"""WITH {BARS}, b AS (SELECT *, {roll("avg", "volume", 5)} AS v5, {roll("avg", "close", 5)} AS m5, {roll("avg", "close", 10)} AS m10, {roll("max", "high", 3)} AS h3, {roll("min", "low", 20)} AS l20 FROM bars),
c AS (SELECT *, m5 - {lagged("m5", 5)} AS d FROM b)
SELECT symbol, date, {", ".join(f"{rnd(v, 4)} AS {k}" for k, v in {
    "f_if": "CASE WHEN close > open AND volume >= v5 THEN close / open - 1 ELSE -0.5 END", "f_minmax": "CASE WHEN m10 IS NULL THEN 0 ELSE greatest(close - m10, 0) END / least(high, h3)",
    "f_nested": f"(d - avg(d) OVER (PARTITION BY date)) / nullif(stddev_samp(d) OVER (PARTITION BY date), 0) + {_share('volume')} - 2 * CAST(close > open OR low < l20 AS DOUBLE)",
    "f_power": "pow(least(greatest(close / open, 0.5), 1.5), 2) + sqrt(volume) - ln(amount)",
}.items())} FROM c"""  # fmt: skip
_register("user_formulas", "Formulas as a user writes them.", USER, USER_SQL, 4)
