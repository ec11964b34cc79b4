"""Registered queries over the panels, each beside its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import factors
from tessera.functions.windows import Cross, Series, Shared, clamp, log, safe_div, sqrt
from tessera.operators import factor_test, indicators, joins, market, screen, text
from tessera.operators.recursive import with_recursive
from tessera.plans.panel import bars, float_shares, fundamentals, membership, table, ticks
from tessera.sources import files
from tessera.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S, X = Series(), Cross()
DIGITS = 6

BARS = """
trades AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price,
  l_quantity, l_extendedprice, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
bars AS (SELECT symbol, date, first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, price) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume, sum(l_extendedprice) AS amount
  FROM trades GROUP BY ALL)"""


def over(n: int, end: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 - end} PRECEDING AND {'CURRENT ROW' if end == 0 else f'{-end} PRECEDING'})"


def roll(f: str, x: str, n: int, end: int = 0) -> str:
    return f"CASE WHEN count({x}) {over(n, end)} = {n} THEN {f}({x}) {over(n, end)} END"


def lagged(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def up(a: str, b: str) -> str:
    return f"({a} > {b} AND {lagged(a)} <= {lagged(b)})"


def down(a: str, b: str) -> str:
    return f"({a} < {b} AND {lagged(a)} >= {lagged(b)})"


ROLL1 = (
    "one AS (SELECT *, "
    + f"{lagged('close')} AS prev_close, "
    + ", ".join(f"{roll('avg', 'close', n)} AS ma{n}" for n in (5, 10, 20, 30, 60))
    + f", {roll('stddev_samp', 'close', 20)} AS std20, {roll('avg', 'volume', 5)} AS vol_ma5, {roll('avg', 'volume', 10)} AS vol_ma10, {roll('avg', 'volume', 5, -1)} AS vol_prev5, "
    + f"{roll('max', 'close', 60)} AS high_60d, {roll('min', 'close', 60)} AS low_60d, "
    + ", ".join(f"close / nullif({lagged('close', n)}, 0) - 1 AS momentum_{n}d" for n in (5, 10, 20, 30, 60))
    + f", close / nullif({lagged('close')}, 0) - 1 AS change_pct FROM bars)"
)
ROLL = f"""{BARS}, {ROLL1}, rolled AS (SELECT *, ma20 + 2 * std20 AS boll_upper, ma20 - 2 * std20 AS boll_lower, volume / nullif(vol_prev5, 0) AS vol_ratio_5d,
  close - prev_close AS change_amount, (high - low) / nullif(prev_close, 0) AS amplitude, {roll("stddev_samp", "change_pct", 20)} * sqrt(252) AS annual_vol_20d,
  CASE WHEN ma60 IS NOT NULL THEN CAST(ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60 AS INTEGER) END AS ma_bull_align,
  CASE WHEN ma60 IS NOT NULL THEN CAST(ma5 < ma10 AND ma10 < ma20 AND ma20 < ma60 AS INTEGER) END AS ma_bear_align FROM one)"""


def snapped(sql: str) -> str:
    """The SQL with round(x, digits) written as ``rnd`` writes it."""
    m = re.search(r"(?<![\w.])round\(", sql)
    if not m:
        return sql
    depth, end = 1, m.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    x, digits = sql[m.end() : end - 1].rsplit(",", 1)
    return sql[: m.start()] + rnd(snapped(x), int(digits)) + snapped(sql[end:])


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = snapped(sql)
        return f

    return register


#: Values are rounded to so many digits more before they are rounded: that takes away the last bits of a sum, which depend on
#: its order and would otherwise decide exact halves, and leaves the value where it is.
SNAP = 4


def even(x: str | Column, digits: int = DIGITS) -> Column:
    """Rounded half to even."""
    return F.rint(F.rint((F.col(x) if isinstance(x, str) else x) * float(10 ** (digits + SNAP))) / float(10**SNAP)) / float(10**digits)


def rounded(df: DataFrame, *keys: str, digits: int = DIGITS) -> DataFrame:
    """Doubles to ``digits`` places, other columns as they are."""
    return df.select(*[even(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def rnd(x: str, digits: int = DIGITS) -> str:
    return f"round_even(round_even(({x}) * CAST({10 ** (digits + SNAP)} AS DOUBLE), 0) / CAST({10**SNAP} AS DOUBLE), 0) / CAST({10**digits} AS DOUBLE)"


def r(*columns: str, digits: int = DIGITS) -> str:
    return ", ".join(f"{rnd(c, digits)} AS {c}" for c in columns)


def week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "week")


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.rolling(week(spark, sf_dir))


# --- panel and indicators -------------------------------------------------------------------------------------------------------


@query(f"""WITH {ROLL}, ok AS (SELECT *, {up("ma5", "ma20")} AS crossed FROM rolled),
  hit AS (SELECT symbol, date, momentum_20d, vol_ratio_5d, change_pct FROM ok WHERE crossed AND vol_ratio_5d >= 1.2 AND close > ma60),
  s AS (SELECT *, CASE WHEN max(momentum_20d) OVER d > min(momentum_20d) OVER d THEN (momentum_20d - min(momentum_20d) OVER d) / (max(momentum_20d) OVER d - min(momentum_20d) OVER d) WHEN momentum_20d IS NOT NULL THEN 0.5 END AS a,
    CASE WHEN max(vol_ratio_5d) OVER d > min(vol_ratio_5d) OVER d THEN (vol_ratio_5d - min(vol_ratio_5d) OVER d) / (max(vol_ratio_5d) OVER d - min(vol_ratio_5d) OVER d) WHEN vol_ratio_5d IS NOT NULL THEN 0.5 END AS b,
    CASE WHEN max(change_pct) OVER d > min(change_pct) OVER d THEN (change_pct - min(change_pct) OVER d) / (max(change_pct) OVER d - min(change_pct) OVER d) WHEN change_pct IS NOT NULL THEN 0.5 END AS c
    FROM hit WINDOW d AS (PARTITION BY date)),
  t AS (SELECT symbol, date, round((coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2) / 1.0 * 100, 6) AS score FROM s),
  p AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS INTEGER) AS place FROM t)
  SELECT symbol, date, score, place FROM p WHERE place <= 20""")  # fmt: skip
def screen_ma_golden_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars, moving-average cross, filter, score, best twenty of each date."""
    strategy = screen.STRATEGIES["ma_golden_cross"]
    hits = screen.evaluated(rolled(spark, sf_dir), {"s": strategy}).where("entry_s").select("symbol", "date", *strategy.score)
    scored = hits.withColumn("score", even(screen.score(strategy.score), DIGITS)).select("symbol", "date", "score")
    return screen.top(scored, "score", 20)


@query(f"WITH {BARS} SELECT symbol, date, {r('open', 'high', 'low', 'close', 'volume', 'amount', digits=4)} FROM bars")
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(week(spark, sf_dir), digits=4)


@query(f"""WITH {BARS}, m AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY date) AS close, sum(volume) AS volume, sum(amount) AS amount FROM bars GROUP BY symbol, date_trunc('month', date)) SELECT symbol, date, {r("open", "high", "low", "close", "volume", "amount", digits=4)} FROM m""")
def bars_monthly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.resample(week(spark, sf_dir), "month"), digits=4)


ROLLED_COLUMNS = ["prev_close", *[f"ma{n}" for n in (5, 10, 20, 30, 60)], "vol_ma5", "vol_ma10", "high_60d", "low_60d", *[f"momentum_{n}d" for n in (5, 10, 20, 30, 60)], "change_pct",
                  "boll_upper", "boll_lower", "vol_ratio_5d", "change_amount", "amplitude", "annual_vol_20d"]


@query(f"WITH {ROLL} SELECT symbol, date, {r(*ROLLED_COLUMNS, digits=3)}, CAST(ma_bull_align AS DOUBLE) AS ma_bull_align, CAST(ma_bear_align AS DOUBLE) AS ma_bear_align FROM rolled")
def rolling_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col(c).cast("double").alias(c) for c in ("ma_bull_align", "ma_bear_align")]
    return rounded(rolled(spark, sf_dir).select("symbol", "date", *ROLLED_COLUMNS, *flags), digits=3)


SIGNAL_SQL = {
    "signal_ma_golden_5_20": up("ma5", "ma20"), "signal_ma_dead_5_20": down("ma5", "ma20"), "signal_ma_golden_20_60": up("ma20", "ma60"),
    **{f"signal_ma{n}_breakout": up("close", f"ma{n}") for n in (5, 10, 20, 30, 60)}, **{f"signal_ma{n}_breakdown": down("close", f"ma{n}") for n in (5, 10, 20, 30, 60)},
    "signal_n_day_high": "close >= high_60d", "signal_n_day_low": "close <= low_60d", "signal_boll_breakout_upper": "close > boll_upper",
    "signal_boll_breakdown_lower": "close < boll_lower", "signal_volume_surge": "vol_ratio_5d >= 2.0",
}


@query(f"WITH {ROLL} SELECT symbol, date, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in SIGNAL_SQL.items())} FROM rolled")
def window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled(spark, sf_dir).select("symbol", "date", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in indicators.window_signals().items()])


EWM = """WITH RECURSIVE {bars}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev,
  max(high) OVER f AS top, min(low) OVER f AS bottom, count(*) OVER f AS c9 FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, greatest(coalesce(close - prev, 0), 0) AS g, greatest(coalesce(prev - close, 0), 0) AS l, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
  CASE WHEN c9 = 9 AND top > bottom THEN (close - bottom) / (top - bottom) * 100 END AS rsv FROM n),
{rest}"""


def _ewm(col: str, alpha: float, out: str) -> str:
    return f"CAST({alpha!r} AS DOUBLE) * m.{col} + CAST({1 - alpha!r} AS DOUBLE) * e.{out}"


_SPANS = {"ema5": ("close", 2 / 6), "ema10": ("close", 2 / 11), "ema20": ("close", 2 / 21), "ema30": ("close", 2 / 31), "ema60": ("close", 2 / 61), "e12": ("close", 2 / 13), "e26": ("close", 2 / 27), "atr_14": ("tr", 1 / 14),
          **{f"g{n}": ("g", 1 / n) for n in (6, 14, 24)}, **{f"l{n}": ("l", 1 / n) for n in (6, 14, 24)}}
EWM_SQL = EWM.format(bars=BARS.strip(), rest=f"""
e AS (SELECT symbol, date, i, {", ".join(f"CAST({c} AS DOUBLE) AS {o}" for o, (c, _) in _SPANS.items())}, CAST(0.0 AS DOUBLE) AS dea, rsv AS k, rsv AS d, rsv AS kk FROM m WHERE i = 1
  UNION ALL SELECT m.symbol, m.date, m.i, {", ".join(_ewm(c, a, o) for o, (c, a) in _SPANS.items())},
    0.2 * ({_ewm("close", 2 / 13, "e12")} - ({_ewm("close", 2 / 27, "e26")})) + 0.8 * e.dea,
    CASE WHEN m.rsv IS NULL THEN e.k WHEN e.k IS NULL THEN m.rsv ELSE m.rsv / 3 + e.k * 2 / 3 END,
    CASE WHEN m.rsv IS NULL THEN e.d WHEN e.d IS NULL THEN m.rsv ELSE (m.rsv / 3 + e.k * 2 / 3) / 3 + e.d * 2 / 3 END,
    CASE WHEN m.rsv IS NULL THEN NULL ELSE 1.0 END
  FROM e JOIN m ON m.symbol = e.symbol AND m.i = e.i + 1)
SELECT symbol, date, {r("ema5", "ema10", "ema20", "ema30", "ema60", digits=4)}, round(e12 - e26, 4) AS macd_dif, round(dea, 4) AS macd_dea, round(2 * (e12 - e26 - dea), 4) AS macd_hist, round(atr_14, 4) AS atr_14,
  {", ".join(f"round(100 - 100 / (1 + g{n} / CASE WHEN l{n} = 0 THEN 1e-12 ELSE l{n} END), 4) AS rsi_{n}" for n in (6, 14, 24))},
  round(CASE WHEN kk IS NOT NULL THEN k END, 4) AS kdj_k, round(CASE WHEN kk IS NOT NULL THEN d END, 4) AS kdj_d, round(CASE WHEN kk IS NOT NULL THEN 3 * k - 2 * d END, 4) AS kdj_j FROM e""")  # fmt: skip


@query(EWM_SQL)
def recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.recursive import EWM_COLUMNS

    out = with_recursive(week(spark, sf_dir)).select("symbol", "date", *EWM_COLUMNS)
    return rounded(out, digits=4)


@query(f"""WITH {BARS}, m AS (SELECT *, coalesce(close > {lagged("close")}, false) AS u, coalesce(close < {lagged("close")}, false) AS d FROM bars),
  i AS (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER w AS ui, sum(CASE WHEN d THEN 0 ELSE 1 END) OVER w AS di FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
  SELECT symbol, date, CASE WHEN u THEN CAST(sum(CAST(u AS INTEGER)) OVER (PARTITION BY symbol, ui ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS up_streak,
    CASE WHEN d THEN CAST(sum(CAST(d AS INTEGER)) OVER (PARTITION BY symbol, di ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS down_streak FROM i""")
def close_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.streaks(week(spark, sf_dir)).select("symbol", "date", F.col("up_streak").cast("long"), F.col("down_streak").cast("long"))


@query(f"""WITH {BARS} SELECT symbol, date, round(floor((floor(prev * 100 + 0.5) * 110 + 50) / 100) / 100, 4) AS upper, round(floor((floor(prev * 100 + 0.5) * 90 + 50) / 100) / 100, 4) AS lower,
  close >= floor((floor(prev * 100 + 0.5) * 110 + 50) / 100) / 100 - 0.005 AS at_upper, close <= floor((floor(prev * 100 + 0.5) * 90 + 50) / 100) / 100 + 0.005 AS at_lower
  FROM (SELECT *, {lagged("close")} AS prev FROM bars) WHERE prev IS NOT NULL""")
def limit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = week(spark, sf_dir).withColumn("prev", S.delay("close")).where("prev is not null")
    upper, lower = indicators.limit_price(F.col("prev"), F.lit(10)), indicators.limit_price(F.col("prev"), F.lit(-10))
    return panel.select("symbol", "date", even(upper, 4).alias("upper"), even(lower, 4).alias("lower"), (F.col("close") >= upper - 0.005).alias("at_upper"), (F.col("close") <= lower + 0.005).alias("at_lower"))


# --- formula operators ----------------------------------------------------------------------------------------------------------


def _last(n: int) -> str:
    return f"(CASE WHEN count(close) {over(n)} = {n} THEN list(close) {over(n)} END)"


TS_SQL = {
    "ts_mean": roll("avg", "close", 10), "ts_std": roll("stddev_samp", "close", 10), "ts_std0": roll("stddev_pop", "close", 10), "ts_sum": roll("sum", "close", 10), "ts_max": roll("max", "close", 10), "ts_min": roll("min", "close", 10),
    "ts_delay": lagged("close", 3), "ts_delta": f"close - {lagged('close', 3)}",
    "ts_zscore": f"(close - {roll('avg', 'close', 10)}) / nullif({roll('stddev_samp', 'close', 10)}, 0)",
    "ts_rank": f"len(list_filter({_last(10)}, lambda y: y < close)) + (len(list_filter({_last(10)}, lambda y: y = close)) + 1) / 2",
    "ts_pctrank": f"(len(list_filter({_last(10)}, lambda y: y < close)) + len(list_filter({_last(10)}, lambda y: y <= close)) + 1) / 20",
    "ts_argmax": f"CAST(list_position({_last(10)}, list_max({_last(10)})) AS BIGINT)", "ts_argmin": f"CAST(list_position({_last(10)}, list_min({_last(10)})) AS BIGINT)",
    "ts_quantile": f"list_sort({_last(10)})[3]", "ts_qlinear": f"CASE WHEN count(close) {over(10)} = 10 THEN quantile_cont(close, 0.25) {over(10)} END",
    "ts_cov": f"CASE WHEN count(close) {over(10)} = 10 THEN covar_samp(close, volume) {over(10)} END",
    "ts_corr": f"CASE WHEN count(close) {over(10)} = 10 THEN covar_samp(close, volume) {over(10)} / nullif(stddev_samp(close) {over(10)} * stddev_samp(volume) {over(10)}, 0) END",
    "ts_slope": f"CASE WHEN count(close) {over(10)} = 10 THEN regr_slope(close, rn) {over(10)} END",
    "ts_rsquare": f"CASE WHEN count(close) {over(10)} = 10 AND stddev_pop(close) {over(10)} > 0 THEN regr_r2(close, rn) {over(10)} END",
    "ts_resi": f"CASE WHEN count(close) {over(10)} = 10 THEN close - (regr_intercept(close, rn) {over(10)} + regr_slope(close, rn) {over(10)} * rn) END",
    "decay_linear": f"CASE WHEN count(close) {over(10)} = 10 THEN (sum(close * rn) {over(10)} - (rn - 10) * sum(close) {over(10)}) / 55 END",
}


def _ts(S: Series) -> dict[str, Column]:
    c, v = "close", "volume"
    return {
        "ts_mean": S.mean(c, 10), "ts_std": S.std(c, 10), "ts_std0": S.std0(c, 10), "ts_sum": S.sum(c, 10), "ts_max": S.max(c, 10), "ts_min": S.min(c, 10), "ts_delay": S.delay(c, 3), "ts_delta": S.delta(c, 3), "ts_zscore": S.zscore(c, 10),
        "ts_rank": S.rank(c, 10), "ts_pctrank": S.pctrank(c, 10), "ts_argmax": S.argmax(c, 10), "ts_argmin": S.argmin(c, 10), "ts_quantile": S.quantile(c, 10, 0.2), "ts_qlinear": S.qlinear(c, 10, 0.25),
        "ts_cov": S.cov(c, v, 10), "ts_corr": S.corr(c, v, 10), "ts_slope": S.slope(c, "rn", 10), "ts_rsquare": S.rsquare(c, "rn", 10), "ts_resi": S.resi(c, "rn", 10), "decay_linear": S.decay_linear(c, "rn", 10),
    }


@query(f"WITH {BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars) SELECT symbol, date, {', '.join(f'{rnd(v, 3)} AS {k}' if k not in ('ts_argmax', 'ts_argmin') else f'{v} AS {k}' for k, v in TS_SQL.items())} FROM b")
def formula_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared()
    made = _ts(shared)
    windowed = week(spark, sf_dir).withColumn("rn", S.row()).withColumns(shared.windows)
    return rounded(windowed.select("symbol", "date", *[v.alias(k) for k, v in made.items()]), digits=3)


AVG_RANK = "(rank() OVER (PARTITION BY date ORDER BY {x}) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2)"


@query(f"""WITH {BARS}, b AS (SELECT *, avg(amount) OVER d AS m, stddev_samp(amount) OVER d AS s FROM bars WINDOW d AS (PARTITION BY date))
  SELECT symbol, date, round({AVG_RANK.format(x="close")} / count(close) OVER (PARTITION BY date), 6) AS cs_rank, round((amount - m) / nullif(s, 0), 6) AS cs_zscore,
    round(CASE WHEN s IS NULL THEN amount ELSE least(greatest(amount, m - 1.5 * s), m + 1.5 * s) END, 2) AS cs_winsorize, round(least(greatest(close - open, -50), 50), 4) AS clamped, round(CASE WHEN close > open THEN ln(close - open) END, 6) AS logged,
    round(CASE WHEN close >= open THEN sqrt(close - open) END, 6) AS rooted, round(pow(close, 1.5), 2) AS powered, CAST(sign(close - open) AS DOUBLE) AS signed FROM b""")
def formula_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    move = F.col("close") - F.col("open")
    return week(spark, sf_dir).select(
        "symbol", "date", even(X.rank("close"), 6).alias("cs_rank"), even(X.zscore("amount"), 6).alias("cs_zscore"), even(X.winsorize("amount", 1.5), 2).alias("cs_winsorize"),
        even(clamp(move, -50.0, 50.0), 4).alias("clamped"), even(log(move), 6).alias("logged"), even(sqrt(move), 6).alias("rooted"), even(F.pow("close", F.lit(1.5)), 2).alias("powered"), F.signum(move).alias("signed"),
    )


# --- factors --------------------------------------------------------------------------------------------------------------------


def _ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


_R = "change_pct"
FACTOR_SQL = {
    **{f"ma{n}_bias": f"close / nullif(ma{n}, 0) - 1" for n in (5, 10, 20, 30, 60)},
    "boll_position": _ratio("close - boll_lower", "boll_upper - boll_lower"), "boll_width": _ratio("boll_upper - boll_lower", "ma20"),
    "vol_ratio_10d": _ratio("volume", roll("avg", "volume", 10, -1)), "vol_trend_5_10": "vol_ma5 / nullif(vol_ma10, 0) - 1", "vol_trend_5_60": f"{_ratio(roll('avg', 'volume', 5), roll('avg', 'volume', 60))} - 1",
    "log_amount": "CASE WHEN amount >= 0 THEN ln(1 + amount) END", "amount_ratio_5d": f"{_ratio('amount', roll('avg', 'amount', 5, -1))} - 1",
    "gap_return": "open / nullif(prev_close, 0) - 1", "intraday_return": "close / nullif(open, 0) - 1", "close_position": _ratio("close - low", "high - low"),
    "distance_to_high_60d": "close / nullif(high_60d, 0) - 1", "distance_from_low_60d": "close / nullif(low_60d, 0) - 1", "max_ret_20d": roll("max", _R, 20),
    "up_days_20d": f"CASE WHEN count({_R}) {over(20)} = 20 THEN CAST(sum(CASE WHEN {_R} > 0 THEN 1 ELSE 0 END) {over(20)} AS DOUBLE) END",
    "vol_price_corr_20d": f"CASE WHEN count({_R}) {over(20)} = 20 THEN covar_samp({_R}, volume) {over(20)} / nullif(stddev_samp({_R}) {over(20)} * stddev_samp(volume) {over(20)}, 0) END",
    "momentum_120d": f"close / nullif({lagged('close', 120)}, 0) - 1", "mom_accel_20_60": "momentum_20d - momentum_60d", "vol_regime_5_60": _ratio(roll("stddev_samp", _R, 5), roll("stddev_samp", _R, 60)),
    "amplitude_trend_20_60": f"{_ratio(roll('avg', 'amplitude', 20), roll('avg', 'amplitude', 60))} - 1",
    "downside_vol_20d": f"CASE WHEN count({_R}) {over(20)} = 20 THEN sqrt(avg(least({_R}, 0) * least({_R}, 0)) {over(20)}) END",
    "obv_trend_20d": f"CASE WHEN count({_R}) {over(20)} = 20 THEN sum(sign({_R}) * volume) {over(20)} / nullif(avg(volume) {over(20)} * 20, 0) END",
    "amount_mean_20d": f"{roll('avg', 'amount', 20)} / 1e8", "amihud_20d": f"CASE WHEN count({_R}) {over(20)} = 20 THEN avg(abs({_R}) / (amount / 1e8)) {over(20)} END",
    "position_240d": _ratio(f"close - {roll('min', 'close', 240)}", f"{roll('max', 'close', 240)} - {roll('min', 'close', 240)}"), "distance_to_high_240d": f"{_ratio('close', roll('max', 'close', 240))} - 1",
    "ret_skew_20d": f"CASE WHEN count({_R}) {over(20)} = 20 AND var_pop({_R}) {over(20)} > 0 THEN (avg({_R} * {_R} * {_R}) {over(20)} - 3 * avg({_R}) {over(20)} * avg({_R} * {_R}) {over(20)} + 2 * pow(avg({_R}) {over(20)}, 3)) / pow(var_pop({_R}) {over(20)}, 1.5) END",
}


@query(f"WITH {ROLL} SELECT symbol, date, {', '.join(f'{rnd(v, 5)} AS {k}' for k, v in FACTOR_SQL.items())} FROM rolled")
def factor_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = factors.first()
    return rounded(rolled(spark, sf_dir).select("symbol", "date", *[catalog[k].alias(k) for k in FACTOR_SQL]), digits=5)


@query(f"WITH {ROLL}, f AS (SELECT *, open / nullif(prev_close, 0) - 1 AS g, close / nullif(open, 0) - 1 AS i FROM rolled) SELECT symbol, date, round({roll('sum', 'g', 20)}, 6) AS overnight_ret_20d, round({roll('sum', 'i', 20)}, 6) AS intraday_ret_20d FROM f")
def factor_return_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = rolled(spark, sf_dir).withColumns({k: v for k, v in factors.first().items() if k in ("gap_return", "intraday_return")})
    return rounded(staged.select("symbol", "date", *[v.alias(k) for k, v in factors.second().items()]))


@query(f"""WITH {BARS}, s AS (SELECT s_suppkey AS symbol, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS float_shares FROM supplier), b AS (SELECT bars.*, volume * 10000 / nullif(float_shares, 0) AS tr FROM bars JOIN s USING (symbol))
  SELECT symbol, date, round(tr, 4) AS turnover_rate, round({_ratio("tr", roll("avg", "tr", 5, -1))} - 1, 6) AS turnover_ratio_5d, round({_ratio(f"tr - {roll('avg', 'tr', 60, -1)}", roll("stddev_samp", "tr", 60, -1))}, 6) AS turnover_z_60d,
    round({roll("avg", "tr", 20)}, 4) AS turnover_mean_20d, round({_ratio(roll("stddev_samp", "tr", 20), roll("avg", "tr", 20))}, 6) AS turnover_std_20d, round(CASE WHEN close * volume / nullif(tr, 0) > 0 THEN ln(close * volume / tr) END, 6) AS log_float_mv FROM b""")
def factor_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factors.turnover(week(spark, sf_dir), float_shares(spark, sf_dir))
    return out.select("symbol", "date", even("turnover_rate", 4).alias("turnover_rate"), even("turnover_ratio_5d", 6).alias("turnover_ratio_5d"), even("turnover_z_60d", 6).alias("turnover_z_60d"),
                      even("turnover_mean_20d", 4).alias("turnover_mean_20d"), even("turnover_std_20d", 6).alias("turnover_std_20d"), even("log_float_mv", 6).alias("log_float_mv"))


# --- joins ----------------------------------------------------------------------------------------------------------------------

FUNDAMENTALS = """fund AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, sum(l_extendedprice) AS revenue,
  CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH + INTERVAL 29 DAY AS DATE) AS announced FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(f"""WITH {BARS}, {FUNDAMENTALS} SELECT b.symbol, b.date, f.quarter, round(f.revenue, 2) AS revenue FROM bars b ASOF LEFT JOIN fund f ON b.symbol = f.symbol AND b.date > f.announced""")
def asof_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.asof(week(spark, sf_dir), fundamentals(spark, sf_dir), "symbol", "date", "announced", ["quarter", "revenue"], strict=True)
    return out.select("symbol", "date", "quarter", even("revenue", 2).alias("revenue"))


@query(f"""WITH {FUNDAMENTALS} SELECT a.symbol, a.quarter, round(a.revenue, 2) AS revenue, round(a.revenue / nullif(b.revenue, 0) - 1, 6) AS yoy FROM fund a LEFT JOIN fund b ON a.symbol = b.symbol AND b.quarter = CAST(a.quarter - INTERVAL 1 YEAR AS DATE)""")
def revenue_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fundamentals(spark, sf_dir)
    before = f.select("symbol", F.add_months("quarter", 12).alias("quarter"), F.col("revenue").alias("before"))
    return f.join(before, ["symbol", "quarter"], "left").select("symbol", "quarter", even("revenue", 2).alias("revenue"), even(safe_div("revenue", "before") - 1, 6).alias("yoy"))


@query(f"""WITH {BARS}, iv AS (SELECT symbol, min(date) AS valid_from, CAST(min(date) + INTERVAL 400 DAY AS DATE) AS valid_to, 'A' AS status FROM bars GROUP BY 1 UNION ALL SELECT symbol, CAST(min(date) + INTERVAL 300 DAY AS DATE), NULL, 'B' FROM bars GROUP BY 1),
  j AS (SELECT b.symbol, b.date, status, row_number() OVER (PARTITION BY b.symbol, b.date ORDER BY valid_from DESC NULLS LAST) AS n FROM bars b LEFT JOIN iv ON b.symbol = iv.symbol AND b.date >= valid_from AND (valid_to IS NULL OR b.date < valid_to)) SELECT symbol, date, status FROM j WHERE n = 1""")
def interval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = week(spark, sf_dir).select("symbol", "date")
    since = b.groupBy("symbol").agg(F.min("date").alias("d"))
    first = since.select("symbol", F.col("d").alias("valid_from"), F.date_add("d", 400).alias("valid_to"), F.lit("A").alias("status"))
    second = since.select("symbol", F.date_add("d", 300).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("B").alias("status"))
    return joins.in_interval(b, first.union(second), "symbol", "date", "valid_from", "valid_to", ["status"])


FORWARD = f"""{ROLL}, cal AS (SELECT date, lead(date, 1) OVER (ORDER BY date) AS d1, lead(date, 5) OVER (ORDER BY date) AS d5 FROM (SELECT DISTINCT date FROM bars)),
fwd AS (SELECT a.*, b.close / nullif(a.close, 0) - 1 AS fwd_1, c.close / nullif(a.close, 0) - 1 AS fwd_5 FROM rolled a JOIN cal USING (date) LEFT JOIN bars b ON b.symbol = a.symbol AND b.date = d1 LEFT JOIN bars c ON c.symbol = a.symbol AND c.date = d5)"""


def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.forward_return(rolled(spark, sf_dir), [1, 5])


@query(f"WITH {FORWARD} SELECT symbol, date, round(fwd_1, 6) AS fwd_1, round(fwd_5, 6) AS fwd_5 FROM fwd")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forward(spark, sf_dir).select("symbol", "date", "fwd_1", "fwd_5"))


@query(f"""WITH {BARS}, g AS (SELECT f.symbol, d.date FROM (SELECT symbol, min(date) AS since FROM bars GROUP BY 1) f JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= since),
  j AS (SELECT g.symbol, g.date, close FROM g LEFT JOIN bars USING (symbol, date)) SELECT symbol, date, {rnd("last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)", 4)} AS close FROM j""")
def filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(joins.filled_grid(week(spark, sf_dir), "close"), digits=4)


@query(f"""WITH {BARS}, f AS (SELECT symbol, date, 1.05 AS factor FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol, year(date) ORDER BY date) AS n FROM bars) WHERE n = 1),
  c AS (SELECT symbol, date, exp(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY date)) AS cum FROM f), t AS (SELECT symbol, max(cum) AS total FROM c GROUP BY 1)
  SELECT b.symbol, b.date, {rnd("b.close * (coalesce(c.cum, 1) / coalesce(t.total, 1))", 4)} AS adj_close FROM bars b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.date >= c.date LEFT JOIN t ON t.symbol = b.symbol""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = week(spark, sf_dir)
    first = b.groupBy("symbol", F.year("date").alias("y")).agg(F.min("date").alias("date")).select("symbol", "date", F.lit(1.05).alias("factor"))
    return joins.adjusted(b, first).select("symbol", "date", even("adj_close", 4).alias("adj_close"))


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_order_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", even("o_totalprice", 2).alias("o_totalprice"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
  SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'kept' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def pool_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, at = table(spark, sf_dir, "orders"), F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
    return joins.changes(orders.where(F.col("o_orderdate") < at), orders.where(F.col("o_orderdate") >= at), "o_custkey")


# --- factor tests ---------------------------------------------------------------------------------------------------------------

RANKED = f"""{FORWARD}, fin AS (SELECT date, symbol, momentum_20d AS x, fwd_1 AS y FROM fwd WHERE momentum_20d IS NOT NULL AND fwd_1 IS NOT NULL),
thick AS (SELECT date FROM fin GROUP BY 1 HAVING count(DISTINCT x) >= 5), rk AS (SELECT date, {AVG_RANK.format(x="x")} AS a, {AVG_RANK.format(x="y")} AS b FROM fin WHERE date IN (SELECT date FROM thick)),
ic AS (SELECT date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic, count(*) AS n FROM rk GROUP BY 1)"""


@query(f"WITH {RANKED} SELECT date, round(ic, 6) AS ic, n FROM ic")
def factor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.ic(forward(spark, sf_dir), "momentum_20d", "fwd_1"))


@query(f"WITH {RANKED} SELECT CAST(year(date) AS INTEGER) AS year, round(avg(ic), 6) AS ic_mean, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS ic_ir, round(avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) AS days FROM ic WHERE ic IS NOT NULL GROUP BY 1")
def factor_ic_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.ic_summary(factor_test.ic(forward(spark, sf_dir), "momentum_20d", "fwd_1")))


NAV = f"""{FORWARD}, fin AS (SELECT date, symbol, momentum_20d AS x, least(greatest(fwd_1, -0.02), 0.02) AS y FROM fwd WHERE fwd_1 IS NOT NULL AND momentum_20d IS NOT NULL),
grp AS (SELECT *, CAST(least(floor(({AVG_RANK.format(x="x")} - 0.5) / count(x) OVER (PARTITION BY date) * 5) + 1, 5) AS INTEGER) AS grp FROM fin),
gm AS (SELECT date, grp, avg(y) AS ret FROM grp GROUP BY 1, 2), nav AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM gm)"""


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = forward(spark, sf_dir).withColumn("ret", clamp("fwd_1", -0.02, 0.02))
    return factor_test.group_nav(clipped, "momentum_20d", "ret", 5)


@query(f"WITH {NAV} SELECT date, grp, round(ret, 6) AS ret, round(nav, 4) AS nav FROM nav")
def factor_group_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav(spark, sf_dir).select("date", "grp", even("ret", 6).alias("ret"), even("nav", 4).alias("nav"))


@query(f"""WITH {NAV}, dd AS (SELECT *, nav / greatest(max(nav) OVER (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM nav)
  SELECT grp, round(last(nav ORDER BY date) - 1, 4) AS total, round(pow(last(nav ORDER BY date), 52.0 / count(*)) - 1, 6) AS annual, round(min(dd), 6) AS max_drawdown, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) AS sharpe, round(avg(CASE WHEN ret > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM dd GROUP BY 1""")
def factor_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.group_stats(nav(spark, sf_dir), 52), "total").withColumn("total", even("total", 4))


@query(f"""WITH {NAV}, s AS (SELECT date, max(CASE WHEN grp = 5 THEN ret END) - max(CASE WHEN grp = 1 THEN ret END) AS spread FROM gm GROUP BY 1) SELECT date, round(spread, 6) AS spread, round(exp(sum(ln(1 + spread)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)), 4) AS nav FROM s WHERE spread IS NOT NULL""")
def factor_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_test.long_short(nav(spark, sf_dir), 5).select("date", even("spread", 6).alias("spread"), even("nav", 4).alias("nav"))


@query(f"""WITH {ROLL}, fin AS (SELECT date, symbol, momentum_20d AS x FROM rolled WHERE momentum_20d IS NOT NULL), g AS (SELECT *, CAST(least(floor(({AVG_RANK.format(x="x")} - 0.5) / count(x) OVER (PARTITION BY date) * 5) + 1, 5) AS INTEGER) AS grp FROM fin),
  h AS (SELECT date, symbol, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM g WHERE grp = 5), st AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM h)),
  b AS (SELECT nx AS date, symbol, w AS w0 FROM h JOIN st USING (date) WHERE nx IS NOT NULL), n AS (SELECT h.date, symbol, w AS w1 FROM h JOIN st ON h.date = st.nx)
  SELECT date, round(sum(abs(coalesce(w1, 0) - coalesce(w0, 0))) / 2, 6) AS turnover FROM b FULL JOIN n USING (date, symbol) GROUP BY 1""")
def factor_top_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.top_turnover(rolled(spark, sf_dir), "momentum_20d", 5))


# --- screens --------------------------------------------------------------------------------------------------------------------

STRATEGY_SQL = {
    "boll_breakout": "close > boll_upper AND vol_ratio_5d >= 1.5", "breakout_new_high_60d": f"close > {lagged('high_60d')} AND change_pct >= 0.02 AND vol_ratio_5d >= 1.3",
    "bullish_alignment": "ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60 AND momentum_20d > 0", "low_volatility_leader": "momentum_20d > 0 AND annual_vol_20d < 0.30 AND close > ma20",
    "ma_golden_cross": f"{up('ma5', 'ma20')} AND vol_ratio_5d >= 1.2 AND close > ma60", "n_day_low_reversal": "close <= low_60d AND close > open AND vol_ratio_5d >= 1.5",
    "platform_consolidation_breakout": f"({roll('max', 'high', 10, -1)} - {roll('min', 'low', 10, -1)}) / close <= 0.08 AND close > {roll('max', 'high', 10, -1)} AND vol_ratio_5d >= 1.5",
    "pullback_ma20_bounce": "abs(close / ma20 - 1) < 0.02 AND ma5 > ma20 AND ma20 > ma60 AND change_pct > 0", "pullback_to_support": "abs(close / ma20 - 1) < 0.02 AND vol_ratio_5d < 0.8 AND close > ma60 AND momentum_20d > 0",
    "strong_open": "open > prev_close * 1.03 AND close > open AND change_pct > 0.03", "trend_breakout": "close > ma60 AND close >= high_60d AND vol_ratio_5d >= 2",
    "volume_price_surge": f"{up('close', 'ma20')} AND vol_ratio_5d >= 2 AND close > open",
}


@query(f"WITH {ROLL} SELECT symbol, date, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in STRATEGY_SQL.items())} FROM rolled")
def strategy_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.evaluated(rolled(spark, sf_dir), screen.STRATEGIES)
    return out.select("symbol", "date", *[F.col(f"entry_{k}").alias(k) for k in STRATEGY_SQL])


@query(f"""WITH {ROLL}, s AS (SELECT *, {lagged("close", 2)} AS c2 FROM rolled) SELECT symbol, date FROM s WHERE coalesce(close > ma20, false) AND coalesce(close > c2, false) AND coalesce(volume >= 30.0, false)""")
def stored_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"left": "close", "op": ">", "right": "ma20"}, {"left": "close", "op": ">", "right": "close", "rightDays": 2}, {"left": "volume", "op": ">=", "right": 30.0}]
    panel = rolled(spark, sf_dir)
    return panel.withColumn("hit", screen.signal(specs, set(panel.columns))).where("hit").select("symbol", "date")


# --- market ---------------------------------------------------------------------------------------------------------------------

_RET = "CASE WHEN abs(change_pct) <= 0.6 THEN change_pct END"
BREADTH = f"""{ROLL}, breadth AS (SELECT date, count(*) AS symbols, CAST(count(CASE WHEN {_RET} > 0 THEN 1 END) AS BIGINT) AS up, CAST(count(CASE WHEN {_RET} < 0 THEN 1 END) AS BIGINT) AS down, avg({_RET}) AS mean_change, median({_RET}) AS median_change,
  CAST(count(CASE WHEN {_RET} >= 0.05 THEN 1 END) AS BIGINT) AS strong_up, CAST(count(CASE WHEN {_RET} <= -0.05 THEN 1 END) AS BIGINT) AS strong_down, sum(amount) AS amount, avg(CASE WHEN close > ma20 THEN 1.0 WHEN ma20 IS NOT NULL THEN 0.0 END) AS above_ma20 FROM rolled GROUP BY 1)"""


@query(f"WITH {BREADTH} SELECT date, symbols, up, down, {r('mean_change', 'median_change')}, strong_up, strong_down, round(amount, 2) AS amount, round(above_ma20, 6) AS above_ma20 FROM breadth")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.breadth(rolled(spark, sf_dir)), "amount").withColumn("amount", even("amount", 2))


@query(f"""WITH {BREADTH}, s AS (SELECT date, CASE WHEN up / nullif(up + down, 0) >= 0.6 AND above_ma20 >= 0.5 THEN 'bull' WHEN up / nullif(up + down, 0) <= 0.4 AND above_ma20 < 0.5 THEN 'bear' ELSE 'range' END AS state FROM breadth) SELECT date, state, lag(state) OVER (ORDER BY date) AS state_before FROM s""")
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.regime(market.breadth(rolled(spark, sf_dir)))


MEMBERS = """mem AS (SELECT s_suppkey AS symbol, n_name AS member FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {ROLL}, {MEMBERS} SELECT date, member, count(*) AS symbols, CAST(count(CASE WHEN change_pct >= 0.05 THEN 1 END) AS BIGINT) AS hot, round(sum(amount), 2) AS amount, round(avg(change_pct), 6) AS mean_change,
  last(symbol ORDER BY change_pct, amount, symbol) AS leader FROM rolled JOIN mem USING (symbol) WHERE change_pct IS NOT NULL GROUP BY 1, 2""")
def market_mainline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.mainline(rolled(spark, sf_dir), membership(spark, sf_dir)), "amount").withColumn("amount", even("amount", 2))


@query(f"""WITH {ROLL}, {MEMBERS}, m AS (SELECT date, member, avg(change_pct) AS mean_change FROM rolled JOIN mem USING (symbol) WHERE change_pct IS NOT NULL GROUP BY 1, 2)
  SELECT date, member, round(mean_change, 6) AS mean_change, CAST(row_number() OVER (PARTITION BY date ORDER BY round(mean_change, 9) DESC, member) AS INTEGER) AS place FROM m""")
def sector_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.rotation(rolled(spark, sf_dir), membership(spark, sf_dir)))


@query(f"WITH {ROLL} SELECT date, CAST({' + '.join(f'CAST(change_pct > {e} AS INTEGER)' for e in market.BANDS)} AS INTEGER) AS band, count(*) AS symbols FROM rolled WHERE change_pct IS NOT NULL GROUP BY 1, 2")
def change_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.bands(rolled(spark, sf_dir))


@query(f"""WITH {ROLL}, {MEMBERS}, j AS (SELECT date, member, symbol, momentum_20d AS x FROM rolled JOIN mem USING (symbol) WHERE momentum_20d IS NOT NULL)
  SELECT date, member, symbol, round(CASE WHEN count(*) OVER (PARTITION BY date, member) > 1 THEN (rank() OVER (PARTITION BY date, member ORDER BY x) + (count(*) OVER (PARTITION BY date, member, x) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY date, member) - 1) END, 6) AS pct FROM j""")
def industry_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.relative_percentile(rolled(spark, sf_dir), membership(spark, sf_dir), "momentum_20d"))


@query(f"""WITH {BARS}, m AS (SELECT symbol, date, close / nullif({lagged("close", 3)}, 0) - 1 AS moved FROM bars), d AS (SELECT symbol, date, moved, moved - avg(moved) OVER (PARTITION BY date) AS deviation FROM m WHERE moved IS NOT NULL)
  SELECT symbol, date, round(moved, 6) AS moved, round(deviation, 6) AS deviation FROM d WHERE abs(deviation) >= 0.2""")
def abnormal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.abnormal(week(spark, sf_dir)).select("symbol", "date", "moved", "deviation"))


# --- sources, events, text ------------------------------------------------------------------------------------------------------


@query("SELECT CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last, count(*) AS rows, count(DISTINCT user_id) AS keys FROM events")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.coverage(ticks(spark, sf_dir), "ts", "symbol")


@query("SELECT user_id AS symbol, date_trunc('hour', ts) AS start, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.tumbling(ticks(spark, sf_dir), "1 hour")
    return rounded(out, digits=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id AS symbol, ts, round(avg(value) OVER w, 6) AS day_mean, round(max(value) OVER w, 6) AS day_high, round(min(value) OVER w, 6) AS day_low FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def intraday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.intraday(ticks(spark, sf_dir)).select("symbol", "ts", "day_mean", "day_high", "day_low"))


@query("""SELECT symbol, ts, round(delta, 6) AS delta FROM (SELECT user_id AS symbol, ts, value - lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS delta FROM events) WHERE delta >= 0""")
def tick_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.deltas(ticks(spark, sf_dir)).select("symbol", "ts", "delta"))


@query("""SELECT symbol, since, until, CAST(seconds AS BIGINT) AS seconds FROM (SELECT user_id AS symbol, ts AS since, lead(ts) OVER w AS until, epoch(date_trunc('second', lead(ts) OVER w)) - epoch(date_trunc('second', ts)) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE seconds > 86400""")
def tick_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.gaps(ticks(spark, sf_dir), 86400)


@query("""WITH RECURSIVE h AS (SELECT user_id AS symbol, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'click'),
  c AS (SELECT symbol, ts, i, ts AS last, true AS ok FROM h WHERE i = 1 UNION ALL SELECT h.symbol, h.ts, h.i, CASE WHEN h.ts >= c.last + INTERVAL 36000 SECOND THEN h.ts ELSE c.last END, h.ts >= c.last + INTERVAL 36000 SECOND FROM c JOIN h ON h.symbol = c.symbol AND h.i = c.i + 1) SELECT symbol, ts FROM c WHERE ok""")
def cooled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cooled(ticks(spark, sf_dir).where("kind = 'click'").select("symbol", "ts"), 36000)


@query("""SELECT event_id, symbol, fired FROM (SELECT event_id, user_id AS symbol, coalesce(value > 50, false) AND NOT coalesce(lag(coalesce(value > 50, false)) OVER (PARTITION BY user_id ORDER BY ts), true) AS fired FROM events) WHERE fired""")
def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("symbol"), "ts", "value")
    return rows.withColumn("fired", Series("symbol", "ts").rising_edge(F.col("value") > 50)).where("fired").select("event_id", "symbol", "fired")


@query("SELECT min(doc_id) AS doc_id, sha256(lower(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))) AS fp FROM documents GROUP BY 2")
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dedupe(table(spark, sf_dir, "documents"), "text", "doc_id", keep=["doc_id"])


MENTIONS = """names AS (SELECT name FROM (VALUES ('the'), ('and'), ('que'), ('und'), ('der'), ('les')) AS t(name)),
found AS (SELECT doc_id, source, name, count(*) AS n FROM (SELECT doc_id, source, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS name FROM documents) JOIN names USING (name) GROUP BY 1, 2, 3)"""


@query(f"""WITH {MENTIONS}, s AS (SELECT name, source, sum(n) AS n FROM found GROUP BY 1, 2), d AS (SELECT name, sum(1 + ln(n)) AS s, count(*) AS sources FROM s GROUP BY 1) SELECT name, sources, round(s * (1 + 0.1 * (sources - 1)), 6) AS score FROM d""")
def mention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("the", "and", "que", "und", "der", "les")], "name string")
    docs = table(spark, sf_dir, "documents")
    found = text.mentions(docs, "doc_id", "text", names).join(docs.select("doc_id", "source"), "doc_id")
    return rounded(text.mention_scores(found, "source"))
