"""Queries of price limits, strategies' exits and recursive signals, each beside its SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import factors
from tessera.operators import chips, indicators, limits, screen
from tessera.operators.recursive import next_bars, state_of, with_recursive
from tessera.plans.panel import float_shares, table
from tessera.plans.queries import BARS, EWM_SQL, ROLL, ROLL1, down, even, lagged, over, query, r, rnd, roll, rolled, rounded, up, week
from tessera.sources.shared import shared_folder
from tessera.streaming import bar_state

# --- price limits ---------------------------------------------------------------------------------------------------------------

LIMITS = f"""{BARS}, listed AS (SELECT s_suppkey AS symbol, ['600', '300', '688', '830'][s_suppkey % 4 + 1] || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || ['.SH', '.SZ', '.SH', '.BJ'][s_suppkey % 4 + 1] AS code, CASE WHEN s_suppkey % 5 = 0 THEN '*ST ' || s_name ELSE s_name END AS name FROM supplier),
lim0 AS (SELECT b.*, CASE WHEN substr(code, 1, 3) IN ('300', '301', '302', '688', '689') THEN 20 WHEN code LIKE '%.BJ' THEN 30 WHEN name LIKE '%ST%' AND date < DATE '{limits.WARNED_UNTIL}' THEN 5 ELSE 10 END AS percent FROM bars b JOIN listed USING (symbol)),
lim1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) > 5 THEN {lagged("close")} END AS pc FROM lim0),
lim2 AS (SELECT *, floor((floor(pc * 100 + 0.5) * (100 + percent) + 50) / 100) / 100 AS limit_upper, floor((floor(pc * 100 + 0.5) * (100 - percent) + 50) / 100) / 100 AS limit_lower FROM lim1),
lim3 AS (SELECT *, coalesce(close >= limit_upper - 0.005, false) AS signal_limit_up, coalesce(close <= limit_lower + 0.005, false) AS signal_limit_down,
  coalesce(high >= limit_upper - 0.005 AND close < limit_upper - 0.005, false) AS signal_broken_limit_up, coalesce(low <= limit_lower + 0.005 AND close > limit_lower + 0.005 AND close > open, false) AS signal_limit_down_recovery FROM lim2),
lim4 AS (SELECT *, sum(CAST(NOT signal_limit_up AS INTEGER)) OVER w AS ui, sum(CAST(NOT signal_limit_down AS INTEGER)) OVER w AS di FROM lim3 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
lim AS (SELECT *, CAST(CASE WHEN signal_limit_up THEN sum(CAST(signal_limit_up AS INTEGER)) OVER (PARTITION BY symbol, ui ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INTEGER) AS consecutive_limit_ups,
  CAST(CASE WHEN signal_limit_down THEN sum(CAST(signal_limit_down AS INTEGER)) OVER (PARTITION BY symbol, di ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INTEGER) AS consecutive_limit_downs FROM lim4)"""
FLAGS = ["signal_limit_up", "signal_limit_down", "signal_broken_limit_up", "signal_limit_down_recovery", "consecutive_limit_ups", "consecutive_limit_downs"]


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars with their limits; every board and risk-warning names are among the suppliers."""
    key = F.col("s_suppkey")
    board = lambda *x: F.element_at(F.array(*map(F.lit, x)), (key % 4 + 1).cast("int"))
    code = F.concat(board("600", "300", "688", "830"), F.lpad((key % 1000).cast("string"), 3, "0"), board(".SH", ".SZ", ".SH", ".BJ"))
    name = F.when(key % 5 == 0, F.concat(F.lit("*ST "), "s_name")).otherwise(F.col("s_name"))
    listed = table(spark, sf_dir, "supplier").select(key.alias("symbol"), code.alias("code"), name.alias("name"))
    bars = week(spark, sf_dir).join(listed, "symbol")
    return limits.flags(bars.withColumn("percent", limits.limit_percent(F.col("code"), F.col("date"), F.col("name"))), free_days=5)


@query(f"WITH {LIMITS} SELECT symbol, date, percent, {r('limit_upper', 'limit_lower', digits=4)}, {', '.join(FLAGS)} FROM lim")
def limit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flagged(spark, sf_dir).select("symbol", "date", "percent", "limit_upper", "limit_lower", *FLAGS), digits=4)


@query(f"WITH {LIMITS} SELECT symbol, date, coalesce(lead(signal_limit_up, 2) OVER (PARTITION BY symbol ORDER BY date), false) AS blocked_up, coalesce(lead(signal_limit_down, 2) OVER (PARTITION BY symbol ORDER BY date), false) AS blocked_down FROM lim")
def entry_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.blocked_entries(flagged(spark, sf_dir), 2).select("symbol", "date", "blocked_up", "blocked_down")


LADDER = f"""{LIMITS}, rung AS (SELECT *, {lagged("consecutive_limit_ups")} AS yesterday, consecutive_limit_ups AS n FROM lim),
ladder AS (SELECT date, count(*) FILTER (n = 1) AS first_board, count(*) FILTER (n >= 2) AS ge2_count, count(*) FILTER (n >= 3) AS ge3_count, count(*) FILTER (n >= 5) AS ge5_count, count(DISTINCT CASE WHEN n >= 2 THEN n END) AS rungs_filled,
  count(*) FILTER (yesterday >= 1) AS promo_pool, count(*) FILTER (yesterday >= 1 AND n = yesterday + 1) AS promo_ok, CAST(max(n) AS BIGINT) AS max_boards FROM rung GROUP BY 1)"""


@query(f"WITH {LADDER} SELECT * FROM ladder")
def limit_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.ladder(flagged(spark, sf_dir))


@query(f"""WITH {LADDER} SELECT symbol, date, n AS boards, coalesce(yesterday, 0) AS yesterday, CASE WHEN n > 0 AND coalesce(yesterday, 0) > 0 THEN 'promoted' WHEN n > 0 THEN 'first' WHEN signal_broken_limit_up THEN 'broken' ELSE 'dropped' END AS status
  FROM rung WHERE n > 0 OR yesterday > 0""")
def limit_ladder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.ladder_rows(flagged(spark, sf_dir))


LIMIT_PANEL = f"""{LIMITS}, {ROLL1.replace("FROM bars)", "FROM lim)")}, shares AS (SELECT s_suppkey AS symbol, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS float_shares FROM supplier),
lp AS (SELECT one.*, volume / nullif(vol_prev5, 0) AS vol_ratio_5d, volume * 10000 / nullif(float_shares, 0) AS turnover_rate, (least(open, close) - low) / nullif(prev_close, 0) AS lower_shadow, (close - low) / nullif(high - low, 0) AS close_position,
  CASE WHEN count(*) {over(20)} = 20 THEN sum(CAST(consecutive_limit_ups > 0 AS INTEGER)) {over(20)} END AS limit_up_count_20d, CASE WHEN count(*) {over(60)} = 60 THEN sum(CAST(consecutive_limit_ups > 0 AS INTEGER)) {over(60)} END AS limit_up_count_60d,
  CAST((greatest(ma5, ma10, ma20) - least(ma5, ma10, ma20)) / ma20 <= 0.025 AS INTEGER) AS tight FROM one JOIN shares USING (symbol))"""
LIMIT_ENTRY = {
    "active_limit_gene": "limit_up_count_60d >= 3 AND change_pct < 0.07 AND vol_ratio_5d <= 1.2", "broken_board_recovery": "signal_limit_up AND vol_ratio_5d >= 1.5 AND change_pct > 0.03",
    "consecutive_limit_ups": "signal_limit_up AND consecutive_limit_ups >= 2", "high_turnover_surge": "turnover_rate > 5 AND change_pct > 0.03", "limit_up_momentum": "change_pct > 0.05 AND consecutive_limit_ups >= 1",
    "long_lower_shadow_reversal": "lower_shadow >= 0.03 AND momentum_5d <= -0.05 AND vol_ratio_5d >= 1.2 AND close_position >= 0.5",
    "ma_convergence_breakout": f"sum(tight) {over(5, -1)} = 5 AND close > greatest(ma5, ma10, ma20) AND change_pct >= 0.02 AND vol_ratio_5d >= 1.2", "near_limit_up": "change_pct > 0.07 AND change_pct >= percent / 100 - 0.03",
}
_MA20 = down("close", "ma20")
LIMIT_EXIT = {"active_limit_gene": "limit_up_count_60d < 2", "broken_board_recovery": _MA20, "consecutive_limit_ups": "false", "high_turnover_surge": _MA20, "limit_up_momentum": "false", "long_lower_shadow_reversal": "close < ma5", "ma_convergence_breakout": "close < ma10", "near_limit_up": _MA20}


@query(f"WITH {LIMIT_PANEL} SELECT symbol, date, limit_up_count_20d, limit_up_count_60d, {', '.join(f'coalesce({v}, false) AS entry_{k}' for k, v in LIMIT_ENTRY.items())}, {', '.join(f'coalesce({v}, false) AS exit_{k}' for k, v in LIMIT_EXIT.items())} FROM lp")
def limit_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = screen.limit_panel(flagged(spark, sf_dir), float_shares(spark, sf_dir))
    out = screen.evaluated(panel, screen.LIMIT_STRATEGIES)
    return out.select("symbol", "date", "limit_up_count_20d", "limit_up_count_60d", *[f"{side}_{k}" for side in ("entry", "exit") for k in screen.LIMIT_STRATEGIES])


# --- exits, composites, ranks ---------------------------------------------------------------------------------------------------

_DEAD = down("ma5", "ma20")
EXIT_SQL = {
    "boll_breakout": "close < boll_lower", "breakout_new_high_60d": "close < ma20", "bullish_alignment": f"{_DEAD} OR {_MA20}", "low_volatility_leader": _MA20, "ma_golden_cross": _DEAD, "n_day_low_reversal": _MA20,
    "platform_consolidation_breakout": "close < ma20", "pullback_ma20_bounce": f"{_MA20} OR {_DEAD}", "pullback_to_support": _MA20, "strong_open": _MA20, "trend_breakout": _MA20, "volume_price_surge": _MA20,
}


@query(f"WITH {ROLL} SELECT symbol, date, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in EXIT_SQL.items())} FROM rolled")
def strategy_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.evaluated(rolled(spark, sf_dir), screen.STRATEGIES)
    return out.select("symbol", "date", *[F.col(f"exit_{k}").alias(k) for k in EXIT_SQL])


@query(f"""WITH {ROLL}, e AS (SELECT symbol, date, coalesce(close > ma60 AND close >= high_60d AND vol_ratio_5d >= 2, false) AS a, coalesce({up("close", "ma20")} AND vol_ratio_5d >= 2 AND close > open, false) AS b, coalesce({_MA20}, false) AS x FROM rolled)
  SELECT symbol, date, CAST(a AS INTEGER) + CAST(b AS INTEGER) AS votes, CAST(a AS INTEGER) + CAST(b AS INTEGER) >= 1 AS entry, x AND max(CAST(a AS INTEGER)) {over(10)} > 0 OR x AND max(CAST(b AS INTEGER)) {over(5)} > 0 AS exit FROM e""")
def composite_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = {k: screen.STRATEGIES[k] for k in ("trend_breakout", "volume_price_surge")}
    out = screen.held(screen.evaluated(rolled(spark, sf_dir), children), [("trend_breakout", 10), ("volume_price_surge", 5)])
    return out.select("symbol", "date", "votes", "entry", "exit")


def _minmax(x: str) -> str:
    return f"CASE WHEN max({x}) OVER d > min({x}) OVER d THEN ({x} - min({x}) OVER d) / (max({x}) OVER d - min({x}) OVER d) WHEN {x} IS NOT NULL THEN 0.5 END"


@query(f"""WITH {ROLL}, s AS (SELECT symbol, date, {rnd(f"(coalesce({_minmax('momentum_20d')}, 0) * 0.7 + coalesce(1 - ({_minmax('annual_vol_20d')}), 0) * 0.3) / 1.0 * 100", 6)} AS score FROM rolled WINDOW d AS (PARTITION BY date)),
  p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN score >= 70 THEN score END DESC NULLS LAST, symbol) AS place FROM s) SELECT symbol, date, score, score >= 70 AND place <= 20 AS entry, score <= 40 AS exit FROM p""")
def factor_rank_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"momentum_20d": 0.7, "annual_vol_20d": -0.3}
    scored = rolled(spark, sf_dir).select("symbol", "date", *weights)
    # the score is rounded before it is compared, so that ties are ties
    return screen.ranked_entries(scored.withColumn("score", even(screen.score(weights), 6))).select("symbol", "date", "score", "entry", "exit")


@query(f"""WITH {ROLL}, a AS (SELECT symbol, date, {rnd("momentum_20d", 6)} AS score, 2.0 AS weight FROM rolled WHERE close > ma20), b AS (SELECT symbol, date, {rnd("vol_ratio_5d", 6)} AS score, 1.0 AS weight FROM rolled WHERE vol_ratio_5d > 1),
  ranked AS (SELECT symbol, date, weight, CASE WHEN n > 1 THEN (n - (rank() OVER (PARTITION BY child, date ORDER BY -score) + (count(*) OVER (PARTITION BY child, date, score) - 1) / 2)) / (n - 1) ELSE 1.0 END * weight AS part
    FROM (SELECT *, count(*) OVER (PARTITION BY child, date) AS n FROM (SELECT *, 1 AS child FROM a WHERE score IS NOT NULL UNION ALL SELECT *, 2 FROM b)))
  SELECT symbol, date, round(sum(part) / sum(weight), 6) AS score, count(*) AS votes FROM ranked GROUP BY 1, 2 HAVING count(*) >= 2""")
def blended_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = rolled(spark, sf_dir)
    a = panel.where("close > ma20 and momentum_20d is not null").select("symbol", "date", even("momentum_20d", 6).alias("score"))
    b = panel.where("vol_ratio_5d > 1").select("symbol", "date", even("vol_ratio_5d", 6).alias("score"))
    return rounded(screen.blended([(a, 2.0), (b, 1.0)], least=2))


# --- recursive signals, factors and strategies ----------------------------------------------------------------------------------

_EWM_CTE, _, _ = EWM_SQL.rpartition("\nSELECT symbol, date,")
RECURSIVE = f"""{_EWM_CTE}, {ROLL1}, rolled AS (SELECT *, volume / nullif(vol_prev5, 0) AS vol_ratio_5d FROM one), rec AS (SELECT rolled.*, ema5, ema10, ema20, ema30, ema60, e12 - e26 AS macd_dif, dea AS macd_dea, 2 * (e12 - e26 - dea) AS macd_hist, atr_14,
  100 - 100 / (1 + g14 / CASE WHEN l14 = 0 THEN 1e-12 ELSE l14 END) AS rsi_14, CASE WHEN kk IS NOT NULL THEN k END AS kdj_k, CASE WHEN kk IS NOT NULL THEN d END AS kdj_d FROM rolled JOIN e USING (symbol, date))"""
RECURSIVE_FACTORS = {
    **{f"ema{n}_bias": f"close / nullif(ema{n}, 0) - 1" for n in (5, 10, 20, 30, 60)}, "macd_dif_pct": "macd_dif / nullif(close, 0)", "macd_dea_pct": "macd_dea / nullif(close, 0)", "macd_hist_pct": "macd_hist / nullif(close, 0)",
    "atr_pct": "atr_14 / nullif(close, 0)", "rsi_14_delta_5d": f"rsi_14 - {lagged('rsi_14', 5)}", "kdj_kd_diff": "kdj_k - kdj_d",
}
RECURSIVE_SIGNALS = {"signal_macd_golden": up("macd_dif", "macd_dea"), "signal_macd_dead": down("macd_dif", "macd_dea"), "signal_kdj_golden": up("kdj_k", "kdj_d"), "signal_kdj_dead": down("kdj_k", "kdj_d")}
RECURSIVE_ENTRY = {
    "macd_golden": f"{up('macd_dif', 'macd_dea')} AND vol_ratio_5d >= 1.5", "macd_below_zero_revival": f"close <= {roll('min', 'close', 20, -1)} AND macd_dif < 0 AND macd_dif > {lagged('macd_dif', 10)}",
    "oversold_bounce": "rsi_14 < 30 AND close > open AND vol_ratio_5d >= 1.2", "oversold_reversal": "rsi_14 < 30 AND change_pct > 0.01 AND close > ma5", "rsi_midline_pullback": f"close > ma60 AND rsi_14 BETWEEN 45 AND 60 AND max(rsi_14) {over(5, -1)} > 65",
}
RECURSIVE_EXIT = {"macd_golden": down("macd_dif", "macd_dea"), "macd_below_zero_revival": f"macd_dif > 0 AND {lagged('macd_dif')} <= 0", "oversold_bounce": _MA20, "oversold_reversal": _MA20, "rsi_midline_pullback": "close < ma20"}


def recursive_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.rolling(with_recursive(week(spark, sf_dir)))


@query(f"{RECURSIVE} SELECT symbol, date, {', '.join(f'{rnd(v, 5)} AS {k}' for k, v in RECURSIVE_FACTORS.items())} FROM rec")
def recursive_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recursive_panel(spark, sf_dir).select("symbol", "date", *[v.alias(k) for k, v in factors.recursive().items()]), digits=5)


@query(f"{RECURSIVE} SELECT symbol, date, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in RECURSIVE_SIGNALS.items())} FROM rec")
def recursive_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive_panel(spark, sf_dir).select("symbol", "date", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in indicators.recursive_signals().items()])


@query(f"{RECURSIVE} SELECT symbol, date, {', '.join(f'coalesce({v}, false) AS entry_{k}' for k, v in RECURSIVE_ENTRY.items())}, {', '.join(f'coalesce({v}, false) AS exit_{k}' for k, v in RECURSIVE_EXIT.items())} FROM rec")
def recursive_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = screen.evaluated(recursive_panel(spark, sf_dir), screen.RECURSIVE_STRATEGIES)
    return out.select("symbol", "date", *[f"{side}_{k}" for side in ("entry", "exit") for k in screen.RECURSIVE_STRATEGIES])


@query(EWM_SQL.replace("FROM trades GROUP BY ALL)", "FROM trades GROUP BY ALL)").replace("bars AS (SELECT symbol, date, first", "fine AS (SELECT symbol, date, first", 1).replace("FROM trades GROUP BY ALL)", "FROM trades GROUP BY ALL), bars AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume) AS volume, sum(amount) AS amount FROM fine GROUP BY symbol, date_trunc('month', date))", 1))
def monthly_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive indicators on monthly bars made of weekly ones."""
    from tessera.operators.recursive import EWM_COLUMNS

    monthly = indicators.resample(week(spark, sf_dir), "month")
    return rounded(with_recursive(monthly).select("symbol", "date", *EWM_COLUMNS), digits=4)


# --- chips and levels -----------------------------------------------------------------------------------------------------------

_CHIPS = f"""{BARS}, sh AS (SELECT s_suppkey AS symbol, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS float_shares FROM supplier),
c0 AS (SELECT b.*, least(greatest(volume / float_shares, 0), 1) AS rate, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars b JOIN sh USING (symbol) WHERE high >= low AND low > 0),
c1 AS (SELECT *, coalesce(exp(sum(CASE WHEN rate < 1 THEN ln(1 - rate) END) OVER w), 1) * CASE WHEN coalesce(max(CAST(rate = 1 AS INTEGER)) OVER w, 0) = 1 THEN 0 ELSE 1 END AS remain, min(low) OVER s AS lo, max(high) OVER s AS hi, first(close) OVER (PARTITION BY symbol ORDER BY n) AS latest, (open + high + low + close) / 4 AS peak
  FROM (SELECT * FROM c0 WHERE n <= 210) WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY symbol)),
c2 AS (SELECT *, greatest((hi - lo) / 149, 0.01) AS width FROM c1 WHERE rate > 0 AND remain > 0),
c3 AS (SELECT c2.*, k.bin, lo + width * k.bin AS price FROM c2 JOIN (SELECT unnest(range(150)) AS bin) k ON CASE WHEN high = low THEN k.bin = floor((peak - lo) / width) ELSE k.bin BETWEEN ceil((low - lo) / width) AND floor((high - lo) / width) END),
c4 AS (SELECT symbol, bin, sum(rate * remain * CASE WHEN high = low THEN 74.5 WHEN price <= peak THEN CASE WHEN abs(peak - low) < 1e-8 THEN 2 / (high - low) ELSE (price - low) / (peak - low) * 2 / (high - low) END ELSE CASE WHEN abs(high - peak) < 1e-8 THEN 2 / (high - low) ELSE (high - price) / (high - peak) * 2 / (high - low) END END) AS chips,
  any_value(latest) AS close, any_value(lo + width * bin) AS price FROM c3 GROUP BY 1, 2),
c5 AS (SELECT *, sum(chips) OVER (PARTITION BY symbol) AS total, sum(chips) OVER (PARTITION BY symbol ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto FROM c4),
c6 AS (SELECT symbol, any_value(close) AS close, sum(CASE WHEN price <= close THEN chips ELSE 0 END) / any_value(total) AS benefit, {", ".join(f"min(CASE WHEN upto > total * {q} THEN price END) AS {k}" for k, q in (("avg_cost", 0.5), ("cost_90_low", 0.05), ("cost_90_high", 0.95), ("cost_70_low", 0.15), ("cost_70_high", 0.85)))} FROM c5 WHERE total > 0 GROUP BY 1)"""
_COSTS = ["close", "benefit", "avg_cost", "cost_90_low", "cost_90_high", "cost_70_low", "cost_70_high", "concentration_90", "concentration_70", "avg_cost_bias"]


@query(f"""WITH {_CHIPS}, c7 AS (SELECT *, {", ".join(f"(cost_{n}_high - cost_{n}_low) / nullif(cost_{n}_high + cost_{n}_low, 0) AS concentration_{n}" for n in (90, 70))}, close / nullif(avg_cost, 0) - 1 AS avg_cost_bias FROM c6) SELECT symbol, {", ".join(f"{rnd(k, 4)} AS {k}" for k in _COSTS)} FROM c7""")
def chip_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = week(spark, sf_dir).join(float_shares(spark, sf_dir), "symbol").withColumn("turnover", F.col("volume") / F.col("float_shares"))
    return rounded(chips.costs(chips.deposits(bars)), digits=4)


_LEVELS = ["pivot_price", "r1", "s1", "r2", "s2", "boll_upper", "boll_lower", "atr", "high_60", "low_60", "fib_382", "fib_500", "fib_618", "gap_up", "gap_down", "swing_high", "swing_low", "round_below", "keltner_upper", "keltner_lower"]
_NEAR = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


@query(f"""WITH {BARS}, a AS (SELECT *, {lagged("high")} AS h1, {lagged("low")} AS l1, {lagged("close")} AS c1, {roll("avg", "close", 20)} AS ma20, {roll("stddev_samp", "close", 20)} AS sd, {roll("max", "high", 60)} AS high_60, {roll("min", "low", 60)} AS low_60, max(high) {_NEAR} AS hn, min(low) {_NEAR} AS ln FROM bars),
  b AS (SELECT *, (h1 + l1 + c1) / 3 AS pivot_price, CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr FROM a),
  c AS (SELECT *, 2 * pivot_price - l1 AS r1, 2 * pivot_price - h1 AS s1, pivot_price + h1 - l1 AS r2, pivot_price - h1 + l1 AS s2, ma20 + 2 * sd AS boll_upper, ma20 - 2 * sd AS boll_lower, {roll("avg", "tr", 14)} AS atr, high_60 - (high_60 - low_60) * 0.382 AS fib_382, high_60 - (high_60 - low_60) * 0.5 AS fib_500, high_60 - (high_60 - low_60) * 0.618 AS fib_618,
    CASE WHEN low > h1 THEN h1 END AS gap_up, CASE WHEN high < l1 THEN l1 END AS gap_down, CASE WHEN high = hn THEN high END AS swing_high, CASE WHEN low = ln THEN low END AS swing_low, floor(close / 50) * 50 AS round_below FROM b),
  d AS (SELECT *, ma20 + 2 * atr AS keltner_upper, ma20 - 2 * atr AS keltner_lower FROM c) SELECT symbol, date, {", ".join(f"{rnd(k, 3)} AS {k}" for k in _LEVELS)} FROM d""")
def price_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(chips.levels(week(spark, sf_dir)).select("symbol", "date", *_LEVELS), digits=3)


# --- from the state of yesterday ------------------------------------------------------------------------------------------------

_LAST = f"""{_EWM_CTE}, {ROLL1}, fin AS (SELECT one.symbol, one.date, ema5, ema60, e12 - e26 AS macd_dif, dea AS macd_dea, atr_14, {", ".join(f"100 - 100 / (1 + g{n} / CASE WHEN l{n} = 0 THEN 1e-12 ELSE l{n} END) AS rsi_{n}" for n in (6, 14, 24))},
  CASE WHEN kk IS NOT NULL THEN k END AS kdj_k, CASE WHEN kk IS NOT NULL THEN d END AS kdj_d, ma5, ma20, ma60, vol_ma5, volume / nullif(vol_prev5, 0) AS vol_ratio_5d, change_pct, row_number() OVER (PARTITION BY one.symbol ORDER BY one.date DESC) AS n, count(*) OVER (PARTITION BY one.symbol) AS many FROM one JOIN e USING (symbol, date))"""
_NEXT = ["ema5", "ema60", "macd_dif", "macd_dea", "atr_14", "rsi_6", "rsi_14", "rsi_24", "kdj_k", "kdj_d", "ma5", "ma20", "ma60", "vol_ma5", "vol_ratio_5d", "change_pct"]


@query(f"{_LAST} SELECT symbol, date, {', '.join(f'{rnd(k, 4)} AS {k}' for k in _NEXT)} FROM fin WHERE n = 1 AND many > 1")
def incremental_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each symbol from the state that the bars before it left; the SQL computes it from the whole history."""
    placed = week(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc())))
    state = state_of(placed.where("n > 1").drop("n"))
    return rounded(next_bars(state, placed.where("n = 1").drop("n")).select("symbol", "date", *_NEXT), digits=4)


_STORED = ["ema5", "ema60", "macd_dif", "macd_dea", "macd_hist", "atr_14", "rsi_6", "rsi_14", "rsi_24", "kdj_k", "kdj_d", "kdj_j", "ma5", "ma20", "ma60", "vol_ma5", "vol_ratio_5d", "change_pct"]


@query(f"""{_LAST} SELECT symbol, date, {", ".join(f"{rnd(k, 4)} AS {k}" for k in _STORED)} FROM (SELECT *, 2 * (macd_dif - macd_dea) AS macd_hist, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM fin)
  WHERE date > (SELECT max(date) FROM bars) - INTERVAL 21 DAY""")
def stored_state_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches into a stored state: the history, two weeks (the first with wrong bars of some symbols), and the last week with their corrections."""
    bars = week(spark, sf_dir)
    last = bars.agg(F.max("date")).first()[0]
    path = f"{shared_folder(spark)}/bar-state-{uuid.uuid4().hex}"
    ago = lambda n: last - dt.timedelta(days=7 * n)
    wrong = F.col("symbol") % 7 == 0
    first = bars.where(F.col("date") == ago(2))
    batches = [
        bars.where(F.col("date") < ago(2)),
        first.withColumn("close", F.when(wrong, F.col("high") * 2).otherwise(F.col("close"))).withColumn("high", F.when(wrong, F.col("high") * 3).otherwise(F.col("high"))),
        bars.where(F.col("date") == ago(1)),
        bars.where(F.col("date") == last).unionByName(first.where(wrong)),
    ]
    for version, batch in enumerate(batches):
        bar_state.apply_bars(spark, path, batch, version)
    bar_state.apply_bars(spark, path, batches[1], 1)  # repeated: changes nothing
    return rounded(bar_state.indicators(spark, path).where(F.col("date") >= F.lit(ago(2))).select("symbol", "date", *_STORED), digits=4)
