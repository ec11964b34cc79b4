"""Queries of market aggregates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import indicators, market
from tessera.plans.panel import membership, table, ticks
from tessera.plans.pattern_queries import LADDER, LIMITS, flagged
from tessera.plans.queries import AVG_RANK, BREADTH, MEMBERS, ROLL, ROLL1, even, lagged, query, rnd, roll, rolled, rounded

CHANGED = f"{LIMITS}, {ROLL1.replace('FROM bars)', 'FROM lim)')}"
RET = "CASE WHEN abs(change_pct) <= 0.25 THEN change_pct END"


def _share(cond: str) -> str:
    return f"avg(CASE WHEN {RET} IS NOT NULL THEN CAST({cond} AS DOUBLE) END) * 100"


def _score(x: str, low: float, high: float) -> str:
    return f"coalesce(greatest(0, least(100, round_even(({x} - ({low})) / ({high} - ({low})) * 100, 0))), 50)"


REGIME = f"""{CHANGED}, met AS (SELECT date, {_share(f"{RET} > 0")} AS up_pct, avg({RET}) * 100 AS avg_pct, median({RET}) * 100 AS median_pct, {_share(f"{RET} >= 0.03")} - {_share(f"{RET} <= -0.03")} AS strong_diff_pct, {_share(f"{RET} <= -0.03")} AS strong_down_pct,
  count(*) FILTER (signal_limit_up) AS limit_up, count(*) FILTER (signal_limit_up) / nullif(count(*) FILTER (signal_limit_up) + count(*) FILTER (signal_broken_limit_up), 0) * 100 AS seal_pct, max(consecutive_limit_ups) AS max_consecutive,
  sum(change_pct * amount) / nullif(sum(amount) FILTER (change_pct IS NOT NULL), 0) * 100 AS index_pct, avg(CASE WHEN ma20 IS NOT NULL THEN CAST(close > ma20 AS DOUBLE) END) * 100 AS above_ma20_pct FROM one GROUP BY 1),
parts AS (SELECT date, {_score("up_pct", 21, 75)} * 0.45 + {_score("avg_pct", -1.2, 1.3)} * 0.25 + {_score("median_pct", -1.2, 1.3)} * 0.20 + {_score("strong_diff_pct", -13, 14)} * 0.10 AS profit,
  {_score("limit_up", 35, 97)} * 0.30 + {_score("seal_pct", 57, 75)} * 0.40 + {_score("max_consecutive", 4, 9)} * 0.30 AS speculation, 100 - {_score("strong_down_pct", 2, 18)} AS resilience, {_score("index_pct", -2.5, 2.5)} * 0.50 + {_score("above_ma20_pct", 22, 76)} * 0.50 AS trend FROM met),
total AS (SELECT *, CAST(round_even(round_even((profit * 0.35 + speculation * 0.25 + resilience * 0.20 + trend * 0.20) * 1e10, 0) / 1e10, 0) AS INTEGER) AS score FROM parts),
reg AS (SELECT *, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'lean_strong' WHEN score >= 45 THEN 'range' WHEN score >= 30 THEN 'lean_weak' ELSE 'weak' END AS state FROM total)"""


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.rolling(flagged(spark, sf_dir))


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.regime_score(market.regime_metrics(changed(spark, sf_dir)))


@query(f"WITH {REGIME} SELECT date, {', '.join(f'{rnd(k, 4)} AS {k}' for k in ('profit', 'speculation', 'resilience', 'trend'))}, score, state, lag(state) OVER (ORDER BY date) AS state_before FROM reg")
def regime_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.day_before(regimes(spark, sf_dir), "state"), digits=4)


_RATIOS = f"{BREADTH}, rat AS (SELECT date, up / greatest(down, 1) AS r FROM breadth), vs AS (SELECT date, CASE WHEN count(r) OVER w = 20 THEN round(avg(r) OVER w, 5) END AS v FROM rat WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


@query(f"WITH {_RATIOS} SELECT date, v, CASE WHEN v <= 1.53761 THEN 'low' WHEN v <= 1.67424 THEN 'mid' WHEN v > 1.67424 THEN 'high' END AS band, CASE WHEN v <= 1.53761 THEN 0.3 WHEN v <= 1.67424 THEN 0.6 WHEN v > 1.67424 THEN 1.0 END::DOUBLE AS share FROM vs")
def breadth_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.breadth_series(market.breadth(rolled(spark, sf_dir))).withColumn("v", even("v", 5))


_LINES = f"""{LIMITS}, {MEMBERS}, okm AS (SELECT * FROM mem WHERE member IN (SELECT member FROM mem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5000) AND member <> 'FRANCE'),
lines AS (SELECT date, member, count(*) AS limit_up_count, count(*) FILTER (consecutive_limit_ups >= 2) AS ge2_count, max(consecutive_limit_ups) AS max_boards, CAST(sum(consecutive_limit_ups) AS BIGINT) AS boards_sum,
  count(DISTINCT CASE WHEN consecutive_limit_ups >= 2 THEN consecutive_limit_ups END) AS rungs_filled, last(symbol ORDER BY consecutive_limit_ups, amount, symbol) AS leader FROM lim JOIN okm USING (symbol) WHERE consecutive_limit_ups >= 1 GROUP BY 1, 2 HAVING count(*) >= 3),
scored AS (SELECT *, round(100 * ({" + ".join(f"({AVG_RANK.format(x=k)} - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) * {w}" for k, w in market.LINE_WEIGHTS.items())}), 6) AS score FROM lines),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, member) AS INTEGER) AS place FROM scored)"""


@query(f"WITH {_LINES} SELECT * FROM placed WHERE place <= 30")
def mainline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = market.allowed_members(membership(spark, sf_dir), 2, 5000, ("FRANCE",))
    return rounded(market.mainlines(flagged(spark, sf_dir), members))


@query(f"""WITH {ROLL}, {MEMBERS}, g AS (SELECT date, member, round(avg(change_pct), 9) AS mean_change, count(*) AS symbols, last(symbol ORDER BY change_pct, symbol) AS top, first(symbol ORDER BY change_pct, symbol) AS bottom FROM rolled JOIN mem USING (symbol) WHERE change_pct IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT date, 'leading' AS side, CAST(row_number() OVER (PARTITION BY date ORDER BY mean_change DESC, member) AS INTEGER) AS place, member, mean_change, symbols, top AS leader FROM g UNION ALL SELECT date, 'lagging', CAST(row_number() OVER (PARTITION BY date ORDER BY mean_change, member) AS INTEGER), member, mean_change, symbols, bottom FROM g)
  SELECT date, side, place, member, round(mean_change, 6) AS mean_change, symbols, leader FROM p WHERE place <= 3""")
def sector_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.leading_and_lagging(rolled(spark, sf_dir), membership(spark, sf_dir), 3)
    return rounded(out)


@query(f"WITH {CHANGED} SELECT date, percent AS board, count(*) AS symbols, count(*) FILTER (change_pct > 0) AS up, count(*) FILTER (change_pct < 0) AS down, round(sum(amount), 2) AS amount FROM one GROUP BY 1, 2")
def board_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.boards(changed(spark, sf_dir), F.col("percent")).withColumn("amount", even("amount", 2))


@query(f"WITH {LADDER}, {BREADTH.split('trades AS', 1)[1].split('FROM trades GROUP BY ALL)', 1)[1].lstrip(', ').strip()} SELECT b.date, symbols, up, down, {rnd('mean_change', 6)} AS mean_change, {rnd('amount', 2)} AS amount, first_board, ge2_count, max_boards, promo_ok / nullif(promo_pool, 0) AS promotion FROM breadth b JOIN ladder USING (date)")
def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth and ladder of each date side by side."""
    from tessera.functions.windows import safe_div
    from tessera.operators import limits

    whole = market.breadth(rolled(spark, sf_dir)).join(limits.ladder(flagged(spark, sf_dir)), "date")
    return whole.select("date", "symbols", "up", "down", even("mean_change", 6).alias("mean_change"), even("amount", 2).alias("amount"), "first_board", "ge2_count", "max_boards", safe_div("promo_ok", "promo_pool").alias("promotion"))


@query("""WITH s AS (SELECT user_id AS symbol, date_trunc('hour', ts) AS start, avg(value) AS m FROM events GROUP BY 1, 2), k AS (SELECT user_id AS symbol, 'group' || (user_id % 7) AS member FROM events GROUP BY 1)
  SELECT member, start, round(avg(m), 6) AS mean, count(*) AS symbols FROM s JOIN k USING (symbol) GROUP BY 1, 2""")
def sector_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of symbols' hourly means per group."""
    rows = ticks(spark, sf_dir)
    members = rows.select("symbol", F.concat(F.lit("group"), F.col("symbol") % 7).alias("member")).distinct()
    return rounded(market.two_level_means(rows, members, "1 hour")).withColumn("start", F.col("start").cast("timestamp_ntz"))


_DEV = f"""{LIMITS}, bench AS (SELECT percent AS board, date, avg(close) AS bench FROM lim GROUP BY 1, 2), bl AS (SELECT board, date, {", ".join(f"bench / nullif(lag(bench, {n}) OVER (PARTITION BY board ORDER BY date), 0) - 1 AS b{n}" for n in (3, 10, 30))} FROM bench),
dev AS (SELECT l.symbol, l.date, {", ".join(f"m{n} - b{n} AS deviate_{n}d" for n in (3, 10, 30))} FROM (SELECT symbol, date, percent AS board, {", ".join(f"close / nullif({lagged('close', n)}, 0) - 1 AS m{n}" for n in (3, 10, 30))} FROM lim) l LEFT JOIN bl USING (board, date)),
near AS (SELECT *, greatest(abs(deviate_3d) / 0.2, abs(deviate_10d) / 1.0, abs(deviate_30d) / 2.0) AS nearness FROM dev)"""


@query(f"WITH {_DEV} SELECT symbol, date, {', '.join(f'{rnd(f'deviate_{n}d', 5)} AS deviate_{n}d' for n in (3, 10, 30))}, {rnd('nearness', 5)} AS nearness, CASE WHEN nearness >= 1 THEN 'over' WHEN nearness >= 0.8 THEN 'close' WHEN nearness >= 0.5 THEN 'half' WHEN nearness IS NOT NULL THEN 'far' END AS status FROM near")
def board_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = flagged(spark, sf_dir).select("symbol", "date", F.col("percent").alias("board"), "close")
    benchmark = panel.groupBy("board", "date").agg(F.avg("close").alias("bench"))
    out = market.proximity(market.deviations(panel, benchmark), {"deviate_3d": 0.2, "deviate_10d": 1.0, "deviate_30d": 2.0})
    return rounded(out.select("symbol", "date", *[f"deviate_{n}d" for n in (3, 10, 30)], "nearness", "status"), digits=5)


_FLOWS = f"""flows AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {rnd("sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END)", 2)} AS net FROM lineitem GROUP BY 1, 2),
stepped AS (SELECT *, CASE WHEN date_diff('day', {lagged("date")}, date) <= 7 THEN net - {lagged("net")} END AS step, {roll("sum", "net", 3)} AS net_3, {roll("sum", "net", 10)} AS net_10 FROM flows)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net weekly flow per supplier: what is sold less what comes back."""
    net = F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")))
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(net.alias("net"))
    return by.withColumn("net", even("net", 2))


@query(f"WITH {_FLOWS} SELECT symbol, date, net, {', '.join(f'{rnd(k, 2)} AS {k}' for k in ('step', 'net_3', 'net_10'))} FROM stepped")
def flow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.flow_sums(flows(spark, sf_dir), (3, 10), 7), digits=2)


@query(f"""WITH {_FLOWS}, r AS (SELECT symbol, date, {rnd("net_3", 2)} AS net_3 FROM stepped), p AS (SELECT *, 'in' AS side, CAST(row_number() OVER (PARTITION BY date ORDER BY net_3 DESC, symbol) AS INTEGER) AS place FROM r WHERE net_3 IS NOT NULL
  UNION ALL SELECT *, 'out', CAST(row_number() OVER (PARTITION BY date ORDER BY net_3, symbol) AS INTEGER) FROM r WHERE net_3 IS NOT NULL) SELECT date, side, place, symbol, net_3 FROM p WHERE place <= 5""")
def flow_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = market.flow_sums(flows(spark, sf_dir), (3,), 7).withColumn("net_3", even("net_3", 2))
    return market.top_and_bottom(summed, "net_3", 5).select("date", "side", "place", "symbol", "net_3")
