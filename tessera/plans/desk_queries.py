"""Queries of a trading desk, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import desk, indicators, market, screen
from tessera.plans.market_queries import _FLOWS, flows
from tessera.plans.panel import float_shares, membership, table, ticks
from tessera.plans.pattern_queries import EXIT_SQL
from tessera.plans.queries import BARS, MEMBERS, ROLL, SIGNAL_SQL, STRATEGY_SQL, even, lagged, query, rnd, roll, rolled, rounded, week

_TRADES = f"""{ROLL}, sg AS (SELECT symbol, date, close, coalesce({STRATEGY_SQL["bullish_alignment"]}, false) AS entry, coalesce({EXIT_SQL["bullish_alignment"]}, false) AS exit FROM rolled),
ah AS (SELECT *, coalesce(first(CASE WHEN exit THEN date END IGNORE NULLS) OVER w, lead(date, 10) OVER o) AS exit_date, coalesce(first(CASE WHEN exit THEN close END IGNORE NULLS) OVER w, lead(close, 10) OVER o) AS exit_close
  FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), o AS (PARTITION BY symbol ORDER BY date)),
tr AS (SELECT symbol, date AS entry_date, exit_date, close AS entry_close, exit_close, exit_close / nullif(close, 0) - 1 AS ret FROM ah WHERE entry AND exit_date IS NOT NULL)"""


def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = screen.evaluated(rolled(spark, sf_dir), {"s": screen.STRATEGIES["bullish_alignment"]})
    return panel.select("symbol", "date", "close", F.col("entry_s").alias("entry"), F.col("exit_s").alias("exit"))


@query(f"WITH {_TRADES} SELECT symbol, entry_date, exit_date, {rnd('ret', 5)} AS ret FROM tr")
def signal_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(desk.trades(signal_panel(spark, sf_dir), 10).select("symbol", "entry_date", "exit_date", "ret"), digits=5)


@query(f"""WITH {_TRADES} SELECT symbol, count(*) AS trades, {rnd("avg(CAST(ret - 0.001 > 0 AS DOUBLE))", 5)} AS win_rate, {rnd("avg(ret - 0.001)", 5)} AS mean_ret, {rnd("sum(greatest(ret - 0.001, 0)) / nullif(-sum(least(ret - 0.001, 0)), 0)", 4)} AS profit_factor,
  {rnd("avg(date_diff('day', entry_date, exit_date))", 4)} AS days, {rnd("max(ret - 0.001)", 5)} AS best, {rnd("min(ret - 0.001)", 5)} AS worst FROM tr GROUP BY 1""")
def symbol_trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = desk.trade_stats(desk.trades(signal_panel(spark, sf_dir), 10), "symbol", 0.001)
    four = ("profit_factor", "days")
    return out.select("symbol", "trades", *[even(c, 4 if c in four else 5).alias(c) for c in ("win_rate", "mean_ret", "profit_factor", "days", "best", "worst")])


@query(f"""WITH {BARS}, o AS (SELECT symbol, date, open / nullif({lagged("close")}, 0) - 1 AS gap, volume / nullif({roll("avg", "volume", 5, -1)}, 0) AS ratio, close / nullif(open, 0) - 1 AS same_day, {lagged("close").replace("lag(", "lead(")} / nullif(close, 0) - 1 AS next_day FROM bars)
  SELECT symbol, date, CASE WHEN gap >= 0.05 THEN 'up' ELSE 'down' END AS side, {", ".join(f"{rnd(k, 5)} AS {k}" for k in ("gap", "ratio", "same_day", "next_day"))} FROM o WHERE abs(gap) >= 0.05 AND ratio >= 1.5""")
def opening_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(desk.openings(week(spark, sf_dir), 0.05, 1.5).select("symbol", "date", "side", "gap", "ratio", "same_day", "next_day"), digits=5)


_SIGNALS = {"signal_ma_golden_5_20": 1, "signal_boll_breakout_upper": 2, "signal_n_day_high": 2, "signal_volume_surge": 3}
_IN_ORDER = sorted(_SIGNALS, key=lambda k: (_SIGNALS[k], k))


@query(f"""WITH {ROLL}, s AS (SELECT symbol, date, {rnd("change_pct", 6)} AS moved, {", ".join(f"coalesce({SIGNAL_SQL[k]}, false) AS {k}" for k in _SIGNALS)} FROM rolled), h AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in _IN_ORDER)}], lambda x: x IS NOT NULL) AS held, CASE {" ".join(f"WHEN {k} THEN {_SIGNALS[k]}" for k in _IN_ORDER)} END AS priority FROM s)
  SELECT symbol, date, held[1] AS signal, CAST(len(held) AS INTEGER) AS signals, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY date ORDER BY priority, abs(moved) DESC NULLS LAST, symbol) AS INTEGER) AS place FROM h WHERE priority IS NOT NULL""")
def signal_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = indicators.window_signals()
    panel = rolled(spark, sf_dir).select("symbol", "date", even("change_pct", 6).alias("moved"), *[F.coalesce(made[k], F.lit(False)).alias(k) for k in _SIGNALS])
    out = desk.strongest(panel, _SIGNALS, F.abs("moved").desc_nulls_last())
    return out.select("symbol", "date", "signal", F.size("held").alias("signals"), "priority", "place")


_GROUPS = """tk AS (SELECT user_id AS symbol, ts, value FROM events), gm AS (SELECT DISTINCT symbol, 'group' || (symbol % 12) AS member FROM tk)"""
_MEANS = f"""{_GROUPS}, sm AS (SELECT symbol, date_trunc('hour', ts) AS start, avg(value) AS m FROM tk GROUP BY 1, 2), mm AS (SELECT member, start, avg(m) AS mean, count(*) AS symbols FROM sm JOIN gm USING (symbol) GROUP BY 1, 2)"""


def groups(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", F.concat(F.lit("group"), F.col("symbol") % 12).alias("member")).distinct()


@query(f"""WITH {_MEANS}, of AS (SELECT *, mean - avg(mean) OVER (PARTITION BY start) AS off FROM mm), cr AS (SELECT *, off > 0 AND lag(off) OVER (PARTITION BY member ORDER BY start) <= 0 AS up FROM of),
  b AS (SELECT start, list(member ORDER BY -round(mean, 9), member)[1:5] AS leaders, count(*) FILTER (up) AS crossings FROM cr GROUP BY 1) SELECT start, array_to_string(leaders, ',') AS leaders, crossings, CASE WHEN lag(start) OVER (ORDER BY start) IS NOT NULL THEN CAST(len(list_intersect(leaders, lag(leaders) OVER (ORDER BY start))) AS INTEGER) END AS overlap FROM b""")
def hourly_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    out = desk.rotation_within(rows, groups(rows), "1 hour", 5)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.array_join("leaders", ",").alias("leaders"), "crossings", "overlap")


@query(f"""WITH {_MEANS}, s AS (SELECT member, start, symbols, CASE WHEN symbols >= 2 THEN mean END AS m FROM mm) SELECT member, start, symbols, {", ".join(f"{rnd(f'm / nullif(lag(m, {k}) OVER (PARTITION BY member ORDER BY start), 0) - 1', 5)} AS mom_{k}" for k in (1, 3, 5))} FROM s""")
def sector_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    out = desk.momentum_within(market.two_level_means(rows, groups(rows), "1 hour"), (1, 3, 5), 2)
    return rounded(out.select("member", F.col("start").cast("timestamp_ntz").alias("start"), "symbols", "mom_1", "mom_3", "mom_5"), digits=5)


@query("SELECT CAST(ts AS DATE) AS date, max(ts) AS last, count(*) FILTER (value > 0) AS quotes FROM events GROUP BY 1 HAVING strftime(max(ts), '%H:%M') < '23:55' AND count(*) FILTER (value > 0) > 0")
def unfinished_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.unfinished(ticks(spark, sf_dir), "23:55")


@query(f"""WITH {_FLOWS}, sp AS (SELECT s_suppkey AS symbol, DATE '1996-01-01' AS since, 2.0 AS ratio FROM supplier WHERE s_suppkey % 3 = 0), v AS (SELECT f.symbol, f.date, abs(net) + 1000 AS value, (abs(net) + 1000) / coalesce(CASE WHEN f.date >= since THEN ratio END, 1) AS adj FROM flows f LEFT JOIN sp ON sp.symbol = f.symbol),
  a AS (SELECT v.*, b.adj AS b30 FROM v ASOF LEFT JOIN (SELECT symbol, date AS at30, adj FROM v) b ON v.symbol = b.symbol AND v.date - 30 >= b.at30), c AS (SELECT a.*, b.adj AS b90 FROM a ASOF LEFT JOIN (SELECT symbol, date AS at90, adj FROM v) b ON a.symbol = b.symbol AND a.date - 90 >= b.at90)
  SELECT symbol, date, {rnd("adj / nullif(b30, 0) - 1", 5)} AS change_30d, {rnd("adj / nullif(b90, 0) - 1", 5)} AS change_90d FROM c""")
def share_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over 30 and 90 days of a quantity that a split doubled."""
    values = flows(spark, sf_dir).select("symbol", "date", (F.abs("net") + 1000).alias("value"))
    splits = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("symbol"), F.lit("1996-01-01").cast("date").alias("since"), F.lit(2.0).alias("ratio"))
    return rounded(desk.changed_since(values, (30, 90), splits).select("symbol", "date", "change_30d", "change_90d"), digits=5)


@query("""SELECT symbol, ts FROM (SELECT user_id AS symbol, ts, value, value > 20 AND NOT coalesce(lag(coalesce(value > 20, false)) OVER (PARTITION BY user_id ORDER BY ts), true) AS fired, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1 AND fired""")
def latest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.last_edges(ticks(spark, sf_dir).select("symbol", "ts", "value"), F.col("value") > 20).select("symbol", "ts")


@query(f"""WITH {BARS}, {MEMBERS}, r AS (SELECT symbol, round(avg(amount), 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) WHERE n <= 5 GROUP BY 1)
  SELECT member, symbol, {rnd("amount", 2)} AS amount, CAST(row_number() OVER (PARTITION BY member ORDER BY {rnd("amount", 2)} DESC, CAST(floor(abs(s_acctbal)) AS BIGINT) DESC, symbol) AS INTEGER) AS place FROM r JOIN mem USING (symbol) JOIN supplier ON s_suppkey = symbol""")
def sector_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = float_shares(spark, sf_dir).withColumnRenamed("float_shares", "cap")
    out = desk.member_ranks(week(spark, sf_dir), membership(spark, sf_dir), caps, 5)
    return out.select("member", "symbol", even("amount", 2).alias("amount"), "place")


@query("""WITH l AS (SELECT o_orderkey AS lot, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price FROM orders) SELECT lot, symbol, 'stop' AS kind, round(price * (1 - 0.08), 2) AS price, CAST(NULL AS DATE) AS until FROM l
  UNION ALL SELECT lot, symbol, 'target', round(price * (1 + 0.2), 2), NULL FROM l UNION ALL SELECT lot, symbol, 'date', NULL, date + 30 FROM l""")
def lot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lot"), F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))
    return rounded(desk.lot_rules(lots, 0.08, 0.2, 30), digits=2)


@query(f"""WITH {_GROUPS}, lb AS (SELECT symbol, date_trunc('hour', ts) AS start, last(value ORDER BY ts) AS value FROM tk GROUP BY 1, 2), g AS (SELECT f.symbol, b.start FROM (SELECT symbol, min(start) AS since FROM lb GROUP BY 1) f JOIN (SELECT DISTINCT start FROM lb) b ON b.start >= since),
  fl AS (SELECT g.symbol, g.start, last_value(value IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.start ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN lb USING (symbol, start)) SELECT member, start, round(avg(value), 5) AS mean, count(*) AS symbols FROM fl JOIN gm USING (symbol) GROUP BY 1, 2""")
def frozen_sector_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir)
    return rounded(desk.frozen_curve(rows, groups(rows), "1 hour"), digits=5).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH {BARS}, m AS (SELECT *, coalesce(close > {lagged("close")}, false) AS u, coalesce(close < {lagged("close")}, false) AS d FROM bars), i AS (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER w AS ui, sum(CASE WHEN d THEN 0 ELSE 1 END) OVER w AS di FROM m WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT symbol, date, CASE WHEN u THEN sum(CAST(u AS INTEGER)) OVER (PARTITION BY symbol, ui ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END - CASE WHEN d THEN sum(CAST(d AS INTEGER)) OVER (PARTITION BY symbol, di ORDER BY date ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM i),
  l AS (SELECT symbol, max(date) AS date, CAST(last(streak ORDER BY date) AS BIGINT) AS streak FROM k GROUP BY 1), {", ".join(f"p{g} AS (SELECT symbol, last(r ORDER BY p) AS {g} FROM (SELECT symbol, date_trunc('{g}', date) AS p, last(close ORDER BY date) / nullif(first(open ORDER BY date), 0) - 1 AS r FROM bars GROUP BY 1, 2) GROUP BY 1)" for g in ("month", "quarter"))}
  SELECT l.symbol, l.date, streak, {rnd("pmonth.month", 5)} AS month, {rnd("pquarter.quarter", 5)} AS quarter FROM l JOIN pmonth USING (symbol) JOIN pquarter USING (symbol)""")
def period_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = desk.period_snapshot(week(spark, sf_dir))
    return rounded(out.select("symbol", "date", F.col("streak").cast("long").alias("streak"), "month", "quarter"), digits=5)
