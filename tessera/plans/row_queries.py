"""Queries of filters, merges, values, rules and text, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.windows import Series
from tessera.operators import joins, rows, screen, text
from tessera.plans.market_queries import _FLOWS, flows
from tessera.plans.panel import float_shares, membership, table, ticks
from tessera.plans.queries import BARS, MEMBERS, ROLL, even, lagged, query, rnd, rolled, rounded, week
from tessera.sources import files
from tessera.streaming import events

# --- filters --------------------------------------------------------------------------------------------------------------------

_DIRTY = f"""{BARS}, dirty AS (SELECT symbol, date, CASE WHEN symbol % 9 = 0 THEN 0 ELSE open END AS open, CASE WHEN symbol % 9 = 0 THEN 0 ELSE high END AS high, low, close, CASE WHEN symbol % 7 = 0 THEN 0 ELSE volume END AS volume, CASE WHEN symbol % 7 = 0 THEN 0 WHEN symbol % 5 = 0 THEN amount * 3 ELSE amount * 100 END AS amount FROM bars)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with halted days and wrong amounts among them."""
    s = F.col("symbol")
    zero = lambda c, n: F.when(s % n == 0, 0.0).otherwise(F.col(c))
    amount = F.when(s % 7 == 0, 0.0).when(s % 5 == 0, F.col("amount") * 3).otherwise(F.col("amount") * 100)
    return week(spark, sf_dir).withColumns({"open": zero("open", 9), "high": zero("high", 9), "volume": zero("volume", 7), "amount": amount})


@query(f"WITH {_DIRTY} SELECT symbol, date, {rnd('close', 4)} AS close FROM dirty WHERE NOT ((open = 0 AND high = 0) OR (volume = 0 AND amount = 0))")
def traded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rows.traded(dirty(spark, sf_dir)).select("symbol", "date", "close"), digits=4)


@query(f"""WITH {_DIRTY}, i AS (SELECT *, amount / nullif(volume * 100, 0) AS v FROM dirty) SELECT symbol, date, {rnd("CASE WHEN coalesce(volume > 0 AND close > 0 AND v IS NOT NULL AND (abs(v / close - 1) > 0.2 OR (low > 0 AND high >= low AND (v < low * 0.97 OR v > high * 1.03))), false) THEN close * volume * 100 ELSE amount END", 2)} AS amount FROM i""")
def guarded_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dirty(spark, sf_dir).withColumn("amount", rows.sane_amount(*[F.col(c) for c in ("amount", "volume", "low", "high", "close")]))
    return out.select("symbol", "date", even("amount", 2).alias("amount"))


@query(f"""WITH {_DIRTY}, i AS (SELECT symbol, date, ((amount / nullif(volume * 100, 0)) / close - 1) * 100 AS bias FROM dirty) SELECT symbol, date, {rnd("bias * 0.01", 6)} AS vwap_bias FROM i WHERE bias IS NOT NULL""")
def scrubbed_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price over close, in percent made shares; divisions by 0 leave no NaN and no infinity."""
    raw = dirty(spark, sf_dir).withColumn("bias", F.try_divide(F.col("amount"), F.col("volume") * 100) / F.col("close") * 100 - 100)
    odd = raw.withColumn("bias", F.when(F.col("volume") == 0, F.when(F.col("symbol") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("bias")))
    clean = rows.scrubbed(odd).where("bias is not null")
    return clean.select("symbol", "date", even(rows.as_share(F.col("bias"), "percent"), 6).alias("vwap_bias"))


@query(f"WITH {ROLL} SELECT symbol, date, {rnd('close', 4)} AS close FROM rolled WHERE close > ma20 AND (volume >= 100 OR amount / close > 50) AND date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def condition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition written as text, within a range of dates."""
    inside = rolled(spark, sf_dir).where(F.col("date").between("1995-01-01", "1996-12-31"))
    return rows.condition(inside, "close > ma20 and (volume >= 100 or amount / close > 50)").select("symbol", "date", even("close", 4).alias("close"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def picked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.picked(table(spark, sf_dir, "orders"), ["o_orderstatus:F|P", "o_orderpriority:1-URGENT|2-HIGH"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"WITH {BARS}, {MEMBERS} SELECT symbol, date, {rnd('close', 4)} AS close FROM bars WHERE symbol IN (SELECT symbol FROM mem WHERE member IN ('ASIA', 'EUROPE', 'region_1', 'REGION_1')) AND symbol <> 3")
def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups, less those of an excluded set."""
    inside = rows.in_scope(week(spark, sf_dir), "group", groups=membership(spark, sf_dir), names=["ASIA", "EUROPE", "region_1", "REGION_1"])
    return inside.where("symbol <> 3").select("symbol", "date", even("close", 4).alias("close"))


@query(f"""WITH {ROLL}, {MEMBERS}, l AS (SELECT symbol, last(date ORDER BY date) AS date, last(close ORDER BY date) AS close, last(amount ORDER BY date) AS amount FROM rolled WHERE close >= 100 AND amount >= 1000 GROUP BY 1),
  p AS (SELECT member, symbol, row_number() OVER (PARTITION BY member ORDER BY {rnd("amount", 2)} DESC, symbol) AS n, {rnd("amount", 2)} AS amount FROM l JOIN mem USING (symbol)) SELECT member, symbol, amount FROM p WHERE n <= 2""")
def picks_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors of price and amount, the latest row of a symbol, two of each group."""
    passed = screen.basic_filter(rolled(spark, sf_dir), least_price=100, least_amount=1000)
    latest = joins.keep_last(passed, ["symbol"], ["date"]).select("symbol", even("amount", 2).alias("amount")).join(membership(spark, sf_dir), "symbol")
    return rows.capped(latest, "member", [F.col("amount").desc(), F.col("symbol")], 2).select("member", "symbol", "amount")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 50 OFFSET 20)")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.page(table(spark, sf_dir, "orders"), [("o_orderpriority", True), ("o_orderkey", False)], 20, 50).select("o_orderkey", even("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.counted(table(spark, sf_dir, "orders"), "o_orderpriority")


# --- sets and merges ------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000)
  SELECT k AS o_custkey, 'every' AS mode FROM (SELECT k FROM a INTERSECT SELECT k FROM b INTERSECT SELECT k FROM c) UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c)""")
def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    sources = [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), o.where("o_totalprice > 200000")]
    every, some = (rows.combined(sources, "o_custkey", x) for x in (True, False))
    return every.withColumn("mode", F.lit("every")).union(some.withColumn("mode", F.lit("any")))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = week(spark, sf_dir).select("symbol", "date", "close")
    return b.where("symbol % 3 <> 0 and date < '1997-01-01'"), b.where("date >= '1996-06-01'")


_H = f"""{BARS}, old AS (SELECT symbol, date, close FROM bars WHERE symbol % 3 <> 0 AND date < DATE '1997-01-01'), new AS (SELECT symbol, date, close FROM bars WHERE date >= DATE '1996-06-01')"""


@query(f"WITH {_H} SELECT symbol, date, {rnd('close', 4)} AS close FROM (SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.symbol = n.symbol AND o.date = n.date))")
def restored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return rounded(rows.restored(old, new, ["symbol", "date"]), digits=4)


@query(f"WITH {_H} SELECT symbol, date, {rnd('close', 4)} AS close FROM (SELECT * FROM old WHERE date < (SELECT min(date) FROM new) UNION ALL SELECT * FROM new)")
def merged_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rows.tail_merged(*_halves(spark, sf_dir), "date"), digits=4)


@query(f"WITH {_H} SELECT symbol, date, {rnd('close', 4)} AS close FROM (SELECT symbol, date, close + 1 AS close FROM new UNION ALL SELECT * FROM old o WHERE o.date NOT IN (SELECT date FROM new))")
def replaced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return rounded(rows.replaced(old, new.withColumn("close", F.col("close") + 1), ["date"]), digits=4)


@query(f"WITH {_H}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY p) AS n FROM (SELECT *, 0 AS p FROM (SELECT symbol, date, close * 2 AS close FROM new WHERE symbol % 2 = 0) UNION ALL SELECT *, 1 FROM old UNION ALL SELECT *, 2 FROM new)) SELECT symbol, date, {rnd('close', 4)} AS close FROM p WHERE n = 1")
def preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    first = new.where("symbol % 2 = 0").withColumn("close", F.col("close") * 2)
    return rounded(rows.preferred([first, old, new], ["symbol", "date"]), digits=4)


@query("""WITH t AS (SELECT o_custkey, o_orderstatus, o_orderkey FROM orders), old AS (SELECT * FROM t WHERE o_orderkey % 2 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM t WHERE o_orderkey % 2 = 1)
  SELECT * FROM old UNION ALL SELECT o_custkey, o_orderstatus, o_orderkey FROM n WHERE n = 1 AND (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM old)""")
def archive_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return rows.inserted(t.where("o_orderkey % 2 = 0"), t.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 5 = 0 THEN upper(d.lang) ELSE d.source END AS source, d.lang FROM documents d")
def filled_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    holes = d.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("source")))
    return rows.blanks_filled(holes, d.select("doc_id", F.upper("lang").alias("source")), ["doc_id"], ["source"])


@query(f"""WITH {BARS}, x AS (SELECT symbol, min(date) AS since FROM bars GROUP BY 1) SELECT d.date, x.symbol FROM x JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= since WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = x.symbol AND b.date = d.date)""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = week(spark, sf_dir).select("symbol", "date")
    return rows.missing_symbols(b, b.groupBy("symbol").agg(F.min("date").alias("since")))


@query(f"WITH {_DIRTY} SELECT date, count(*) AS rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (open IS NULL OR close IS NULL) AS with_null, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS wrong, count(*) - count(DISTINCT symbol) AS repeated FROM dirty GROUP BY 1")
def row_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.integrity(dirty(spark, sf_dir))


@query(f"WITH {BARS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) SELECT symbol, max(date) AS date, {rnd('max(CASE WHEN n = 1 THEN close END)', 4)} AS last_close, {rnd('max(CASE WHEN n = 2 THEN close END)', 4)} AS close_before FROM p WHERE n <= 2 GROUP BY 1")
def last_two_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rows.last_two(week(spark, sf_dir)), digits=4)


@query("WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT o_custkey, last FROM l WHERE last < (SELECT max(last) FROM l)")
def lagging_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.lagging(table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey")


@query("SELECT 'nation' AS asset_type, n_name AS name, CAST(n_nationkey AS BIGINT) AS key, n_regionkey AS up FROM nation UNION ALL SELECT 'region', r_name, r_regionkey, NULL FROM region")
def unified_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_regionkey").alias("up"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("key"))
    return files.unified({"nation": n, "region": r})


@query("""WITH a AS (SELECT o_custkey AS k, o_orderdate AS seen, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS x, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS y, o_orderkey FROM orders)
  SELECT k, last(x ORDER BY seen, o_orderkey) FILTER (x IS NOT NULL) AS x, last(y ORDER BY seen, o_orderkey) FILTER (y IS NOT NULL) AS y FROM a GROUP BY 1""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value that is not null of each column, over two sources."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    made = o.select(F.col("o_custkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("seen"), F.when(k % 3 != 0, k).alias("x"), F.when(k % 2 != 0, F.col("o_orderstatus")).alias("y"), k)
    return joins.merged([made.where("o_orderkey % 5 < 2"), made.where("o_orderkey % 5 >= 2")], ["k"], ["x", "y"], "seen").select("k", "x", "y")


# --- values ---------------------------------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT s_suppkey, ['60', 'SH60', '00', '30', '8x', '43'][s_suppkey % 6 + 1] || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || ['', '.sh', ''][s_suppkey % 3 + 1] AS code, CAST(s_suppkey AS VARCHAR) || ['.5万', '亿', '万亿', ',000', ' x'][s_suppkey % 5 + 1] AS paid FROM supplier),
  d AS (SELECT *, regexp_extract(code, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1) AS six FROM c)
  SELECT s_suppkey, CASE WHEN six <> '' THEN six || '.' || CASE WHEN six[1] IN ('6', '5') THEN 'SH' WHEN six[1] IN ('0', '1', '2', '3') THEN 'SZ' ELSE 'BJ' END END AS code,
    CASE s_suppkey % 5 WHEN 0 THEN (s_suppkey + 0.5) * 1e4 WHEN 1 THEN s_suppkey * 1e8 WHEN 2 THEN s_suppkey * 1e12 WHEN 3 THEN s_suppkey * 1000.0 END::DOUBLE AS paid FROM d""")
def codes_and_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    one = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (k % n + 1).cast("int"))
    code = F.concat(one(6, "60", "SH60", "00", "30", "8x", "43"), F.lpad((k % 10000).cast("string"), 4, "0"), one(3, "", ".sh", ""))
    paid = F.concat(k.cast("string"), one(5, ".5万", "亿", "万亿", ",000", " x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", rows.exchange_code(code).alias("code"), rows.money(paid).alias("paid"))


@query("""WITH m AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events) SELECT event_id, CASE WHEN m >= 570 AND m < 690 THEN 'morning' WHEN m >= 690 AND m < 780 THEN 'noon' WHEN m >= 780 AND m < 900 THEN 'afternoon' ELSE 'closed' END AS session,
  CAST(least(greatest(m - 570, 0), 120) + least(greatest(m - 780, 0), 120) AS INTEGER) AS elapsed FROM m""")
def trading_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rows.session(F.col("ts")).alias("session"), rows.elapsed_minutes(F.col("ts")).alias("elapsed"))


@query("SELECT s_suppkey, s_name, CASE WHEN starts_with(lower(s_name), 'supplier#00000000') THEN 0 ELSE 1 END AS rank FROM supplier WHERE lower(s_name) LIKE '%supplier#00000000%'")
def names_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.found_by_name(table(spark, sf_dir, "supplier"), "s_name", "Supplier#00000000").select("s_suppkey", "s_name", "rank")


@query(f"WITH {MEMBERS} SELECT symbol, string_agg(member, ',' ORDER BY CASE WHEN member IN ('ASIA', 'region_1') THEN 0 ELSE 1 END, member) AS labels FROM mem GROUP BY 1")
def member_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = membership(spark, sf_dir)
    both = named.withColumn("member", F.col("member"))
    return rows.joined_labels(both, ["ASIA", "region_1"]).select("symbol", "labels")


@query(f"""WITH {_FLOWS} SELECT f.symbol, min(f.date) AS date, first(net ORDER BY f.date, net) AS amount FROM flows f WHERE f.date >= DATE '1997-03-01' GROUP BY 1""")
def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.next_event(flows(spark, sf_dir).withColumnRenamed("net", "amount"), F.lit("1997-03-01").cast("date"))


@query(f"""WITH {_FLOWS}, h AS (SELECT symbol, date, CASE WHEN net > 0 THEN net END AS net FROM flows) SELECT symbol, last(net ORDER BY date) FILTER (net IS NOT NULL) AS net, max(date) FILTER (net IS NOT NULL) AS at FROM h GROUP BY 1""")
def latest_positive_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.latest_value(flows(spark, sf_dir).withColumn("net", F.when(F.col("net") > 0, F.col("net"))), "symbol", "net", "date")


@query(f"WITH {_FLOWS} SELECT symbol, date, CASE WHEN sign(net) = sign({lagged('net')}) THEN net END AS net FROM flows")
def agreed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Series().delay("net")
    return flows(spark, sf_dir).select("symbol", "date", rows.agreed(F.col("net"), before).alias("net"))


@query(f"WITH {_FLOWS}, d AS (SELECT date, sum(net) AS total FROM flows GROUP BY 1) SELECT date, {rnd('total', 2)} AS total, {rnd('total - lag(total) OVER (ORDER BY date)', 2)} AS change FROM d")
def flow_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rows.trend(flows(spark, sf_dir), "net"), digits=2)


@query("""WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5), e AS (SELECT event_id, ts - INTERVAL 10000 DAY AS ts FROM events), w AS (SELECT event_id, CASE WHEN hour(ts) >= 15 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS day FROM e)
  SELECT event_id, min(date) AS knowable FROM w LEFT JOIN c ON c.date >= w.day GROUP BY 1""")
def knowable_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event could be acted on: before the close on its day, else on the next day of the calendar."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().where(F.dayofweek("date").between(2, 6))
    e = table(spark, sf_dir, "events").select("event_id", F.expr("ts - interval 10000 days").alias("ts"))
    return rows.knowable(e, "ts", days).select("event_id", "knowable")


@query("""WITH m AS (SELECT event_id, date_trunc('hour', ts) AS start, value, event_id % 5 + 1 AS weight FROM events), t AS (SELECT start, sum(value) AS total FROM m GROUP BY 1) SELECT event_id, round(total * weight / nullif(sum(weight) OVER (PARTITION BY start), 0), 4) AS part FROM m JOIN t USING (start)""")
def competing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one hour share its sum by weight."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", "ts").alias("start"), "value", (F.col("event_id") % 5 + 1).alias("weight"))
    totals = e.groupBy("start").agg(F.sum("value").alias("total"))
    return rounded(rows.shares_of_weight(e.join(totals, "start"), ["start"], "weight", "total", "part").select("event_id", "part"), digits=4)


@query(f"""WITH {BARS}, n AS (SELECT s_suppkey AS symbol, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS value FROM supplier), k AS (SELECT symbol, n.value * CASE WHEN symbol % 4 = 0 THEN 1.2 ELSE 1.0 END AS value, (SELECT max(date) FROM bars) - CAST(symbol % 200 AS INTEGER) AS seen FROM n WHERE symbol % 7 <> 0)
  SELECT * FROM (SELECT n.symbol, CASE WHEN k.value IS NULL THEN 'missing' WHEN (SELECT max(date) FROM bars) - seen > 120 THEN 'old' WHEN abs(k.value / n.value - 1) > 0.05 THEN 'off' END AS why FROM n LEFT JOIN k USING (symbol)) WHERE why IS NOT NULL""")
def stale_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = float_shares(spark, sf_dir).withColumnRenamed("float_shares", "value")
    day = week(spark, sf_dir).agg(F.max("date").alias("today"))
    known = now.crossJoin(F.broadcast(day)).where("symbol % 7 <> 0")  # one row on the right
    known = known.select("symbol", (F.col("value") * F.when(F.col("symbol") % 4 == 0, 1.2).otherwise(1.0)).alias("value"), F.date_sub("today", (F.col("symbol") % 200).cast("int")).alias("at"), "today")
    return rows.stale(known, now, 0.05, 120, F.col("today"))


# --- rules and events -----------------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT user_id AS symbol, date_trunc('hour', ts) AS start, count(*) AS n, min(ts) AS first FROM events WHERE value > 20 GROUP BY 1, 2) SELECT start, CASE WHEN count(*) > 5 THEN NULL ELSE min(symbol) END AS symbol, CAST(sum(n) AS BIGINT) AS hits FROM h GROUP BY start, CASE WHEN (SELECT count(*) FROM h b WHERE b.start = h.start) > 5 THEN -1 ELSE symbol END""")
def collapsed_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.collapsed(ticks(spark, sf_dir).where("value > 20"), "1 hour", 5).select(F.col("start").cast("timestamp_ntz").alias("start"), "symbol", "hits")


_RULES = {"dear": ("value", ">", 60.0, None), "click": ("kind", "==", "click", "2024-01-10"), "cheap": ("value", "<", 2.0, None)}


@query("""SELECT event_id, 'dear' AS rule FROM events WHERE value > 60 UNION ALL SELECT event_id, 'click' FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' UNION ALL SELECT event_id, 'cheap' FROM events WHERE value < 2""")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value", F.col("event_type").alias("kind"))
    return events.rule_hits(e, _RULES, set(e.columns)).select("event_id", "rule")


@query("""WITH s AS (SELECT user_id AS symbol, ts, value, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events))
  SELECT symbol, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY symbol, k""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.sessions(ticks(spark, sf_dir), "6 hours"), digits=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT symbol, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id AS symbol, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def sliding_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.sliding(ticks(spark, sf_dir), "2 hours", "1 hour"), digits=4).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase') SELECT e.event_id, count(t.ts) AS ticks, round(sum(t.value), 4) AS flow, round(last(t.value ORDER BY t.ts) / nullif(e.value, 0) - 1, 5) AS moved FROM e LEFT JOIN events t ON t.user_id = e.user_id AND t.ts > e.ts AND t.ts <= e.ts + INTERVAL 48 HOUR GROUP BY e.event_id, e.value""")
def event_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed each purchase on its symbol within two days, after it and not before."""
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("symbol"), "ts", "value")
    out = events.confirmed(marks, ticks(spark, sf_dir), 48)
    return out.select("event_id", "ticks", even("flow", 4).alias("flow"), even("moved", 5).alias("moved"))


# --- text -----------------------------------------------------------------------------------------------------------------------

_LAYERS = {"wide": ["the", "und", "que", "les"], "narrow": ["thethe", "theand", "undder", "theing"]}


@query(f"""WITH dict AS (SELECT * FROM (VALUES {", ".join(f"('{layer}', '{w}')" for layer, ws in _LAYERS.items() for w in ws)}) AS v(layer, term)), d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
  SELECT doc_id, layer, last(term ORDER BY length(term), term) AS term FROM d JOIN dict ON contains(t, term) GROUP BY 1, 2""")
def layered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.layered(table(spark, sf_dir, "documents"), "doc_id", "text", _LAYERS)


#: A headline is the first sentence of the first line, whole.
HEADLINE = "^[^\\n.!?]*"


@query(r"""WITH h AS (SELECT min(doc_id) AS k, source, lower(trim(regexp_replace(regexp_replace(regexp_extract(coalesce(text, ''), '^[^\n.!?]*'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS head FROM documents GROUP BY source, 3),
  g AS (SELECT *, list_distinct(CASE WHEN length(head) >= 2 THEN list_transform(range(1, length(head)), lambda i: head[i:i + 1]) ELSE [head] END) AS g FROM h)
  SELECT least(a.k, b.k) AS a, greatest(a.k, b.k) AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.source = b.source AND a.k < b.k WHERE len(list_intersect(a.g, b.g)) >= 0.6 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))""")
def similar_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of one source whose headlines (first sentences) are alike."""
    return text.similar_headlines(table(spark, sf_dir, "documents").withColumn("head", F.regexp_extract("text", HEADLINE, 0)), "doc_id", "head", 0.6, ["source"])
