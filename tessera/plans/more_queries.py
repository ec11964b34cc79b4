"""Queries of joins to what was known, phases and news, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins, limits, market, screen, text
from tessera.plans.market_queries import _RATIOS, REGIME, changed, regimes
from tessera.plans.panel import float_shares, membership, table, ticks
from tessera.plans.row_queries import HEADLINE
from tessera.plans.pattern_queries import LADDER, flagged
from tessera.plans.queries import BARS, MEMBERS, ROLL, STRATEGY_SQL, even, query, rnd, rolled, rounded, week
from tessera.plans.research_queries import _REPORTS, reports

# --- joins to what was known ----------------------------------------------------------------------------------------------------

_HISTORY = f"""{BARS}, {_REPORTS}, his AS (SELECT symbol, announced AS since, shares + qkey % 7 * 10 AS float_shares FROM rep), cur AS (SELECT s_suppkey AS symbol, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS float_shares FROM supplier)"""


@query(f"""WITH {_HISTORY} SELECT b.symbol, b.date, CASE WHEN b.date = (SELECT max(date) FROM bars) THEN c.float_shares ELSE coalesce(h.float_shares, c.float_shares) END AS float_shares
  FROM bars b ASOF LEFT JOIN his h ON b.symbol = h.symbol AND b.date >= h.since LEFT JOIN cur c ON c.symbol = b.symbol""")
def shares_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = reports(spark, sf_dir).select("symbol", F.col("announced").alias("since"), (F.col("shares") + F.col("qkey") % 7 * 10).alias("float_shares"))
    return joins.shares_then(week(spark, sf_dir).select("symbol", "date"), history, float_shares(spark, sf_dir)).select("symbol", "date", "float_shares")


@query(f"""WITH {BARS}, {MEMBERS}, {_REPORTS} SELECT b.symbol, b.date, r.orders, m.label FROM bars b ASOF LEFT JOIN (SELECT symbol, announced, orders FROM rep) r ON b.symbol = r.symbol AND b.date >= r.announced LEFT JOIN (SELECT symbol, min(member) AS label FROM mem GROUP BY 1) m ON m.symbol = b.symbol""")
def extension_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of a time series, as of the date, and one of a snapshot."""
    series = reports(spark, sf_dir).select("symbol", F.col("announced").alias("date"), "orders")
    snapshot = membership(spark, sf_dir).groupBy("symbol").agg(F.min("member").alias("label"))
    dated = joins.with_extension(week(spark, sf_dir).select("symbol", "date"), series, ["orders"], dated=True)
    return joins.with_extension(dated, snapshot, ["label"], dated=False).select("symbol", "date", "orders", "label")


@query("""WITH f AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS date, 1.01 AS factor FROM events WHERE user_id % 3 = day(ts) % 3), c AS (SELECT symbol, date, exp(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS cum FROM f),
  e AS (SELECT event_id, user_id AS symbol, CAST(ts AS DATE) AS day, value FROM events) SELECT e.event_id, round(e.value * coalesce(c.cum, 1), 4) AS adjusted FROM e ASOF LEFT JOIN c ON e.symbol = c.symbol AND e.day >= c.date""")
def adjusted_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("symbol"), "ts", "value")
    factors = e.select("symbol", F.to_date("ts").alias("date")).distinct().where(F.col("symbol") % 3 == F.dayofmonth("date") % 3).withColumn("factor", F.lit(1.01))
    return rounded(joins.adjusted_ticks(e, factors).select("event_id", "adjusted"), digits=4)


@query("""WITH c AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS six FROM supplier), f AS (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS net FROM lineitem GROUP BY 1) SELECT s_suppkey, net FROM c LEFT JOIN f ON lpad(CAST(l_suppkey AS VARCHAR), 6, '0') = six""")
def joined_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes written in two ways, joined by their digits."""
    six = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(six("s_suppkey"), F.lit(".SH")).alias("code"))
    b = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("net")).select(F.concat(F.lit("sh"), six("l_suppkey")).alias("other"), even("net", 2).alias("net"))
    return joins.by_code(a, b, "code", "other").select("s_suppkey", "net")


@query(f"""WITH {REGIME}, {ROLL[ROLL.index("one AS (SELECT *,"):].replace("one AS (", "one_r AS (", 1).replace("FROM one)", "FROM one_r)")}, st AS (SELECT date, lag(state) OVER (ORDER BY date) AS s FROM reg), en AS (SELECT symbol, date FROM rolled WHERE {STRATEGY_SQL["bullish_alignment"]}) SELECT symbol, date, s AS state_before FROM en JOIN st USING (date) WHERE s IN ('strong', 'lean_strong', 'range')""")
def regime_filtered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on days that follow a day of an allowed state."""
    entries = screen.evaluated(rolled(spark, sf_dir), {"s": screen.STRATEGIES["bullish_alignment"]}).where("entry_s").select("symbol", "date")
    known = market.day_before(regimes(spark, sf_dir), "state").select("date", "state_before")
    return entries.join(known, "date").where(F.col("state_before").isin("strong", "lean_strong", "range")).select("symbol", "date", "state_before")


# --- phases ---------------------------------------------------------------------------------------------------------------------

_ORDERED = " ".join(f"WHEN {c} THEN '{n}'" for n, c in market.PHASES)
_PHASES = f"""WITH RECURSIVE {LADDER}, {REGIME[REGIME.index("one AS ("):]}, sealed AS (SELECT date, count(*) FILTER (signal_limit_up) / nullif(count(*) FILTER (signal_limit_up) + count(*) FILTER (signal_broken_limit_up), 0) AS seal FROM lim GROUP BY 1),
d0 AS (SELECT l.date, state, CAST(max_boards AS DOUBLE) AS height, CAST(first_board AS DOUBLE) AS first, CAST(ge2_count AS DOUBLE) AS ge2, last_value(CASE WHEN promo_pool >= 10 THEN promo_ok / promo_pool END IGNORE NULLS) OVER (ORDER BY l.date ROWS UNBOUNDED PRECEDING) AS promotion, seal, row_number() OVER (ORDER BY l.date) AS i
  FROM ladder l JOIN sealed USING (date) JOIN reg USING (date)),
sm AS (SELECT * FROM d0 WHERE i = 1 UNION ALL SELECT d.date, d.state, {", ".join(f"CASE WHEN s.{k} IS NULL THEN d.{k} ELSE coalesce(d.{k} * CAST({market.NEWEST!r} AS DOUBLE) + s.{k} * CAST({1 - market.NEWEST!r} AS DOUBLE), s.{k}) END" for k in ("height", "first", "ge2", "promotion", "seal"))}, d.i FROM sm s JOIN d0 d ON d.i = s.i + 1),
s5 AS (SELECT *, coalesce(lag(ge2, 5) OVER (ORDER BY i), first_value(ge2) OVER (ORDER BY i)) AS ge2_5, coalesce(lag(height, 5) OVER (ORDER BY i), first_value(height) OVER (ORDER BY i)) AS height_5 FROM sm),
rw AS (SELECT i, date, CASE WHEN raw IN ('climax', 'rally', 'ignite') AND state IN ('weak', 'lean_weak') THEN 'repair' ELSE raw END AS raw FROM (SELECT *, CASE {_ORDERED} ELSE 'repair' END AS raw FROM s5)),
cf AS (SELECT i, date, raw AS now, CAST(NULL AS VARCHAR) AS next, 0 AS run FROM rw WHERE i = 1
  UNION ALL SELECT r.i, r.date, CASE WHEN raw <> now AND CASE WHEN raw = next THEN run + 1 ELSE 1 END >= 2 THEN raw ELSE now END, CASE WHEN raw <> now AND CASE WHEN raw = next THEN run + 1 ELSE 1 END < 2 THEN raw END, CASE WHEN raw <> now AND CASE WHEN raw = next THEN run + 1 ELSE 1 END < 2 THEN CASE WHEN raw = next THEN run + 1 ELSE 1 END ELSE 0 END FROM cf JOIN rw r ON r.i = cf.i + 1)"""


@query(f"{_PHASES} SELECT date, now AS phase FROM cf")
def market_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.windows import safe_div

    panel = changed(spark, sf_dir)
    up, broken = F.sum(F.col("signal_limit_up").cast("int")), F.sum(F.col("signal_broken_limit_up").cast("int"))
    sealed = panel.groupBy("date").agg(safe_div(up, up + broken).alias("seal"))
    daily = limits.ladder(flagged(spark, sf_dir)).join(sealed, "date").join(regimes(spark, sf_dir).select("date", "state"), "date")
    return market.phases(daily)


@query(f"""WITH RECURSIVE {_RATIOS}, bd AS (SELECT CASE WHEN v <= 1.53761 THEN 'low' WHEN v <= 1.67424 THEN 'mid' ELSE 'high' END AS band, row_number() OVER (ORDER BY date) AS i FROM vs WHERE v IS NOT NULL),
  w AS (SELECT i, band AS held, CAST(NULL AS VARCHAR) AS next, 0 AS run FROM bd WHERE i = 1 UNION ALL SELECT b.i, CASE WHEN band = held OR CASE WHEN band = next THEN run + 1 ELSE 1 END >= 3 THEN band ELSE held END, CASE WHEN band <> held AND CASE WHEN band = next THEN run + 1 ELSE 1 END < 3 THEN band END, CASE WHEN band <> held AND CASE WHEN band = next THEN run + 1 ELSE 1 END < 3 THEN CASE WHEN band = next THEN run + 1 ELSE 1 END ELSE 0 END FROM w JOIN bd b ON b.i = w.i + 1)
  SELECT CASE WHEN run > 0 THEN run END AS days FROM w ORDER BY i DESC LIMIT 1""")
def breadth_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.confirming_days(market.breadth_series(market.breadth(rolled(spark, sf_dir))))


# --- news -----------------------------------------------------------------------------------------------------------------------

_NAMES = ["there", "the", "und", "ander", "de", "que"]
_BY_NAME = "|".join(_NAMES)


@query(f"SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_BY_NAME}')) AS name FROM documents) GROUP BY 1, 2")
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.named(table(spark, sf_dir, "documents"), "doc_id", "text", _NAMES)


@query(f"""WITH m AS (SELECT doc_id, source, name, count(*) AS n FROM (SELECT doc_id, source, unnest(regexp_extract_all(coalesce(text, ''), '{_BY_NAME}')) AS name FROM documents) GROUP BY ALL), s AS (SELECT name, source, CASE WHEN doc_id >= last // 2 THEN 'now' ELSE 'before' END AS w, 1 + ln(sum(n)) AS s FROM m CROSS JOIN (SELECT max(doc_id) AS last FROM documents) GROUP BY 1, 2, 3),
  b AS (SELECT name, coalesce(sum(s) FILTER (w = 'now'), 0) AS score, coalesce(sum(s) FILTER (w = 'before'), 0) AS baseline FROM s GROUP BY 1) SELECT name, round(score, 5) AS score, round(baseline, 5) AS baseline, round(score / (baseline + 1), 5) AS growth FROM b""")
def mention_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    found = text.named(docs, "doc_id", "text", _NAMES).join(docs.select("doc_id", "source"), "doc_id").withColumnRenamed("doc_id", "at")
    return rounded(text.growth(found, last // 2, last), digits=5)


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS media FROM documents) SELECT min(doc_id) AS doc_id, CASE WHEN length(regexp_replace(t, '\s+', '', 'g')) < 400 AND media <> '' THEN sha256(media) ELSE sha256(lower(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))) END AS fp FROM t GROUP BY 2""")
def media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts are known by their media."""
    docs = table(spark, sf_dir, "documents").withColumn("media", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""))
    marked = docs.select("doc_id", text.source_fingerprint(F.col("text"), F.col("media"), 400).alias("fp"))
    return marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fp")


_HEAD = r"lower(trim(regexp_replace(regexp_replace(regexp_extract(coalesce(text, ''), '^[^\n.!?]*'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.lower(text.clean(F.regexp_extract("text", HEADLINE, 0)))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", head.alias("head"), F.timestamp_seconds(F.col("doc_id") * 60).alias("ts"))


@query(f"""WITH RECURSIVE h AS (SELECT doc_id, lang, {_HEAD} AS head FROM documents), g AS (SELECT *, list_distinct(CASE WHEN length(trim(head)) >= 2 THEN list_transform(range(1, length(trim(head))), lambda i: trim(head)[i:i + 1]) ELSE [trim(head)] END) AS g FROM h),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.lang = b.lang AND a.doc_id < b.doc_id AND (b.doc_id - a.doc_id) * 60 <= 6000 WHERE len(list_intersect(a.g, b.g)) >= 0.6 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))),
  w AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT doc_id, doc_id AS l FROM h UNION SELECT w.b, r.l FROM r JOIN w ON w.a = r.doc_id) SELECT doc_id, min(l) AS cluster FROM r GROUP BY 1""")
def news_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of one language that are alike and close in time, put together."""
    heads = _heads(spark, sf_dir)
    pairs = text.pairs_in_time(heads, "doc_id", "head", "ts", 6000, 0.6, ["lang"])
    return text.clusters(heads.select(F.col("doc_id").alias("key")), pairs).select(F.col("key").alias("doc_id"), "cluster")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'the_') OR contains(lower(coalesce(text, '')), '100%') OR contains(lower(coalesce(source, '')), '100%')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return text.search(docs, ["text", "source"], "100%").select("doc_id").union(text.search(docs, ["text"], "the_").select("doc_id")).distinct()


@query("SELECT source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id BETWEEN (SELECT max(doc_id) // 10 FROM documents) AND (SELECT max(doc_id) * 6 // 10 FROM documents) GROUP BY 1")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    rows = docs.where(F.col("doc_id").between(last // 10, last * 6 // 10))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_chars").alias("chars"))
