"""Queries of factor research and fundamentals, each beside its SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.formula import with_formulas
from tessera.functions.windows import clamp, safe_div
from tessera.operators import factor_test, fundamentals, joins, market, mining, screen, statistics
from tessera.plans.market_queries import REGIME, regimes
from tessera.plans.panel import float_shares, table
from tessera.plans.pattern_queries import LIMITS, flagged
from tessera.plans.queries import AVG_RANK, BARS, FORWARD, NAV, RANKED, ROLL, even, forward, lagged, nav, over, query, rnd, rolled, rounded, week

# --- correlations with returns --------------------------------------------------------------------------------------------------

_H = """SELECT date, symbol, 1 AS horizon, momentum_20d AS x, fwd_1 AS y FROM fwd UNION ALL SELECT date, symbol, 5, momentum_20d, fwd_5 FROM fwd"""


def _rank(x: str, *by: str) -> str:
    p = ", ".join(by)
    return f"(rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count({x}) OVER (PARTITION BY {p}, {x}) - 1) / 2)"


@query(f"""WITH {FORWARD}, h AS (SELECT * FROM ({_H}) WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT date, horizon, {_rank("x", "date", "horizon")} AS a, {_rank("y", "date", "horizon")} AS b FROM h),
  d AS (SELECT date, horizon, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k GROUP BY 1, 2) SELECT horizon, round(avg(ic), 6) AS ic_mean, count(ic) AS n_dates FROM d GROUP BY 1""")
def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.ic_decay(forward(spark, sf_dir), "momentum_20d", {1: "fwd_1", 5: "fwd_5"}))


@query(f"""WITH {RANKED}, {REGIME[REGIME.index("listed AS"):].replace("one AS (SELECT *,", "one_l AS (SELECT *,").replace("FROM one GROUP BY", "FROM one_l GROUP BY")}, st AS (SELECT date, lag(state) OVER (ORDER BY date) AS s FROM reg)
  SELECT CASE WHEN s IN ('strong', 'lean_strong') THEN 'strong' WHEN s = 'range' THEN 'range' ELSE 'weak' END AS level, round(avg(ic), 6) AS ic_mean, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS ic_ir, round(avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) AS days FROM ic JOIN st USING (date) WHERE ic IS NOT NULL AND s IS NOT NULL GROUP BY 1""")
def regime_conditioned_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = factor_test.ic(forward(spark, sf_dir), "momentum_20d", "fwd_1")
    return rounded(factor_test.regime_ic(daily, market.day_before(regimes(spark, sf_dir), "state")))


def _pair(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, avg(ic) AS corr FROM (SELECT date, covar_samp(p, q) / nullif(stddev_samp(p) * stddev_samp(q), 0) AS ic FROM (SELECT date, {_rank("x", "date")} AS p, {_rank("y", "date")} AS q
  FROM (SELECT date, {a} AS x, {b} AS y, FROM rolled WHERE {a} IS NOT NULL AND {b} IS NOT NULL) WHERE date IN (SELECT date FROM rolled WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {a}) >= 3)) GROUP BY 1)"""


FACTORS = ["momentum_20d", "momentum_10d", "annual_vol_20d"]


@query(f"WITH {ROLL}, c AS ({' UNION ALL '.join(_pair(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :])}) SELECT a, b, round(corr, 6) AS corr FROM c")
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mining.pair_correlations(rolled(spark, sf_dir), FACTORS).select("a", "b", "corr"))


MINED = ["momentum_5d", "momentum_10d", "momentum_20d", "momentum_30d", "momentum_60d", "annual_vol_20d", "vol_ratio_5d", "amplitude", "change_pct", "change_amount", "ma5", "ma20", "ma60", "boll_upper"]
#: Values by name, pairs of them on the rows that have both, ranks within date and pair.
_PAIRS = f"""l AS (UNPIVOT (SELECT symbol, date, {", ".join(MINED)} FROM rolled) ON {", ".join(MINED)} INTO NAME f VALUE x),
p AS (SELECT a.date, a.f AS a, b.f AS b, a.x AS x, b.x AS y FROM l a JOIN l b ON a.symbol = b.symbol AND a.date = b.date AND list_position({MINED}, a.f) < list_position({MINED}, b.f)),
pr AS (SELECT date, a, b, x, {_rank("x", "date", "a", "b")} AS p, {_rank("y", "date", "a", "b")} AS q FROM p),
pd AS (SELECT date, a, b, count(*) AS n, CASE WHEN count(DISTINCT x) >= 3 THEN covar_samp(p, q) / nullif(stddev_samp(p) * stddev_samp(q), 0) END AS ic FROM pr GROUP BY ALL),
pc AS MATERIALIZED (SELECT a, b, avg(ic) AS corr, count(ic) AS n_dates, CAST(coalesce(sum(n) FILTER (ic IS NOT NULL), 0) AS BIGINT) AS n FROM pd GROUP BY ALL)"""


@query(f"WITH {ROLL}, {_PAIRS} SELECT a, b, round(corr, 6) AS corr, n_dates, n FROM pc")
def all_pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mining.pair_correlations(rolled(spark, sf_dir), MINED))


_CLUSTER_OVER = 0.5


@query(f"""WITH RECURSIVE {ROLL}, {_PAIRS}, w AS (SELECT a AS f, corr AS c FROM pc WHERE corr IS NOT NULL UNION ALL SELECT b, corr FROM pc WHERE corr IS NOT NULL),
  o AS (SELECT f, row_number() OVER (ORDER BY {rnd("max(abs(c))")} DESC, f) AS i FROM w GROUP BY 1),
  m AS (SELECT map(list(a || ' ' || b), list(corr)) AS m FROM (SELECT a, b, corr FROM pc UNION ALL SELECT b, a, corr FROM pc)),
  g AS (SELECT 0 AS i, CAST(NULL AS VARCHAR) AS f, CAST([] AS VARCHAR[]) AS heads, CAST(NULL AS VARCHAR) AS head
    UNION ALL SELECT o.i, o.f, CASE WHEN h IS NULL THEN list_append(heads, o.f) ELSE heads END, coalesce(h, o.f)
    FROM (SELECT o.i, o.f, g.heads, list_filter(g.heads, lambda x: coalesce(abs(m[x || ' ' || o.f]) >= {_CLUSTER_OVER}, false))[1] AS h FROM g JOIN o ON o.i = g.i + 1 CROSS JOIN m) o)
  SELECT i AS place, g.f AS factor, head AS representative, CASE WHEN g.f <> head THEN {rnd("m[head || ' ' || g.f]")} END AS rho FROM g CROSS JOIN m WHERE i > 0""")
def factor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors, the most related first, each put to the first representative that it is correlated with."""
    pairs = mining.pair_correlations(rolled(spark, sf_dir), MINED).persist()
    known = pairs.where("corr is not null")
    most = known.select(F.col("a").alias("f"), "corr").union(known.select("b", "corr")).groupBy("f").agg(even(F.max(F.abs("corr"))).alias("most"))
    order = [r["f"] for r in most.orderBy(F.desc("most"), "f").collect()]
    placed = mining.greedy_clusters(pairs, order, _CLUSTER_OVER)
    pairs.unpersist()
    rows = [(i, p.factor, p.representative, p.rho) for i, p in enumerate(placed, 1)]
    return rounded(spark.createDataFrame(rows, "place long, factor string, representative string, rho double"))


_BEAM = ["annual_vol_20d", "momentum_20d", "vol_ratio_5d"]
_TRIES = [(s, w) for k in (1, 2, 3) for s in combinations(_BEAM, k) for w in ([(1,)] if k == 1 else [(1,) * k, *[tuple(2 if i == j else 1 for i in range(k)) for j in range(k)]])]


def _tried(names: tuple[str, ...], weights: tuple[int, ...], way: str) -> str:
    """The blend of one combination on the rows that have all of it; ``way`` tells the sign of a factor."""
    all_ = " AND ".join(f"{f} IS NOT NULL" for f in (*names, "fwd_1"))
    blend = " + ".join(f"{w} * {way.format(f)} * {_rank(f, 'date')}" for f, w in zip(names, weights, strict=True))
    return f"SELECT '{','.join(names)}' AS factors, '{','.join(map(str, weights))}' AS weights, date, {blend} AS x, fwd_1 AS y FROM fwd WHERE {all_}"


def _measured(no: str, of: str) -> str:
    return f"""k{no} AS (SELECT *, {_rank("x", "factors", "weights", "date")} AS a, {_rank("y", "factors", "weights", "date")} AS b FROM ({of})),
  d{no} AS (SELECT factors, weights, date, count(*) AS n, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k{no} GROUP BY ALL HAVING count(*) >= 3),
  e{no} AS MATERIALIZED (SELECT factors, weights, avg(ic) AS ic, coalesce(avg(ic) / CASE WHEN stddev_pop(ic) > 1e-12 THEN stddev_pop(ic) END, 0) AS ir, CAST(sum(n) AS BIGINT) AS observations, count(*) AS dates FROM d{no} WHERE ic IS NOT NULL GROUP BY ALL)"""


_WAY = "(SELECT CASE WHEN ic >= 0 THEN 1 ELSE -1 END FROM e1 WHERE factors = '{}')"


@query(f"""WITH {FORWARD}, {_measured("1", " UNION ALL ".join(_tried(s, w, "1") for s, w in _TRIES if len(s) == 1))},
  {_measured("2", " UNION ALL ".join(_tried(s, w, _WAY) for s, w in _TRIES if len(s) > 1))}
  SELECT factors, weights, round(rank_ic, 6) AS rank_ic, round(ir, 6) AS ir, observations, dates FROM (SELECT factors, weights, abs(ic) AS rank_ic, abs(ir) AS ir, observations, dates FROM e1 UNION ALL SELECT * FROM e2)""")
def factor_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of three factors that the search may keep; the SQL tries them all."""
    best = mining.beam_search(forward(spark, sf_dir), _BEAM, "fwd_1")
    rows = [(",".join(c.factors), ",".join(map(str, c.weights)), c.rank_ic, c.ir, c.observations, c.dates) for c in best]
    return rounded(spark.createDataFrame(rows, "factors string, weights string, rank_ic double, ir double, observations long, dates long"))


_WALKED = ["annual_vol_20d", "momentum_10d", "momentum_60d", "vol_ratio_5d"]
#: Dates of a fold's training and test and how far it moves on; the same of inner folds; dates left out between.
_FOLDS = {"train": 100, "test": 30, "step": 30, "inner_train": 40, "inner_test": 20, "inner_step": 20, "purge": 5}
_WALK = f"""dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM fwd)),
  fo AS (SELECT DISTINCT unnest(range(0, n - 135 + 1, 30)) AS s FROM dn WHERE n >= 135),
  sp AS (SELECT s // 30 AS fold, CAST(NULL AS BIGINT) AS inn, s AS a, s + 100 AS b, s + 105 AS c, s + 135 AS d FROM fo UNION ALL SELECT s // 30, j, s + 20 * j, s + 20 * j + 40, s + 20 * j + 45, s + 20 * j + 65 FROM fo, range(0, 2) AS r(j)),
  u AS (SELECT date, f AS factor, x, y FROM (UNPIVOT (SELECT symbol, date, fwd_1 AS y, {", ".join(_WALKED)} FROM fwd) ON {", ".join(_WALKED)} INTO NAME f VALUE x) WHERE y IS NOT NULL),
  rk AS (SELECT date, factor, x, {_rank("x", "date", "factor")} AS p, {_rank("y", "date", "factor")} AS q FROM u),
  ic AS (SELECT date, factor, covar_samp(p, q) / nullif(stddev_samp(p) * stddev_samp(q), 0) AS ic FROM rk GROUP BY ALL HAVING count(DISTINCT x) >= 3),
  pa AS (SELECT fold, inn, factor, avg(ic) FILTER (i >= a AND i < b) AS seen, avg(ic) FILTER (i >= c AND i < d) AS unseen, count(*) FILTER (i >= c AND i < d) AS days FROM sp JOIN dn ON i >= a AND i < d JOIN ic USING (date) WHERE ic IS NOT NULL GROUP BY ALL),
  wy AS (SELECT *, CASE WHEN seen >= 0 THEN 1 ELSE -1 END AS way FROM pa WHERE seen IS NOT NULL),
  inn AS (SELECT fold, factor, avg(unseen * way) AS inner_ic, count(*) AS inner_folds FROM wy WHERE inn IS NOT NULL AND unseen IS NOT NULL GROUP BY ALL),
  be AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(inner_ic, 9) DESC, factor) AS k FROM inn),
  wk AS (SELECT be.fold, be.factor, inner_ic, inner_folds, seen * way AS train_ic, unseen * way AS test_ic, days FROM be LEFT JOIN wy ON wy.fold = be.fold AND wy.factor = be.factor AND wy.inn IS NULL WHERE k = 1)"""


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = forward(spark, sf_dir)
    daily = mining.daily_correlations(panel, _WALKED, against=["fwd_1"]).select("date", F.col("a").alias("factor"), "ic")
    return factor_test.walk_forward(daily, factor_test.nested_folds(panel.select("date"), **_FOLDS))


@query(f"WITH {FORWARD}, {_WALK} SELECT fold, factor, {rnd('inner_ic')} AS inner_ic, inner_folds, {rnd('train_ic')} AS train_ic, {rnd('test_ic')} AS test_ic, days FROM wk")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor that each fold's inner folds choose, and what it did on the dates after the fold."""
    return rounded(walked(spark, sf_dir))


@query(f"""WITH {FORWARD}, {_WALK} SELECT count(test_ic) AS folds, {rnd("avg(test_ic)")} AS test_ic, {rnd("avg(test_ic) / nullif(stddev_pop(test_ic), 0)")} AS test_ir, {rnd("avg(CASE WHEN test_ic > 1e-9 THEN 1.0 WHEN test_ic IS NOT NULL THEN 0.0 END)")} AS win_rate,
  {rnd("avg(test_ic) / nullif(avg(inner_ic), 0)")} AS kept FROM wk""")
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.out_of_sample(walked(spark, sf_dir)))


@query(f"""WITH {FORWARD}, r AS (SELECT date, fwd_1 AS y, round({_rank("momentum_20d", "date")} / count(*) OVER (PARTITION BY date) * 0.6 + {_rank("vol_ratio_5d", "date")} / count(*) OVER (PARTITION BY date) * 0.4, 12) AS x FROM fwd WHERE momentum_20d IS NOT NULL AND vol_ratio_5d IS NOT NULL AND fwd_1 IS NOT NULL),
  k AS (SELECT date, {AVG_RANK.format(x="x")} AS a, {AVG_RANK.format(x="y")} AS b FROM r WHERE date IN (SELECT date FROM r GROUP BY 1 HAVING count(DISTINCT x) >= 2))
  SELECT date, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 6) AS ic, count(*) AS n FROM k GROUP BY 1""")
def proxy_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.proxy_ic(forward(spark, sf_dir), {"momentum_20d": 0.6, "vol_ratio_5d": 0.4}, "fwd_1"))


@query(f"""WITH {BARS}, cal AS (SELECT date, lead(date, 1) OVER o AS d1, lead(date, 2) OVER o AS d2, lead(date, 6) OVER o AS d6 FROM (SELECT DISTINCT date FROM bars) WINDOW o AS (ORDER BY date))
  SELECT a.symbol, a.date, round(c.close / nullif(b.close, 0) - 1, 6) AS fwd_1, round(d.close / nullif(b.close, 0) - 1, 6) AS fwd_5 FROM bars a JOIN cal USING (date) LEFT JOIN bars b ON b.symbol = a.symbol AND b.date = d1 LEFT JOIN bars c ON c.symbol = a.symbol AND c.date = d2 LEFT JOIN bars d ON d.symbol = a.symbol AND d.date = d6""")
def lagged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns from the date after to 1 and 5 dates after that."""
    return rounded(joins.forward_return(week(spark, sf_dir), [1, 5], lag=1).select("symbol", "date", "fwd_1", "fwd_5"))


# --- robust statistics ----------------------------------------------------------------------------------------------------------


def _nw(source: str, by: str, order: str, x: str, lag: int) -> str:
    apart = ", ".join(f"c * lag(c, {k}) OVER w AS g{k}" if k else "c * c AS g0" for k in range(lag + 1))
    total = "sum(g0)" + "".join(f" + 2 * {1 - k / (lag + 1)!r} * coalesce(sum(g{k}), 0)" for k in range(1, lag + 1))
    return f"""nwc AS (SELECT {by} AS k, {order} AS o, {x} - avg({x}) OVER (PARTITION BY {by}) AS c, avg({x}) OVER (PARTITION BY {by}) AS m, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {x} IS NOT NULL),
nwg AS (SELECT k, m, n, {apart} FROM nwc WINDOW w AS (PARTITION BY k ORDER BY o)), nwv AS (SELECT k, any_value(n) AS n, any_value(m) AS mean, greatest(({total}) / any_value(n), 0) AS v FROM nwg GROUP BY 1),
nw AS (SELECT k, n, mean, CASE WHEN n > {lag + 2} AND n >= 3 AND v > 0 THEN sqrt(v / n) END AS error FROM nwv)"""


_T = "(1 / (1 + 0.2316419 * abs({x})))"


def _cdf(x: str) -> str:
    t = _T.format(x=x)
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


@query(f"""WITH {RANKED}, yic AS (SELECT CAST(year(date) AS INTEGER) AS year, date, ic FROM ic), {_nw("yic", "year", "date", "ic", 3)}, p AS (SELECT *, mean / error AS t, 2 * (1 - {_cdf("abs(mean / error)")}) AS p FROM nw),
  o AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST) AS place, count(p) OVER () AS m FROM p), q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(p * m / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM o)
  SELECT k AS year, n, round(mean, 6) AS mean, round(error, 6) AS error, round(t, 4) AS t, round(p, 6) AS p, round(q, 6) AS q FROM q""")
def ic_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per year: robust t of the daily correlations, and the false-discovery value of its p among the years."""
    daily = factor_test.ic(forward(spark, sf_dir), "momentum_20d", "fwd_1").withColumn("year", F.year("date"))
    out = statistics.newey_west(daily, "year", "date", "ic", 3).withColumn("p", statistics.two_sided_p(F.col("t")))
    out = statistics.false_discovery(out, "p")
    return out.select("year", "n", *[even(c, 6).alias(c) for c in ("mean", "error")], even("t", 4).alias("t"), even("p", 6).alias("p"), even("q", 6).alias("q"))


@query(f"""WITH {ROLL}, f AS (SELECT symbol, date, {lagged("close", 1).replace("lag(", "lead(")} / nullif(close, 0) - 1 AS y, close / nullif({lagged("close", 3)}, 0) - 1 AS x FROM bars), fin AS (SELECT date, x, y FROM f WHERE x IS NOT NULL AND y IS NOT NULL),
  k AS (SELECT date, {AVG_RANK.format(x="x")} AS a, {AVG_RANK.format(x="y")} AS b FROM fin WHERE date IN (SELECT date FROM fin GROUP BY 1 HAVING count(DISTINCT x) >= 5)), d AS (SELECT 0 AS g, date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM k GROUP BY 2),
  {_nw("d", "g", "date", "ic", 1)} SELECT n, round(mean, 6) AS mean, round(error, 6) AS error, round(mean / error, 4) AS t FROM nw""")
def formula_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula, its daily correlation with the next bar's return, and the robust t of these."""
    panel = with_formulas(week(spark, sf_dir), {"x": "close / ts_delay(close, 3) - 1"})
    ahead = panel.withColumn("y", safe_div(F.lead("close").over(Window.partitionBy("symbol").orderBy("date")), "close") - 1)
    daily = factor_test.ic(ahead, "x", "y").withColumn("g", F.lit(0))
    return statistics.newey_west(daily, "g", "date", "ic", 1).select("n", even("mean", 6).alias("mean"), even("error", 6).alias("error"), even("t", 4).alias("t"))


@query(f"""WITH {NAV}, s AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS v, quantile_cont(ret, 0.05) OVER (PARTITION BY grp) AS worst FROM gm WINDOW w AS (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT *, v / greatest(max(v) OVER (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS dd FROM s),
  a AS (SELECT grp, count(*) AS n, last(v ORDER BY date) - 1 AS total, pow(last(v ORDER BY date), 52.0 / count(*)) - 1 AS annual, stddev_samp(ret) * sqrt(52) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(52) AS sharpe, avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(52) AS sortino, min(dd) AS max_drawdown, sqrt(avg(dd * dd)) AS ulcer,
    avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS quality, avg(CAST(ret > 1e-12 AS DOUBLE)) AS win_rate, sum(CASE WHEN ret > 1e-12 THEN ret END) / sum(CASE WHEN ret < -1e-12 THEN -ret END) AS profit_factor, avg(CASE WHEN ret > 1e-12 THEN ret END) / avg(CASE WHEN ret < -1e-12 THEN -ret END) AS payoff, avg(CASE WHEN ret <= worst + 1e-15 THEN ret END) AS cvar_95 FROM d GROUP BY 1)
  SELECT grp, n, {", ".join(f"{rnd(k, 4)} AS {k}" for k in ("total", "annual", "volatility", "sharpe", "sortino", "max_drawdown", "ulcer", "quality", "win_rate", "profit_factor", "payoff", "cvar_95"))}, {rnd("CASE WHEN max_drawdown < 0 THEN annual / -max_drawdown END", 4)} AS calmar, {rnd("win_rate - (1 - win_rate) / payoff", 4)} AS kelly FROM a""")
def group_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.risk(nav(spark, sf_dir), "grp", "date", "ret", 52), digits=4)


@query(f"""WITH {NAV}, b AS (SELECT date, avg(y) AS bench FROM fin GROUP BY 1) SELECT grp, count(*) AS n, round(stddev_samp(ret - bench) * sqrt(52), 6) AS tracking_error, round(avg(ret - bench) / nullif(stddev_samp(ret - bench), 0) * sqrt(52), 4) AS information_ratio, round(covar_samp(ret, bench) / nullif(var_samp(bench), 0), 4) AS beta FROM gm JOIN b USING (date) GROUP BY 1""")
def group_against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = forward(spark, sf_dir).where("fwd_1 is not null and momentum_20d is not null").select("date", clamp("fwd_1", -0.02, 0.02).alias("ret"))
    out = statistics.against_benchmark(nav(spark, sf_dir), clipped.groupBy("date").agg(F.avg("ret").alias("bench")), "grp", "ret", 52)
    return out.select("grp", "n", even("tracking_error", 6).alias("tracking_error"), even("information_ratio", 4).alias("information_ratio"), even("beta", 4).alias("beta"))


_SPREAD = "(1 - g3 * sr + (g4 - 1) / 4 * sr * sr)"


@query(f"""WITH {NAV}, c AS (SELECT grp, ret, ret - avg(ret) OVER (PARTITION BY grp) AS e FROM gm), m AS (SELECT grp, count(*) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, avg(e * e * e) / pow(avg(e * e), 1.5) AS g3, avg(e * e * e * e) / pow(avg(e * e), 2) AS g4 FROM c GROUP BY 1),
  z AS (SELECT *, (sr - 0.05) * sqrt(n - 1) / sqrt({_SPREAD}) AS z FROM m) SELECT grp, n, round(sr, 6) AS sharpe, round({_cdf("z")}, 5) AS probability FROM z""")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.deflated_sharpe(nav(spark, sf_dir), "grp", "ret", 0.05)
    return out.select("grp", "n", even("sharpe", 6).alias("sharpe"), even("probability", 5).alias("probability"))


_EVENTS = f"""{LIMITS}, ev AS (SELECT symbol, date, lead(close, 2) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS y, signal_limit_up FROM lim), e AS (SELECT date, y FROM ev WHERE signal_limit_up AND y IS NOT NULL)"""


@query(f"""WITH {_EVENTS}, m AS (SELECT avg(y) AS mean, count(*) AS n FROM e), s AS (SELECT date, sum(y) AS s, count(*) AS k FROM e GROUP BY 1), v AS (SELECT any_value(n) AS n, count(*) AS clusters, any_value(mean) AS mean, sqrt(sum(pow(s - mean * k, 2)) * count(*) / (count(*) - 1)) / any_value(n) AS error FROM s CROSS JOIN m)
  SELECT n, clusters, round(mean, 6) AS mean, round(error, 6) AS error, round(mean / error, 4) AS t FROM v""")
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return over the two bars after a limit-up, with the error that its dates give it."""
    rows = flagged(spark, sf_dir).withColumn("y", safe_div(F.lead("close", 2).over(Window.partitionBy("symbol").orderBy("date")), "close") - 1)
    out = statistics.clustered_t(rows.where("signal_limit_up"), "date", "y")
    return out.select("n", "clusters", even("mean", 6).alias("mean"), even("error", 6).alias("error"), even("t", 4).alias("t"))


@query()
def drawdown_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the largest drawdown of the top group over resampled weeks; drawn from hashes, so it has no SQL."""
    return statistics.bootstrap_drawdowns(nav(spark, sf_dir).where("grp = 5"), "ret", 500)


# --- rebalancing, folds, costs --------------------------------------------------------------------------------------------------


@query(f"""WITH {BARS}, f AS (SELECT min(date) AS date FROM bars GROUP BY date_trunc('month', date)), st AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM f)
  SELECT a.symbol, a.date, round(b.close / nullif(a.close, 0) - 1, 6) AS ret FROM bars a JOIN st USING (date) LEFT JOIN bars b ON b.symbol = a.symbol AND b.date = nx""")
def monthly_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.rebalanced(week(spark, sf_dir), "month").select("symbol", "date", "ret"))


@query(f"""WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS t FROM (SELECT DISTINCT date FROM bars)), x AS (SELECT CAST(f AS INTEGER) AS fold, date, CASE WHEN i >= floor(f * t / 5) AND i < floor((f + 1) * t / 5) THEN 'test' WHEN i < floor(f * t / 5) - 3 OR i >= floor((f + 1) * t / 5) + 2 THEN 'train' END AS part FROM d CROSS JOIN range(5) r(f))
  SELECT fold, date, part FROM x WHERE part IS NOT NULL""")
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_test.folds(week(spark, sf_dir), 5, purge=3, embargo=2)


@query(f"""WITH {FORWARD} SELECT fwd_5 > 0 AS won, count(*) AS n, round(avg(momentum_20d), 6) AS momentum_20d, round(avg(vol_ratio_5d), 6) AS vol_ratio_5d FROM fwd WHERE ma5 > ma10 AND ma10 > ma20 AND ma20 > ma60 AND momentum_20d > 0 AND fwd_5 IS NOT NULL GROUP BY 1""")
def entry_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screen.evaluated(forward(spark, sf_dir), {"s": screen.STRATEGIES["bullish_alignment"]}).where("entry_s")
    return rounded(factor_test.attribution(rows, "fwd_5", ["momentum_20d", "vol_ratio_5d"]))


_TIERS = {"low": 0.0002, "mid": 0.0005, "high": 0.0015}


@query(f"""WITH {NAV}, t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in _TIERS.items())}) AS v(tier, cost)) SELECT grp, tier, round(avg(ret - cost * 2 * 0.5), 6) AS mean_net, round(avg(CAST(ret - cost * 2 * 0.5 > 0 AS DOUBLE)), 6) AS win_rate FROM gm CROSS JOIN t GROUP BY 1, 2""")
def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factor_test.cost_table(nav(spark, sf_dir), "grp", "ret", 0.5, _TIERS))


@query(f"""WITH {NAV} SELECT date, grp, round(exp(sum(ln(1 + ret - 0.001)) OVER (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING)), 4) AS nav FROM gm""")
def layers_after_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = forward(spark, sf_dir).withColumn("ret", clamp("fwd_1", -0.02, 0.02))
    return factor_test.group_nav(clipped, "momentum_20d", "ret", 5, cost=0.001).select("date", "grp", even("nav", 4).alias("nav"))


# --- fundamentals ---------------------------------------------------------------------------------------------------------------

_REPORTS = """q AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount)), 2) AS gross, round(sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)), 2) AS net, count(*) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
rep0 AS (SELECT q.*, CAST(CAST(quarter + INTERVAL 3 MONTH AS DATE) + CAST(29 + symbol % 40 AS INTEGER) AS DATE) AS announced, CAST(year(quarter) * 4 + quarter(quarter) - 1 AS INTEGER) AS qkey, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1000 AS shares FROM q JOIN supplier ON s_suppkey = symbol),
rep AS (SELECT a.*, a.net / a.shares AS eps, a.gross * 4 / a.shares AS bps, a.net / nullif(a.gross * 4, 0) AS roe, a.net / nullif(a.gross * 8, 0) AS roa, a.gross / nullif(a.revenue, 0) AS gross_margin, a.net / nullif(a.revenue, 0) AS net_margin, a.revenue / nullif(b.revenue, 0) - 1 AS revenue_yoy, a.net / nullif(b.net, 0) - 1 AS net_income_yoy,
  1 - a.gross / nullif(a.revenue, 0) AS debt_ratio, a.net * 0.9 / nullif(a.revenue, 0) AS ocf_to_revenue FROM rep0 a LEFT JOIN rep0 b ON b.symbol = a.symbol AND b.qkey = a.qkey - 4)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly figures per supplier, announced 30 to 69 days after the quarter's end."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    price, kept = F.col("l_extendedprice"), 1 - F.col("l_discount")
    q = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter"))
    q = q.agg(F.sum(price).alias("revenue"), F.sum(price * kept).alias("gross"), F.sum(price * kept * (1 - F.col("l_tax"))).alias("net"), F.count("*").alias("orders"))
    q = q.withColumns({c: even(c, 2) for c in ("revenue", "gross", "net")}).join(float_shares(spark, sf_dir).withColumnRenamed("float_shares", "shares"), "symbol")
    q = q.withColumns({"announced": F.date_add(F.add_months("quarter", 3), (F.lit(29) + F.col("symbol") % 40).cast("int")), "qkey": fundamentals.quarter_key(F.col("quarter"))})
    year = q.select("symbol", (F.col("qkey") + 4).alias("qkey"), F.col("revenue").alias("__r"), F.col("net").alias("__n"))
    both = q.join(year, ["symbol", "qkey"], "left")
    made = {
        "eps": F.col("net") / F.col("shares"), "bps": F.col("gross") * 4 / F.col("shares"), "roe": safe_div("net", F.col("gross") * 4), "roa": safe_div("net", F.col("gross") * 8), "gross_margin": safe_div("gross", "revenue"),
        "net_margin": safe_div("net", "revenue"), "revenue_yoy": safe_div("revenue", "__r") - 1, "net_income_yoy": safe_div("net", "__n") - 1, "debt_ratio": 1 - safe_div("gross", "revenue"), "ocf_to_revenue": safe_div(F.col("net") * 0.9, "revenue"),
    }
    return both.withColumns(made).drop("__r", "__n")


_LATEST = ["bps", "eps", "roe", "roa", "gross_margin", "net_margin", "revenue_yoy", "net_income_yoy", "debt_ratio", "ocf_to_revenue"]


@query(f"""WITH {BARS}, {_REPORTS} SELECT b.symbol, b.date, {", ".join(f"{rnd('r.' + c, 5)} AS {c}_latest" for c in _LATEST)}, {rnd("CASE WHEN eps > 0 THEN close / eps END", 5)} AS pe_latest, {rnd("CASE WHEN bps > 0 THEN close / bps END", 5)} AS pb_latest FROM bars b ASOF LEFT JOIN rep r ON b.symbol = r.symbol AND b.date > r.announced""")
def fundamental_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fundamentals.latest_factors(week(spark, sf_dir), reports(spark, sf_dir))
    return rounded(out.select("symbol", "date", *[f"{c}_latest" for c in _LATEST], "pe_latest", "pb_latest"), digits=5)


_BACK = f"""{BARS}, {_REPORTS}, kn AS (SELECT symbol, CAST(announced + 1 AS DATE) AS since, max(qkey) OVER (PARTITION BY symbol ORDER BY CAST(announced + 1 AS DATE), qkey ROWS UNBOUNDED PRECEDING) AS qkey FROM rep),
pl AS (SELECT b.symbol, b.date, b.close, k.qkey FROM bars b ASOF LEFT JOIN kn k ON b.symbol = k.symbol AND b.date >= k.since),
bk AS (SELECT p.*, {", ".join(f"CASE WHEN CAST(r{k}.announced + 1 AS DATE) <= p.date THEN r{k}.revenue END AS revenue_{k}, CASE WHEN CAST(r{k}.announced + 1 AS DATE) <= p.date THEN r{k}.eps END AS eps_{k}" for k in (0, 1, 4, 5))} FROM pl p {" ".join(f"LEFT JOIN rep r{k} ON r{k}.symbol = p.symbol AND r{k}.qkey = p.qkey - {k}" for k in (0, 1, 4, 5))}),
yy AS (SELECT *, revenue_0 / nullif(revenue_4, 0) - 1 AS yoy, revenue_0 / nullif(revenue_4, 0) - revenue_1 / nullif(revenue_5, 0) AS yoy_change FROM bk)"""


def back(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    placed = fundamentals.latest_known(week(spark, sf_dir).select("symbol", "date", "close"), r)
    out = fundamentals.quarters_back(placed, r, ["revenue", "eps"], [0, 1, 4, 5])
    before = safe_div("revenue_1", "revenue_5")
    return out.withColumns({"yoy": safe_div("revenue_0", "revenue_4") - 1, "yoy_change": safe_div("revenue_0", "revenue_4") - before})


@query(f"WITH {_BACK} SELECT symbol, date, qkey, {', '.join(f'{rnd(c, 2)} AS {c}' for c in ('revenue_0', 'revenue_1', 'revenue_4', 'revenue_5'))}, {rnd('yoy', 5)} AS yoy, {rnd('yoy_change', 5)} AS yoy_change FROM yy")
def quarter_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = back(spark, sf_dir)
    return out.select("symbol", "date", "qkey", *[even(c, 2).alias(c) for c in ("revenue_0", "revenue_1", "revenue_4", "revenue_5")], even("yoy", 5).alias("yoy"), even("yoy_change", 5).alias("yoy_change"))


@query(f"""WITH {_BACK}, f AS (SELECT symbol, date, {rnd("yoy", 9)} AS yoy, {rnd("close / nullif(eps_0, 0)", 9)} AS pe, {rnd("yoy_change", 9)} AS yoy_change FROM yy), ok AS (SELECT * FROM f WHERE yoy > 0 AND pe > 0 AND yoy IS NOT NULL AND pe IS NOT NULL AND yoy_change IS NOT NULL),
  s AS (SELECT symbol, date, round(({AVG_RANK.format(x="-yoy")} + {AVG_RANK.format(x="pe")} + {AVG_RANK.format(x="-yoy_change")}) / 3, 9) AS score FROM ok), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS INTEGER) AS place FROM s) SELECT symbol, date, round(score, 6) AS score, place FROM p WHERE place <= 10""")
def fundamental_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = back(spark, sf_dir).select("symbol", "date", even("yoy", 9).alias("yoy"), even(safe_div("close", "eps_0"), 9).alias("pe"), even("yoy_change", 9).alias("yoy_change"))
    best = fundamentals.rank_score(rows, (F.col("yoy") > 0) & (F.col("pe") > 0), {"yoy": True, "pe": False, "yoy_change": True}, 10)
    return best.select("symbol", "date", even("score", 6).alias("score"), "place")


@query(f"""WITH {_REPORTS}, y AS (SELECT symbol, quarter, qkey, {rnd("sum(revenue) OVER (PARTITION BY symbol, year(quarter) ORDER BY qkey ROWS UNBOUNDED PRECEDING)", 2)} AS ytd FROM rep),
  s AS (SELECT *, CASE WHEN qkey % 4 = 0 THEN ytd WHEN lag(qkey) OVER w = qkey - 1 THEN ytd - lag(ytd) OVER w END AS single FROM y WINDOW w AS (PARTITION BY symbol ORDER BY qkey)), m AS (SELECT *, median(single) OVER (PARTITION BY quarter) AS mid FROM s)
  SELECT symbol, quarter, ytd, {rnd("single", 2)} AS single, coalesce(single > mid, false) AS above FROM m""")
def single_quarter_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums since the year's begin turned back into quarters, and whether a quarter is above its median."""
    upto = Window.partitionBy("symbol", F.year("quarter")).orderBy("qkey").rowsBetween(Window.unboundedPreceding, 0)
    ytd = reports(spark, sf_dir).withColumn("ytd", even(F.sum("revenue").over(upto), 2)).select("symbol", "quarter", "ytd")
    single = fundamentals.single_quarters(ytd, "ytd", "single")
    return fundamentals.above_median(single, "single", ["quarter"], "above").select("symbol", "quarter", "ytd", even("single", 2).alias("single"), "above")
