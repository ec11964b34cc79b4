"""Statistics of return and correlation series: robust t, false discovery, ratios, risk, resampling.

A series is a column of a DataFrame with an order; a group column tells series apart, so many
are computed side by side.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import safe_div, unbounded_div

YEAR = 252
#: Fewer values than this give no tail mean. A fixed value.
LEAST_TAIL = 20
#: Returns closer to 0 than this are 0: a mean that is 0 comes out as a few units of the last bit, of either sign.
NOTHING = 1e-12


def newey_west(series: DataFrame, by: str, order: str, x: str, lag: int) -> DataFrame:
    """Per group: n, mean, robust error and t of the mean with Bartlett weights up to ``lag``; null for n of lag + 2 or less, or without spread.

    Products of values k apart are formed by lag over the group's order, then summed.
    """
    rows = series.where(F.col(x).isNotNull())
    sized = rows.join(rows.groupBy(by).agg(F.avg(x).alias("__m"), F.count("*").alias("__n")), by).withColumn("__c", F.col(x) - F.col("__m"))
    w = Window.partitionBy(by).orderBy(order)
    apart = sized.select(by, "__m", "__n", *[(F.col("__c") * (F.lag("__c", k).over(w) if k else F.col("__c"))).alias(f"__g{k}") for k in range(lag + 1)])
    gamma = [F.coalesce(F.sum(f"__g{k}"), F.lit(0.0)) / F.first("__n") for k in range(lag + 1)]
    variance = gamma[0]
    for k in range(1, lag + 1):
        variance = variance + 2.0 * (1.0 - k / (lag + 1)) * gamma[k]
    out = apart.groupBy(by).agg(F.first("__n").alias("n"), F.first("__m").alias("mean"), F.greatest(variance, F.lit(0.0)).alias("__v"))
    enough = (F.col("n") > lag + 2) & (F.col("n") >= 3) & (F.col("__v") > 0)
    error = F.sqrt(F.col("__v") / F.col("n"))
    return out.select(by, "n", "mean", F.when(enough, error).alias("error"), F.when(enough, F.col("mean") / error).alias("t"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by the rational approximation of Zelen and Severo (error below 7.5e-8); the constants are fixed values."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def two_sided_p(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def false_discovery(tests: DataFrame, p: str, by: str | None = None) -> DataFrame:
    """``tests`` with q, the Benjamini-Hochberg value of p among the tests of a group; null for null.

    Tests are hypotheses, not rows of data: a group of them is sorted in one task.
    """
    group = F.col(by) if by else F.lit(0)
    m = F.count(p).over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(p).asc_nulls_last()))
    ranked = tests.withColumn("__q", F.when(F.col(p).isNotNull(), F.col(p) * m / place)).withColumn("__place", place)
    after = Window.partitionBy(group).orderBy("__place").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__q").over(after)))).drop("__q", "__place")


def expected_max_sharpe(trials: int, deviation: float) -> float:
    """Largest Sharpe ratio to be expected of so many trials without skill, whose ratios have this deviation."""
    if trials < 2:
        return 0.0
    gamma, normal = 0.5772156649015329, NormalDist()
    return deviation * ((1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(returns: DataFrame, by: str, x: str, expected: float = 0.0) -> DataFrame:
    """Per group: Sharpe ratio of a period, and the probability that it exceeds ``expected`` given skew and tails; null below five values."""
    s, g3, g4, n = F.col("sharpe"), F.col("__skew"), F.col("__kurt"), F.col("n")
    out = returns.where(F.col(x).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), safe_div(F.avg(x), F.stddev_samp(x)).alias("sharpe"),
        F.when(F.stddev_pop(x) > 0, F.skewness(x)).alias("__skew"), F.when(F.stddev_pop(x) > 0, F.kurtosis(x) + 3).alias("__kurt"),
    )
    spread = 1 - g3 * s + (g4 - 1) / 4 * s * s
    probability = normal_cdf((s - expected) * F.sqrt(n - 1) / F.sqrt(spread))
    return out.select(by, "n", "sharpe", F.when((n >= 5) & (spread > 0), probability).alias("probability"))


def risk(returns: DataFrame, by: str, order: str, x: str, periods: int = YEAR) -> DataFrame:
    """Per group of returns in order: total and annual return, volatility, Sharpe, Sortino, Calmar, largest drawdown, ulcer index,
    system quality, share of gains, profit factor, payoff, Kelly share and mean of the worst twentieth (null below LEAST_TAIL values).
    Sharpe, Sortino and quality are infinite without a deviation.
    """
    rows = returns.where(F.col(x).isNotNull())
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    valued = rows.withColumn("__nav", F.exp(F.sum(F.log1p(x)).over(upto)))
    down = F.col("__nav") / F.greatest(F.max("__nav").over(upto), F.lit(1.0)) - 1
    worst = F.percentile(x, 0.05).over(Window.partitionBy(by))
    valued = valued.withColumns({"__dd": down, "__tail": F.when(F.col(x) <= worst + 1e-15, F.col(x))})
    gain, loss = F.when(F.col(x) > NOTHING, F.col(x)), F.when(F.col(x) < -NOTHING, -F.col(x))
    n, total = F.count("*"), F.max_by("__nav", order)
    out = valued.groupBy(by).agg(
        n.alias("n"), (total - 1).alias("total"), (F.pow(total, F.lit(periods) / n) - 1).alias("annual"), (F.stddev_samp(x) * periods**0.5).alias("volatility"),
        (unbounded_div(F.avg(x), F.stddev_samp(x)) * periods**0.5).alias("sharpe"), (unbounded_div(F.avg(x), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2))))) * periods**0.5).alias("sortino"),
        F.min("__dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("__dd") * F.col("__dd"))).alias("ulcer"), (unbounded_div(F.avg(x), F.stddev_samp(x)) * F.sqrt(n)).alias("quality"),
        F.avg((F.col(x) > NOTHING).cast("double")).alias("win_rate"), safe_div(F.sum(gain), F.sum(loss)).alias("profit_factor"), safe_div(F.avg(gain), F.avg(loss)).alias("payoff"),
        F.when(n >= LEAST_TAIL, F.avg("__tail")).alias("cvar_95"),
    )
    kelly = F.when(F.col("payoff") != 0, F.col("win_rate") - (1 - F.col("win_rate")) / F.col("payoff"))
    return out.withColumns({"calmar": F.when(F.col("max_drawdown") < 0, F.col("annual") / -F.col("max_drawdown")), "kelly": kelly})


def against_benchmark(returns: DataFrame, benchmark: DataFrame, by: str, x: str, periods: int = YEAR) -> DataFrame:
    """Per group: tracking error, information ratio and beta against benchmark (date, bench), on dates that both have; null below three."""
    rows = returns.where(F.col(x).isNotNull()).join(benchmark.where("bench is not null"), "date").withColumn("__e", F.col(x) - F.col("bench"))
    n = F.count("*")
    out = rows.groupBy(by).agg(
        n.alias("n"), F.when(n >= 3, F.stddev_samp("__e") * periods**0.5).alias("tracking_error"),
        F.when(n >= 3, safe_div(F.avg("__e"), F.stddev_samp("__e")) * periods**0.5).alias("information_ratio"),
        F.when(n >= 3, safe_div(F.covar_samp(x, "bench"), F.var_samp("bench"))).alias("beta"),
    )
    return out


def clustered_t(events: DataFrame, cluster: str, x: str) -> DataFrame:
    """Mean of x with the error that its clusters give it: n, clusters, mean, error, t; null with fewer than two clusters."""
    mean = events.where(F.col(x).isNotNull()).agg(F.avg(x).alias("mean"), F.count("*").alias("n"))
    sums = events.where(F.col(x).isNotNull()).groupBy(cluster).agg(F.sum(x).alias("__s"), F.count("*").alias("__k"))
    off = F.col("__s") - F.col("mean") * F.col("__k")
    both = sums.crossJoin(F.broadcast(mean))  # one row on the right
    g = F.count("*")
    out = both.agg(F.first("n").alias("n"), g.alias("clusters"), F.first("mean").alias("mean"), (F.sqrt(F.sum(off * off) * g / F.when(g > 1, g - 1)) / F.first("n")).alias("error"))
    return out.withColumn("t", F.when(F.col("error") > 0, F.col("mean") / F.col("error")))


def bootstrap_drawdowns(returns: DataFrame, x: str, draws: int, percentiles: tuple[float, ...] = (0.05, 0.5, 0.95), seed: int = 42) -> DataFrame:
    """Percentiles of the largest drawdown over ``draws`` resamples of the series, one row.

    The series is sent to every draw as one array, so it must be a series of days, not of
    ticks; draws run side by side, each from hashes of its number and the seed.
    """
    series = returns.where(F.col(x).isNotNull()).agg(F.sort_array(F.collect_list(x)).alias("r"))
    drawn = returns.sparkSession.range(draws).crossJoin(F.broadcast(series)).where("size(r) > 0")  # one row on the right
    pick = F.transform(F.sequence(F.lit(1), F.size("r")), lambda i: F.get("r", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.size("r")).cast("int")))
    state = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(a: Column, v: Column) -> Column:
        nav = a["nav"] * (1 + v)
        peak = F.greatest(a["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.least(a["dd"], nav / peak - 1).alias("dd"))

    worst = drawn.select(F.aggregate(pick, state, step, lambda a: a["dd"]).alias("dd"))
    return worst.agg(F.count("*").alias("draws"), *[F.percentile("dd", q).alias(f"p{round(q * 100):02d}") for q in percentiles])
