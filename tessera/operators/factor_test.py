"""Tests of a factor: rank correlation with forward returns, quantile groups, turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Cross, safe_div
from tessera.operators.statistics import NOTHING

X = Cross()


def finite(panel: DataFrame, factor: str, ret: str, least: int) -> DataFrame:
    """Rows with both values, on dates with at least ``least`` different factor values."""
    rows = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    thin = rows.groupBy("date").agg(F.countDistinct(factor).alias("__n")).where(F.col("__n") >= least).select("date")
    return rows.join(thin, "date")


def ic(panel: DataFrame, factor: str, ret: str, least: int = 5) -> DataFrame:
    """Spearman correlation per date; null where one side is constant."""
    ranked = finite(panel, factor, ret, least).select("date", X.average_rank(factor).alias("a"), X.average_rank(ret).alias("b"))
    by = ranked.groupBy("date").agg(F.covar_samp("a", "b").alias("c"), (F.stddev_samp("a") * F.stddev_samp("b")).alias("s"), F.count("*").alias("n"))
    return by.select("date", safe_div("c", "s").alias("ic"), "n")


#: A rank correlation that is 0 comes out as a few units of the last bit, of either sign; real ones differ from 0 by more.
ZERO = 1e-9


def ic_summary(daily: DataFrame, by: str = "year") -> DataFrame:
    """Mean, information ratio (population deviation) and share of positive dates, per year or over all."""
    key = F.year("date") if by == "year" else F.lit(0)
    return daily.where("ic is not null").groupBy(key.alias("year")).agg(
        F.avg("ic").alias("ic_mean"), safe_div(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.avg((F.col("ic") > ZERO).cast("double")).alias("win_rate"), F.count("*").alias("days")
    )


def grouped(panel: DataFrame, factor: str, groups: int) -> DataFrame:
    """``panel`` with grp from 1 to groups by average rank within the date, so that ties stay together."""
    n = F.count(F.col(factor)).over(X.spec)
    place = F.floor((X.average_rank(factor) - 0.5) / n * groups) + 1
    return panel.withColumn("grp", F.when(F.col(factor).isNotNull(), F.least(place, F.lit(groups)).cast("int"))).where("grp is not null")


def group_nav(panel: DataFrame, factor: str, ret: str, groups: int, cost: float = 0.0) -> DataFrame:
    """Per date and group: mean return and the value of one unit put in at the start."""
    means = grouped(panel.where(F.col(ret).isNotNull()), factor, groups).groupBy("date", "grp").agg(F.avg(ret).alias("ret"))
    w = Window.partitionBy("grp").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return means.withColumn("nav", F.exp(F.sum(F.log1p(F.col("ret") - cost)).over(w)))


def group_stats(nav: DataFrame, periods: int) -> DataFrame:
    """Per group: total and annual return, largest drawdown, Sharpe ratio and share of gains."""
    w = Window.partitionBy("grp").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peaks = nav.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    last, n = F.max_by("nav", "date"), F.count("*")
    return peaks.groupBy("grp").agg(
        (last - 1).alias("total"),
        (F.pow(last, periods / n) - 1).alias("annual"),
        F.min("dd").alias("max_drawdown"),
        (safe_div(F.avg("ret"), F.stddev_samp("ret")) * periods**0.5).alias("sharpe"),
        F.avg((F.col("ret") > NOTHING).cast("double")).alias("win_rate"),
    )


def long_short(nav: DataFrame, groups: int) -> DataFrame:
    """Spread of the top over the bottom group per date, and its cumulative value."""
    spread = nav.where(F.col("grp").isin(1, groups)).groupBy("date").agg(
        (F.max(F.when(F.col("grp") == groups, F.col("ret"))) - F.max(F.when(F.col("grp") == 1, F.col("ret")))).alias("spread")
    )
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    return spread.where("spread is not null").withColumn("nav", F.exp(F.sum(F.log1p("spread")).over(w)))


def top_turnover(panel: DataFrame, factor: str, groups: int) -> DataFrame:
    """Half the sum of weight changes of the top group from one date to the next, equal weights."""
    top = grouped(panel, factor, groups).where(F.col("grp") == groups)
    held = top.select("date", "symbol", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("w"))
    dates = held.select("date").distinct()
    step = dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next")).where("next is not null")
    before = held.join(step, "date").select(F.col("next").alias("date"), "symbol", F.col("w").alias("w0"))
    now = held.join(step.select(F.col("next").alias("date")), "date").select("date", "symbol", F.col("w").alias("w1"))
    both = before.join(now, ["date", "symbol"], "full")
    return both.groupBy("date").agg((F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) / 2).alias("turnover"))


def ic_decay(panel: DataFrame, factor: str, horizons: dict[int, str]) -> DataFrame:
    """Per horizon: mean of the daily rank correlation with the return over it, and the dates that have one. Horizons are ranked side by side."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("__y")) for h, c in horizons.items()])).alias("x")
    rows = panel.where(F.col(factor).isNotNull()).select("date", factor, each).select("date", factor, "x.*").where("__y is not null")
    by = Cross("__by")
    ranked = rows.withColumn("__by", F.struct("date", "horizon")).select("__by", by.average_rank(factor).alias("a"), by.average_rank("__y").alias("b"))
    daily = ranked.groupBy("__by").agg(F.covar_samp("a", "b").alias("c"), (F.stddev_samp("a") * F.stddev_samp("b")).alias("s"))
    daily = daily.select("__by.horizon", safe_div("c", "s").alias("ic"))
    return daily.groupBy("horizon").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n_dates"))


#: Regime states put together to three; fixed values.
THREE_LEVELS = {"strong": "strong", "lean_strong": "strong", "range": "range", "lean_weak": "weak", "weak": "weak"}


def regime_ic(daily: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per state of the day before: mean, information ratio and share of positive daily correlations; regimes: (date, state_before)."""
    level = F.coalesce(*[F.when(F.col("state_before") == k, v) for k, v in THREE_LEVELS.items()])
    joined = daily.where("ic is not null").join(regimes.where("state_before is not null").select("date", level.alias("level")), "date")
    return joined.groupBy("level").agg(F.avg("ic").alias("ic_mean"), safe_div(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.avg((F.col("ic") > ZERO).cast("double")).alias("win_rate"), F.count("*").alias("days"))


def proxy_ic(panel: DataFrame, weights: dict[str, float], ret: str) -> DataFrame:
    """Daily rank correlation of a weighted sum of ranks with the return, on rows that have all."""
    rows = panel
    for c in (*weights, ret):
        rows = rows.where(F.col(c).isNotNull())
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + X.rank(name) * w
    # ranks are shares of small whole numbers; twelve places take the noise of their sum away, so that ties are ties
    blended = rows.select("date", ret, F.round(total, 12).alias("__x"))
    return ic(blended, "__x", ret, least=2)


def pruned(correlations: DataFrame, order: list[str], most: float) -> list[str]:
    """Factors kept in order: one goes when it is correlated beyond ``most`` with one kept before it. The matrix of factors is small."""
    known = {frozenset((r["a"], r["b"])): r["corr"] for r in correlations.collect()}
    kept: list[str] = []
    for name in order:
        if all(abs(known.get(frozenset((name, k))) or 0.0) <= most for k in kept):
            kept.append(name)
    return kept


def rebalanced(bars: DataFrame, grain: str) -> DataFrame:
    """Bars of the first date of each week, month or quarter, with ret, the return to the first date of the next; null for the last or where the symbol is missing then."""
    dates = bars.select("date").distinct()
    firsts = dates.groupBy(F.date_trunc(grain, "date").alias("p")).agg(F.min("date").alias("date"))
    step = firsts.select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))  # a row a period
    at = bars.join(step, "date")
    later = bars.select("symbol", F.col("date").alias("next"), F.col("close").alias("__later"))
    return at.join(later, ["symbol", "next"], "left").withColumn("ret", safe_div("__later", "close") - 1).drop("__later", "next")


def folds(dates: DataFrame, n: int, purge: int, embargo: int) -> DataFrame:
    """(fold, date, part): n blocks of dates in order, each the test of one fold; dates up to ``purge`` before it and ``embargo`` after it are in neither part."""
    placed = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    total = placed.agg(F.count("*").alias("total"))
    each = placed.crossJoin(F.broadcast(total)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))  # one row on the right
    start, stop = F.floor(F.col("fold") * F.col("total") / n), F.floor((F.col("fold") + 1) * F.col("total") / n)
    part = F.when((F.col("i") >= start) & (F.col("i") < stop), "test").when((F.col("i") < start - purge) | (F.col("i") >= stop + embargo), "train")
    return each.withColumn("part", part).where("part is not null").select("fold", "date", "part")


def nested_folds(dates: DataFrame, train: int, test: int, step: int, inner_train: int, inner_test: int, inner_step: int, purge: int) -> DataFrame:
    """(fold, inner, part, date): rolling folds of ``train`` dates, ``purge`` dates left out, and ``test`` dates, moved on by ``step``.

    inner is null for the fold's own train and test; within its train lie the inner folds,
    none of which reaches beyond it. Folds that do not fit whole are left out; none fits, no rows.
    """
    if inner_train + purge + inner_test > train:
        raise ValueError("no inner fold fits into the training dates")
    placed = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    number = placed.agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - (train + purge + test)) / step)
    outer = number.where(F.col("n") >= train + purge + test).select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold"))
    start = F.col("fold") * step
    span = lambda inner, part, lo, size: F.struct(inner.cast("long").alias("inner"), F.lit(part).alias("part"), lo.cast("long").alias("lo"), (lo + size - 1).cast("long").alias("hi"))
    spans = [span(F.lit(None), "train", start, train), span(F.lit(None), "test", start + train + purge, test)]
    for j in range((train - inner_train - purge - inner_test) // inner_step + 1):
        at = start + j * inner_step
        spans += [span(F.lit(j), "train", at, inner_train), span(F.lit(j), "test", at + inner_train + purge, inner_test)]
    each = outer.select("fold", F.explode(F.array(*spans)).alias("s")).select("fold", "s.inner", "s.part", F.explode(F.sequence("s.lo", "s.hi")).alias("i"))
    return each.join(placed, "i").select("fold", "inner", "part", "date")


def walk_forward(daily: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold the factor that did best on its inner tests, and how it did on the dates after.

    daily: (date, factor, ic); folds: of ``nested_folds``. A factor's direction is the sign of
    its mean on a part's training dates, so nothing of a test chooses. Returns fold, factor,
    inner_ic (mean over inner tests, in the direction of each), inner_folds, train_ic, test_ic
    (in the direction of the fold's training), days. Ties go to the first name.
    """
    parts = folds.join(daily.where("ic is not null"), "date").groupBy("fold", "inner", "factor").agg(
        F.avg(F.when(F.col("part") == "train", F.col("ic"))).alias("seen"), F.avg(F.when(F.col("part") == "test", F.col("ic"))).alias("unseen"), F.count(F.when(F.col("part") == "test", 1)).alias("days")
    )
    way = F.when(F.col("seen") >= 0, 1).when(F.col("seen") < 0, -1)
    parts = parts.withColumn("out", F.col("unseen") * way)
    inner = parts.where("inner is not null and out is not null").groupBy("fold", "factor").agg(F.avg("out").alias("inner_ic"), F.count("*").alias("inner_folds"))
    best = inner.groupBy("fold").agg(F.min(F.struct((-F.round("inner_ic", 9)).alias("worst"), "factor", "inner_ic", "inner_folds")).alias("b")).select("fold", "b.factor", "b.inner_ic", "b.inner_folds")
    after = parts.where("inner is null").select("fold", "factor", (F.col("seen") * way).alias("train_ic"), F.col("out").alias("test_ic"), "days")
    return best.join(after, ["fold", "factor"], "left")


def out_of_sample(walked: DataFrame) -> DataFrame:
    """One row over all folds of ``walk_forward``: folds, mean and ratio of the test correlations, share of positive ones, what is kept of the inner score."""
    return walked.agg(
        F.count("test_ic").alias("folds"), F.avg("test_ic").alias("test_ic"), safe_div(F.avg("test_ic"), F.stddev_pop("test_ic")).alias("test_ir"),
        F.avg(F.when(F.col("test_ic").isNotNull(), (F.col("test_ic") > ZERO).cast("double"))).alias("win_rate"), safe_div(F.avg("test_ic"), F.avg("inner_ic")).alias("kept"),
    )


def attribution(rows: DataFrame, outcome: str, factors: list[str]) -> DataFrame:
    """Per outcome (won or not): number and mean of each factor at entry; rows without an outcome are left out."""
    won = F.when(F.col(outcome).isNotNull(), F.col(outcome) > 0)
    return rows.where(F.col(outcome).isNotNull()).groupBy(won.alias("won")).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in factors])


def cost_table(returns: DataFrame, by: str, ret: str, turnover: float, tiers: dict[str, float]) -> DataFrame:
    """Per group and tier of cost: mean return and share of gains after ``turnover`` times the cost of a side."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(v).alias("cost")) for k, v in tiers.items()])).alias("t")
    net = F.col(ret) - F.col("cost") * 2 * turnover
    return returns.select(by, ret, each).select(by, ret, "t.*").groupBy(by, "tier").agg(F.avg(net).alias("mean_net"), F.avg((net > 0).cast("double")).alias("win_rate"))
