"""Fundamentals as they were known: quarters by key, quarters back, year on year, ratios and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Cross, Series, safe_div
from tessera.operators.joins import asof

X = Cross()


def quarter_key(date: Column) -> Column:
    """Whole number that grows by one a quarter."""
    return F.year(date) * 4 + F.quarter(date) - 1


def versioned(reports: DataFrame) -> DataFrame:
    """Reports (symbol, quarter, announced, ...) with qkey and effective_from, the day after the announcement."""
    return reports.withColumns({"qkey": quarter_key(F.col("quarter")), "effective_from": F.date_add("announced", 1)})


def latest_known(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """``bars`` with qkey, the latest quarter announced before each date; a late report of an older quarter does not take it back."""
    upto = Window.partitionBy("symbol").orderBy("effective_from", "qkey").rowsBetween(Window.unboundedPreceding, 0)
    known = versioned(reports).select("symbol", "effective_from", "qkey").withColumn("qkey", F.max("qkey").over(upto))
    return asof(bars, known, "symbol", "date", "effective_from", ["qkey"], span=None)  # a symbol's bars in one piece, as windows by symbol have them: nothing is dealt twice


def quarters_back(placed: DataFrame, reports: DataFrame, columns: list[str], offsets: list[int]) -> DataFrame:
    """``placed`` (from ``latest_known``) with <column>_<k>: the value of k quarters before the latest known one, if it was known at the date."""
    at = lambda c, k: F.first(c).over(Window.partitionBy("symbol").orderBy("qkey").rangeBetween(-k, -k))
    keyed = versioned(reports).select("symbol", "qkey", "effective_from", *columns)
    # the quarters back of each quarter come together in one sort of the reports, so that bars meet one row
    back = keyed.select("symbol", "qkey", *[at("effective_from", k).alias(f"__from_{k}") for k in offsets], *[at(c, k).alias(f"{c}_{k}") for k in offsets for c in columns])
    out = placed.join(back, ["symbol", "qkey"], "left")
    known = {f"{c}_{k}": F.when(F.col(f"__from_{k}") <= F.col("date"), F.col(f"{c}_{k}")) for k in offsets for c in columns}
    return out.withColumns(known).drop(*[f"__from_{k}" for k in offsets])


def single_quarters(reports: DataFrame, column: str, to: str) -> DataFrame:
    """Values of single quarters from sums since the year's begin: less the quarter before, unless it is the first or that one is missing."""
    s = Series("symbol", "qkey")
    keyed = reports.withColumn("qkey", quarter_key(F.col("quarter")))
    before = F.when(s.delay("qkey") == F.col("qkey") - 1, s.delay(column))
    return keyed.withColumn(to, F.when(F.col("qkey") % 4 == 0, F.col(column)).otherwise(F.col(column) - before)).drop("qkey")


def latest_factors(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """``bars`` with <name>_latest of the report announced before each date, and prices over earnings and book where these are positive."""
    plain = ["bps", "eps", "roe", "roa", "gross_margin", "net_margin", "revenue_yoy", "net_income_yoy", "debt_ratio", "ocf_to_revenue"]
    joined = asof(bars, reports, "symbol", "date", "announced", plain, strict=True)
    ratio = lambda c: F.when(F.col(c) > 0, F.col("close") / F.col(c))
    out = joined.withColumns({"pe_latest": ratio("eps"), "pb_latest": ratio("bps")})
    return out.withColumnsRenamed({c: f"{c}_latest" for c in plain})


def above_median(rows: DataFrame, value: str, by: list[str], to: str) -> DataFrame:
    """``rows`` with whether the value is above the median of its group; false where there is none."""
    middle = F.percentile(value, 0.5).over(Window.partitionBy(*by))
    return rows.withColumn(to, F.coalesce(F.col(value) > middle, F.lit(False)))


def rank_score(rows: DataFrame, passes: Column, ranks: dict[str, bool], n: int) -> DataFrame:
    """The n best rows of each date that pass: score is the mean of their average ranks, ranked among them alone; True ranks the largest first. Ties by symbol."""
    left = rows.where(F.coalesce(passes, F.lit(False)))
    for c in ranks:
        left = left.where(F.col(c).isNotNull())
    total = F.lit(0.0)
    for c, largest in ranks.items():
        total = total + X.average_rank(-F.col(c) if largest else F.col(c))
    scored = left.withColumn("score", F.round(total / len(ranks), 9))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("score", "symbol")))
    return placed.where(F.col("place") <= n)


def roic(profit: Column, tax: Column, before_tax: Column, equity: Column, debt: Column) -> Column:
    """After-tax operating profit over equity and debt; null without capital or profit before tax."""
    rate = F.when(before_tax != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), tax / before_tax)))
    return safe_div(profit * (1 - rate), F.when(equity + debt > 0, equity + debt))
