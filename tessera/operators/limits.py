"""Daily price limits: their share by board and date, the limit prices, what a bar did at them, and ladders of limit-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import Series
from tessera.operators.indicators import limit_price

S = Series()
#: Shares by board, the share of risk-warning names on the main board, and the date on which that ended. Fixed values.
MAIN, GROWTH, BEIJING, WARNED = 10, 20, 30, 5
WARNED_UNTIL = "2026-07-06"
#: Half a cent: prices within it are at the limit.
HALF_CENT = 0.005


def limit_percent(code: Column, date: Column, name: Column) -> Column:
    """Whole percent of the daily limit of a code such as 300001.SZ."""
    growth = code.rlike("^(30[012]|68[89])")
    beijing = code.endswith(".BJ")
    warned = F.upper(F.coalesce(name, F.lit(""))).contains("ST")
    return F.when(growth, GROWTH).when(beijing, BEIJING).when(warned & (date < F.lit(WARNED_UNTIL).cast("date")), WARNED).otherwise(MAIN)


def flags(bars: DataFrame, free_days: int = 0) -> DataFrame:
    """``bars`` (symbol, date, open, high, low, close, percent) with the limits and what the bar did at them.

    Adds limit_upper and limit_lower, signal_limit_up and signal_limit_down (closed there),
    signal_broken_limit_up (touched, not closed there), signal_limit_down_recovery (touched the
    lower one, not closed there and closed above the open), and the lengths of the runs
    consecutive_limit_ups and consecutive_limit_downs. A symbol's first bar, and its first
    ``free_days`` bars, have no limits.
    """
    out = bars.withColumns({"__row": S.row(), "__prev": S.delay("close")}).withColumn("__prev", F.when(F.col("__row") > free_days, F.col("__prev")))
    out = out.withColumns({"limit_upper": limit_price(F.col("__prev"), F.col("percent")), "limit_lower": limit_price(F.col("__prev"), -F.col("percent"))})
    at_upper, at_lower = F.col("close") >= F.col("limit_upper") - HALF_CENT, F.col("close") <= F.col("limit_lower") + HALF_CENT
    off = F.lit(False)
    out = out.withColumns(
        {
            "signal_limit_up": F.coalesce(at_upper, off),
            "signal_limit_down": F.coalesce(at_lower, off),
            "signal_broken_limit_up": F.coalesce((F.col("high") >= F.col("limit_upper") - HALF_CENT) & ~at_upper, off),
            "signal_limit_down_recovery": F.coalesce((F.col("low") <= F.col("limit_lower") + HALF_CENT) & ~at_lower & (F.col("close") > F.col("open")), off),
        }
    )
    return out.withColumns(
        {"consecutive_limit_ups": S.streak("signal_limit_up", "__row").cast("int"), "consecutive_limit_downs": S.streak("signal_limit_down", "__row").cast("int")}
    ).drop("__prev", "__row")


def blocked_entries(flagged: DataFrame, lag: int) -> DataFrame:
    """``flagged`` with blocked_up and blocked_down: whether the bar ``lag`` later closes at a limit; false where there is none."""
    ahead = lambda c: F.coalesce(F.lead(c, lag).over(S.spec), F.lit(False))
    return flagged.withColumns({"blocked_up": ahead("signal_limit_up"), "blocked_down": ahead("signal_limit_down")})


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("int")), F.lit(0)).cast("long")


def ladder(flagged: DataFrame) -> DataFrame:
    """Per date: first boards, runs of two, three and five or more, rungs that someone stands on, and how many of yesterday's went on."""
    n, before = F.col("consecutive_limit_ups"), F.col("__before")
    rows = flagged.withColumn("__before", S.delay("consecutive_limit_ups"))
    return rows.groupBy("date").agg(
        _count(n == 1).alias("first_board"), _count(n >= 2).alias("ge2_count"), _count(n >= 3).alias("ge3_count"), _count(n >= 5).alias("ge5_count"),
        F.countDistinct(F.when(n >= 2, n)).alias("rungs_filled"), _count(before >= 1).alias("promo_pool"), _count((before >= 1) & (n == before + 1)).alias("promo_ok"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_boards"),
    )


def ladder_rows(flagged: DataFrame) -> DataFrame:
    """Rows on the ladder today or yesterday, with their status: promoted, first, broken (touched today) or dropped."""
    n, before = F.col("consecutive_limit_ups"), F.col("yesterday")
    rows = flagged.withColumn("yesterday", F.coalesce(S.delay("consecutive_limit_ups"), F.lit(0))).where((n > 0) | (before > 0))
    status = F.when((n > 0) & (before > 0), "promoted").when(n > 0, "first").when(F.col("signal_broken_limit_up"), "broken").otherwise("dropped")
    return rows.select("symbol", "date", n.alias("boards"), "yesterday", status.alias("status"))
