"""The enriched panel: rolling indicators and signals over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import Series, safe_div

S = Series()
YEAR = 252


def rolling(bars: DataFrame) -> DataFrame:
    """Add moving means, bands, extremes, momenta, volatility and volume ratios. One sort serves all frames."""
    one = bars.withColumns(
        {
            "prev_close": S.delay("close"),
            **{f"ma{n}": S.mean("close", n) for n in (5, 10, 20, 30, 60)},
            "std20": S.std("close", 20),
            "vol_ma5": S.mean("volume", 5),
            "vol_ma10": S.mean("volume", 10),
            "vol_prev5": S.mean("volume", 5, end=-1),
            "high_60d": S.max("close", 60),
            "low_60d": S.min("close", 60),
            **{f"momentum_{n}d": S.change("close", n) for n in (5, 10, 20, 30, 60)},
            "change_pct": S.change("close"),
        }
    )
    return one.withColumns(
        {
            "boll_upper": F.col("ma20") + 2 * F.col("std20"),
            "boll_lower": F.col("ma20") - 2 * F.col("std20"),
            "vol_ratio_5d": safe_div("volume", "vol_prev5"),
            "change_amount": F.col("close") - F.col("prev_close"),
            "amplitude": safe_div(F.col("high") - F.col("low"), "prev_close"),
            "annual_vol_20d": S.std("change_pct", 20) * YEAR**0.5,
            "ma_bull_align": F.when(F.col("ma60").isNotNull(), ((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")) & (F.col("ma20") > F.col("ma60"))).cast("int")),
            "ma_bear_align": F.when(F.col("ma60").isNotNull(), ((F.col("ma5") < F.col("ma10")) & (F.col("ma10") < F.col("ma20")) & (F.col("ma20") < F.col("ma60"))).cast("int")),
        }
    ).drop("std20", "vol_prev5")


def window_signals() -> dict[str, Column]:
    """Signals on columns of ``rolling``."""
    up, down = S.crossed_up, S.crossed_down
    return {
        "signal_ma_golden_5_20": up("ma5", "ma20"),
        "signal_ma_dead_5_20": down("ma5", "ma20"),
        "signal_ma_golden_20_60": up("ma20", "ma60"),
        **{f"signal_ma{n}_breakout": up("close", f"ma{n}") for n in (5, 10, 20, 30, 60)},
        **{f"signal_ma{n}_breakdown": down("close", f"ma{n}") for n in (5, 10, 20, 30, 60)},
        "signal_n_day_high": F.col("close") >= F.col("high_60d"),
        "signal_n_day_low": F.col("close") <= F.col("low_60d"),
        "signal_boll_breakout_upper": F.col("close") > F.col("boll_upper"),
        "signal_boll_breakdown_lower": F.col("close") < F.col("boll_lower"),
        "signal_volume_surge": F.col("vol_ratio_5d") >= 2.0,
    }


def recursive_signals() -> dict[str, Column]:
    """Signals on columns of ``with_recursive``."""
    return {
        "signal_macd_golden": S.crossed_up("macd_dif", "macd_dea"),
        "signal_macd_dead": S.crossed_down("macd_dif", "macd_dea"),
        "signal_kdj_golden": S.crossed_up("kdj_k", "kdj_d"),
        "signal_kdj_dead": S.crossed_down("kdj_k", "kdj_d"),
    }


def streaks(bars: DataFrame) -> DataFrame:
    """Lengths of the runs of rising and of falling closes that end at each bar."""
    moved = bars.withColumn("prev", S.delay("close")).withColumns({"up": F.coalesce(F.col("close") > F.col("prev"), F.lit(False)), "down": F.coalesce(F.col("close") < F.col("prev"), F.lit(False))})
    marked = moved.withColumn("__row", S.row())
    return marked.withColumns({"up_streak": S.streak("up", "__row"), "down_streak": S.streak("down", "__row")}).drop("prev", "up", "down", "__row")


def resample(bars: DataFrame, grain: str) -> DataFrame:
    """Coarser bars from finer ones: first open, last close, extremes and sums."""
    return bars.groupBy("symbol", F.date_trunc(grain, "date").cast("date").alias("date")).agg(
        F.min_by("open", "date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    )


def limit_price(prev: Column, percent: Column) -> Column:
    """Exchange limit price, half up in whole cents: percent as a whole number, negative for the lower limit."""
    cents = F.floor(prev * 100 + 0.5)
    return (F.floor((cents * (F.lit(100) + percent) + 50) / 100)) / 100
