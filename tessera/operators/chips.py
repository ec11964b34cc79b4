"""Chip distribution: at what prices the shares now held were bought, estimated from turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Series, safe_div

#: Price bins between the lowest low and the highest high, bars looked back on, least width of a bin. Fixed values.
BINS, BARS, LEAST_WIDTH = 150, 210, 0.01


def deposits(bars: DataFrame) -> DataFrame:
    """(symbol, bin, chips, close, low, width): chips left in each bin at the symbol's last bar.

    Bars: symbol, date, open, high, low, close, turnover (share of the shares that changed
    hands). A bar lays its turnover on its prices as a triangle with its top at the mean of the
    four prices; each later bar takes its own share away. What is left of a bar is a product
    over the bars after it, a sum of logarithms; one that turns everything over ends what was
    before it. So no bar waits for another, and bins are summed by shuffle.
    """
    valid = (F.col("high") >= F.col("low")) & (F.col("low") > 0)
    rows = bars.where(valid).withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))).where(F.col("__n") <= BARS)
    rows = rows.withColumn("rate", F.least(F.greatest(F.coalesce("turnover", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    later = Window.partitionBy("symbol").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("symbol")
    gone = F.coalesce(F.max((F.col("rate") == 1).cast("int")).over(later), F.lit(0)) == 1
    left = F.coalesce(F.exp(F.sum(F.when(F.col("rate") < 1, F.log1p(-F.col("rate")))).over(later)), F.lit(1.0))
    placed = rows.withColumns(
        {"left": F.when(gone, 0.0).otherwise(left), "min": F.min("low").over(whole), "max": F.max("high").over(whole), "last": F.max_by("close", "date").over(whole), "top": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4}
    )
    placed = placed.withColumn("width", F.greatest((F.col("max") - F.col("min")) / (BINS - 1), F.lit(LEAST_WIDTH))).where("rate > 0 and left > 0")
    flat = F.col("high") == F.col("low")
    first = F.when(flat, F.floor((F.col("top") - F.col("min")) / F.col("width"))).otherwise(F.ceil((F.col("low") - F.col("min")) / F.col("width")))
    stop = F.when(flat, first).otherwise(F.floor((F.col("high") - F.col("min")) / F.col("width")))
    placed = placed.withColumns({"first": F.greatest(first, F.lit(0)), "stop": F.least(stop, F.lit(BINS - 1))}).where("first <= stop")
    each = placed.withColumn("bin", F.explode(F.sequence("first", "stop"))).withColumn("price", F.col("min") + F.col("width") * F.col("bin"))
    height = F.lit(2.0) / (F.col("high") - F.col("low"))
    rise = F.when(F.abs(F.col("top") - F.col("low")) < 1e-8, height).otherwise((F.col("price") - F.col("low")) / (F.col("top") - F.col("low")) * height)
    fall = F.when(F.abs(F.col("high") - F.col("top")) < 1e-8, height).otherwise((F.col("high") - F.col("price")) / (F.col("high") - F.col("top")) * height)
    weight = F.when(flat, (BINS - 1) / 2.0).when(F.col("price") <= F.col("top"), rise).otherwise(fall)
    return each.groupBy("symbol", "bin").agg(F.sum(weight * F.col("rate") * F.col("left")).alias("chips"), F.first("last").alias("close"), F.first("min").alias("low"), F.first("width").alias("width"))


def costs(deposited: DataFrame) -> DataFrame:
    """Per symbol: share of chips at or below the close, and the prices below which half of them, and the inner 90 and 70 percent, lie.

    A price is that of the first bin at which the chips so far exceed the share.
    """
    total = F.sum("chips").over(Window.partitionBy("symbol"))
    upto = F.sum("chips").over(Window.partitionBy("symbol").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    price = F.col("low") + F.col("width") * F.col("bin")
    rows = deposited.withColumns({"price": price, "total": total, "upto": upto}).where("total > 0")
    at = lambda q: F.min(F.when(F.col("upto") > F.col("total") * q, F.col("price")))
    out = rows.groupBy("symbol").agg(
        F.first("close").alias("close"), (F.sum(F.when(F.col("price") <= F.col("close"), F.col("chips")).otherwise(0.0)) / F.first("total")).alias("benefit"), at(0.5).alias("avg_cost"),
        at(0.05).alias("cost_90_low"), at(0.95).alias("cost_90_high"), at(0.15).alias("cost_70_low"), at(0.85).alias("cost_70_high"),
    )
    spread = lambda n: safe_div(F.col(f"cost_{n}_high") - F.col(f"cost_{n}_low"), F.col(f"cost_{n}_high") + F.col(f"cost_{n}_low"))
    return out.withColumns({"concentration_90": spread(90), "concentration_70": spread(70), "avg_cost_bias": safe_div("close", "avg_cost") - 1})


def levels(bars: DataFrame, near: int = 5) -> DataFrame:
    """Per bar: pivot of the bar before with two lines on each side, Bollinger and range bands, extremes, gaps, retracements and the round number below.

    Each is a price at which others may act; null until its window is full.
    """
    s = Series()
    h, low, c = (s.delay(x) for x in ("high", "low", "close"))
    one = bars.withColumns({"pivot_price": (h + low + c) / 3, "__h": h, "__l": low, "__c": c, "ma20": s.mean("close", 20), "__sd": s.std("close", 20), "high_60": s.max("high", 60), "low_60": s.min("low", 60)})
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__c")), F.abs(F.col("low") - F.col("__c")))
    two = one.withColumn("__tr", F.when(F.col("__c").isNotNull(), reach))
    span = F.col("high_60") - F.col("low_60")
    p = F.col("pivot_price")
    made = two.withColumns(
        {
            "r1": 2 * p - F.col("__l"), "s1": 2 * p - F.col("__h"), "r2": p + F.col("__h") - F.col("__l"), "s2": p - F.col("__h") + F.col("__l"),
            "boll_upper": F.col("ma20") + 2 * F.col("__sd"), "boll_lower": F.col("ma20") - 2 * F.col("__sd"), "atr": s.mean("__tr", 14),
            "fib_382": F.col("high_60") - span * 0.382, "fib_500": F.col("high_60") - span * 0.5, "fib_618": F.col("high_60") - span * 0.618,
            "gap_up": F.when(F.col("low") > F.col("__h"), F.col("__h")), "gap_down": F.when(F.col("high") < F.col("__l"), F.col("__l")),
            "swing_high": F.when(F.col("high") == F.max("high").over(s.spec.rowsBetween(-near, near)), F.col("high")), "swing_low": F.when(F.col("low") == F.min("low").over(s.spec.rowsBetween(-near, near)), F.col("low")),
            "round_below": F.floor(F.col("close") / 50) * 50.0,
        }
    )
    return made.withColumns({"keltner_upper": F.col("ma20") + 2 * F.col("atr"), "keltner_lower": F.col("ma20") - 2 * F.col("atr")}).drop("__h", "__l", "__c", "__sd", "__tr")
