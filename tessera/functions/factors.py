"""Catalogue of factors as columns of the enriched panel.

Stages keep windows unnested: FIRST needs bars with ``indicators.rolling``, SECOND needs FIRST.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import Cross, Series, log, safe_div

S, X = Series(), Cross()


def _c(name: str) -> Column:
    return F.col(name)


def _of_240(best: Callable[..., Column], of_60: str) -> Column:
    """The best of 240 bars from that of 60 here and 60, 120 and 180 bars before: a frame that long is gone through for every row."""
    parts = [_c(of_60), *[S.delay(of_60, n) for n in (60, 120, 180)]]
    return F.when(reduce(and_, [p.isNotNull() for p in parts]), best(*parts))


def first() -> dict[str, Column]:
    ret, volume, amount = _c("change_pct"), _c("volume"), _c("amount")
    top, bottom = _of_240(F.greatest, "high_60d"), _of_240(F.least, "low_60d")
    return {
        **{f"ma{n}_bias": safe_div("close", f"ma{n}") - 1 for n in (5, 10, 20, 30, 60)},
        "boll_position": safe_div(_c("close") - _c("boll_lower"), _c("boll_upper") - _c("boll_lower")),
        "boll_width": safe_div(_c("boll_upper") - _c("boll_lower"), "ma20"),
        "vol_ratio_10d": safe_div(volume, S.mean("volume", 10, end=-1)),
        "vol_trend_5_10": safe_div("vol_ma5", "vol_ma10") - 1,
        "vol_trend_5_60": safe_div(S.mean("volume", 5), S.mean("volume", 60)) - 1,
        "log_amount": F.when(amount >= 0, F.log1p(amount)),
        "amount_ratio_5d": safe_div(amount, S.mean("amount", 5, end=-1)) - 1,
        "gap_return": safe_div("open", "prev_close") - 1,
        "intraday_return": safe_div("close", "open") - 1,
        "close_position": safe_div(_c("close") - _c("low"), _c("high") - _c("low")),
        "distance_to_high_60d": safe_div("close", "high_60d") - 1,
        "distance_from_low_60d": safe_div("close", "low_60d") - 1,
        "max_ret_20d": S.max("change_pct", 20),
        "ret_skew_20d": F.when(S.std0("change_pct", 20) > 0, S.skew("change_pct", 20)),
        "up_days_20d": S.sum((ret > 0).cast("int"), 20).cast("double"),
        "vol_price_corr_20d": S.corr("change_pct", "volume", 20),
        "momentum_120d": S.change("close", 120),
        "mom_accel_20_60": _c("momentum_20d") - _c("momentum_60d"),
        "vol_regime_5_60": safe_div(S.std("change_pct", 5), S.std("change_pct", 60)),
        "amplitude_trend_20_60": safe_div(S.mean("amplitude", 20), S.mean("amplitude", 60)) - 1,
        "downside_vol_20d": F.sqrt(S.mean(F.pow(F.least(ret, F.lit(0.0)), F.lit(2)) + ret * 0, 20)),
        "obv_trend_20d": safe_div(S.sum(F.signum(ret) * volume, 20), S.mean("volume", 20) * 20),
        "amount_mean_20d": S.mean(amount / 1e8, 20),
        "amihud_20d": S.mean(safe_div(F.abs(ret), amount / 1e8), 20),
        "position_240d": safe_div(_c("close") - bottom, top - bottom),
        "distance_to_high_240d": safe_div("close", top) - 1,
    }


def second() -> dict[str, Column]:
    return {"overnight_ret_20d": S.sum("gap_return", 20), "intraday_ret_20d": S.sum("intraday_return", 20)}


def recursive() -> dict[str, Column]:
    """Factors on columns of ``recursive.with_recursive``."""
    return {
        **{f"ema{n}_bias": safe_div("close", f"ema{n}") - 1 for n in (5, 10, 20, 30, 60)},
        "macd_dif_pct": safe_div("macd_dif", "close"),
        "macd_dea_pct": safe_div("macd_dea", "close"),
        "macd_hist_pct": safe_div("macd_hist", "close"),
        "atr_pct": safe_div("atr_14", "close"),
        "rsi_14_delta_5d": S.delta("rsi_14", 5),
        "kdj_kd_diff": _c("kdj_k") - _c("kdj_d"),
    }


def turnover(bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Turnover factors; shares: (symbol, float_shares)."""
    joined = bars.join(shares, "symbol").withColumn("turnover_rate", safe_div(F.col("volume") * 10000, "float_shares"))
    rate = "turnover_rate"
    return joined.withColumns(
        {
            "turnover_ratio_5d": safe_div(rate, S.mean(rate, 5, end=-1)) - 1,
            "turnover_z_60d": safe_div(F.col(rate) - S.mean(rate, 60, end=-1), S.std(rate, 60, end=-1)),
            "turnover_mean_20d": S.mean(rate, 20),
            "turnover_std_20d": safe_div(S.std(rate, 20), S.mean(rate, 20)),
            "log_float_mv": log(safe_div(F.col("close") * F.col("volume"), rate)),
        }
    )


def composite(weights: dict[str, float]) -> Column:
    """Weighted sum of the factors' scores within each date."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.coalesce(X.zscore(name), F.lit(0.0))
    return total
