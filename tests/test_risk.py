"""Figures of risk at their bounds."""

from __future__ import annotations

import datetime as dt
import math

from tessera.operators import statistics


def test_ratios_without_a_deviation_are_infinite(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(24)]
    returns = {"up": [0.01, 0.02] * 12, "flat": [0.5] * 24, "none": [0.0] * 24, "down": [0.01, -0.02] * 12}
    rows = [(g, d, x) for g, xs in returns.items() for d, x in zip(days, xs)]
    got = {x["g"]: x for x in statistics.risk(spark.createDataFrame(rows, "g string, d date, x double"), "g", "d", "x", 52).collect()}
    assert got["up"]["sortino"] == math.inf and 0 < got["up"]["sharpe"] < math.inf
    assert got["flat"]["sharpe"] == got["flat"]["sortino"] == got["flat"]["quality"] == math.inf
    assert math.isnan(got["none"]["sharpe"]) and math.isnan(got["none"]["sortino"])
    assert -math.inf < got["down"]["sortino"] < 0
