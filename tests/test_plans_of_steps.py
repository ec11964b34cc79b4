"""What the shared steps sort, join and go through, and that their results are as by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import factors
from tessera.functions.windows import Cross, Shared
from tessera.operators import candles, desk, fundamentals, indicators, limits
from tessera.plans import queries

BAR = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"
DAY = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bars(spark, n: int):
    rows = [("a", DAY + dt.timedelta(days=i), 10.0, 11.0 + i * 7 % 13, 9.0 - i * 5 % 3, 10.0 + i * 11 % 17, 100.0 + i, 1e8) for i in range(n)]
    return spark.createDataFrame(rows, BAR)


def test_ranks_of_a_column_share_one_sort(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 0.0), (1, -0.0), (1, float("nan")), (1, None), (2, 5.0)], "date int, x double")
    got = rows.select("*", Cross().average_rank("x").alias("r"), Cross().rank("x").alias("share"))
    assert plan(got).count("Sort [") == 1
    want = [(1, 0.0, 1.5, 0.3), (1, 0.0, 1.5, 0.3), (1, 2.0, 3.5, 0.7), (1, 2.0, 3.5, 0.7), (1, None, None, None), (2, 5.0, 1.0, 1.0)]
    assert sorted(map(tuple, got.where("x is null or not isnan(x)").collect()), key=repr) == sorted(want, key=repr)
    assert [r["r"] for r in got.where("isnan(x)").collect()] == [5.0]


def test_runs_share_the_sort_of_the_bars(spark):
    flagged = limits.flags(bars(spark, 9).withColumn("percent", F.lit(10)))
    assert plan(flagged).count("Sort [") == 1
    streaks = indicators.streaks(bars(spark, 9))
    assert plan(streaks).count("Sort [") == 1
    close = [10.0 + i * 11 % 17 for i in range(9)]
    want, run = [], 0
    for a, b in zip([close[0], *close], close):
        run = run + 1 if b > a else 0
        want.append(run)
    assert [r["up_streak"] for r in streaks.orderBy("date").collect()] == want


def test_changes_over_days_need_no_join(spark):
    at = lambda n: DAY + dt.timedelta(days=n)
    values = spark.createDataFrame([("a", at(0), 10.0), ("a", at(20), 12.0), ("a", at(30), 40.0), ("b", at(0), 1.0)], "symbol string, date date, value double")
    splits = spark.createDataFrame([("a", at(30), 2.0)], "symbol string, since date, ratio double")
    got = desk.changed_since(values, (10, 30), splits)
    assert "Join" not in plan(got) and plan(got).count("Sort [") == 1
    assert [tuple(r) for r in got.orderBy("symbol", "date").select("change_10d", "change_30d").collect()] == [(None, None), (12 / 10 - 1, None), (20 / 12 - 1, 1.0), (None, None)]


def test_quarters_back_come_with_one_join(spark):
    reports = spark.createDataFrame([("a", dt.date(2023, 3 * q + 1, 1), dt.date(2023, 3 * q + 1, 1), 1.0 * q) for q in (0, 1, 3)], "symbol string, quarter date, announced date, v double")
    placed = spark.createDataFrame([("a", DAY, 2023 * 4 + 3), ("a", DAY, None)], "symbol string, date date, qkey int")
    got = fundamentals.quarters_back(placed, reports, ["v"], [0, 1, 2])
    assert plan(got).count("Join") == 1
    assert sorted((tuple(r) for r in got.select("v_0", "v_1", "v_2").collect()), key=repr) == [(3.0, None, 1.0), (None, None, None)]


def test_extremes_of_240_bars_come_from_those_of_60(spark):
    made = indicators.rolling(bars(spark, 260))
    got = made.select("date", "close", factors.first()["distance_to_high_240d"].alias("d"), factors.first()["position_240d"].alias("p")).orderBy("date")
    assert "-239" not in plan(got)
    rows = got.collect()
    assert all(r["d"] is None and r["p"] is None for r in rows[:239])
    for i, r in enumerate(rows[239:], 239):
        last = [x["close"] for x in rows[i - 239 : i + 1]]
        assert r["d"] == r["close"] / max(last) - 1 and r["p"] == (r["close"] - min(last)) / (max(last) - min(last))


def largest_method(spark, df) -> int:
    """Bytes of the largest method that the stages of ``df`` are compiled to."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_patterns_fit_methods_that_are_compiled(spark):
    """The JVM goes through a method of over 8,000 bytes without compiling it. Open patterns share their windows."""
    made = candles.patterns(bars(spark, 30))
    assert largest_method(spark, made) <= 8000
    assert plan(made).count("Window [") == 5
    assert len(made.columns) == 8 + len(candles.PATTERNS) and made.count() == 30
    few = candles.patterns(bars(spark, 30), ["doji", "engulfing"])
    assert few.columns[8:] == ["cdl_doji", "cdl_engulfing"]
    assert few.exceptAll(made.select(few.columns)).count() == 0


def test_equal_windows_are_computed_once(spark):
    shared = Shared()
    made = {"z": shared.zscore("close", 5), "m": shared.mean("close", 5), "r": shared.rank("close", 5), "least": shared.argmin("close", 5), "half": shared.quantile("close", 5, 0.5)}
    got = bars(spark, 9).withColumns(shared.windows).select("date", "close", *[v.alias(k) for k, v in made.items()])
    windows = next(x for x in plan(got).splitlines() if "Window [" in x)
    assert windows.count("windowspecdefinition") == 4  # count, avg, stddev_samp, collect_list
    rows = got.orderBy("date").collect()
    assert all(v is None for r in rows[:4] for v in r[2:])
    for i, r in enumerate(rows[4:], 4):
        last = [x["close"] for x in rows[i - 4 : i + 1]]
        assert r["m"] == sum(last) / 5 and r["least"] == last.index(min(last)) + 1 and r["half"] == sorted(last)[2]
        assert r["r"] == sum(x < r["close"] for x in last) + (last.count(r["close"]) + 1) / 2


def test_time_series_compute_equal_windows_once(spark):
    made = plan(queries.formula_time_series(spark, "/root/testdata/sf0.001"))
    (windows,) = [x for x in made.splitlines() if "Window [" in x and "row_number" not in x]
    assert windows.count("windowspecdefinition") == 15 and "regr_" not in windows


def test_lines_of_a_window(spark):
    rows = [("a", DAY + dt.timedelta(days=i), x, i + 1) for i, x in enumerate([1.0, 3.0, 2.0, 6.0, 5.0, 5.0, 5.0, None, 7.0, 9.0, 11.0])]
    got = spark.createDataFrame(rows, "symbol string, date date, x double, rn int")
    S = Shared()
    made = {"slope": S.slope("x", "rn", 3), "r2": S.rsquare("x", "rn", 3), "resi": S.resi("x", "rn", 3), "none": S.slope("x", "rn", 1)}
    got = got.withColumns(S.windows).select("rn", *[v.alias(k) for k, v in made.items()]).orderBy("rn").collect()
    values = [r[2] for r in rows]
    for i, r in enumerate(got):
        last = values[max(i - 2, 0) : i + 1]
        assert r["none"] is None
        if len(last) < 3 or None in last:
            assert r["slope"] is None and r["r2"] is None and r["resi"] is None
            continue
        mean, slope = sum(last) / 3, (last[2] - last[0]) / 2
        around = sum((x - mean) ** 2 for x in last)
        assert abs(r["slope"] - slope) < 1e-12 and abs(r["resi"] - (last[2] - mean - slope)) < 1e-12
        assert r["r2"] is None if not around else abs(r["r2"] - slope * slope * 2 / around) < 1e-12
