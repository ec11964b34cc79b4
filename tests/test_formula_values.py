"""Functions that look at a window's values share one column of them."""

from __future__ import annotations

from tessera.functions import families, formula


def test_values_of_a_window_are_gathered_once(spark):
    names = frozenset(["open", "high", "low", "close", "volume", "amount", "raw_close"])
    compiler = formula.Compiler(names)
    made = [compiler.compile(t).column for t in families.windowed(5).values()]
    steps = [str(c) for step in compiler.steps.values() for c in step.values()]
    # of close, high and low
    assert sum(c.count("collect_list") for c in [*steps, *map(str, made)]) == 3
    assert not any("percentile" in c for c in [*steps, *map(str, made)])


def test_formulas_share_their_windows(spark):
    panel = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate((3, 1, 2, 2, 5))], "symbol string, date int, close double")
    made = formula.with_formulas(panel, {"m": "ts_mean(close, 3)", "z": "ts_zscore(close, 3)", "again": "ts_mean(ts_mean(close, 3) - close, 2)"})
    windows = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    # count, avg, stddev_samp of close; count, avg of what is left
    assert sorted(x.count("windowspecdefinition") for x in windows) == [2, 3]
    got = made.orderBy("date").collect()
    assert made.columns == ["symbol", "date", "close", "m", "z", "again"]
    assert [r["m"] for r in got] == [None, None, 2.0, 5 / 3, 3.0] and [r["z"] for r in got][:3] == [None, None, 0.0]
    assert [r["again"] for r in got][:3] == [None] * 3 and abs(got[3]["again"] + 1 / 6) < 1e-12
