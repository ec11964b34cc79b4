"""Operators on small panels whose answers are known, files, and streams."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from tessera.functions import families, formula
from tessera.operators import candles, factor_test, joins, limits, recursive, row_patterns, rows, statistics
from tessera.sources import files
from tessera.streaming import bar_state, events

D = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return D + dt.timedelta(days=i)


def panel(spark, bars: dict[str, list[tuple[float, float, float, float]]]):
    """Bars (open, high, low, close) by symbol, a day each."""
    flat = [(s, day(i), float(o), float(h), float(low), float(c), 100.0 + i, 1000.0) for s, xs in bars.items() for i, (o, h, low, c) in enumerate(xs)]
    return spark.createDataFrame(flat, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")


# --- formulas -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("nothing + 1", "E001"), ("foo(close)", "E002"), ("ts_mean(close)", "E003"), ("ts_mean(close, volume)", "E003"), ("ts_mean(close, 0)", "E004"), ("ts_mean(close, 2.5)", "E004"), ("ts_mean(close, 9999)", "E004"),
        ("ts_delay(close, -1)", "E005"), ("-" * 13 + "close", "E006"), (" + ".join(["close"] * 150), "E007"), ("close / 0", "E008"), ("ts_mean(rank(close), 5)", "E009"), ("power(close, 5)", "E010"), ("winsorize(close, 9)", "E011"),
        ("close +", "E014"), ("", "E014"), ("__import__('os').system('x')", "E014"), ("close.real", "E014"), ("[close]", "E014"), ("lambda: close", "E014"), ("1 + 2", "E016"), ("ts_quantile(close, 5, 1)", "E004"), ("close and open", "E003"),
    ],
)
def test_refused_formulas(spark, text, code):
    got = formula.check(text, ["close", "open", "volume"])
    assert got is not None and got.code in (code, "E007" if code == "E006" else code)


def test_formulas_do_not_look_ahead(spark):
    r = random.Random(1)
    bars = {s: [(p := 50 + r.random() * 10, p + r.random(), p - r.random(), p + r.uniform(-1, 1)) for _ in range(80)] for s in "ab"}
    texts = {k: v.replace("raw_close", "close") for k, v in families.alpha158((5, 20)).items()} | families.GTJA
    whole = formula.with_formulas(panel(spark, bars), texts).where(F.col("date") < day(60))
    cut = formula.with_formulas(panel(spark, {s: x[:60] for s, x in bars.items()}), texts)
    names = [c for c in cut.columns]
    assert sorted(map(str, whole.select(names).collect())) == sorted(map(str, cut.collect()))
    with pytest.raises(ValueError, match="gtja_15"):
        families.gtja("gtja_15")


def test_windows_stay_with_their_symbol(spark):
    got = formula.with_formulas(panel(spark, {"a": [(1, 1, 1, x) for x in (10, 11, 12)], "b": [(1, 1, 1, x) for x in (100, 90, 80)]}), {"d": "ts_delta(close, 1)"})
    assert {(r["symbol"], r["date"]): r["d"] for r in got.collect()} == {("a", day(0)): None, ("a", day(1)): 1.0, ("a", day(2)): 1.0, ("b", day(0)): None, ("b", day(1)): -10.0, ("b", day(2)): -10.0}


# --- patterns, limits, state ----------------------------------------------------------------------------------------------------


#: Ten plain bars (bodies of 0.5, ranges of 2) that any pattern may follow.
CALM = [(10, 11, 9, 10.5), (10.5, 11, 9.5, 10)] * 6


def test_candles(spark):
    cases = {
        "engulfing": ([(10.2, 10.4, 9.7, 9.8), (9.7, 10.6, 9.6, 10.5)], 100),
        "marubozu": ([(10, 12, 10, 12)], 100),
        "hammer": ([(9.7, 9.92, 7.7, 9.9)], 100),
        "doji": ([(10, 10.5, 9.5, 10.01)], 100),
        "dark_cloud_cover": ([(9, 11, 8.9, 10.9), (11.2, 11.3, 9.4, 9.6)], -100),
        "three_outside": ([(10.2, 10.4, 9.7, 9.8), (9.7, 10.6, 9.6, 10.5), (10.5, 11, 10.4, 10.9)], 100),
        # those that the tables hold none or few of
        "upside_gap_two_crows": ([(9, 11, 9, 11), (11.6, 11.7, 11.3, 11.4), (11.7, 11.8, 11.1, 11.2)], -100),
        "three_stars_south": ([(12, 12.2, 8, 10.5), (11.5, 11.6, 8.5, 10.4), (10.3, 10.35, 10.05, 10.1)], 100),
        "concealing_baby": ([(13, 13, 12, 12), (12, 12, 11, 11), (10.8, 11.5, 10, 10.2), (11.6, 11.7, 9.8, 9.9)], 100),
        "breakaway": ([(12, 12.1, 10, 10.1), (9.9, 10, 9.4, 9.5), (9.4, 9.6, 9, 9.2), (9.2, 9.3, 8.7, 8.8), (8.8, 10.1, 8.7, 10.05)], 100),
        "ladder_bottom": ([(12, 12.1, 11, 11.1), (11.8, 11.9, 10.7, 10.8), (11.5, 11.6, 10.2, 10.3), (10.8, 11.3, 9.9, 10), (11, 12, 10.9, 11.9)], 100),
        "mat_hold": ([(9, 11, 9, 11), (11.4, 11.5, 11.2, 11.2), (11.2, 11.3, 10.9, 10.9), (11, 11.1, 10.6, 10.7), (10.8, 12, 10.7, 11.9)], 100),
        "rising_falling_three": ([(9, 11, 9, 11), (10.8, 10.9, 10.6, 10.6), (10.5, 10.6, 10.3, 10.3), (10.2, 10.3, 9.9, 10), (10.1, 12, 10.1, 11.9)], 100),
        "advance_block": ([(10, 11.2, 9.9, 11.1), (10.8, 11.7, 10.7, 11.5), (11.4, 12.5, 11.3, 11.7)], -100),
    }
    got = candles.patterns(panel(spark, {k: CALM + bars for k, (bars, _) in cases.items()}))
    last = {r["symbol"]: r for r in got.collect() if r["date"] == day(len(CALM) + len(cases[r["symbol"]][0]) - 1)}
    assert {k: last[k][f"cdl_{k}"] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert len(candles.PATTERNS) == 61


def test_open_patterns_are_confirmed_once(spark):
    """A hikkake stays open for three bars; the first that turns back beyond the inner bar confirms it, and another takes its place."""
    outer, inner, out = (10, 14, 6, 11), (10, 12, 8, 11), (10, 11, 7, 9)
    quiet, beyond = (9, 11.5, 7.5, 9), (9, 13, 7.5, 12.5)
    cases = {
        "next": ([outer, inner, out, beyond, beyond], [0, 0, 100, 200, 0]),
        "third": ([outer, inner, out, quiet, (9, 11.6, 7.4, 9), beyond], [0, 0, 100, 0, 0, 200]),
        "late": ([outer, inner, out, quiet, (9, 11.6, 7.4, 9), (9, 11.7, 7.3, 9), beyond], [0, 0, 100, 0, 0, 0, 0]),
        "taken": ([outer, inner, out, (9, 10.5, 7.5, 9), (9, 11.5, 7.6, 9), (9, 13, 7.5, 12.5)], [0, 0, 100, 0, -100, 0]),
    }
    got = candles.patterns(panel(spark, {k: bars for k, (bars, _) in cases.items()})).orderBy("date").collect()
    for k, (_, want) in cases.items():
        assert [r["cdl_hikkake"] for r in got if r["symbol"] == k] == want, k


def test_patterns_need_their_past(spark):
    bars = [(10, 12, 10, 12)] * 3
    got = candles.patterns(panel(spark, {"a": bars})).collect()
    assert all(r[f"cdl_{k}"] == 0 for r in got for k in ("marubozu", "doji", "long_line", "hammer"))
    with pytest.raises(ValueError, match="beyond"):
        row_patterns.pattern(2, "c.close > a.close").fields()


def test_limit_percent(spark):
    data = [("300001.SZ", "2024-01-02", "A", 20), ("688001.SH", "2024-01-02", "*ST B", 20), ("830001.BJ", "2024-01-02", "C", 30), ("600001.SH", "2024-01-02", "ST D", 5), ("600001.SH", "2026-07-06", "ST D", 10), ("600001.SH", "2024-01-02", None, 10)]
    df = spark.createDataFrame(data, "code string, date string, name string, want int").withColumn("date", F.col("date").cast("date"))
    assert all(r["got"] == r["want"] for r in df.withColumn("got", limits.limit_percent(F.col("code"), F.col("date"), F.col("name"))).collect())


def test_limit_runs(spark):
    bars = panel(spark, {"a": [(10, 10, 10, 10), (11, 11, 11, 11), (12.1, 12.1, 12.1, 12.1), (13, 13.31, 12, 12.5), (11.3, 12, 11.25, 11.9)]}).withColumn("percent", F.lit(10))
    got = limits.flags(bars).orderBy("date").collect()
    assert [r["consecutive_limit_ups"] for r in got] == [0, 1, 2, 0, 0] and [r["signal_broken_limit_up"] for r in got] == [False, False, False, True, False]
    assert got[4]["signal_limit_down_recovery"] and got[1]["limit_upper"] == 11.0


def test_next_bar_equals_whole_history(spark):
    r = random.Random(3)
    bars = panel(spark, {s: [(p := 50 + r.random() * 10, p + r.random(), p - r.random(), p + r.uniform(-1, 1)) for _ in range(n)] for s, n in (("a", 90), ("b", 12), ("c", 2))})
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    today = bars.join(last, ["symbol", "date"])
    state = recursive.state_of(bars.join(last, ["symbol", "date"], "left_anti"))
    got = {x["symbol"]: x for x in recursive.next_bars(state, today).collect()}
    for x in recursive.with_recursive(bars).join(last, ["symbol", "date"]).collect():
        for c in recursive.EWM_COLUMNS:
            a, b = got[x["symbol"]][c], x[c]
            assert (a is None or math.isnan(a)) == (b is None or math.isnan(b)), (x["symbol"], c)
            assert a is None or math.isnan(a) or a == pytest.approx(b, rel=1e-9), (x["symbol"], c)


# --- joins and rows -------------------------------------------------------------------------------------------------------------


def test_intervals_keep_repeated_rows(spark):
    left = spark.createDataFrame([("a", day(0), 1), ("a", day(0), 1), ("a", day(9), 2), ("a", day(500), 3), ("b", day(1), 4), (None, day(1), 5)], "k string, t date, x int")
    spans = spark.createDataFrame([("a", day(-5), day(5), "s"), ("a", day(-3), None, "u"), ("a", day(-1), day(2), "v")], "k string, f date, e date, status string")
    got = sorted((str(r["k"]), r["x"], r["status"]) for r in joins.in_interval(left, spans, "k", "t", "f", "e", ["status"]).collect())
    assert got == [("None", 5, None), ("a", 1, "v"), ("a", 1, "v"), ("a", 2, "u"), ("a", 3, "u"), ("b", 4, None)]


@pytest.mark.parametrize("span", ["quarter", "month", None])
def test_asof(spark, span):
    r = random.Random(4)
    left = [(r.choice("abc"), day(r.randrange(700)), i) for i in range(300)]
    right = [(r.choice("ab"), day(i * 7), i) for i in range(90)]
    got = joins.asof(spark.createDataFrame(left, "k string, t date, x int"), spark.createDataFrame(right, "k string, s date, v int"), "k", "t", "s", ["v"], strict=True, span=span).collect()
    for row in got:
        want = [v for k, s, v in right if k == row["k"] and s < row["t"]]
        assert row["v"] == (want[-1] if want else None)
    assert len(got) == 300


def test_values(spark):
    codes = {"600000": "600000.SH", "sz000001": "000001.SZ", "830799.bj": "830799.BJ", "12345": None, None: None}
    texts = {"1.2万": 12000.0, "-3亿": -3e8, "1,200": 1200.0, "x": None, "2万亿元": 2e12}
    got = {r["c"]: r["x"] for r in spark.createDataFrame([(c,) for c in codes], "c string").withColumn("x", rows.exchange_code(F.col("c"))).collect()}
    assert got == codes
    assert {r["c"]: r["x"] for r in spark.createDataFrame([(c,) for c in texts], "c string").withColumn("x", rows.money(F.col("c"))).collect()} == texts


def test_conditions_are_whitelisted(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "a double, b double")
    assert rows.condition(df, "a < b or a > 2").count() == 2
    for text in ("a; drop table x", "exists(select 1)", "a + 1", "ts_mean(a, 2) > 1", "c > 1"):
        with pytest.raises(formula.Refused):
            rows.condition(df, text)
    assert rows.in_scope(df.withColumn("symbol", F.lit("x")), "nonsense").count() == 0


# --- statistics -----------------------------------------------------------------------------------------------------------------


def test_statistics(spark):
    r = random.Random(5)
    x = [r.gauss(0.01, 0.05) for _ in range(120)]
    df = spark.createDataFrame([("g", day(i), v) for i, v in enumerate(x)], "g string, date date, x double")
    n, m, lag = len(x), st.fmean(x), 4
    c = [v - m for v in x]
    gamma = [sum(c[i] * c[i + k] for i in range(n - k)) / n for k in range(lag + 1)]
    error = math.sqrt(max(gamma[0] + 2 * sum((1 - k / (lag + 1)) * gamma[k] for k in range(1, lag + 1)), 0) / n)
    got = statistics.newey_west(df, "g", "date", "x", lag).first()
    assert (got["n"], got["mean"], got["error"], got["t"]) == (n, pytest.approx(m), pytest.approx(error), pytest.approx(m / error))
    assert statistics.newey_west(df.limit(3), "g", "date", "x", 4).first()["t"] is None
    for z in (-3.0, -0.5, 0.0, 1.96):
        assert spark.range(1).select(statistics.normal_cdf(F.lit(z)).alias("p")).first()["p"] == pytest.approx(st.NormalDist().cdf(z), abs=1e-7)
    p = [0.01, 0.04, 0.03, None, 0.5]
    got = {r_["i"]: r_["q"] for r_ in statistics.false_discovery(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    assert got == {0: pytest.approx(0.04), 1: pytest.approx(0.16 / 3), 2: pytest.approx(0.16 / 3), 3: None, 4: pytest.approx(0.5)}
    draws = statistics.bootstrap_drawdowns(df, "x", 300)
    a, b = draws.first(), draws.first()
    assert a == b and -1 < a["p05"] <= a["p50"] <= a["p95"] <= 0
    assert statistics.expected_max_sharpe(1, 1.0) == 0 < statistics.expected_max_sharpe(10, 1.0) < statistics.expected_max_sharpe(100, 1.0)


def test_pruning(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.8), ("c", "d", -0.95)], "a string, b string, corr double")
    assert factor_test.pruned(pairs, ["a", "b", "c", "d"], 0.7) == ["a", "c"]


# --- files ----------------------------------------------------------------------------------------------------------------------


def test_reading(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame([("a", day(0), 1.0)], "symbol string, date date, open double").write.parquet(f"{path}/1")
    spark.createDataFrame([("b", day(1), 2.0, 5)], "symbol string, date date, close double, extra int").write.parquet(f"{path}/2")
    got = {r["symbol"]: r.asDict() for r in files.read_bars(spark, f"{path}/*").collect()}
    assert got["a"]["open"] == 1.0 and got["a"]["close"] is None and got["b"]["close"] == 2.0 and "extra" not in got["b"]
    files.view(spark, "bars_view", [f"{path}/1", f"{path}/2"])
    assert {(r["symbol"], r["extra"]) for r in spark.sql("select symbol, extra from bars_view").collect()} == {("a", None), ("b", 5)}
    (tmp_path / "x.csv").write_bytes("name,n\n中文,3\n".encode("gbk"))
    schema = spark.createDataFrame([], "name string, n int").schema
    assert files.read_csv(spark, str(tmp_path / "x.csv"), schema).first()["name"] == files.read_csv(spark, str(tmp_path / "x.csv"), schema, "GBK").first()["name"] == "中文"
    (tmp_path / "x.json").write_text('{"name": "a", "n": 1}\n{"name": "b"}\n')
    assert {tuple(r) for r in files.read_json(spark, str(tmp_path / "x.json"), schema).collect()} == {("a", 1), ("b", None)}
    raw = spark.createDataFrame([('{"d": {"p": "1.5", "when": "20240102"}}',), ("nonsense",), (None,)], "j string")
    got = files.from_json_paths(raw, "j", {"p": ("d.p", "double"), "w": ("d.when", "string")})
    assert [r["p"] for r in got.collect()] == [1.5, None, None]
    made = files.mapped(got, {"day": ("w", "date"), "share": ("w", "percent")}).collect()
    assert made[0]["day"] == dt.date(2024, 1, 2) and made[0]["share"] == 202401.02 and made[1]["day"] is None
    with pytest.raises(ValueError, match="eval"):
        files.mapped(got, {"x": ("w", "eval")})


def test_writing(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "symbol string, date date, kind string, v int, seq int"
    write = lambda data: files.upsert(spark, path, spark.createDataFrame(data, kinds), ["symbol", "date"], "date", "seq")
    write([("a", day(0), "x", 1, 1), ("b", day(0), "x", 2, 1), ("a", day(1), "x", 3, 1)])
    write([("a", day(0), "y", 9, 2), ("c", day(0), "x", 4, 1)])
    read = lambda: {(r["symbol"], r["date"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert read() == {("a", day(0), 9), ("b", day(0), 2), ("c", day(0), 4), ("a", day(1), 3)}
    files.replace_days(spark, path, spark.createDataFrame([("z", day(0), "x", 7, 1)], kinds), ["date", "kind"], "date")
    assert read() == {("a", day(0), 9), ("z", day(0), 7), ("a", day(1), 3)}
    archive = str(tmp_path / "archive")
    for data in ([("s", 1, "a"), ("s", 1, "b")], [("s", 1, "c"), ("s", 2, "d")]):
        files.append_new(spark, archive, spark.createDataFrame(data, "source string, id int, text string"), ["source", "id"], "text")
    assert {tuple(r) for r in spark.read.parquet(archive).collect()} == {("s", 1, "a"), ("s", 2, "d")}
    manifest = files.export(spark, spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string"), str(tmp_path / "out"), ["i"]).collect()
    assert {r["rows"] for r in manifest} == {2} and len({r["digest"] for r in manifest}) == 1


# --- streams --------------------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    schema = spark.createDataFrame([], "symbol string, ts timestamp, value double").schema
    for i, batch in enumerate(([("a", 0, 1.0), ("a", 30, 2.0), ("b", 40, 5.0)], [("a", 100, 3.0), ("a", 110, 9.0)], [("a", 9000, 4.0)], [("a", 5, 100.0)])):
        data = [(s, base + dt.timedelta(seconds=sec), v) for s, sec, v in batch]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.tick_stream(spark, str(tmp_path / "in"), schema)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    bars = run(events.tumbling(stream, "1 minute", late="10 minutes"), "bars", "append")
    got = {(r["symbol"], r["start"].timestamp() - base.timestamp()): (r["n"], r["total"]) for r in bars}
    assert got[("a", 60.0)] == (2, 12.0) and got[("b", 0.0)] == (1, 5.0) and got[("a", 0.0)][0] in (2, 3)  # files may come in any order
    assert {r["n"] for r in run(events.sessions(stream, "5 minutes", late="10 minutes"), "stretches", "append") if r["symbol"] == "b"} == {1}
    assert all(r["n"] >= 1 for r in run(events.sliding(stream, "2 minutes", "1 minute", late="10 minutes"), "slid", "append"))
    cooled = run(events.cooled_stream(stream.select("symbol", "ts"), 60), "cooled", "append")
    times = sorted(r["ts"].timestamp() for r in cooled if r["symbol"] == "a")
    assert times and all(b - a >= 60 for a, b in zip(times, times[1:]) if b > a)


# --- stored state ---------------------------------------------------------------------------------------------------------------


def walk(symbols: str, n: int, seed: int = 7):
    r = random.Random(seed)
    rows = []
    for s in symbols:
        p = 50.0
        for i in range(n):
            o, p = p, max(1.0, p + r.uniform(-2, 2))
            rows.append((s, day(i), o, max(o, p) + r.random(), min(o, p) - r.random(), p, 100.0 + r.randrange(50), 1000.0 + i))
    return rows


BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double, amount double"


def stored(spark, path):
    return {(r["symbol"], r["date"]): [None if v is None else round(v, 6) for v in (r[c] for c in bar_state.INDICATORS)] for r in bar_state.indicators(spark, path).collect()}


def test_state_goes_on_without_history(spark, tmp_path):
    """Day by day, with a new symbol, a day that one misses, corrections, late bars and repeated batches: always as if all had come at once."""
    rows = walk("abc", 70)
    late = [x for x in rows if x[0] == "b" and x[1] == day(40)]
    missing = [x for x in rows if x[0] == "c" and x[1] < day(60)]
    wrong = [(*x[:5], x[5] * 3, *x[6:7], 0.0) for x in rows if x[0] == "a" and x[1] == day(64)]
    usual = [x for x in rows if x not in late and x not in missing]
    days = lambda a, b: [x for x in usual if day(a) <= x[1] < day(b) and not (x[0] == "a" and x[1] == day(64))]
    batches = [days(0, 50), days(50, 60), days(60, 65) + wrong, [], days(65, 68), [x for x in rows if x[0] == "a" and x[1] == day(64)] + late, days(68, 70) + missing + days(68, 69)]
    path = f"file://{tmp_path}/state"
    df = lambda xs: spark.createDataFrame(xs, BAR_SCHEMA)
    for version, batch in enumerate(batches):
        assert bar_state.apply_bars(spark, path, df(batch), version)
        assert not bar_state.apply_bars(spark, path, df(wrong), version)
    got = stored(spark, path)
    bar_state.apply_bars(spark, f"file://{tmp_path}/whole", df(rows), 0)
    want = stored(spark, f"file://{tmp_path}/whole")
    assert len(got) == len(rows) and got == want
    plain = recursive.with_recursive(df(rows))
    for r in plain.collect():
        state = dict(zip(bar_state.INDICATORS, want[(r["symbol"], r["date"])], strict=True))
        for c in recursive.EWM_COLUMNS:
            assert state[c] == pytest.approx(r[c], abs=1e-5) if r[c] is not None and not math.isnan(r[c]) else state[c] is None, c


def test_new_bars_read_the_heads_alone(spark, tmp_path, monkeypatch):
    """Without corrections, nothing but the last version of the heads is joined to a batch."""
    path = f"file://{tmp_path}/state"
    rows = walk("ab", 20)
    df = lambda xs: spark.createDataFrame(xs, BAR_SCHEMA)
    bar_state.apply_bars(spark, path, df([x for x in rows if x[1] < day(19)]), 0)
    seen = []
    plan = bar_state.replayed
    monkeypatch.setattr(bar_state, "replayed", lambda rows, base: seen.append((rows, base)) or plan(rows, base))
    bar_state.apply_bars(spark, path, df([x for x in rows if x[1] == day(19)]), 1)
    (today, base), = seen
    assert today.count() == 2 and all("/heads/" in f for f in base.inputFiles())


def test_stream_of_bars_applies_each_batch_once(spark, tmp_path):
    rows = walk("ab", 12)
    for i in range(3):
        spark.createDataFrame([x for x in rows if day(4 * i) <= x[1] < day(4 * i + 4)], BAR_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/state"
    for _ in range(2):  # the second finds nothing new
        bar_state.stream_bars(read(), path, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    bar_state.apply_bars(spark, f"file://{tmp_path}/whole", spark.createDataFrame(rows, BAR_SCHEMA), 0)
    assert stored(spark, path) == stored(spark, f"file://{tmp_path}/whole")
    assert bar_state.heads(spark, path)[1] == 2


def test_stored_bars_hold_their_windows_once(spark, tmp_path):
    """The values of windows stand with a symbol's last bar of a batch, whatever the number of its bars; months that a batch does not touch are not read."""
    path = f"file://{tmp_path}/state"
    rows = walk("ab", 70)
    df = lambda xs: spark.createDataFrame(xs, BAR_SCHEMA)
    bar_state.apply_bars(spark, path, df([x for x in rows if x[1] < day(68)]), 0)
    bar_state.apply_bars(spark, path, df([x for x in rows if x[1] >= day(68)]), 1)
    held = spark.read.parquet(f"{path}/bars").where("state.closes is not null").select("symbol", "date", F.size("state.closes").alias("n")).collect()
    assert sorted(map(tuple, held)) == [(s, day(n), 60) for s in "ab" for n in (67, 69)]
