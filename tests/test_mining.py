"""Correlations, clusters and combinations against plain loops, with values missing here and there."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
import statistics as st

import pytest

from tessera.operators import factor_test, mining

D = dt.date(2024, 1, 1)
FACTORS = ["a", "b", "c", "d"]


def rows(seed=1, dates=6, symbols=25):
    r = random.Random(seed)
    out = []
    for i in range(dates):
        for s in range(symbols):
            a = r.choice([1.0, 2.0, 2.5, r.random()])
            values = [a, a + r.gauss(0, 0.3), r.random(), 7.0 if i == 2 else r.random()]
            values = [None if r.random() < 0.15 else float("nan") if r.random() < 0.05 else v for v in values]
            out.append((f"s{s}", D + dt.timedelta(days=i), *values, a * 0.1 - (values[2] or 0) * 0.05 + r.gauss(0, 0.05)))
    return out


def panel(spark, data):
    return spark.createDataFrame(data, "symbol string, date date, a double, b double, c double, d double, y double")


def ranked(x):
    return [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]


def rho(x, y):
    a, b = ranked(x), ranked(y)
    return st.correlation(a, b) if len(set(a)) > 1 and len(set(b)) > 1 else None


def known(v):
    return v is not None and math.isfinite(v)


def daily(data, columns):
    """Per date, the values of the columns on the rows that have them all."""
    for date in sorted({x[1] for x in data}):
        own = [[x[2 + "abcdy".index(c)] for c in columns] for x in data if x[1] == date]
        yield [v for v in own if all(map(known, v))]


def test_pairs_on_the_rows_that_have_both(spark):
    data = rows()
    got = {(r["a"], r["b"]): r for r in mining.pair_correlations(panel(spark, data), FACTORS).collect()}
    assert set(got) == set(itertools.combinations(FACTORS, 2))
    for pair, r in got.items():
        each = [(rho(*zip(*own, strict=True)), len(own)) for own in daily(data, pair) if len({v[0] for v in own}) >= 3]
        each = [(ic, n) for ic, n in each if ic is not None]
        assert r["corr"] == pytest.approx(st.mean(ic for ic, _ in each)) and r["n_dates"] == len(each) and r["n"] == sum(n for _, n in each)
    assert got["a", "d"]["n_dates"] == 5  # constant on one date
    assert mining.pair_correlations(panel(spark, data).limit(0), FACTORS).count() == 0
    one = mining.daily_correlations(panel(spark, data), ["a", "b"], against=["y"]).collect()
    assert {(r["a"], r["b"]) for r in one} == {("a", "y"), ("b", "y")}


def test_the_plan_has_one_size(spark):
    size = lambda k: mining.pair_correlations(panel(spark, rows()), FACTORS[:k])._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(2) == size(4)


def test_clusters(spark):
    pairs = [("a", "b", 0.9), ("a", "c", -0.8), ("b", "c", 0.1), ("a", "d", 0.2), ("c", "d", None), ("b", "d", 0.95), ("d", "e", 0.6), ("a", "e", 0.55)]
    df = spark.createDataFrame(pairs, "a string, b string, corr double")
    placed = lambda order, **k: [(p.factor, p.representative, p.rho) for p in mining.greedy_clusters(df, order, 0.5, **k)]
    assert placed("abcd") == [("a", "a", None), ("b", "a", 0.9), ("c", "a", -0.8), ("d", "d", None)]
    assert placed("adce") == [("a", "a", None), ("d", "d", None), ("c", "a", -0.8), ("e", "a", 0.55)]
    assert placed("ade", strongest=True)[-1] == ("e", "d", 0.6)
    assert placed("") == []


def by_hand(data, c):
    ics, n = [], 0
    for own in daily(data, (*c.factors, "y")):
        if len(own) < 3:
            continue
        *xs, y = zip(*own, strict=True)
        blend = [sum(w * d * v for w, d, v in zip(c.weights, c.directions, r, strict=True)) for r in zip(*map(ranked, xs), strict=True)]
        ic = rho(blend, y)
        if ic is not None:
            ics.append(ic)
            n += len(own)
    return st.mean(ics), st.mean(ics) / st.pstdev(ics), n, len(ics)


def test_beam_search(spark):
    data = rows(seed=3)
    df = panel(spark, data)
    whole = mining.beam_search(df, FACTORS, "y", most=3, width=100, trials=1000)
    assert len(whole) == 4 + 6 * 3 + 4 * 4 == len({(c.factors, c.weights) for c in whole})
    for c in whole:
        ic, ir, n, dates = by_hand(data, c)
        assert (c.rank_ic, c.ir) == pytest.approx((ic, ir)) and (c.observations, c.dates) == (n, dates)
        assert len(c.factors) > 1 or c.rank_ic >= 0
    assert whole == mining.ordered(whole)
    # a narrow beam keeps the best of each level, and extends those only
    narrow = mining.beam_search(df, FACTORS, "y", most=2, width=1)
    best = next(c for c in whole if len(c.factors) == 1)
    assert {len(c.factors) for c in narrow} == {1, 2} and best in narrow
    assert next(c for c in narrow if len(c.factors) == 2) == next(c for c in whole if len(c.factors) == 2 and best.factors[0] in c.factors)
    assert {len(c.factors) for c in mining.beam_search(df, FACTORS, "y", trials=4)} == {1}
    assert mining.beam_search(df.limit(0), FACTORS, "y") == [] == mining.beam_search(df, [], "y")


def test_nested_folds(spark):
    dates = spark.createDataFrame([(D + dt.timedelta(days=i),) for i in range(50)] * 2, "date date")
    sizes = {"train": 20, "test": 6, "step": 7, "inner_train": 8, "inner_test": 4, "inner_step": 4, "purge": 2}
    got = {}
    for r in factor_test.nested_folds(dates, **sizes).collect():
        got.setdefault((r["fold"], r["inner"], r["part"]), []).append((r["date"] - D).days)
    got = {k: sorted(v) for k, v in got.items()}
    want = {}
    for f in range(4):  # 7 * 3 + 28 <= 50
        s = 7 * f
        want |= {(f, None, "train"): [*range(s, s + 20)], (f, None, "test"): [*range(s + 22, s + 28)]}
        for j in range(2):  # 4 + 14 <= 20
            a = s + 4 * j
            want |= {(f, j, "train"): [*range(a, a + 8)], (f, j, "test"): [*range(a + 10, a + 14)]}
    assert got == want
    assert factor_test.nested_folds(dates.limit(5), **sizes).count() == 0
    with pytest.raises(ValueError, match="inner fold"):
        factor_test.nested_folds(dates, **(sizes | {"train": 10}))


def test_nothing_of_a_test_chooses(spark):
    """The chosen factor is the best of the inner tests, however it does afterwards; changing the last dates changes no choice."""
    sizes = {"train": 20, "test": 6, "step": 7, "inner_train": 8, "inner_test": 4, "inner_step": 4, "purge": 2}
    r = random.Random(5)
    ics = [(D + dt.timedelta(days=i), f, r.gauss({"good": 0.2, "bad": -0.05, "mid": 0.05}[f], 0.02)) for i in range(28) for f in ("good", "bad", "mid")]
    turned = [(d, f, -x if (d - D).days >= 22 else x) for d, f, x in ics]
    made = []
    for rows_ in (ics, turned):
        daily = spark.createDataFrame(rows_, "date date, factor string, ic double")
        made.append(factor_test.walk_forward(daily, factor_test.nested_folds(daily.select("date"), **sizes)).collect())
    (a,), (b,) = made
    assert a["factor"] == b["factor"] == "good" and a["inner_ic"] == b["inner_ic"] and a["inner_folds"] == 2 and a["days"] == 6
    assert a["test_ic"] == pytest.approx(-b["test_ic"]) and a["train_ic"] == pytest.approx(b["train_ic"])
