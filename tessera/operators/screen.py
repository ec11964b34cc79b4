"""Screens: a basic filter, a strategy's entry and exit conditions, a weighted score and the best of each date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Cross, Series, safe_div
from tessera.operators import indicators

S, X = Series(), Cross()


def c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Strategy:
    """Conditions on the enriched panel, and the weights of its score; exit None: never."""

    entry: Callable[[], Column]
    exit: Callable[[], Column] | None = None
    score: dict[str, float] = field(default_factory=lambda: {"momentum_20d": 0.5, "vol_ratio_5d": 0.3, "change_pct": 0.2})


def _below_ma20() -> Column:
    return S.crossed_down("close", "ma20")


def _near_ma20() -> Column:
    return F.abs(c("close") / c("ma20") - 1) < 0.02


#: Built-in strategies; their thresholds are fixed values.
STRATEGIES: dict[str, Strategy] = {
    "boll_breakout": Strategy(lambda: (c("close") > c("boll_upper")) & (c("vol_ratio_5d") >= 1.5), lambda: c("close") < c("boll_lower")),
    "breakout_new_high_60d": Strategy(
        lambda: (c("close") > S.delay("high_60d")) & (c("change_pct") >= 0.02) & (c("vol_ratio_5d") >= 1.3), lambda: c("close") < c("ma20")
    ),
    "bullish_alignment": Strategy(
        lambda: (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")) & (c("ma20") > c("ma60")) & (c("momentum_20d") > 0),
        lambda: S.crossed_down("ma5", "ma20") | S.crossed_down("close", "ma20"),
    ),
    "low_volatility_leader": Strategy(lambda: (c("momentum_20d") > 0) & (c("annual_vol_20d") < 0.30) & (c("close") > c("ma20")), _below_ma20),
    "ma_golden_cross": Strategy(
        lambda: S.crossed_up("ma5", "ma20") & (c("vol_ratio_5d") >= 1.2) & (c("close") > c("ma60")), lambda: S.crossed_down("ma5", "ma20")
    ),
    "n_day_low_reversal": Strategy(lambda: (c("close") <= c("low_60d")) & (c("close") > c("open")) & (c("vol_ratio_5d") >= 1.5), _below_ma20),
    "platform_consolidation_breakout": Strategy(
        lambda: ((S.max("high", 10, end=-1) - S.min("low", 10, end=-1)) / c("close") <= 0.08) & (c("close") > S.max("high", 10, end=-1)) & (c("vol_ratio_5d") >= 1.5),
        lambda: c("close") < c("ma20"),
    ),
    "pullback_ma20_bounce": Strategy(
        lambda: _near_ma20() & (c("ma5") > c("ma20")) & (c("ma20") > c("ma60")) & (c("change_pct") > 0),
        lambda: S.crossed_down("close", "ma20") | S.crossed_down("ma5", "ma20"),
    ),
    "pullback_to_support": Strategy(lambda: _near_ma20() & (c("vol_ratio_5d") < 0.8) & (c("close") > c("ma60")) & (c("momentum_20d") > 0), _below_ma20),
    "strong_open": Strategy(lambda: (c("open") > c("prev_close") * 1.03) & (c("close") > c("open")) & (c("change_pct") > 0.03), _below_ma20),
    "trend_breakout": Strategy(lambda: (c("close") > c("ma60")) & (c("close") >= c("high_60d")) & (c("vol_ratio_5d") >= 2), _below_ma20),
    "volume_price_surge": Strategy(lambda: S.crossed_up("close", "ma20") & (c("vol_ratio_5d") >= 2) & (c("close") > c("open")), _below_ma20),
}
#: Strategies on columns of ``recursive.with_recursive`` as well.
RECURSIVE_STRATEGIES: dict[str, Strategy] = {
    "macd_golden": Strategy(lambda: S.crossed_up("macd_dif", "macd_dea") & (c("vol_ratio_5d") >= 1.5), lambda: S.crossed_down("macd_dif", "macd_dea")),
    "macd_below_zero_revival": Strategy(
        lambda: (c("close") <= S.min("close", 20, end=-1)) & (c("macd_dif") < 0) & (c("macd_dif") > S.delay("macd_dif", 10)), lambda: S.crossed_up("macd_dif", F.lit(0.0))
    ),
    "oversold_bounce": Strategy(lambda: (c("rsi_14") < 30) & (c("close") > c("open")) & (c("vol_ratio_5d") >= 1.2), _below_ma20),
    "oversold_reversal": Strategy(lambda: (c("rsi_14") < 30) & (c("change_pct") > 0.01) & (c("close") > c("ma5")), _below_ma20),
    "rsi_midline_pullback": Strategy(
        lambda: (c("close") > c("ma60")) & c("rsi_14").between(45, 60) & (F.max("rsi_14").over(S.frame(5, -1)) > 65), lambda: c("close") < c("ma20")
    ),
}


def _band() -> tuple[Column, Column]:
    return F.greatest("ma5", "ma10", "ma20"), F.least("ma5", "ma10", "ma20")


def _squeezed(days: int = 5, widest: float = 0.025) -> Column:
    """The means have lain together on each of the ``days`` bars before this one."""
    top, bottom = _band()
    tight = ((top - bottom) / c("ma20") <= widest).cast("int")
    return F.sum(tight).over(S.frame(days, -1)) == days


#: Strategies on columns of ``limits.flags`` and of turnover, shadows and places in the bar as well (see ``limit_panel``).
LIMIT_STRATEGIES: dict[str, Strategy] = {
    "active_limit_gene": Strategy(
        lambda: (c("limit_up_count_60d") >= 3) & (c("change_pct") < 0.07) & (c("vol_ratio_5d") <= 1.2), lambda: c("limit_up_count_60d") < 2
    ),
    "broken_board_recovery": Strategy(lambda: c("signal_limit_up") & (c("vol_ratio_5d") >= 1.5) & (c("change_pct") > 0.03), _below_ma20),
    "consecutive_limit_ups": Strategy(lambda: c("signal_limit_up") & (c("consecutive_limit_ups") >= 2)),
    "high_turnover_surge": Strategy(lambda: (c("turnover_rate") > 5) & (c("change_pct") > 0.03), _below_ma20),
    "limit_up_momentum": Strategy(lambda: (c("change_pct") > 0.05) & (c("consecutive_limit_ups") >= 1)),
    "long_lower_shadow_reversal": Strategy(
        lambda: (c("lower_shadow") >= 0.03) & (c("momentum_5d") <= -0.05) & (c("vol_ratio_5d") >= 1.2) & (c("close_position") >= 0.5), lambda: c("close") < c("ma5")
    ),
    "ma_convergence_breakout": Strategy(
        lambda: _squeezed() & (c("close") > _band()[0]) & (c("change_pct") >= 0.02) & (c("vol_ratio_5d") >= 1.2), lambda: c("close") < c("ma10")
    ),
    "near_limit_up": Strategy(lambda: (c("change_pct") > 0.07) & (c("change_pct") >= c("percent") / 100 - 0.03), _below_ma20),
}


def limit_panel(flagged: DataFrame, shares: DataFrame) -> DataFrame:
    """``flagged`` bars with indicators and the further columns of LIMIT_STRATEGIES; shares: (symbol, float_shares)."""
    rolled = indicators.rolling(flagged).join(shares, "symbol")
    up = F.sum((c("consecutive_limit_ups") > 0).cast("int"))
    return rolled.withColumns(
        {
            "turnover_rate": safe_div(c("volume") * 10000, "float_shares"),
            "lower_shadow": safe_div(F.least("open", "close") - c("low"), "prev_close"),
            "close_position": safe_div(c("close") - c("low"), c("high") - c("low")),
            "limit_up_count_20d": S.guarded(c("consecutive_limit_ups"), 20, up.over(S.frame(20))),
            "limit_up_count_60d": S.guarded(c("consecutive_limit_ups"), 60, up.over(S.frame(60))),
        }
    )


def ranked_entries(scored: DataFrame, enter: float = 70.0, leave: float = 40.0, n: int = 20) -> DataFrame:
    """``scored`` with entry (a score of ``enter``, among the n best of its date, ties by symbol) and exit (a score of ``leave`` or less)."""
    enough = F.when(c("score") >= enter, c("score"))
    placed = scored.withColumn("__place", F.row_number().over(Window.partitionBy("date").orderBy(enough.desc_nulls_last(), "symbol")))
    return placed.withColumns({"entry": enough.isNotNull() & (c("__place") <= n), "exit": c("score") <= leave}).drop("__place")


def held(panel: DataFrame, children: list[tuple[str, int]], least: int = 1) -> DataFrame:
    """Several strategies as one: entry where ``least`` children enter, exit where a child whose entry stood within its last n bars leaves.

    panel has entry_<name> and exit_<name> for each (name, n).
    """
    votes, leave = F.lit(0), F.lit(False)
    for name, n in children:
        votes = votes + c(f"entry_{name}").cast("int")
        leave = leave | (c(f"exit_{name}") & (F.max(c(f"entry_{name}").cast("int")).over(S.frame(n)) > 0))
    return panel.withColumns({"entry": votes >= least, "exit": leave, "votes": votes})


def evaluated(panel: DataFrame, strategies: dict[str, Strategy]) -> DataFrame:
    """``panel`` with boolean columns entry_<name> and exit_<name>; undecided counts as false."""
    columns = {}
    for name, s in strategies.items():
        columns[f"entry_{name}"] = F.coalesce(s.entry(), F.lit(False))
        columns[f"exit_{name}"] = F.coalesce(s.exit(), F.lit(False)) if s.exit else F.lit(False)
    return panel.withColumns(columns)


def basic_filter(
    panel: DataFrame, least_price: float = 0.0, least_amount: float = 0.0, prefixes: tuple[str, ...] = (), excluded: str | None = None, listed_after: int = 0, name: str = "name"
) -> DataFrame:
    """Rows that pass the floors of price and amount, symbol prefixes, a pattern of excluded names (column ``name``; a missing name passes) and a minimum age in bars."""
    out = panel.where((c("close") >= least_price) & (c("amount") >= least_amount))
    if prefixes:
        match = F.lit(False)
        for p in prefixes:
            match = match | c("symbol").cast("string").startswith(p)
        out = out.where(match)
    if excluded:
        out = out.where(~F.coalesce(c(name).rlike(excluded), F.lit(False)))
    if listed_after:
        out = out.withColumn("__age", F.row_number().over(S.spec)).where(c("__age") > listed_after).drop("__age")
    return out


def score(weights: dict[str, float]) -> Column:
    """0 to 100: factors scaled to 0..1 within the date, a negative weight turning one round; missing counts 0."""
    total, size = F.lit(0.0), sum(abs(w) for w in weights.values())
    for name, w in weights.items():
        x = X.minmax(name)
        total = total + F.coalesce(x if w > 0 else 1 - x, F.lit(0.0)) * abs(w)
    return total / size * 100


def top(rows: DataFrame, by: str, n: int, per: str = "date") -> DataFrame:
    """The n best rows of each ``per``, ties by symbol, with their place."""
    w = Window.partitionBy(per).orderBy(c(by).desc_nulls_last(), "symbol")
    return rows.withColumn("place", F.row_number().over(w)).where(c("place") <= n)


def blended(children: list[tuple[DataFrame, float]], least: int = 1) -> DataFrame:
    """Composite of several screens (date, symbol, score): scores turned into ranks within each child, weighted, from at least ``least`` children."""
    parts = None
    for frame, weight in children:
        n = F.count("*").over(Window.partitionBy("date"))
        ranked = frame.select("date", "symbol", (F.when(n > 1, (n - X.average_rank(-c("score"))) / (n - 1)).otherwise(1.0) * weight).alias("part"), F.lit(float(weight)).alias("weight"))
        parts = ranked if parts is None else parts.union(ranked)
    out = parts.groupBy("date", "symbol").agg((F.sum("part") / F.sum("weight")).alias("score"), F.count("*").alias("votes"))
    return out.where(c("votes") >= least)


#: Comparisons that a stored condition may name; a fixed list, so that no text becomes code.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "contains": lambda a, b: a.contains(b),
    "cross_up": lambda a, b: S.crossed_up(a, b),
    "cross_down": lambda a, b: S.crossed_down(a, b),
}


def condition(spec: dict, columns: set[str]) -> Column:
    """Column of one stored condition {left, op, right, leftDays, rightDays}; right is a column or a value. Undecided: false.

    Only an equality or ``contains`` takes text for a value; elsewhere text must name a column.
    """
    if spec["op"] not in OPERATORS:
        raise ValueError(f"unknown operator {spec['op']!r}")
    if spec["left"] not in columns:
        raise ValueError(f"unknown field {spec['left']!r}")

    right = spec["right"]
    if isinstance(right, str) and right not in columns and spec["op"] not in ("==", "!=", "contains"):
        raise ValueError(f"unknown field {right!r}")

    def side(value, days: int) -> Column:
        if isinstance(value, str) and value in columns:
            return S.delay(value, days) if days else F.col(value)
        return F.lit(value)

    return F.coalesce(OPERATORS[spec["op"]](side(spec["left"], spec.get("leftDays", 0)), side(spec["right"], spec.get("rightDays", 0))), F.lit(False))


def signal(specs: list[dict], columns: set[str], logic: str = "and") -> Column:
    """All (or any) of at most eight conditions."""
    if not 1 <= len(specs) <= 8:
        raise ValueError("a signal has one to eight conditions")
    out = condition(specs[0], columns)
    for s in specs[1:]:
        out = out & condition(s, columns) if logic == "and" else out | condition(s, columns)
    return out
