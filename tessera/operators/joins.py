"""Joins over time: as of, by interval, forward, and on a filled grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Series


def asof(
    left: DataFrame, right: DataFrame, on: str | list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, span: str | None = "quarter"
) -> DataFrame:
    """``left`` with the values of the last row of ``right`` of the same key not after it (before it, if strict).

    Both sides are tagged, united and sorted by (key, time, tag) within spans of time; the last
    value that is not null is carried forward. What a span begins with comes from one row a key
    and span, carried forward the same way, so the rows of a hot key are dealt over its spans.
    No pair of rows is ever formed. span None: times that are not dates, in one piece a key.
    """
    keys = [on] if isinstance(on, str) else on
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    by = [f"__k{i}" for i in range(len(keys))]
    payload, row = F.struct(*values), F.struct(*left.columns)
    piece = lambda t: F.date_trunc(span, t) if span else F.lit(0)
    r = right.select(*named, F.col(right_time).alias("__t"), piece(right_time).alias("__s"), F.lit(1 if strict else 0).alias("__tag"), payload.alias("__v"))
    le = left.select(*named, F.col(left_time).alias("__t"), piece(left_time).alias("__s"), F.lit(0 if strict else 1).alias("__tag"), row.alias("__row"))
    both = le.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__s").orderBy("__t", "__tag").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__row is not null")
    if span:
        ends = both.groupBy(*by, "__s").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__end"))
        before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.select(*[F.col(k).alias(f"{k}b") for k in by], F.col("__s").alias("__sb"), F.last("__end", ignorenulls=True).over(before).alias("__begin"))
        same = F.col("__s").eqNullSafe(F.col("__sb"))
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}b"))
        found = found.join(begins, same).withColumn("__v", F.coalesce("__v", "__begin"))
    return found.select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def in_interval(left: DataFrame, intervals: DataFrame, on: str, time: str, start: str, end: str, values: list[str], span: str = "year") -> DataFrame:
    """``left`` with the values of the interval [start, end) of its key; of several, the one that began last. A null end is open.

    Rows that repeat stay. Keys with times are matched once each; an interval stands once a
    span that it touches, so a row meets only the intervals around it.
    """
    asked = left.select(F.col(on).alias("__k"), F.col(time).alias("__t")).distinct().withColumn("__p", F.trunc("__t", span))
    ends = asked.agg(F.max("__p").alias("__last"))
    i = intervals.select(F.col(on).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"), *values).crossJoin(F.broadcast(ends))  # one row on the right
    first, last = F.trunc("__s", span), F.least(F.trunc("__e", span), F.col("__last"))
    step = F.expr(f"interval 1 {span}")
    i = i.where(first <= last).withColumn("__p", F.explode(F.sequence(first, last, step)))
    met = asked.join(i, ["__k", "__p"]).where("__t >= __s and (__e is null or __t < __e)")
    best = met.groupBy("__k", "__t").agg(F.max_by(F.struct(*values), F.struct("__s", *values)).alias("__v"))
    joined = left.join(best, left[on].eqNullSafe(best["__k"]) & left[time].eqNullSafe(best["__t"]), "left")
    return joined.select(*[left[c] for c in left.columns], *[F.col(f"__v.{v}").alias(v) for v in values])


def numbered(dates: DataFrame) -> DataFrame:
    """Distinct dates with n, their place in the calendar from 1. A row a date."""
    return dates.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))


def forward_return(bars: DataFrame, horizons: list[int], lag: int = 0) -> DataFrame:
    """Return of each bar to the bar at the date h places later in the market's calendar; null where there is none.

    With lag, from the bar ``lag`` places later to h places after that. One sort by symbol
    serves all horizons: a frame reaches by calendar number, not by row.
    """
    placed = bars.join(numbered(bars).withColumnRenamed("n", "__n"), "date")
    at = lambda k: F.first("close").over(Window.partitionBy("symbol").orderBy("__n").rangeBetween(k, k))
    base = at(lag) if lag else F.col("close")
    return placed.withColumns({f"fwd_{h}": F.when(base != 0, at(lag + h) / base - 1) for h in horizons}).drop("__n")


def filled_grid(bars: DataFrame, value: str) -> DataFrame:
    """Every symbol on every date from its first on, the value carried forward. The grid is as large as its answer."""
    first = bars.groupBy("symbol").agg(F.min("date").alias("since"))
    calendar = bars.agg(F.sort_array(F.collect_set("date")).alias("dates"))  # one row, a date each day of the market
    grid = first.crossJoin(F.broadcast(calendar)).select("symbol", F.explode(F.filter("dates", lambda d: d >= F.col("since"))).alias("date"))
    return grid.join(bars.select("symbol", "date", value), ["symbol", "date"], "left").withColumn(value, Series().fill(value))


def adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices in terms of the last date: times the cumulative factor at the bar over the total; factors: (symbol, date, factor)."""
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = factors.withColumn("cum", F.exp(F.sum(F.ln("factor")).over(upto)))
    total = cumulative.groupBy("symbol").agg(F.max_by("cum", "date").alias("total"))
    out = asof(bars, cumulative.select("symbol", F.col("date").alias("since"), "cum"), "symbol", "date", "since", ["cum"])
    scale = F.coalesce("cum", F.lit(1.0)) / F.coalesce("total", F.lit(1.0))
    return out.join(total, "symbol", "left").withColumn("adj_close", F.col("close") * scale).drop("cum", "total")


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and state: new, kept or removed."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    both = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("__b").isNull(), "new").when(F.col("__a").isNull(), "removed").otherwise("kept").alias("state"))


def merged(sources: list[DataFrame], key: list[str], columns: list[str], seen: str) -> DataFrame:
    """One row a key from several sources: of each column the latest value that is not null, by ``seen``."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seen))).alias(c) for c in columns])


def with_extension(panel: DataFrame, extension: DataFrame, values: list[str], dated: bool) -> DataFrame:
    """``panel`` with columns of an extension table: of a snapshot by symbol, of a time series the last row not after the date, so that nothing is seen early."""
    if dated:
        renamed = extension.select("symbol", F.col("date").alias("__since"), *values)
        return asof(panel, renamed, "symbol", "date", "__since", values)
    return panel.join(extension.select("symbol", *values), "symbol", "left")


def shares_then(bars: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """``bars`` with float_shares as of each date, and on the last date of all the current ones; before the first report the current ones too.

    history: (symbol, since, float_shares); current: (symbol, float_shares).
    """
    known = asof(bars, history.select("symbol", "since", F.col("float_shares").alias("__then")), "symbol", "date", "since", ["__then"])
    last = bars.agg(F.max("date").alias("__last"))
    both = known.join(current.withColumnRenamed("float_shares", "__now"), "symbol", "left").crossJoin(F.broadcast(last))  # one row on the right
    then = F.when(F.col("date") == F.col("__last"), F.col("__now")).otherwise(F.coalesce("__then", "__now"))
    return both.withColumn("float_shares", then).drop("__then", "__now", "__last")


def adjusted_ticks(ticks: DataFrame, factors: DataFrame) -> DataFrame:
    """``ticks`` (symbol, ts, value) with adjusted, the value times the cumulative factor of its day; looked up once a symbol and day.

    factors: (symbol, date, factor).
    """
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = factors.select("symbol", F.col("date").alias("since"), F.exp(F.sum(F.ln("factor")).over(upto)).alias("cum"))
    days = ticks.select("symbol", F.to_date("ts").alias("date")).distinct()
    found = asof(days, cumulative, "symbol", "date", "since", ["cum"]).withColumnRenamed("date", "__day").withColumnRenamed("symbol", "__symbol")
    joined = ticks.join(found, (ticks["symbol"] == found["__symbol"]) & (F.to_date(ticks["ts"]) == found["__day"]))
    return joined.withColumn("adjusted", F.col("value") * F.coalesce("cum", F.lit(1.0))).drop("__day", "__symbol", "cum")


def by_code(left: DataFrame, right: DataFrame, left_code: str, right_code: str) -> DataFrame:
    """Rows of ``left`` with those of ``right`` whose codes have the same six digits, however they write the exchange."""
    digits = lambda c: F.regexp_extract(c, "([0-9]{6})", 1)
    r = right.withColumn("__digits", digits(right_code)).drop(right_code)
    joined = left.withColumn("__code", digits(left_code)).join(r, F.col("__code") == F.col("__digits"), "left")
    return joined.drop("__code", "__digits")
