"""Filters, set operations, merges and small functions over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.formula import Compiler, Refused
from tessera.functions.windows import safe_div

# --- filters --------------------------------------------------------------------------------------------------------------------


def traded(bars: DataFrame) -> DataFrame:
    """Without the days on which a symbol was halted: no open and no high, or no volume and no amount."""
    halted = ((F.col("open") == 0) & (F.col("high") == 0)) | ((F.col("volume") == 0) & (F.col("amount") == 0))
    return bars.where(~F.coalesce(halted, F.lit(False)))


def scrubbed(rows: DataFrame) -> DataFrame:
    """NaN and infinite values of all floating columns become null."""
    made = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, t in rows.dtypes if t in ("double", "float")}
    return rows.withColumns(made) if made else rows


#: Shares of a lot; how far the implied mean price may lie outside low, high and close. Fixed values.
LOT, BELOW_LOW, ABOVE_HIGH, OFF_CLOSE = 100.0, 0.97, 1.03, 0.20


def sane_amount(amount: Column, volume: Column, low: Column, high: Column, close: Column) -> Column:
    """The amount, or close times shares where the mean price it implies is out of the bar's reach."""
    implied = safe_div(amount, volume * LOT)
    usable = (volume > 0) & (close > 0) & implied.isNotNull()
    far = F.abs(implied / close - 1) > OFF_CLOSE
    outside = (low > 0) & (high >= low) & ((implied < low * BELOW_LOW) | (implied > high * ABOVE_HIGH))
    return F.when(F.coalesce(usable & (far | outside), F.lit(False)), close * volume * LOT).otherwise(amount)


#: Units of stored shares and what one of them is worth.
UNITS = {"share": 1.0, "percent": 0.01, "permille": 0.001, "bp": 0.0001}


def as_share(value: Column, unit: str) -> Column:
    return value * UNITS[unit]


def condition(rows: DataFrame, text: str) -> DataFrame:
    """Rows that meet a condition written as a formula without windows; anything else is refused, so no text becomes SQL."""
    part = Compiler(frozenset(rows.columns)).compile(text)
    if not part.truth or part.steps:
        raise Refused("E003", "a condition on one row is needed")
    return rows.where(F.coalesce(part.column, F.lit(False)))


def picked(rows: DataFrame, specs: list[str]) -> DataFrame:
    """Rows that meet all ``field:v1|v2``: the field, as text, is one of the values. An unknown field is an error."""
    out = rows
    for spec in specs:
        name, _, values = spec.partition(":")
        if name not in rows.columns:
            raise ValueError(f"unknown field {name!r}")
        out = out.where(F.col(name).cast("string").isin(values.split("|")))
    return out


def in_scope(rows: DataFrame, kind: str, symbols: list | None = None, groups: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of all symbols, of the given ones, or of the members of the named groups (symbol, member); an unknown kind lets nothing through."""
    if kind == "all":
        return rows
    if kind == "symbols" and symbols is not None:
        return rows.where(F.col("symbol").isin(symbols))
    if kind == "group" and groups is not None and names:
        return rows.join(groups.where(F.col("member").isin(names)).select("symbol"), "symbol", "left_semi")
    return rows.limit(0)


def capped(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; a report's rule, not a sample."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def page(rows: DataFrame, by: list[tuple[str, bool]], offset: int, limit: int) -> DataFrame:
    """One page of the rows in order; by: (column, descending), nulls last."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in by]
    return rows.orderBy(*order).offset(offset).limit(limit)


# --- sets and merges ------------------------------------------------------------------------------------------------------------


def combined(sources: list[DataFrame], key: str, every: bool) -> DataFrame:
    """Keys in all sources, or in any."""
    out = sources[0].select(key)
    for s in sources[1:]:
        out = out.intersect(s.select(key)) if every else out.union(s.select(key))
    return out.distinct()


def restored(panel: DataFrame, raw: DataFrame, key: list[str]) -> DataFrame:
    """``panel`` with the rows of ``raw`` whose key it lacks; columns that raw lacks are null."""
    return panel.unionByName(raw.join(panel, key, "left_anti"), allowMissingColumns=True)


def tail_merged(history: DataFrame, tail: DataFrame, time: str) -> DataFrame:
    """History up to the day before the tail begins, then the tail, so that the day both have comes from the tail alone."""
    since = tail.agg(F.min(time).alias("__since"))
    before = history.crossJoin(F.broadcast(since)).where(F.col("__since").isNull() | (F.col(time) < F.col("__since"))).drop("__since")  # one row on the right
    return before.unionByName(tail, allowMissingColumns=True)


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new``, and the rows of ``old`` whose key it does not have: whole days give way."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` and the rows of ``new`` with keys that are not there yet, the first of each by ``order``."""
    w = Window.partitionBy(*key).orderBy(order)
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.unionByName(first.join(old, key, "left_anti"), allowMissingColumns=True)


def preferred(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """One row a key, from the first source that has it; a source has a key once."""
    out = None
    for place, s in enumerate(sources):
        one = s.withColumn("__p", F.lit(place))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__p")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__p")


def blanks_filled(rows: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with null or blank values of the columns taken from ``other``; nothing else changes."""
    more = other.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    joined = rows.join(more, key, "left")
    return joined.select(*[F.when(blank(c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def missing_symbols(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(date, symbol) expected on a date that is there at all, and missing; expected: (symbol, since)."""
    calendar = rows.agg(F.sort_array(F.collect_set("date")).alias("dates"))  # one row, a date each day of the market
    due = expected.crossJoin(F.broadcast(calendar)).select("symbol", F.explode(F.filter("dates", lambda d: d >= F.col("since"))).alias("date"))
    return due.join(rows, ["symbol", "date"], "left_anti").select("date", "symbol")


def integrity(bars: DataFrame) -> DataFrame:
    """Per date: rows, symbols, rows with a null, rows whose prices contradict each other, repeated keys."""
    empty = F.lit(False)
    for c in ("open", "high", "low", "close", "volume", "amount"):
        empty = empty | F.col(c).isNull()
    wrong = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    n = F.count("*")
    return bars.groupBy("date").agg(
        n.alias("rows"), F.countDistinct("symbol").alias("symbols"), F.count(F.when(empty, 1)).alias("with_null"), F.count(F.when(wrong, 1)).alias("wrong"), (n - F.countDistinct("symbol")).alias("repeated")
    )


def last_two(bars: DataFrame) -> DataFrame:
    """Per symbol its last two closes, side by side."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    placed = bars.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    at = lambda n: F.max(F.when(F.col("__n") == n, F.col("close")))
    return placed.groupBy("symbol").agg(F.max("date").alias("date"), at(1).alias("last_close"), at(2).alias("close_before"))


def counted(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column and how often each stands, the most frequent first."""
    return rows.groupBy(F.col(column).alias("value")).count().orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())


# --- functions of values --------------------------------------------------------------------------------------------------------


def exchange_code(code: Column) -> Column:
    """600000, SH600000 or 600000.sh to 600000.SH; null for what is no code of six digits."""
    digits = F.regexp_extract(code, "(?<![0-9])([0-9]{6})(?![0-9])", 1)
    first = F.substring(digits, 1, 1)
    place = F.when(first.isin("6", "5"), "SH").when(first.isin("0", "1", "2", "3"), "SZ").when(first.isin("4", "8", "9"), "BJ")
    return F.when(digits != "", F.concat(digits, F.lit("."), place))


def money(text: Column) -> Column:
    """Number of a text such as 1.2万, -3亿 or 1,200: ten thousands and hundred millions by their signs."""
    plain = F.regexp_replace(text, "[,\\s]", "")
    number = F.regexp_extract(plain, "^([+-]?[0-9]+(?:[.][0-9]+)?)(万亿|亿|万)?元?$", 1)
    sign = F.regexp_extract(plain, "^([+-]?[0-9]+(?:[.][0-9]+)?)(万亿|亿|万)?元?$", 2)
    worth = F.when(sign == "万亿", 1e12).when(sign == "亿", 1e8).when(sign == "万", 1e4).otherwise(1.0)
    return F.when(number != "", number.cast("double") * worth)


#: Minutes of the day at which the two sessions begin and end; fixed values.
SESSIONS = ((570, 690), (780, 900))


def session(ts: Column) -> Column:
    """morning, noon, afternoon or closed."""
    m = F.hour(ts) * 60 + F.minute(ts)
    (a, b), (c, d) = SESSIONS
    return F.when((m >= a) & (m < b), "morning").when((m >= b) & (m < c), "noon").when((m >= c) & (m < d), "afternoon").otherwise("closed")


def elapsed_minutes(ts: Column) -> Column:
    """Minutes of trading so far that day."""
    m = F.hour(ts) * 60 + F.minute(ts)
    spent = [F.least(F.greatest(m - a, F.lit(0)), F.lit(b - a)) for a, b in SESSIONS]
    return spent[0] + spent[1]


def found_by_name(rows: DataFrame, name: str, query: str) -> DataFrame:
    """Rows whose name begins with the text, then those that hold it, letters in any case: with rank 0 or 1."""
    low, q = F.lower(name), query.lower()
    return rows.withColumn("rank", F.when(low.startswith(q), 0).when(low.contains(q), 1)).where("rank is not null")


def agreed(a: Column, b: Column) -> Column:
    """The first of two readings if both have one sign; null if they disagree."""
    return F.when(F.signum(a) == F.signum(b), a)


def joined_labels(membership: DataFrame, order: list[str]) -> DataFrame:
    """Per symbol its members in the given order, joined by commas; members outside the order come last, by name."""
    place = F.coalesce(*[F.when(F.col("member") == m, F.lit(i)) for i, m in enumerate(order)], F.lit(len(order)))
    sorted_ = F.array_sort(F.collect_set(F.struct(place.alias("p"), F.col("member").alias("m"))))
    return membership.groupBy("symbol").agg(F.array_join(F.transform(sorted_, lambda x: x["m"]), ",").alias("labels"))


def next_event(events: DataFrame, today: Column) -> DataFrame:
    """Per symbol the nearest event on or after ``today``: date and amount."""
    return events.where(F.col("date") >= today).groupBy("symbol").agg(F.min("date").alias("date"), F.min_by("amount", F.struct("date", "amount")).alias("amount"))


def latest_value(rows: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Per key the last value that is not null, and its time."""
    at = F.when(F.col(value).isNotNull(), F.struct(time, value))
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(F.when(F.col(value).isNotNull(), F.col(time))).alias("at"))


def knowable(disclosed: DataFrame, ts: str, calendar: DataFrame, close_hour: int = 15) -> DataFrame:
    """``disclosed`` with knowable: the first trading day on which it could be acted on: the same day before the close, else the next one.

    calendar (date) has a row a trading day. Each trading day stands for the days since the one
    before it, so rows look their day up in a table of days; days beyond the calendar are null.
    """
    day = F.to_date(ts)
    wanted = disclosed.withColumn("__day", F.when(F.hour(ts) >= close_hour, F.date_add(day, 1)).otherwise(day))
    days = calendar.select("date").distinct().withColumn("__before", F.lag("date").over(Window.orderBy("date")))  # a row a date
    first = days.agg(F.min("date").alias("__first"))
    since = F.coalesce(F.date_add("__before", 1), F.col("date"))
    looked = days.select(F.col("date").alias("knowable"), F.explode(F.sequence(since, F.col("date"))).alias("__day"))
    out = wanted.crossJoin(F.broadcast(first)).withColumn("__day", F.greatest("__day", "__first"))  # one row on the right
    return out.join(looked, "__day", "left").drop("__day", "__first")


def shares_of_weight(rows: DataFrame, by: list[str], weight: str, value: str, to: str) -> DataFrame:
    """``rows`` with the part of the value that falls to each by its weight among those of the group."""
    return rows.withColumn(to, safe_div(F.col(value) * F.col(weight), F.sum(weight).over(Window.partitionBy(*by))))


def trend(rows: DataFrame, value: str) -> DataFrame:
    """Sum per date and its change since the date before. A row a date."""
    daily = rows.groupBy("date").agg(F.sum(value).alias("total"))
    return daily.withColumn("change", F.col("total") - F.lag("total").over(Window.orderBy("date")))


def stale(known: DataFrame, current: DataFrame, tolerance: float, most_days: int, today: Column) -> DataFrame:
    """Symbols whose known value is missing, too old or off the current one by more than the tolerance; known: (symbol, value, at), current: (symbol, value)."""
    both = current.withColumnRenamed("value", "__now").join(known, "symbol", "left")
    off = F.abs(safe_div("value", "__now") - 1) > tolerance
    why = F.when(F.col("value").isNull(), "missing").when(F.datediff(today, "at") > most_days, "old").when(off, "off")
    return both.withColumn("why", why).where("why is not null").select("symbol", "why")
