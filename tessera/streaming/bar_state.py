"""Indicators with memory, from a stored state: new bars need no history, corrected bars replay from the last good state.

Two tables under one path. ``bars`` has one row per symbol and date, partitioned by month: the
bar and the numbers that the recursions remember after it; the values of its windows stand
with a symbol's last bar of a batch alone, as the bars before an earlier one tell them.
``heads`` has the last state of each symbol, a version a batch.
A batch of new bars reads the newest heads alone. Where a batch corrects or fills in earlier
bars, the symbols concerned start again from the state before, and their later bars follow.
A version that is there already is not applied again, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.joins import keep_last
from tessera.sources.files import existing, rewritten, upsert

#: Partitions of the table; with the letter, no reader takes them for numbers or dates.
MONTH = "yyyy-MM'm'"
BAR = ("open", "high", "low", "close", "volume", "amount")
SPANS, SMOOTHED = (5, 10, 20, 30, 60), (6, 14, 24)
#: What windows need of the past: values of the last bars, this one among them.
HELD = {"closes": ("close", 60), "highs": ("high", 9), "lows": ("low", 9), "volumes": ("volume", 10)}
#: Exponential means: name to weight of a new value.
MEANS = {**{f"ema{n}": 2 / (n + 1) for n in SPANS}, "e12": 2 / 13, "e26": 2 / 27, "atr_14": 1 / 14, **{f"{side}{n}": 1 / n for side in ("gain", "loss") for n in SMOOTHED}}
CARRIED = ("dea", "k", "d")
#: What is read from the windows of a bar.
WINDOWED = (*[f"ma{n}" for n in SPANS], "vol_ma5", "vol_ratio_5d", "change_pct")
SHOWN = ("macd_dif", "macd_dea", "macd_hist", *[f"rsi_{n}" for n in SMOOTHED], "kdj_k", "kdj_d", "kdj_j", *WINDOWED)
#: ``ranged``: whether the bar has a place in its range, and so k and d of its own.
REMEMBERED = ("date", "close", *MEANS, *CARRIED, "ranged", *WINDOWED)
TYPES = {"date": "date", "ranged": "boolean"}
PLAIN = "struct<" + ",".join(f"{c}:{TYPES.get(c, 'double')}" for c in REMEMBERED) + ">"
STATE = PLAIN[:-1] + "," + ",".join(f"{c}:array<double>" for c in HELD) + ">"
#: Columns that a user reads.
INDICATORS = (*[f"ema{n}" for n in SPANS], "atr_14", *SHOWN)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _mean(values: Column, n: int, skip: int = 0) -> Column:
    """Of the last n values but ``skip``; null where there are fewer."""
    tail = F.slice(values, F.greatest(F.size(values) - n - skip + 1, F.lit(1)), n)
    return F.when(F.size(values) >= n + skip, F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / n)


def step(s: Column, b: Column) -> Column:
    """The state after bar ``b``, from the state before it (null before the first)."""
    prev = s["close"]
    move = F.coalesce(b["close"] - prev, F.lit(0.0))
    true_range = F.greatest(b["high"] - b["low"], F.abs(b["high"] - prev), F.abs(b["low"] - prev))
    new = {**dict.fromkeys(MEANS, b["close"]), "atr_14": true_range}
    new |= {f"gain{n}": F.greatest(move, F.lit(0.0)) for n in SMOOTHED} | {f"loss{n}": F.greatest(-move, F.lit(0.0)) for n in SMOOTHED}
    means = [F.coalesce(a * new[c] + (1 - a) * s[c], new[c], s[c]).alias(c) for c, a in MEANS.items()]
    held = []
    for c, (of, n) in HELD.items():
        grown = F.concat(F.coalesce(s[c], F.array().cast("array<double>")), F.array(b[of]))
        held.append(F.slice(grown, F.greatest(F.size(grown) - n + 1, F.lit(1)), n).alias(c))

    def second(m: Column) -> Column:
        top, bottom = F.array_max(m["highs"]), F.array_min(m["lows"])
        rsv = F.when((F.size(m["highs"]) == HELD["highs"][1]) & (top != bottom), (b["close"] - bottom) / (top - bottom) * 100)
        return _let(F.struct((m["e12"] - m["e26"]).alias("dif"), rsv.alias("rsv")), lambda t: third(m, t))

    def third(m: Column, t: Column) -> Column:
        dea = F.coalesce(0.2 * t["dif"] + 0.8 * s["dea"], t["dif"], s["dea"])
        k = F.coalesce(t["rsv"] / 3 + s["k"] * 2 / 3, t["rsv"], s["k"])
        return _let(F.struct(dea.alias("dea"), k.alias("k")), lambda u: last(m, t, u))

    def last(m: Column, t: Column, u: Column) -> Column:
        known = t["rsv"].isNotNull()
        d = F.when(known, F.coalesce(u["k"] / 3 + s["d"] * 2 / 3, u["k"])).otherwise(s["d"])
        before = _mean(m["volumes"], 5, skip=1)
        windowed = {
            **{f"ma{n}": _mean(m["closes"], n) for n in SPANS},
            "vol_ma5": _mean(m["volumes"], 5), "vol_ratio_5d": F.when(before != 0, b["volume"] / before), "change_pct": F.when(prev != 0, b["close"] / prev - 1),
        }
        fields = [b["date"].alias("date"), b["close"].alias("close"), *[m[c].alias(c) for c in MEANS], u["dea"].alias("dea"), u["k"].alias("k"), d.alias("d"), known.alias("ranged")]
        return F.struct(*fields, *[windowed[c].alias(c) for c in WINDOWED], *[m[c].alias(c) for c in HELD]).cast(STATE)

    return _let(F.struct(*means, *held), second)


def _plain(s: Column) -> Column:
    """A state without HELD."""
    return F.struct(*[s[c].alias(c) for c in REMEMBERED]).cast(PLAIN)


def shown(s: Column) -> dict[str, Column]:
    """SHOWN by name, from a state."""
    dif = s["e12"] - s["e26"]
    rsi = {f"rsi_{n}": 100 - 100 / (1 + s[f"gain{n}"] / F.when(s[f"loss{n}"] != 0, s[f"loss{n}"]).otherwise(1e-12)) for n in SMOOTHED}
    kdj = {"kdj_k": s["k"], "kdj_d": s["d"], "kdj_j": 3 * s["k"] - 2 * s["d"]}
    return {
        "macd_dif": dif, "macd_dea": s["dea"], "macd_hist": 2 * (dif - s["dea"]), **rsi,
        **{c: F.when(s["ranged"], x) for c, x in kdj.items()}, **{c: s[c] for c in WINDOWED},
    }


def replayed(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` (symbol, date, BAR) with ``state``, each symbol going on from its state in ``base`` (symbol, state), or from none.

    A symbol's rows are folded in one task: those of a batch, and those after a corrected bar.
    HELD is null in the states of all but a symbol's last row.
    """
    bars = F.array_sort(F.collect_list(F.struct("date", *BAR))).alias("__bars")
    grouped = rows.groupBy("symbol").agg(bars).join(base, "symbol", "left")

    def on(done: Column, b: Column) -> Column:
        # a fold copies what it carries at every step, so windows are carried once and not with every state
        return _let(step(done["last"], b), lambda now: F.struct(F.concat(done["states"], F.array(_plain(now))).alias("states"), now.alias("last")))

    start = F.struct(F.array().cast(f"array<{PLAIN}>").alias("states"), F.col("state").cast(STATE).alias("last"))
    folded = grouped.select("symbol", "__bars", F.aggregate("__bars", start, on).alias("__f"))
    made = folded.select("symbol", F.size("__bars").alias("__n"), F.col("__f.last").alias("__last"), F.posexplode(F.arrays_zip("__bars", F.col("__f.states").alias("state"))).alias("__i", "x"))
    held = [F.when(F.col("__i") == F.col("__n") - 1, F.col(f"__last.{c}")).alias(c) for c in HELD]
    state = F.struct(*[F.col(f"x.state.{c}").alias(c) for c in REMEMBERED], *held).cast(STATE)
    return made.select("symbol", "x.__bars.date", *[f"x.__bars.{c}" for c in BAR], state.alias("state"))


def before(stored: DataFrame, late: DataFrame) -> DataFrame:
    """(symbol, state): the state before ``since`` of each row of ``late`` (symbol, since) that has bars before it.

    Dates alone are compared over the whole table; states are read from the months that hold
    them, and windows from the month on in which the first of them begins.
    """
    most = max(n for _, n in HELD.values())
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    dated = stored.select("symbol", "date").join(late, "symbol").where("date < since").withColumn("__n", place).where(F.col("__n") <= most)
    ends = dated.groupBy("symbol").agg(F.min("date").alias("__first"), F.max("date").alias("__last"))
    months, first = ends.agg(F.collect_set(F.date_format("__last", MONTH)), F.date_format(F.min("__first"), MONTH)).first()  # a text a month
    last = stored.where(F.col("month").isin(months)).join(ends, "symbol").where(F.col("date") == F.col("__last")).select("symbol", "state")
    near = stored.where(F.col("month") >= first).select("symbol", "date", *[of for of, _ in HELD.values()]).join(ends, "symbol").where("date between __first and __last")
    bars = near.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", *[of for of, _ in HELD.values()]))).alias("__bars"))
    size = F.size("__bars")
    held = [F.slice(F.col(f"__bars.{of}"), F.greatest(size - n + 1, F.lit(1)), n).alias(c) for c, (of, n) in HELD.items()]
    state = F.struct(*[F.col(f"state.{c}").alias(c) for c in REMEMBERED], *held).cast(STATE)
    return last.join(bars, "symbol").select("symbol", state.alias("state"))


def heads(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The last state of each symbol in its newest version, and that version; none and -1 before the first batch."""
    stored = existing(spark, f"{path}/heads")
    if stored is None:
        return None, -1
    newest = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).select("symbol", "state"), newest


def apply_bars(spark: SparkSession, path: str, batch: DataFrame, version: int) -> bool:
    """Merge a batch of bars (symbol, date, BAR; further columns are left out) into the tables at ``path``; false if ``version`` is there already.

    The last row of a repeated (symbol, date) by amount, then volume, counts. Rows without a
    symbol or a date are left out. Bars may be new, corrected or late; an empty batch only
    moves the version on.
    """
    head, newest = heads(spark, path)
    if newest >= version:
        return False
    rows = batch.where("symbol is not null and date is not null").select("symbol", "date", *BAR)
    rows = keep_last(rows, ["symbol", "date"], ["amount", "volume"]).persist()
    done = None
    try:
        base = head
        replay = rows
        if head is not None:
            since = rows.groupBy("symbol").agg(F.min("date").alias("since"))
            late = since.join(head, "symbol").where("since <= state.date").select("symbol", "since")
            earliest = late.agg(F.min("since")).first()[0]
            if earliest:
                stored = spark.read.parquet(f"{path}/bars")
                after = stored.where(F.col("month") >= f"{earliest:%Y-%m}m").select(*rows.columns).join(late, "symbol").where("date >= since").join(rows.select("symbol", "date"), ["symbol", "date"], "left_anti")
                replay = rows.unionByName(after.select(*rows.columns))
                base = head.join(late, "symbol", "left_anti").unionByName(before(stored, late))
        none = rows.select("symbol", F.lit(None).cast(STATE).alias("state")).limit(0)
        done = replayed(replay, none if base is None else base).withColumn("version", F.lit(version).cast("long")).withColumn("month", F.date_format("date", MONTH))
        if existing(spark, f"{path}/bars") is None:
            rewritten(spark, f"{path}/bars", done, "month", aside=False)
        else:
            done = done.persist()
            upsert(spark, f"{path}/bars", done, ["symbol", "date"], "month", "version")
        # from what is written, so that heads and bars can't differ; heads come last and make the version count
        first = rows.agg(F.min("date")).first()[0]
        written = spark.read.parquet(f"{path}/bars").where((F.col("month") >= f"{first:%Y-%m}m") & (F.col("version") == version)) if first else None
        fresh = none if written is None else written.where(F.col(f"state.{next(iter(HELD))}").isNotNull()).select("symbol", "state")
        kept = none if head is None else head.join(fresh.select("symbol"), "symbol", "left_anti")
        kept.unionByName(fresh).write.parquet(f"{path}/heads/version={version}")
    finally:
        rows.unpersist()
        if done is not None:
            done.unpersist()
    return True


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """symbol, date, BAR and INDICATORS of all stored bars."""
    made = shown(F.col("state"))
    return spark.read.parquet(f"{path}/bars").select("symbol", "date", *BAR, *[made.get(c, F.col("state")[c]).alias(c) for c in INDICATORS])


def stream_bars(bars: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges a stream of bars, one version a micro-batch; a batch that a restart repeats is not applied twice."""
    return bars.writeStream.foreachBatch(lambda batch, number: apply_bars(batch.sparkSession, path, batch, number) and None).option("checkpointLocation", checkpoint)
