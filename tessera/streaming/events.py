"""Streams of ticks: bars by time window, deltas, edges and rules with a cooldown.

The same functions take a stream or a batch where they only use windows of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tick_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """Ticks from a folder to which files are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(ticks: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Bars of each symbol and window: start, n, low, high, total. With ``late``, a stream closes windows by that watermark."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    bars = timed.groupBy("symbol", F.window("ts", width)).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
    return bars.select("symbol", F.col("window.start").alias("start"), "n", "low", "high", "total")


def deltas(ticks: DataFrame) -> DataFrame:
    """Change since the tick before of the same symbol and day; negative ones are dropped as resets."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    return ticks.withColumn("delta", F.col("value") - F.lag("value").over(w)).where("delta >= 0")


def cooled(hits: DataFrame, seconds: int) -> DataFrame:
    """Hits (symbol, ts) less those within ``seconds`` of the last one let through, in a batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        pdf = pdf.sort_values("ts", kind="stable")
        for t in pdf["ts"]:
            ok = last is None or (t - last).total_seconds() >= seconds
            keep.append(ok)
            last = t if ok else last
        return pdf[keep]

    return hits.groupBy("symbol").applyInPandas(run, hits.schema)


def cooled_stream(hits: DataFrame, seconds: int) -> DataFrame:
    """The same for a stream: the time of the last hit let through is each symbol's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        keep = []
        for t in rows["ts"]:
            now = t.timestamp()
            ok = last is None or now - last >= seconds
            keep.append(ok)
            last = now if ok else last
        state.update((last,))
        yield rows[keep]

    return hits.groupBy("symbol").applyInPandasWithState(run, hits.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def gaps(ticks: DataFrame, seconds: int) -> DataFrame:
    """Stretches without a tick that are longer than ``seconds``."""
    w = Window.partitionBy("symbol").orderBy("ts")
    after = F.lead("ts").over(w)
    gap = F.unix_seconds(after.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return ticks.select("symbol", F.col("ts").alias("since"), after.alias("until"), gap.alias("seconds")).where(F.col("seconds") > seconds)


def intraday(ticks: DataFrame) -> DataFrame:
    """Per tick: running mean, high and low of the symbol's day."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumns({"day_mean": F.avg("value").over(w), "day_high": F.max("value").over(w), "day_low": F.min("value").over(w)})


def sliding(ticks: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    """Counts and sums of each symbol over windows that overlap; batch, or a stream with ``late`` as watermark."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    made = timed.groupBy("symbol", F.window("ts", width, step)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select("symbol", F.col("window.start").alias("start"), "n", "total")


def sessions(ticks: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Stretches of activity of each symbol that no pause of ``gap`` or more interrupts; batch or stream."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    made = timed.groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select("symbol", F.col("session_window.start").alias("start"), "n", "total")


def collapsed(hits: DataFrame, width: str, most: int) -> DataFrame:
    """Hits per symbol and bucket of time; where more than ``most`` symbols hit in a bucket, one row for all of them, without a symbol."""
    start = F.window(F.col("ts").cast("timestamp"), width)["start"].alias("start")
    by = hits.groupBy("symbol", start).agg(F.count("*").alias("n"))
    many = F.count("*").over(Window.partitionBy("start")) > most
    named = by.withColumn("symbol", F.when(~many, F.col("symbol")))
    return named.groupBy("start", "symbol").agg(F.sum("n").alias("hits"))


def rule_hits(rows: DataFrame, rules: dict[str, tuple[str, str, object, str | None]], columns: set[str]) -> DataFrame:
    """``rows``, once for each rule that it meets, with its name; rules: (field, operator, value, first date or None).

    All rules are checked in one pass, as conditions of one row.
    """
    from tessera.operators.screen import condition

    checks = []
    for name, (field, op, value, since) in rules.items():
        ok = condition({"left": field, "op": op, "right": value}, columns)
        if since:
            ok = ok & (F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
        checks.append(F.when(ok, F.lit(name)))
    met = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(met))


def confirmed(marks: DataFrame, ticks: DataFrame, hours: int) -> DataFrame:
    """``marks`` (event_id, symbol, ts, value) with ticks, flow and moved: number, sum and change of the symbol's ticks within so many hours after it.

    A mark is dealt to the days that its hours touch, so that it meets the ticks around it alone.
    """
    last = F.col("ts") + F.expr(f"interval {hours} hours")
    days = F.explode(F.sequence(F.to_date("ts"), F.to_date(last))).alias("day")
    asked = marks.select("event_id", "symbol", F.col("ts").alias("since"), days)
    there = ticks.select("symbol", "ts", F.col("value").alias("tick"), F.to_date("ts").alias("day"))
    met = asked.join(there, ["symbol", "day"]).where((F.col("ts") > F.col("since")) & (F.col("ts") <= F.col("since") + F.expr(f"interval {hours} hours")))
    sums = met.groupBy("event_id").agg(F.count("*").alias("ticks"), F.sum("tick").alias("flow"), F.max_by("tick", "ts").alias("__last"))
    out = marks.join(sums, "event_id", "left")
    moved = F.when(F.col("value") != 0, F.col("__last") / F.col("value") - 1)
    return out.select(*marks.columns, F.coalesce("ticks", F.lit(0)).alias("ticks"), "flow", moved.alias("moved"))
