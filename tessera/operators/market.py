"""Market-wide aggregates: breadth, regime, mainline, rotation, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Cross, safe_div

X = Cross()
#: Upper ends of the overview's bands of daily change; a fixed value.
BANDS = (-0.07, -0.05, -0.02, 0.0, 0.02, 0.05, 0.07)


def breadth(panel: DataFrame, strong: float = 0.05, outlier: float = 0.6) -> DataFrame:
    """Per date: advancers and decliners within the outlier bound, mean and median change, strong moves, amount, share above ma20."""
    ret = F.when(F.abs("change_pct") <= outlier, F.col("change_pct"))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return panel.groupBy("date").agg(
        F.count("*").alias("symbols"), count(ret > 0).alias("up"), count(ret < 0).alias("down"), F.avg(ret).alias("mean_change"), F.percentile(ret, 0.5).alias("median_change"),
        count(ret >= strong).alias("strong_up"), count(ret <= -strong).alias("strong_down"), F.sum("amount").alias("amount"), F.avg((F.col("close") > F.col("ma20")).cast("double")).alias("above_ma20"),
    )


def regime(daily: DataFrame) -> DataFrame:
    """bull, bear or range from the share of advancers and of closes above their mean, with the state of the date before."""
    share = safe_div("up", F.col("up") + F.col("down"))
    state = F.when((share >= 0.6) & (F.col("above_ma20") >= 0.5), "bull").when((share <= 0.4) & (F.col("above_ma20") < 0.5), "bear").otherwise("range")
    w = Window.orderBy("date")  # a row a date
    return daily.select("date", state.alias("state")).withColumn("state_before", F.lag("state").over(w))


def mainline(panel: DataFrame, members: DataFrame, hot: float = 0.05) -> DataFrame:
    """Per date and member: symbols, hot symbols, amount, mean change, and the leader by change then amount."""
    joined = panel.where("change_pct is not null").join(members, "symbol")
    return joined.groupBy("date", "member").agg(
        F.count("*").alias("symbols"), F.sum(F.when(F.col("change_pct") >= hot, 1).otherwise(0)).cast("long").alias("hot"), F.sum("amount").alias("amount"), F.avg("change_pct").alias("mean_change"),
        F.max_by("symbol", F.struct("change_pct", "amount", "symbol")).alias("leader"),
    )


def rotation(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Per date: members ranked by mean change, 1 the best, ties by name."""
    means = panel.where("change_pct is not null").join(members, "symbol").groupBy("date", "member").agg(F.avg("change_pct").alias("mean_change"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.round("mean_change", 9).desc(), "member")))


def bands(panel: DataFrame) -> DataFrame:
    """Number of symbols per date in each band of change, 0 the lowest."""
    band = F.lit(0)
    for edge in BANDS:
        band = band + (F.col("change_pct") > edge).cast("int")
    return panel.where("change_pct is not null").groupBy("date", band.alias("band")).agg(F.count("*").alias("symbols"))


def relative_percentile(panel: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """(average rank - 1) / (n - 1) of each symbol among its member group per date; null for a group of one."""
    joined = panel.join(members, "symbol").where(F.col(value).isNotNull())
    x = Cross(("date", "member"))
    n = x.total(value)
    return joined.withColumn("pct", F.when(n > 1, (x.average_rank(value) - 1) / (n - 1))).select("date", "member", "symbol", "pct")


def abnormal(panel: DataFrame, days: int = 3, limit: float = 0.2) -> DataFrame:
    """Rows whose change over ``days`` departs from the market's mean by the limit or more."""
    from tessera.functions.windows import Series

    moved = panel.withColumn("moved", Series().change("close", days)).where("moved is not null")
    gap = F.col("moved") - F.avg("moved").over(X.spec)
    return moved.withColumn("deviation", gap).where(F.abs("deviation") >= limit)


def score(value: Column, low: float, high: float) -> Column:
    """Whole points from 0 at ``low`` to 100 at ``high``, half to even; 50 where there is no value."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint((value - low) / (high - low) * 100))), F.lit(50.0))


#: Weights of the four parts of the regime score and the lowest scores of its states; fixed values.
REGIME_WEIGHTS = {"profit": 0.35, "speculation": 0.25, "resilience": 0.20, "trend": 0.20}
REGIME_STATES = ((70, "strong"), (55, "lean_strong"), (45, "range"), (30, "lean_weak"))


def regime_metrics(panel: DataFrame, strong: float = 0.03, outlier: float = 0.25) -> DataFrame:
    """Per date, of a panel with indicators and limits: what ``regime_score`` takes."""
    ret = F.when(F.abs("change_pct") <= outlier, F.col("change_pct"))
    share = lambda condition: F.avg(F.when(ret.isNotNull(), condition.cast("double"))) * 100
    up, broken = F.sum(F.col("signal_limit_up").cast("int")), F.sum(F.col("signal_broken_limit_up").cast("int"))
    return panel.groupBy("date").agg(
        share(ret > 0).alias("up_pct"), (F.avg(ret) * 100).alias("avg_pct"), (F.percentile(ret, 0.5) * 100).alias("median_pct"), (share(ret >= strong) - share(ret <= -strong)).alias("strong_diff_pct"),
        share(ret <= -strong).alias("strong_down_pct"), up.alias("limit_up"), (safe_div(up, up + broken) * 100).alias("seal_pct"), F.max("consecutive_limit_ups").alias("max_consecutive"),
        (safe_div(F.sum(F.col("change_pct") * F.col("amount")), F.sum(F.when(F.col("change_pct").isNotNull(), F.col("amount")))) * 100).alias("index_pct"),
        (F.avg((F.col("close") > F.col("ma20")).cast("double")) * 100).alias("above_ma20_pct"),
    )


def regime_score(metrics: DataFrame) -> DataFrame:
    """date, the four parts, score (whole points) and state: strong, lean_strong, range, lean_weak or weak. Bounds are fixed values."""
    c = F.col
    parts = {
        "profit": score(c("up_pct"), 21, 75) * 0.45 + score(c("avg_pct"), -1.2, 1.3) * 0.25 + score(c("median_pct"), -1.2, 1.3) * 0.20 + score(c("strong_diff_pct"), -13, 14) * 0.10,
        "speculation": score(c("limit_up"), 35, 97) * 0.30 + score(c("seal_pct"), 57, 75) * 0.40 + score(c("max_consecutive"), 4, 9) * 0.30,
        "resilience": 100 - score(c("strong_down_pct"), 2, 18),
        "trend": score(c("index_pct"), -2.5, 2.5) * 0.50 + score(c("above_ma20_pct"), 22, 76) * 0.50,
    }
    out = metrics.select("date", *[v.alias(k) for k, v in parts.items()])
    total = F.lit(0.0)
    for k, w in REGIME_WEIGHTS.items():
        total = total + c(k) * w
    # parts are sums of whole points times hundredths; ten places take their rounding noise away
    out = out.withColumn("score", F.rint(F.round(total, 10)).cast("int"))
    state = F.lit("weak")
    for least, name in reversed(REGIME_STATES):
        state = F.when(c("score") >= least, name).otherwise(state)
    return out.withColumn("state", state)


def day_before(daily: DataFrame, value: str) -> DataFrame:
    """``daily`` with the value of the trading day before: what is known when a day begins. A row a date."""
    return daily.withColumn(f"{value}_before", F.lag(value).over(Window.orderBy("date")))


#: Days of the breadth series, its frozen bounds and the share of money that each band suggests; fixed values.
BREADTH_DAYS, BREADTH_BOUNDS, BREADTH_SHARES = 20, (1.53761, 1.67424), {"low": 0.3, "mid": 0.6, "high": 1.0}


def breadth_series(daily: DataFrame) -> DataFrame:
    """date, v (mean of up / max(down, 1) over the last days, null until there are as many), band and share; daily: date, up, down. A row a date."""
    ratio = F.col("up") / F.greatest("down", F.lit(1))
    w = Window.orderBy("date").rowsBetween(-(BREADTH_DAYS - 1), 0)
    out = daily.withColumn("__r", ratio).withColumn("v", F.when(F.count("__r").over(w) == BREADTH_DAYS, F.round(F.avg("__r").over(w), 5)))
    low, high = BREADTH_BOUNDS
    band = F.when(F.col("v") <= low, "low").when(F.col("v") <= high, "mid").when(F.col("v") > high, "high")
    share = F.when(band == "low", BREADTH_SHARES["low"]).when(band == "mid", BREADTH_SHARES["mid"]).when(band == "high", BREADTH_SHARES["high"])
    return out.select("date", "v", band.alias("band"), share.alias("share"))


#: Weights of a member's ranks, fewest limit-ups that count, members kept a day; fixed values.
LINE_WEIGHTS, LINE_LEAST, LINE_KEPT = {"limit_up_count": 0.35, "max_boards": 0.25, "rungs_filled": 0.25, "ge2_count": 0.15}, 3, 30


def allowed_members(members: DataFrame, least: int, most: int, banned: tuple[str, ...] = ()) -> DataFrame:
    """The rows of members (symbol, member) whose member has from ``least`` to ``most`` symbols and isn't banned."""
    sizes = members.groupBy("member").agg(F.count("*").alias("__n")).where(F.col("__n").between(least, most))
    return members.join(sizes.where(~F.col("member").isin(*banned)), "member", "left_semi")


def mainlines(flagged: DataFrame, members: DataFrame, least: int = LINE_LEAST, kept: int = LINE_KEPT) -> DataFrame:
    """Per date and member with enough limit-ups: counts, leader, score from ranks within the date, and place; ties by name."""
    n = F.col("consecutive_limit_ups")
    joined = flagged.where(n >= 1).join(members, "symbol")
    lines = joined.groupBy("date", "member").agg(
        F.count("*").alias("limit_up_count"), F.sum((n >= 2).cast("int")).cast("long").alias("ge2_count"), F.max(n).alias("max_boards"), F.sum(n).cast("long").alias("boards_sum"),
        F.countDistinct(F.when(n >= 2, n)).alias("rungs_filled"), F.max_by("symbol", F.struct("consecutive_limit_ups", "amount", "symbol")).alias("leader"),
    )
    lines = lines.where(F.col("limit_up_count") >= least)
    others = F.greatest(F.count("*").over(X.spec) - 1, F.lit(1))
    total = F.lit(0.0)
    for name, w in LINE_WEIGHTS.items():
        total = total + (X.average_rank(name) - 1) / others * w
    scored = lines.withColumn("score", F.round(total * 100, 6))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.col("score").desc(), "member")))
    return placed.where(F.col("place") <= kept)


def leading_and_lagging(panel: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Per date the n members with the best and with the worst mean change: member, side, place, mean, symbols, and the symbol that leads its side."""
    joined = panel.where("change_pct is not null").join(members, "symbol")
    by = joined.groupBy("date", "member").agg(F.round(F.avg("change_pct"), 9).alias("mean_change"), F.count("*").alias("symbols"), F.max_by("symbol", F.struct("change_pct", "symbol")).alias("top"), F.min_by("symbol", F.struct("change_pct", "symbol")).alias("bottom"))
    best = by.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.col("mean_change").desc(), "member"))).withColumn("side", F.lit("leading"))
    worst = by.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("mean_change", "member"))).withColumn("side", F.lit("lagging"))
    both = best.unionByName(worst).where(F.col("place") <= n)
    return both.select("date", "side", "place", "member", "mean_change", "symbols", F.when(F.col("side") == "leading", F.col("top")).otherwise(F.col("bottom")).alias("leader"))


def boards(panel: DataFrame, board: Column) -> DataFrame:
    """Per date and board: symbols, advancers, decliners, amount."""
    count = lambda cond: F.count(F.when(cond, 1))
    return panel.groupBy("date", board.alias("board")).agg(F.count("*").alias("symbols"), count(F.col("change_pct") > 0).alias("up"), count(F.col("change_pct") < 0).alias("down"), F.sum("amount").alias("amount"))


def two_level_means(ticks: DataFrame, members: DataFrame, width: str) -> DataFrame:
    """Mean of symbols' means per member and bucket of time, so that a busy symbol weighs no more than a quiet one."""
    bucket = F.window(F.col("ts").cast("timestamp"), width)["start"].alias("start")
    by_symbol = ticks.groupBy("symbol", bucket).agg(F.avg("value").alias("mean"))
    return by_symbol.join(members, "symbol").groupBy("member", "start").agg(F.avg("mean").alias("mean"), F.count("*").alias("symbols"))


def deviations(panel: DataFrame, benchmark: DataFrame, days: tuple[int, ...] = (3, 10, 30)) -> DataFrame:
    """``panel`` with deviate_<n>d: change over n bars less that of the board's benchmark; benchmark: (board, date, bench)."""
    from tessera.functions.windows import Series

    s, b = Series(), Series("board")
    ahead = benchmark.withColumns({f"__b{n}": b.change("bench", n) for n in days}).drop("bench")
    out = panel.withColumns({f"__m{n}": s.change("close", n) for n in days}).join(ahead, ["board", "date"], "left")
    return out.withColumns({f"deviate_{n}d": F.col(f"__m{n}") - F.col(f"__b{n}") for n in days}).drop(*[f"__{k}{n}" for k in "mb" for n in days])


#: Bands of a deviation's share of its limit.
NEARNESS = ((1.0, "over"), (0.8, "close"), (0.5, "half"))


def proximity(deviated: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``deviated`` with nearness, the largest share of its limit that a deviation has, and status: over, close, half or far."""
    shares = [F.abs(F.col(k)) / v for k, v in limits.items()]
    near = F.greatest(*shares) if len(shares) > 1 else shares[0]
    status = F.lit("far")
    for least, name in reversed(NEARNESS):
        status = F.when(F.col("nearness") >= least, name).otherwise(status)
    return deviated.withColumn("nearness", near).withColumn("status", F.when(F.col("nearness").isNotNull(), status))


def flow_sums(flows: DataFrame, windows: tuple[int, ...], most_days: int) -> DataFrame:
    """``flows`` (symbol, date, net) with step (change since the row before, null if it is more than ``most_days`` old) and sums over windows of rows."""
    from tessera.functions.windows import Series

    s = Series()
    fresh = F.datediff("date", s.delay("date")) <= most_days
    return flows.withColumns({"step": F.when(fresh, s.delta("net", 1)), **{f"net_{n}": s.sum("net", n) for n in windows}})


def top_and_bottom(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Per date the n largest and the n smallest of ``by``, ties by symbol: side, place."""
    both = [(F.col(by).desc(), "in"), (F.col(by).asc(), "out")]
    out = None
    for order, side in both:
        placed = rows.where(F.col(by).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(order, "symbol"))).withColumn("side", F.lit(side))
        out = placed if out is None else out.unionByName(placed)
    return out.where(F.col("place") <= n)


#: Bounds of the phases of a ladder market, in order of precedence; fixed values.
PHASES = (
    ("climax", "ge2 >= 50 or first >= 220"),
    ("rally", "height >= 7 and ge2 >= 15 and promotion >= 0.23 or promotion >= 0.30 and ge2 >= 12 and height >= 5"),
    ("ice", "height <= 4 and ge2 <= 6 and first <= 24"),
    ("ebb", "(ge2_5 >= 12 or height_5 >= 6) and promotion <= 0.15 and ge2 < ge2_5 or promotion <= 0.13 and seal <= 0.57"),
    ("ignite", "ge2 - ge2_5 >= 3 and ge2 >= 8 and promotion >= 0.20 or height - height_5 >= 1 and height >= 5 and promotion >= 0.19"),
)
#: Phases that a weak market vetoes, and the states that do.
RISING, WEAK = ("climax", "rally", "ignite"), ("weak", "lean_weak")
#: Fewest of yesterday's limit-ups that give a rate of promotion, weight of the newest day, days that confirm a new phase. Fixed values.
LEAST_POOL, NEWEST, CONFIRM = 10, 1 / 3, 2


def phases(daily: DataFrame) -> DataFrame:
    """date and phase: climax, rally, ice, ebb, ignite or repair; a phase changes when a new one has stood for CONFIRM days.

    daily: date, max_boards, first_board, ge2_count, promo_pool, promo_ok, seal (share of touched limits that held), state.
    A market has one row a date, so the smoothing and the confirmation run over one sorted array of days.
    """
    promotion = F.when(F.col("promo_pool") >= LEAST_POOL, safe_div("promo_ok", "promo_pool"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    fields = {"height": F.col("max_boards"), "first": F.col("first_board"), "ge2": F.col("ge2_count"), "promotion": F.last(promotion, ignorenulls=True).over(w), "seal": F.col("seal")}
    rows = daily.select("date", "state", *[v.cast("double").alias(k) for k, v in fields.items()])
    days = rows.agg(F.array_sort(F.collect_list(F.struct("date", "state", *fields))).alias("days"))

    def smooth(a, x):
        """A field goes on from its last value by the newest day's weight; a missing one changes nothing."""
        before = F.get(a, F.size(a) - 1)
        new = [F.when(before.isNull() | before[k].isNull(), x[k]).otherwise(F.coalesce(x[k] * NEWEST + before[k] * (1 - NEWEST), before[k])).alias(k) for k in fields]
        return F.concat(a, F.array(F.struct(x["date"].alias("date"), x["state"].alias("state"), *new)))

    kind = f"array<struct<date:date,state:string,{','.join(f'{k}:double' for k in fields)}>>"
    smoothed = days.select(F.aggregate("days", F.array().cast(kind), smooth).alias("days"))
    each = smoothed.select(F.posexplode("days").alias("i", "d")).select("i", "d.*")
    back = Window.orderBy("i")
    each = each.withColumns({f"{k}_5": F.coalesce(F.lag(k, 5).over(back), F.first(k).over(back)) for k in ("ge2", "height")})
    raw = F.lit("repair")
    for name, condition in reversed(PHASES):
        raw = F.when(F.coalesce(F.expr(condition), F.lit(False)), name).otherwise(raw)
    raw = F.when(raw.isin(*RISING) & F.coalesce(F.col("state").isin(*WEAK), F.lit(False)), "repair").otherwise(raw)
    labelled = each.select("date", raw.alias("raw")).agg(F.array_sort(F.collect_list(F.struct("date", "raw"))).alias("days"))
    start = F.struct(F.lit(None).cast("string").alias("now"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("run"), F.array().cast("array<struct<date:date,phase:string>>").alias("out"))

    def confirm(a, x):
        run = F.when(x["raw"] == a["next"], a["run"] + 1).otherwise(1)
        changed = a["now"].isNull() | ((x["raw"] != a["now"]) & (run >= CONFIRM))
        now = F.when(changed, x["raw"]).otherwise(a["now"])
        waiting = ~changed & (x["raw"] != a["now"])
        done = F.concat(a["out"], F.array(F.struct(x["date"].alias("date"), now.alias("phase"))))
        return F.struct(now.alias("now"), F.when(waiting, x["raw"]).alias("next"), F.when(waiting, run).otherwise(0).alias("run"), done.alias("out"))

    return labelled.select(F.explode(F.aggregate("days", start, confirm, lambda a: a["out"])).alias("x")).select("x.*")


def confirming_days(banded: DataFrame, need: int = 3) -> DataFrame:
    """One row: for how many days a new band has stood without being confirmed by ``need``; null if none is waiting. banded: date, band; a row a date."""
    days = banded.where("band is not null").agg(F.array_sort(F.collect_list(F.struct("date", "band"))).alias("days"))
    start = F.struct(F.lit(None).cast("string").alias("held"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("run"))

    def step(a, x):
        new = x["band"]
        run = F.when(new == a["next"], a["run"] + 1).otherwise(1)
        same = a["held"].isNull() | (new == a["held"]) | (run >= need)
        return F.struct(F.when(same, new).otherwise(a["held"]).alias("held"), F.when(~same, new).alias("next"), F.when(~same, run).otherwise(0).alias("run"))

    return days.select(F.aggregate("days", start, step, lambda a: F.when(a["run"] > 0, a["run"])).alias("days"))
