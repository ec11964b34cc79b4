"""Benchmark decontamination (DataFrame functions only).

Windows of a document as long as a benchmark item get a SimHash fingerprint. Fingerprints
within RADIUS of an item's are found through a multi-index: of BLOCKS blocks, one differs in
at most RADIUS // BLOCKS bits, so looking up every block value within that distance finds
them all. What is found is confirmed by the exact weighted similarity of word shingles.

Two texts that share no shingle have similarity 0, and a similar window shares PERCENT of its
item's weight. So shingles of items are looked up in the documents first, and every window
whose shared shingles can weigh as much is laid, at whatever offset; no window that passes is
missed for want of an alignment, and the rest of the corpus is not fingerprinted. The
multi-index is asked for the items a window was laid for, not for all of its size.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, words

SHINGLE = 5
PERCENT = 80
#: At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average, deviation 2.9; beyond 23 lies 1 in 100,000.
RADIUS, BLOCKS, BLOCK_BITS = 23, 8, 8
#: Shingle weights are kept as whole thousandths, so that sums are exact in any order.
UNIT = 1000.0


def shingle_hashes(w: Column, k: int) -> Column:
    """All k-word shingles of a word array in order, as hashes; none where it is shorter."""
    return F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])),
    )


def fingerprint(hashes: Column, weights: Column) -> Column:
    """64-bit SimHash of weighted shingle hashes."""
    signed = F.zip_with(hashes, weights, lambda h, v: F.struct(h.alias("h"), v.alias("v")))

    def bit(b: Column) -> Column:
        total = F.aggregate(
            signed,
            F.lit(0).cast("long"),
            lambda a, x: a + F.when(F.call_function("shiftright", x["h"], b).bitwiseAND(F.lit(1)) == 1, x["v"]).otherwise(-x["v"]),
        )
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column) -> Column:
    """(block number, value) of a fingerprint."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("no"), F.shiftright(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value"))
            for i in range(BLOCKS)
        ]
    )


def masks() -> list[int]:
    """All block differences of at most RADIUS // BLOCKS bits."""
    most = RADIUS // BLOCKS
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, n (words), k (words of a shingle), hashes."""
    w = F.col("w")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), words(F.lower(F.col(text_col))).alias("w"))
    items = items.where("item is not null and size(w) > 0").dropDuplicates().withColumn("n", F.size("w"))
    k = F.least(F.lit(SHINGLE), F.col("n"))
    hashes = F.coalesce(*[F.when(k == j, shingle_hashes(w, j)) for j in range(1, SHINGLE + 1)])
    return items.select("item", "n", k.alias("k"), hashes.alias("hashes"))


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """Pairs of document and benchmark item where a window of the document is similar to the item.

    Returns id_col, item_col, start (first word of the most similar window, counted from 0),
    n_words (of the window) and similarity (weighted shared over weighted union), one row a
    pair of ids. Words are lower-cased; a shingle is five words, or all of a shorter item. A
    shingle weighs by its rarity among the items, and counts as often as it stands.

    Null or blank texts on either side match nothing, nor do null ids. Rows that repeat an
    id stand for one document. Empty tables: empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    items = cut(_items(benchmark, item_col, "text"), "items")
    shingles = items.select("item", "n", "k", F.posexplode("hashes").alias("q", "h"))
    counts = items.agg(F.count("*").alias("items"))
    rarity = shingles.groupBy("k", "h").agg(F.countDistinct("item").alias("df")).crossJoin(F.broadcast(counts))
    weigh = F.round(F.lit(UNIT) * F.log1p(F.col("items") / F.col("df"))).cast("long")
    weighted = cut(rarity.select("k", "h", weigh.alias("weight")), "weights")
    rarest = F.round(F.lit(UNIT) * F.log1p(F.col("items"))).cast("long")
    counts = counts.select(rarest.alias("rarest"))

    own = cut(shingles.join(weighted, ["k", "h"]), "shingles")  # item, n, k, q, h, weight
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]  # SHINGLE rows at most
    laid = None
    for k in sizes:
        placed = rows.withColumn("w", words(F.lower(F.col("text")))).select(
            "id", F.xxhash64("text").alias("text_hash"), F.size("w").alias("words"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("p", "h")
        )
        here = own.where(F.col("k") == k).select("item", "n", "h", "weight").distinct()
        hit = placed.join(here, "h").select("id", "text_hash", "words", "item", F.lit(k).alias("k"), "n", "p", "weight")
        laid = hit if laid is None else laid.union(hit)
    if laid is None:
        return rows.limit(0).select(
            F.col("id").alias(id_col), F.col("id").alias(item_col), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")
        )
    # the hits of an item in a text are at most the text's words
    hits = laid.groupBy("id", "text_hash", "words", "item", "k", "n").agg(F.collect_set(F.struct("p", "weight")).alias("at"))
    needs = own.groupBy("item").agg(F.sum("weight").alias("need"))
    enough = lambda got: F.lit(100) * got >= F.lit(PERCENT) * F.col("need")
    total = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    hits = hits.join(needs, "item").where(enough(total)).withColumn("at", F.array_sort("at"))
    reach = F.col("n") - F.col("k")

    def starts(x: Column, i: Column) -> Column:
        """Starts of the windows whose first hit is x: those that reach the hit with which the weight is enough."""
        state = F.struct(F.lit(0).cast("long").alias("got"), F.lit(-1).alias("last"))
        grown = F.aggregate(
            F.slice("at", i + 1, reach + 1), state,
            lambda a, y: F.when(enough(a["got"]), a).otherwise(F.struct((a["got"] + y["weight"]).alias("got"), y["p"].alias("last"))),
            lambda a: F.when(enough(a["got"]), a["last"]),
        )
        before = F.when(i > 0, F.get("at", i - 1)["p"]).otherwise(-1)
        low = F.greatest(before + 1, F.when(grown.isNotNull(), grown - reach))
        high = F.least(x["p"], F.greatest(F.col("words") - F.col("n"), F.lit(0)))
        return F.when(grown.isNotNull() & (low <= high), F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    laid = hits.select("id", "text_hash", "item", "k", "n", F.explode(F.flatten(F.transform("at", starts))).alias("start"))
    laid = cut(laid.select("id", "text_hash", "item", "k", "n", "start", F.xxhash64("id", "text_hash", "k", "n", "start").alias("win")), "laid")
    # the windows of a text together, so that it is split once; they are at most its words times the sizes of items
    of_text = cut(laid.groupBy("id", "text_hash").agg(F.collect_set(F.struct("k", "n", "start", "win")).alias("at")), "laid_by_text")

    # windows: their shingles with weights; shingles that no item has weigh as much as the rarest
    texts = rows.select("id", F.xxhash64("text").alias("text_hash"), "text")
    found = of_text.hint("merge").join(texts, ["id", "text_hash"]).select("id", "text_hash", "at", words(F.lower(F.col("text"))).alias("w"))
    for k in sizes:
        found = found.withColumn(f"h{k}", shingle_hashes(F.col("w"), k))

    def window(x: Column) -> Column:
        hashes = F.coalesce(*[F.when(x["k"] == j, F.slice(f"h{j}", x["start"] + 1, x["n"] - j + 1)) for j in sizes])
        return F.struct(x["k"].alias("k"), x["n"].alias("n"), x["start"].alias("start"), x["win"].alias("win"), F.least(x["n"], F.size("w") - x["start"]).alias("n_words"), hashes.alias("hashes"))

    windows = found.select("id", "text_hash", F.explode(F.transform("at", window)).alias("x")).select("id", "text_hash", "x.*")
    # repeated rows of a document give the same windows
    windows = cut(windows.dropDuplicates(["win"]), "windows")
    flat = windows.select("win", "k", F.explode("hashes").alias("h"))
    of_window = (
        flat.join(weighted, ["k", "h"], "left")
        .crossJoin(F.broadcast(counts))
        .groupBy("win", "k", "h")
        .agg(F.count("*").alias("c"), F.max(F.coalesce("weight", "rarest")).alias("weight"))
    )
    of_window = cut(of_window, "window_shingles")
    of_item = cut(own.groupBy("item", "k", "n", "h").agg(F.count("*").alias("c"), F.max("weight").alias("weight")), "item_shingles")
    mass = F.col("c") * F.col("weight")

    def printed(part: DataFrame, *by: str) -> DataFrame:
        """Fingerprint and weight of each window or item."""
        pairs = F.array_sort(F.collect_list(F.struct("h", mass.alias("v"))))  # at most the words of an item
        return part.groupBy(*by).agg(pairs.alias("s"), F.sum(mass).alias("mass")).select(
            *by, "mass", fingerprint(F.col("s.h"), F.col("s.v")).alias("fp")
        )

    of_win = cut(printed(of_window, "win").join(windows.select("win", "n", "k"), "win"), "window_prints")
    of_it = cut(printed(of_item, "item", "n", "k"), "item_prints")
    near = F.array(*[F.lit(m) for m in masks()])
    index = (
        of_it.select("item", F.explode(blocks(F.col("fp"))).alias("b"))
        .select("item", F.col("b.no").alias("no"), F.explode(F.transform(near, lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    )
    asked = laid.select("win", "item").distinct().join(of_win.select("win", F.explode(blocks(F.col("fp"))).alias("b")), "win").select("win", "item", "b.no", "b.value")
    found = asked.join(index, ["item", "no", "value"]).select("win", "item").distinct()
    a, b = of_win.alias("a"), of_it.alias("b")
    found = (
        found.join(a, "win").join(b, "item")
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        .select("win", "item", F.col("a.k").alias("k"), (F.col("a.mass") + F.col("b.mass")).alias("masses"))
    )
    found = cut(found, "candidates")
    x = of_window.select("win", "h", F.col("c").alias("cx"), "weight")
    y = of_item.select("item", "h", F.col("c").alias("cy"))
    shared = F.sum(F.least("cx", "cy") * F.col("weight"))
    sure = (
        found.join(x, "win").join(y, ["item", "h"])
        .groupBy("win", "item", "masses").agg(shared.alias("shared"))
        .where(F.lit(100) * F.col("shared") >= F.lit(PERCENT) * (F.col("masses") - F.col("shared")))
        .select("win", "item", (F.col("shared") / (F.col("masses") - F.col("shared"))).alias("similarity"))
    )
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), "n_words")).alias("best")
    return (
        sure.join(windows.select("win", "id", "start", "n_words"), "win")
        .groupBy("id", "item").agg(best)
        .select(
            F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("best.back")).cast("long").alias("start"),
            F.col("best.n_words").cast("long").alias("n_words"), F.round("best.similarity", 6).alias("similarity"),
        )
    )


def clean_of(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose document matches no benchmark item."""
    bad = cut(matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__bad")).distinct(), "leaks")
    return docs.join(bad.hint("merge"), docs[id_col].cast("long") == bad["__bad"], "left_anti")
