"""Near-duplicates: similarity sketches by rounds of hashed bin placement, banding, exact verification.

A sketch has T coordinates. In round i every shingle falls into one bin by a hash of its
own; a bin keeps the least value of the first round that reaches it. Rounds T to 2T-1 send
all shingles to bin i-T, so every coordinate fills. Equal sets have equal sketches, and the
share of equal coordinates is concentrated around the Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import cut
from tessera.llm.shingles import mix64, shingle_set, similar

#: 32 bands of 4: at similarity 0.8 a pair meets in no band with probability (1 - 0.8**4)**32, about 5e-8.
BANDS, ROWS = 32, 4
T = BANDS * ROWS
BIN_BITS = 7
assert 1 << BIN_BITS == T
SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BIN_EDGES = np.arange(T, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
BAND_SALT = mix64(np.arange(101, 101 + BANDS, dtype=np.uint64))


def sketch(items: np.ndarray) -> np.ndarray:
    """T coordinates of a set without repeats, of at least one item."""
    out = np.zeros(T, np.uint64)
    filled = np.zeros(T, bool)
    per = max(1, -(-1100 // len(items)))  # rounds at a time; about T ln T placements fill all bins
    for first in range(0, T, per):
        rounds = np.arange(first, min(first + per, T), dtype=np.uint64)
        h = mix64(items[None, :] ^ SEEDS[first : first + len(rounds), None])
        # bin, then round, then value: the first of a bin is its least value of its first round
        key = ((h >> np.uint64(64 - BIN_BITS)) << np.uint64(64 - BIN_BITS)) | (rounds[:, None] << np.uint64(50)) | (h & np.uint64((1 << 50) - 1))
        key = np.sort(key, axis=None)
        at = np.minimum(np.searchsorted(key, BIN_EDGES), len(key) - 1)
        new = ((key[at] >> np.uint64(64 - BIN_BITS)) == np.arange(T, dtype=np.uint64)) & ~filled
        out[new] = key[at][new]
        filled |= new
        if filled.all():
            return out
    for b in np.flatnonzero(~filled):
        out[b] = mix64(items ^ SEEDS[T + b]).min()
    return out


def band_keys(items: np.ndarray) -> np.ndarray:
    s = sketch(items).reshape(BANDS, ROWS)
    h = BAND_SALT.copy()
    for j in range(ROWS):
        h = mix64(h + s[:, j])
    return h


def _sketched(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, lo, hi, bands = [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, k)
                n.append(len(s))
                if len(s):
                    # two independent sums over the set name it by 128 bits
                    lo.append(int(mix64(s ^ SEEDS[0]).sum(dtype=np.uint64).view(np.int64)))
                    hi.append(int(mix64(s ^ SEEDS[1]).sum(dtype=np.uint64).view(np.int64)))
                    bands.append(band_keys(s).view(np.int64))
                else:
                    lo.append(None), hi.append(None), bands.append(None)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "lo": pd.array(lo, "Int64"), "hi": pd.array(hi, "Int64"), "bands": bands})

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "items": [shingle_set(t, k).tobytes() for t in pdf["text"]]})

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)
                for x, y in zip(pdf["x"], pdf["y"], strict=True)
            ]
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _links(pairs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose full sets are similar, and the sets; nodes: (id, text) of class representatives."""
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = cut(nodes.join(wanted.hint("merge"), "id").mapInPandas(_sets(k), "id long, items binary"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut(both.mapInPandas(_verified(num, den), "a long, b long"), "links"), sets


def _differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        d = [np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True) for x, y in zip(pdf["items"], pdf["pivot_items"], strict=True)]
        out = pdf[["pivot", "id", "label", "n"]].copy()
        out["pn"], out["m"], out["d"] = [len(y) // 8 for y in pdf["pivot_items"]], [len(x) for x in d], d
        yield out


def _crossed(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with one pivot and two components that may be similar; open_: (pivot, id, n, label).

    D(x), the shingles that only one of x and the pivot p has, tells all about a pair: x and y
    differ in as many shingles as D(x) and D(y) do. With c = (den - num) / (den + num) they
    are similar when these are at most c * (n_x + n_y), that is when D(x) and D(y) share
    t = (|D(x)| + |D(y)| - c * (n_x + n_y)) / 2. At most one component is p's, so one of the
    two, the far one, is not similar to p: |D| > c * (n + n_p). Hence t > 0, and by what
    is known of one side alone

        2t >= |D| + c * (n_p - n)     if the other side is far,
        2t >= |D| - c * (n_p + n)     for the far side, if the other is near p.

    With D sorted by frequency among the pivot's documents, similar pairs share one of the
    first |D| - t + 1. A shingle that one component alone has is shared with no other.
    """
    up, down = den + num, den - num
    pivot_sets = sets.select(F.col("id").alias("pivot"), F.col("items").alias("pivot_items"))
    kind = "pivot long, id long, label long, n long, pn long, m long, d array<long>"
    diffs = cut(open_.join(sets, "id").join(pivot_sets, "pivot").select("pivot", "id", "label", "n", "items", "pivot_items").mapInPandas(_differences, kind), "differences")
    flat = diffs.select("pivot", "id", "label", F.explode("d").alias("h"))
    common = flat.groupBy("pivot", "h").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("pivot", "h", "df")
    ranked = flat.select("pivot", "id", "h").join(cut(common, "common"), ["pivot", "h"]).groupBy("pivot", "id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    sized = diffs.select("pivot", "id", "label", "n", "pn", "m").join(cut(ranked, "ranked"), ["pivot", "id"])
    first = lambda twice_t: F.col("m") + 1 - F.greatest(F.lit(1), F.ceil(twice_t / F.lit(2 * up)))
    sized = sized.withColumns({
        "far": F.lit(up) * F.col("m") > F.lit(down) * (F.col("n") + F.col("pn")),
        "to_far": first(F.lit(up) * F.col("m") + F.lit(down) * (F.col("pn") - F.col("n"))),
        "to_near": first(F.lit(up) * F.col("m") - F.lit(down) * (F.col("pn") + F.col("n"))),
    })
    placed = sized.select("pivot", "id", "label", "n", "m", "far", "to_far", "to_near", F.posexplode("s").alias("i", "e"), (F.col("m") - F.size("s")).alias("alone"))
    placed = placed.withColumn("left", F.col("m") - F.col("alone") - F.col("i")).withColumn("at", F.col("alone") + F.col("i")).withColumn("h", F.col("e.h"))
    placed = cut(placed.where("at < to_far or (far and at < to_near)").drop("i", "e", "alone"), "prefixes")
    x = placed.where("far").select("pivot", "h", *[F.col(c).alias(f"x_{c}") for c in ("id", "label", "n", "m", "at", "left", "to_far", "to_near")])
    y = placed.where("at < to_far")
    return (
        x.join(y, ["pivot", "h"])
        .where("x_label <> label and if(far, x_at < x_to_far and x_id < id, x_at < x_to_near)")
        .where(f"{2 * up} * least(x_left, left) >= {up} * (x_m + m) - {down} * (x_n + n)")
        .select(*_ordered("x_id", "id"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Component of each document under links den * |A & B| >= num * |A | B| of k-word shingle sets.

    Returns id_col, n_shingles, component_id (smallest id reachable) and kept
    (id = component_id), one row per input row.

    Equal sets form a class; only its smallest id is compared further. Members of a band
    bucket are first compared with its pivot, the member that meets most others over all
    buckets. After these links are joined, every pair of members of a bucket that still lie
    in two components is compared too, unless their differences from the pivot rule it out.
    No bucket, however large, is cut short.

    Null or blank text: no shingles, linked with nothing. Null id: linked with nothing,
    component null, kept. Rows that repeat an id stand for one document, linked through any
    of its texts; each gets the id's component. Empty table: empty result. Other columns are
    not read, whatever they are called.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = cut(rows.mapInPandas(_sketched(k), "id long, n long, lo long, hi long, bands array<long>"), "sketches")
    named = sketched.where("id is not null and lo is not null")
    classes = cut(named.groupBy("lo", "hi", "n").agg(F.min("id").alias("rep")), "classes")
    member = cut(named.select("id", "lo", "hi", "n").join(classes, ["lo", "hi", "n"]).select("id", "rep").distinct(), "members")
    edges = member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    own = classes.select("lo", "hi", "n", F.col("rep").alias("id"))
    banded = named.join(own, ["id", "lo", "hi", "n"], "left_semi").dropDuplicates(["id", "lo", "hi"])
    placed = banded.select(F.explode("bands").alias("key"), "id", "n")
    keys = cut(placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    shared = cut(placed.join(keys, "key"), "placed")
    # the centre of a group meets more of it than a member at its rim does
    company = cut(shared.groupBy("id").agg(F.sum("m").alias("met")), "company")
    ranked = shared.join(company, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("back"))).alias("top"))
    pivots = cut(ranked.select("key", (-F.col("top.back")).alias("pivot")), "pivots")
    met = cut(shared.join(pivots, "key"), "met")
    nodes = rows.where("id is not null")

    pairs = cut(met.where("id <> pivot").select(*_ordered("pivot", "id")).distinct(), "pairs")
    links, sets = _links(pairs, nodes, k, num, den)
    labels = components(edges.union(links))

    # members of buckets that still lie in several components; pivots have met everyone in theirs
    open_ = met.where("m > 2 and id <> pivot").select("pivot", "id", "n").distinct()
    open_ = open_.join(labels, open_["id"] == labels["node"], "left").select("pivot", "id", "n", F.coalesce("label", "id").alias("label"))
    open_ = cut(open_, "unsettled")
    spread = open_.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    open_ = cut(open_.join(cut(spread.select("pivot"), "split"), "pivot"), "open")
    crossed = cut(_crossed(open_, sets, num, den).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not crossed.isEmpty():
        more, _ = _links(crossed, nodes, k, num, den)
        labels = components(edges.union(links).union(more))
    found = sketched.select("id", "n").join(labels, sketched["id"] == labels["node"], "left")
    comp = F.coalesce("label", "id")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose document is kept; rows that repeat an id stay together."""
    kept = near_duplicates(docs, id_col, text_col, k).where("kept").select(F.col(id_col).alias("__ok")).distinct()
    return docs.join(kept.hint("merge"), docs[id_col].cast("long").eqNullSafe(kept["__ok"]), "left_semi")
