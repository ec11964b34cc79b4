"""Mixing sources to target weights, by blocks.

Each source's words, in order of document ids, are cut into blocks of a fixed number of
words. Every output shard draws how many of its slots each source fills from a multinomial;
a source's slots run through a pseudorandom permutation of its block indices, and blocks
join their slots by (source, index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, words
from tessera.llm.shingles import mix64

#: Weights of the sources in order of their names, repeating; the mix's share of all words; most uses of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_USES = 2
BLOCK_WORDS = 32
SHARD_SLOTS = 4096
TASK_SHARDS = 32
SEED = 20240229
#: Sources are drawn in two steps, groups of so many first; a group's list is fetched for so many shards at a time.
GROUP, SHARD_PACK = 4096, 256
ROUND_KEYS = mix64(np.arange(SEED, SEED + 4, dtype=np.uint64))


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, no, weight, target); no: rank by code point, null last.

    Targets share SHARE of all words by weight; those above MOST_USES times their source stop
    there and the excess is shared again. With sources sorted by size over weight, levels fall from
    the first source that its level does not fill, so the largest of those levels is that of the last sharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(by_name)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), ((no - 1) % len(WEIGHTS) + 1).cast("int"))
    named = sizes.select("source", "source_size", no.alias("no"), w.alias("weight"))
    stop = F.col("source_size") * F.lit(float(MOST_USES))
    by_stop = Window.orderBy(stop / F.col("weight"), "no")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(all_) * SHARE - F.coalesce(F.sum(stop).over(before), F.lit(0.0))
    weights = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = named.withColumns({"level": left / weights, "stop": stop})
    capped = F.col("stop") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~capped, F.col("level"))).over(all_)
    return levelled.select(
        "source", "source_size", "no", "weight",
        F.when(capped, F.col("stop")).otherwise(level * F.col("weight")).alias("target"),
    )


def offsets(rows: DataFrame, key: str, order: list[str], value: str, total_rows: int) -> DataFrame:
    """``rows`` with column off: the sum of ``value`` over the rows of the same key before it.

    Rows fall into about sqrt(total_rows) chunks by a hash of the order columns; chunk
    sums give each chunk's start, and a window inside (key, chunk) gives the rest, so a key
    that holds most rows is still summed by many tasks.
    """
    chunks = max(1, int(total_rows**0.5))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    sums = dealt.groupBy(key, "chunk").agg(F.sum(value).alias("s"))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.select(key, "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start")), "starts")
    inside = Window.partitionBy(key, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("part", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(starts, [key, "chunk"]).withColumn("off", F.col("start") + F.col("part")).drop("chunk", "start", "part")


def _draw(wanted: np.ndarray):
    """Slots of each group of sources in each shard: one multinomial a shard, seeded by the shard."""
    total = int(wanted.sum())
    p = wanted / max(1, total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                slots = min(SHARD_SLOTS, total - int(shard) * SHARD_SLOTS)
                got = np.random.default_rng([SEED, int(shard)]).multinomial(slots, p)
                grp = np.flatnonzero(got)
                yield pd.DataFrame({"shard": shard, "grp": grp, "n": got[grp]})

    return run


def _deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's slots of some shards to its sources: one multinomial a shard and group. Of a multinomial, that is one again."""
    for pdf in batches:
        for grp, shards, sources in zip(pdf["grp"], pdf["shards"], pdf["sources"], strict=True):
            no, wanted = np.array([x["no"] for x in sources]), np.array([x["wanted"] for x in sources], float)
            p = wanted / wanted.sum()
            for x in shards:
                got = np.random.default_rng([SEED, int(x["shard"]), int(grp)]).multinomial(int(x["n"]), p)
                hit = np.flatnonzero(got)
                yield pd.DataFrame({"shard": x["shard"], "no": no[hit], "n": got[hit]})


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each index of [0, n) goes under the permutation of [0, n) named by key: a Feistel network, walked until inside."""
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, out = index.astype(np.uint64), n.astype(np.uint64), np.zeros(len(index), np.uint64)
    todo = np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(len(ROUND_KEYS)):
            left, right = right, left ^ (mix64(right + k + ROUND_KEYS[r]) & m)
        x[todo] = (left << h) | right
        out[todo] = x[todo]
        todo = todo[x[todo] >= n[todo]]
    return out.astype(np.int64)


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of slots (shard, no, first, n, blocks) to slots with their blocks, about SHARD_SLOTS at a time."""
    for pdf in batches:
        for _, part in pdf.groupby(pdf["n"].cumsum() // SHARD_SLOTS, sort=True):
            n = part["n"].to_numpy()
            at = np.repeat(np.arange(len(part)), n)
            k = part["first"].to_numpy()[at] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            no, size = part["no"].to_numpy()[at], part["blocks"].to_numpy()[at]
            key = mix64(no.astype(np.uint64) * np.uint64(1_000_003) + (k // size).astype(np.uint64) + np.uint64(SEED))
            yield pd.DataFrame({"shard": part["shard"].to_numpy()[at], "no": no, "slot": k, "block": permuted(k % size, size, key)})


def _filled(drawn: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Runs of slots (shard, no, first, n, blocks) in which every source has as many as wanted.

    Multinomial draws miss the wanted counts by chance, by about their square roots. The
    draws of a source beyond its count pass, in order, to the sources that fell short.
    """
    got = drawn.groupBy("no").agg(F.sum("n").alias("drawn"))
    ledger = plan.join(got, "no", "left").select("no", "blocks", "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.lit(0).alias("all"))
    ledger = ledger.withColumns({"over": F.greatest(F.col("drawn") - F.col("wanted"), F.lit(0)), "short": F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0))})
    ledger = offsets(cut(ledger, "ledger"), "all", ["no"], "over", n_sources).withColumnRenamed("off", "over_from")
    ledger = cut(offsets(ledger, "all", ["no"], "short", n_sources).withColumnRenamed("off", "short_from").drop("all"), "ledger")
    runs = drawn.join(ledger, "no")
    kept = runs.select("shard", "no", F.col("off").alias("first"), F.least("n", F.col("wanted") - F.col("off")).alias("n"), "blocks").where("n > 0")
    beyond = runs.where("off + n > wanted").select("shard", F.col("no").alias("of"), "over_from", "wanted", F.explode(F.sequence(F.greatest("off", "wanted"), F.col("off") + F.col("n") - 1)).alias("k"))
    beyond = beyond.select("shard", "of", (F.col("over_from") + F.col("k") - F.col("wanted")).alias("at"))
    lacking = ledger.where("short > 0").select("no", "blocks", "drawn", "short_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("u"))
    lacking = lacking.select((F.col("short_from") + F.col("u")).alias("at"), "no", (F.col("drawn") + F.col("u")).alias("first"), "blocks")
    # draws of one source in one shard that pass to one other follow each other there too
    passed = beyond.join(lacking, "at").groupBy("shard", "of", "no", "blocks").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return kept.union(passed.select("shard", "no", "first", "n", "blocks"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of all ``docs``: (documents, slots, sources).

    documents: one row per input row: id_col, text_hash, source, no, size, source_size, target,
    off; a source's words run from 0 on, and a document's from off on.
    slots: shard, slot, no, block: slot of the shard holds that block of the source's words.
    sources: source, source_size, no, weight, target, blocks, wanted.

    Null or blank text: size 0, never taken. Null source: a source of its own, last. Null
    ids and repeated rows are rows like others. Empty table, or no words at all: no slots.
    The result depends on ids, texts, sources and SEED alone, not on partitions. The driver
    sees one number per GROUP sources.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    sized = cut(sized, "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1)).cast("long")
    wanted = F.rint(F.coalesce("target", F.lit(0.0)) * F.col("blocks") / F.col("source_size")).cast("long")
    sources = sources.withColumn("blocks", blocks).withColumn("wanted", F.when(F.col("source_size") > 0, F.least(wanted, MOST_USES * F.col("blocks"))).otherwise(F.lit(0)))
    sources = cut(sources, "sources")

    s = sources.alias("s")
    with_no = sized.join(s, sized["source"].eqNullSafe(F.col("s.source"))).select("id", "text_hash", sized["source"], "no", "size", "source_size", "target")
    documents = cut(offsets(with_no, "no", ["id", "size", "text_hash"], "size", sized.count()), "offsets")

    plan = sources.select("no", "blocks", "wanted", F.floor((F.col("no") - 1) / GROUP).cast("long").alias("grp"))
    by_group = {r["grp"]: r["wanted"] for r in plan.groupBy("grp").agg(F.sum("wanted").alias("wanted")).collect()}
    in_group = np.array([by_group[g] for g in range(len(by_group))], np.int64)
    shards = -(-int(in_group.sum()) // SHARD_SLOTS)
    drawn = spark.range(shards).mapInPandas(_draw(in_group), "shard long, grp long, n long")
    # a group's list of sources is fetched once for SHARD_PACK shards
    packs = drawn.groupBy("grp", F.floor(F.col("shard") / SHARD_PACK).alias("pack")).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("shards"))
    lists = plan.where("wanted > 0").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("no", "wanted"))).alias("sources"))
    dealt = packs.join(lists, "grp").select("grp", "shards", "sources").mapInPandas(_deal, "shard long, no int, n long")
    dealt = cut(offsets(cut(dealt, "dealt"), "no", ["shard"], "n", shards), "draws")
    runs = cut(_filled(dealt, plan, max(1, len(in_group)) * GROUP), "runs")
    # a shard is a few short rows here and thousands of slots afterwards, which Spark can't know: so many tasks, and no broadcast
    tasks = max(1, -(-shards // TASK_SHARDS))
    slots = runs.repartition(tasks, "shard").mapInPandas(_placed, "shard long, no int, slot long, block long")
    return documents.withColumnRenamed("id", id_col), slots, sources


def targets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id_col, size, and its source's source_size and target. Nulls as in ``mix``."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    s = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).alias("s")
    return sized.alias("d").join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select(F.col("id").alias(id_col), "size", "source_size", "target")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: id_col, source, size, source_size, target, and the words the mix takes of it, repeats counted."""
    documents, slots, _ = mix(docs, id_col, text_col, source_col)
    b = F.lit(BLOCK_WORDS)
    first, last = F.floor(F.col("off") / b), F.floor((F.col("off") + F.col("size") - 1) / b)
    spans = documents.where("size > 0").select("no", "off", "size", F.explode(F.sequence(first, last)).alias("block"))
    start, stop = F.greatest(F.col("block") * b, F.col("off")), F.least((F.col("block") + 1) * b, F.col("off") + F.col("size"))
    uses = slots.groupBy("no", "block").agg(F.count("*").alias("uses"))
    spans = uses.hint("merge").join(spans.select("no", "block", "off", (stop - start).alias("words")), ["no", "block"])
    used = spans.groupBy("no", "off").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # empty documents share their offset with the next one
    both = documents.join(used, (documents["no"] == used["no"]) & (documents["off"] == used["off"]) & (documents["size"] > 0), "left")
    return both.select(
        id_col, documents["source"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


PIECES = "no int, block long, off long, id long, named boolean, words long, t string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each document puts into each block; a document at a time, so that long ones do not add up."""
    for pdf in batches:
        for no, off, i, named, text in zip(pdf["no"], pdf["off"], pdf["id"], pdf["named"], pdf["text"], strict=True):
            w = text.encode("utf-8", "surrogatepass").split()
            first, last = int(off) // BLOCK_WORDS, (int(off) + len(w) - 1) // BLOCK_WORDS
            ends = [max(0, b * BLOCK_WORDS - int(off)) for b in range(first, last + 1)] + [len(w)]
            parts = [w[x:y] for x, y in zip(ends, ends[1:])]
            yield pd.DataFrame({
                "no": no, "block": range(first, last + 1), "off": off, "id": i, "named": named, "words": [len(x) for x in parts],
                "t": [b" ".join(x).decode("utf-8", "surrogatepass") for x in parts],
            })


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: shard, slot, source, doc_ids, n_words and text, a slot's words joined by one space.

    Rows are told apart by id and text, so rows that repeat an id, or have none, are mixed like
    others; a missing id is null in doc_ids. Empty table, or no words: empty result. Texts move
    twice: to their offsets, then cut into pieces to their blocks, where the slots come to fetch
    them; a block is at most BLOCK_WORDS pieces.
    """
    documents, slots, sources = mix(docs, id_col, text_col, source_col)
    # no key is null, so texts are joined where their grouping has put them
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), c.isNotNull().alias("named"))
    keyed = documents.where("size > 0").select(*key(F.col(id_col)), "text_hash", "no", "off")
    texts = docs.select(*key(F.col(id_col).cast("long")), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = texts.groupBy("id", "named", "text_hash").agg(F.min("text").alias("text"))
    joined = keyed.hint("merge").join(texts, ["id", "named", "text_hash"]).select("no", "off", "id", "named", "text")
    pieces = joined.mapInPandas(_pieces, PIECES)
    piece = F.struct("off", F.when(F.col("named"), F.col("id")).alias("id"), "words", "t")
    blocks = pieces.groupBy("no", "block").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    filled = blocks.select(
        "no", "block", F.col("p.id").alias("doc_ids"),
        F.aggregate("p.words", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"),
        F.array_join("p.t", " ").alias("text"),
    )
    return slots.hint("merge").join(filled, ["no", "block"]).join(sources.select("no", "source"), "no").select("shard", "slot", "source", "doc_ids", "n_words", "text")
