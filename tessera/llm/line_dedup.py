"""Line dedup by pairwise alignment.

What is hashed is a line of BLOCK_WORDS words; a shorter one is taken together with the lines
after it, and with those before it, until they have as many. A hash is rare when RARE_DOCS
documents or fewer hold it. Documents that share a rare hash are paired with the first
document that holds it; each pair is aligned by patience diff on line hashes, and common
blocks of BLOCK_WORDS words leave the later document, also where they cross the alignment.

A hash that more documents hold pairs nobody, since it tells little about any two of them;
its run of lines stands in its first holder as it does in the others, so it leaves all the
others directly. Every line of a block of BLOCK_WORDS words lies in such a run of the block,
so no block is missed, whatever its frequency, and the work is in proportion to the lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import SPACES, cut
from tessera.llm.shingles import GOLDEN, mix64

#: An aligned block leaves the later document if it has so many words.
BLOCK_WORDS = 20
#: Documents that hold a rare hash, at most.
RARE_DOCS = 50
TRIMMED = " \t\n\x0b\x0c\r"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two sequences, rising in both: ends first, then lines that are unique on both sides.

    Where no common line is unique, the n-th standing of a line in a is matched with its n-th in b.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        in_a, in_b = Counter(a[i:ie]), Counter(b[j:je])
        where = {x: p for p, x in enumerate(b[j:je], j) if in_b[x] == 1}
        both = [(p, where[x]) for p, x in enumerate(a[i:ie], i) if in_a[x] == 1 and x in where]
        if not both:
            seen, numbered = Counter(), {}
            for p in range(j, je):
                numbered[b[p], seen[b[p]]] = p
                seen[b[p]] += 1
            seen = Counter()
            for p in range(i, ie):
                if (q := numbered.get((a[p], seen[a[p]]))) is not None:
                    both.append((p, q))
                seen[a[p]] += 1
        if not both:
            continue
        tails: list[int] = []  # positions in `both` that end the best rising run of each length
        ends: list[int] = []
        before: list[int] = []
        for n, (_, q) in enumerate(both):
            at = bisect_left(ends, q)
            before.append(tails[at - 1] if at else -1)
            if at == len(tails):
                tails.append(n)
                ends.append(q)
            else:
                tails[at], ends[at] = n, q
        run, n = [], tails[-1]
        while n >= 0:
            run.append(both[n])
            n = before[n]
        p, q = i, j
        for x, y in [*reversed(run), (ie, je)]:
            todo.append((p, x, q, y))
            if x < ie:
                out.append((x, y))
            p, q = x + 1, y + 1
    return sorted(out)


#: GOLDEN * INVERSE is 1 modulo 2**64.
INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(min(n, 1), np.uint64), np.full(max(n - 1, 0), x))))


def rare_runs(seq: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last, and hash of the shortest runs of ``least`` words: from each line with words on, then up to each."""
    n = len(seq)
    total = np.concatenate(([0], np.cumsum(words)))
    stop = np.searchsorted(total, total[:-1] + least)
    on = np.flatnonzero((stop <= n) & (words > 0))
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    upto = np.flatnonzero((start >= 0) & (words > 0))
    start, stop = np.concatenate((on, start[upto])), np.concatenate((stop[on], upto + 1))
    with np.errstate(over="ignore"):
        # the sum of line p's hash times GOLDEN**p; a run's is the difference, divided by the power of its first line
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(seq.view(np.uint64)) * _powers(GOLDEN, n))))
        runs = (sums[stop] - sums[start]) * _powers(INVERSE, n)[start]
    return start, stop, mix64(runs + stop.astype(np.uint64) - start.astype(np.uint64)).view(np.int64)


def rare_hashes(seq: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """For each line with words, the hash of the shortest run of lines from it on that has ``least`` words; distinct, sorted."""
    _, _, hashes = rare_runs(seq, words, least)
    total = np.concatenate(([0], np.cumsum(words)))
    return np.unique(hashes[: np.count_nonzero((words > 0) & (total[-1] - total[:-1] >= least))])


def shared_lines(a: np.ndarray, b: list[int], weight: list[int], least: int) -> set[int]:
    """Positions in b of all lines with words in runs of ``least`` words or more that stand in a too, wherever.

    Such a line lies in the shortest run from itself on, in that up to itself, or in that from
    the first line of the common run on.
    """
    known = dict(zip(b, weight, strict=True))
    # a line that b lacks may end a run, but no run with it is in b
    _, _, there = rare_runs(a, np.array([known.get(x, least) for x in a.tolist()], np.int64), least)
    return covered(np.array(b, np.int64), np.array(weight, np.int64), there, least)


def covered(seq: np.ndarray, words: np.ndarray, hashes: np.ndarray, least: int) -> set[int]:
    """Positions of the lines in runs whose hash is among ``hashes``."""
    start, stop, runs = rare_runs(seq, words, least)
    hit = np.isin(runs, hashes)
    depth = np.zeros(len(seq) + 1, np.int64)
    np.add.at(depth, start[hit], 1)
    np.add.at(depth, stop[hit], -1)
    return set(np.flatnonzero(np.cumsum(depth)).tolist())


def common_lines(a: list[int], b: list[int], weight: list[int], least: int) -> list[int]:
    """Positions in b of common blocks of ``least`` words or more.

    These are the aligned blocks, with the lines without words at their ends, and the blocks
    that cross the alignment.
    """
    crossing = shared_lines(np.array(a, np.int64), b, weight, least)
    if not crossing:  # then no aligned block is long enough either
        return []
    blocks: list[list[tuple[int, int]]] = []
    for i, j in patience(a, b):
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    aligned = {j for block in blocks if sum(weight[j] for _, j in block) >= least for _, j in block}
    return sorted(aligned | crossing)


def _rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [np.unique(rare_runs(np.asarray(s, np.int64), np.asarray(w, np.int64), BLOCK_WORDS)[2]) for s, w in zip(pdf["seq"], pdf["words"], strict=True)]
        ids = np.repeat(pdf["id"].to_numpy(), [len(x) for x in found])
        yield pd.DataFrame({"id": ids, "rare": np.concatenate(found) if found else np.empty(0, np.int64)})


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gone = [
            common_lines(list(a), list(b), list(n), BLOCK_WORDS)
            for a, b, n in zip(pdf["a"], pdf["b"], pdf["words"], strict=True)
        ]
        yield pd.DataFrame({"id": pdf["id"], "text_hash": pdf["text_hash"], "gone": gone})


def _often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gone = [
            sorted(covered(np.asarray(s, np.int64), np.asarray(w, np.int64), np.asarray(often, np.int64), BLOCK_WORDS))
            for s, w, often in zip(pdf["b"], pdf["words"], pdf["often"], strict=True)
        ]
        yield pd.DataFrame({"id": pdf["id"], "text_hash": pdf["text_hash"], "gone": gone})


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with common blocks deleted from text_col, and columns n_lines and n_removed added last.

    Of two documents the one with the larger id is the later. Lines are compared without
    white space at their ends.

    Null text: stays null, with 0 lines. Null id: the row is left alone. Rows that repeat an
    id are one document: they are not compared with each other, and each loses what it
    shares with earlier ids. A block leaves whether patience diff aligns it or other lines cross
    it. Empty table: empty result. All columns of ``docs`` are kept under their names, except that earlier columns n_lines and n_removed are replaced.
    """
    docs = docs.drop(*({"n_lines", "n_removed"} & set(docs.columns)))
    line_hash = F.transform(_lines(F.col("text")), lambda x: F.xxhash64(F.btrim(x, F.lit(TRIMMED))))
    n_words = F.transform(
        _lines(F.col("text")),
        lambda x: F.when(F.btrim(x, F.lit(TRIMMED)) == "", 0).otherwise(F.size(F.split(F.btrim(x, F.lit(TRIMMED)), SPACES))),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    seqs = cut(rows.select("id", F.xxhash64("text").alias("text_hash"), line_hash.alias("seq"), n_words.alias("words")), "lines")
    rare = seqs.select("id", "seq", "words").mapInPandas(_rare, "id long, rare long")
    rare = cut(rare.groupBy("rare", "id").agg(F.lit(1).alias("one")).select("rare", "id"), "rare")
    anchors = rare.groupBy("rare").agg(F.count("*").alias("docs"), F.min("id").alias("first")).where("docs > 1")
    held = cut(rare.join(cut(anchors, "anchors"), "rare").where("id <> first"), "held")
    pairs = cut(held.where(F.col("docs") <= RARE_DOCS).select("first", "id").distinct(), "pairs")
    # one document's own hashes
    often = cut(held.where(F.col("docs") > RARE_DOCS).groupBy("id").agg(F.collect_list("rare").alias("often")), "often")
    earlier = seqs.select(F.col("id").alias("first"), F.col("seq").alias("a"))
    later = seqs.select("id", "text_hash", F.col("seq").alias("b"), "words")
    both = pairs.join(earlier, "first").join(later, "id").select("id", "text_hash", "a", "b", "words")
    positions = "id long, text_hash long, gone array<int>"
    gone = (
        both.mapInPandas(_aligned, positions)
        .union(often.join(later, "id").mapInPandas(_often, positions))
        .select("id", "text_hash", F.explode("gone").alias("at"))
        .groupBy("id", "text_hash")
        .agg(F.collect_set("at").alias("gone"))
    )
    gone = cut(gone, "gone").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone"))
    # texts move by id at every size; a broadcast while there is little to delete would only hide that
    joined = docs.join(
        gone.hint("merge"), (docs[id_col].cast("long") == gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__hash"]), "left"
    )
    text = docs[text_col]
    joined = joined.withColumn("__lines", _lines(text))
    lines, n_lines = F.col("__lines"), F.size("__lines")
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *[F.when(F.col("__gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_emptied(deduped: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """Without the documents that deletion left with fewer than ``least`` words, and without the two added columns.

    A document that has lost nothing stays, however short.
    """
    emptied = (F.col("n_removed") > 0) & (F.regexp_count(text_col, F.lit("[^ \\t-\\r]+")) < least)
    return deduped.where(F.coalesce(~emptied, F.lit(True))).drop("n_lines", "n_removed")
