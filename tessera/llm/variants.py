"""Spelling variants of a corpus's words: which words are one edit apart, and which spelling is the usual one.

An edit leaves one of a word's two even segments whole, so words are indexed by either
segment, and words of the same length or one longer are looked up by the substrings that
stand where the segment may have moved to. Where many words share a segment, the other
segment is halved again under the same principle, down to a single place, so no bucket
grows with the vocabulary and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Entries that may share a key before the rest of their words is halved again.
BUCKET = 200


def without_one(run: str, seed: int, every: int) -> str:
    """``run`` less one code point where ``every`` divides its checksum, which continues ``seed``."""
    h = zlib.crc32(run.encode("utf-8"), seed)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(least: int, misspelt: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def frame(n: Counter[str]) -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(n.keys()), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                if not text:
                    continue
                own = Counter(RUN.findall(text.encode("utf-8").lower().decode("utf-8")))  # bytes lower A-Z alone
                if misspelt:
                    seed = zlib.crc32(f"{key or ''}:".encode())
                    for word, times in own.items():
                        n[without_one(word, seed, misspelt)] += times
                else:
                    n.update(own)
                if len(n) > HELD_WORDS:
                    yield frame(Counter({w: k for w, k in n.items() if len(w) >= least}))
                    n.clear()
        yield frame(Counter({w: k for w, k in n.items() if len(w) >= least}))

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, misspelt: int = 0) -> DataFrame:
    """word, n: the runs of letters `[A-Za-z\\u00C0-\\u00FF]+` of whole texts, A-Z lower-cased, with their occurrences.

    ``misspelt`` plants errors to find: a run loses one code point where that number divides
    the CRC-32 of ``id:run``. Null text: no words; null id: an empty one. Repeated rows count
    as often as they occur. Empty table: no words.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(_counted(least_length, misspelt), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _entries(rows: DataFrame) -> DataFrame:
    """Both halves of each row's open interval [a, b): one half gets fixed, the other stays open."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    open_ = F.explode(F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b"))))
    rows = rows.select("word", "n", "longer", "size", open_.alias("x")).select("word", "n", "longer", "size", "x.a", "x.b")
    after = F.substring("word", F.col("b") + F.col("longer").cast("int") + 1, F.col("size") + 1)
    return rows.withColumn("key", F.concat_ws("\0", "size", "a", "b", F.substring("word", F.lit(1), F.col("a")), after))


def entries(words: DataFrame) -> DataFrame:
    """word, n, longer, size, a, b, key: what stands outside [a, b) of an indexed word of ``size``, or of a word one longer.

    A key holds BUCKET entries at most, or else [a, b) is one place, where no more words can
    differ than there are letters.
    """
    size = F.char_length("word")
    root = lambda longer: F.struct(F.lit(longer).alias("longer"), (size - int(longer)).alias("size"))
    rows = words.select("word", "n", F.explode(F.array(root(False), root(True))).alias("x")).select("word", "n", "x.*").where("size > 0")
    left, done = cut(_entries(rows.withColumn("a", F.lit(0)).withColumn("b", F.col("size"))), "entries"), None
    while True:
        hot = left.where("b - a > 1").groupBy("key").count().where(F.col("count") > BUCKET).select("key")
        hot = cut(hot, "hot")
        if hot.isEmpty():
            return left if done is None else done.union(left)
        cold = left.join(hot, "key", "left_anti").select(*left.columns)
        done = cold if done is None else done.union(cold)
        left = cut(_entries(left.join(hot, "key", "left_semi")), "entries")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: words that differ by exactly one inserted, deleted or replaced code point, once each way.

    Two words may share several keys, but only one whose interval holds the first place where
    they differ (or follows all of the shorter one) counts; that takes out doubles before
    the edit is verified.
    """
    every = cut(entries(words), "indexed")
    s = every.where("not longer").select("key", "size", "b", F.col("word").alias("s"), F.col("n").alias("sn"))
    r = every.select("key", "longer", F.col("word").alias("r"), F.col("n").alias("rn"))
    first: Column = (F.col("b") == F.col("size")) | (F.substring("s", F.lit(1), F.col("b")) != F.substring("r", F.lit(1), F.col("b")))
    pairs = s.join(r, "key").where((F.col("longer") | (F.col("s") < F.col("r"))) & first & (F.levenshtein("s", "r", 1) == 1))
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}n").alias("n"), F.col(b).alias("other"), F.col(f"{b}n").alias("other_n"))
    return pairs.select(F.explode(F.array(way("s", "r"), way("r", "s"))).alias("x")).select("x.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last, twice as far each round."""
    links = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        longer = cut(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        links = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """The usual spelling of each of ``words`` (word, n; words are distinct).

    Returns word, form, root string, n, n_near, form_n long. form is the near word of largest
    n (ties: the smallest in code-point order) if that n is ``times`` the word's or more, else
    null; root follows forms to the last, which is the word itself where it has none.

    Null words and null n: no row. Empty table: empty result. Further columns are not read.
    """
    if times < 2:
        raise ValueError("forms must grow, or they could lead in a circle")
    words = cut(words.where("word is not null and n is not null").select("word", "n"), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("other"))).alias("best"))
    usual = -F.col("best.n") >= times * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.other")).alias("form"), F.when(usual, -F.col("best.n")).alias("form_n")
    )
    forms = cut(forms, "forms")
    out = forms.join(roots(forms.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
