"""Spelling variants against all pairs of words, at every bucket size, and the word counts against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import variants

SCHEMA = "doc_id long, text string, word string, n int, key binary"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int]):
    form, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near), words[form[w]] if form[w] else None)
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, *out[w]))
    return rows


def found(spark, words):
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, key string")
    got = [tuple(r) for r in variants.spelling_variants(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("bucket", [2, 30, 10**9])
def test_all_pairs(spark, monkeypatch, bucket):
    """Dense short words over few letters, with doubled letters, so that every kind of overlap occurs."""
    monkeypatch.setattr(variants, "BUCKET", bucket)
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))): r.randint(3, 400) for _ in range(500)}
    words |= {"a" * i: 5 + i for i in range(1, 9)}
    assert found(spark, words) == brute(words)


def test_chains_and_ties(spark):
    words = {"aaaaa": 1000, "aaaab": 400, "aaabb": 150, "aabbb": 70, "abbbb": 3, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "lonely": 3, "\U0001f600aaaa": 9, "caaaa": 20}
    got = {r[0]: r for r in found(spark, words)}
    assert set(got.values()) == brute(words)
    assert got["abbbb"][2] == "aaaaa" and got["zzzzz"][1] == "zzzzx" and got["lonely"][1:3] == (None, "lonely")


def test_hot_key(spark):
    """A segment that thousands of words share is halved until keys are small."""
    r = random.Random(8)
    words = {"andth" + "".join(r.choice("aeiou") for _ in range(6)): r.randint(3, 99) for _ in range(3000)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    entries = variants.entries(df)
    assert entries.where("b - a > 1").groupBy("key").count().agg({"count": "max"}).first()[0] <= variants.BUCKET
    got = {(x["word"], x["other"]) for x in variants.near_words(df).collect()}
    want = set()
    for w in words:  # every word that one deletion or substitution away exists
        near = {w[:i] + c + w[i + 1 :] for i in range(5, len(w)) for c in "aeiou"} | {w[:i] + w[i + 1 :] for i in range(5, len(w))}
        want |= {(w, x) for x in near if x in words and x != w}
    assert got == want


def plain_counts(rows, misspelt):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


@pytest.mark.parametrize("held", [3, 400_000])
def test_counts(spark, monkeypatch, held):
    monkeypatch.setattr(variants, "HELD_WORDS", held)
    r = random.Random(9)
    some = ["Éclair", "ÉCLAIR", "straße", "words", "WORDS", "don't", "naïve", "x2yellow", "×÷abc", "日本words", "tiny"]
    rows = [(i, " ".join(r.choices(some, k=30))) for i in range(40)]
    rows += [(None, "words " * 50), (7, None), (8, ""), (9, " \n"), rows[0], rows[0], (10, "longer " * 60_000)]
    df = spark.createDataFrame([(*x, "x", 1, b"") for x in rows], SCHEMA)
    for misspelt in (0, 3):
        got = {x["word"]: x["n"] for x in variants.word_counts(df, misspelt=misspelt).collect()}
        assert got == plain_counts(rows, misspelt)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants.word_counts(empty).count() == 0
    assert found(spark, {}) == set() and found(spark, {"alone": 4}) == {("alone", None, "alone", 4, 0, None)}
    odd = spark.createDataFrame([(None, 3), ("words", None), ("sword", 3)], "word string, n long")
    assert [tuple(r) for r in variants.spelling_variants(odd).collect()] == [("sword", None, "sword", 3, 0, None)]
    with pytest.raises(ValueError, match="circle"):
        variants.spelling_variants(odd, times=1)
