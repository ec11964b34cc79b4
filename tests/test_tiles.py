"""Similar texts: rows are cut into tiles by size and weight, and compared a pair of tiles at a time."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import text


def _grams(t: str) -> set[str]:
    return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) >= 2 else {t}


def _pairs(rows: list[tuple], least: float) -> dict:
    """Of rows (key, text, block), each by each."""
    out = {}
    for a, s, x in rows:
        for b, t, y in rows:
            if a is not None and b is not None and x is not None and x == y and a < b and (shared := len(_grams(s) & _grams(t))) >= least * len(_grams(s) | _grams(t)):
                out[a, b] = round(shared / len(_grams(s) | _grams(t)), 6)
    return out


def _texts(draw: random.Random, letters: str, many: int) -> list[str]:
    made = ["", "\0", "a", "é", "\U0001f600"]
    for _ in range(many):
        base = "".join(draw.choice(letters) for _ in range(draw.choice([2, 5, 20, 60, 250])))
        cut = draw.randint(0, len(base))
        made += [base, base[:cut] + draw.choice(letters) + base[cut:], base[cut:] + base[:cut]]
    return sorted(set(made))


@pytest.mark.parametrize("weight", [150, 1500, 2_000_000])
def test_tiles_meet_all_pairs_once(spark, monkeypatch, weight):
    """Of tiles of some rows, of some tens of rows and of all; more numbers than have a bit of their own."""
    monkeypatch.setattr(text, "TILE", weight)
    draw = random.Random(7)
    heads = _texts(draw, "abcdefghijklmnopqrstuvwxyzßéñ\U0001f600", 90) + _texts(draw, "".join(map(chr, range(0x4E00, 0x4E80))), 60)
    heads = [h for h in sorted(set(heads)) if h == h.strip() and h == h.lower()]
    rows = [(None if i % 41 == 5 else i, t, (None, "x", "y", "x")[i % 4]) for i, t in enumerate(heads)]
    out = text.similar_headlines(spark.createDataFrame(rows, "k long, t string, source string"), "k", "t", 0.6, ["source"]).collect()
    want = _pairs(rows, 0.6)
    assert len(want) > 30 and len(out) == len(want) and {(r["a"], r["b"]): r["similarity"] for r in out} == want


def test_numbers_are_made_once_texts_are_one(spark):
    """No filter of a join reaches below the grouping of equal texts, where it would be evaluated for each document."""
    docs = spark.createDataFrame([(1, "ab", "x")], "k long, t string, source string")
    for made in (text.similar_headlines(docs, "k", "t", 0.6, ["source"]), text.pairs_in_time(docs.selectExpr("*", "timestamp_seconds(k) as ts"), "k", "t", "ts", 6, 0.6, ["source"])):
        for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines():
            assert not re.search(r"regexp_extract_all|transform\(|aggregate\(", line)


def test_sets_of_two_sizes_meet_their_like(spark, monkeypatch):
    """Sets of 10 and of 100 members, which lie in tiles of their own, are compared with their like, across tiles too."""
    monkeypatch.setattr(text, "TILE", 42 * 10)
    rows = [(i, list(range(i, i + (10 if i < 100 else 100)))) for i in range(200)]
    sets = spark.createDataFrame([(k, len(g), g, 1) for k, g in rows], "key long, n int, g array<long>, b int")
    out = text._alike(sets, ["b"], 0.6)
    got = {(r["a"], r["b"]) for r in out.collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}


def test_groups_are_cut_whole(monkeypatch):
    """Small groups come together, and no group is in two parts, however batches cut them."""
    monkeypatch.setattr(text, "TILE", 400)
    draw = random.Random(1)
    grp = [g for g in range(40) for _ in range(draw.choice([1, 2, 9, 60]))]
    table = pa.table({"p": pa.array([g // 2 for g in grp]), "q": pa.array([g % 2 for g in grp]), "g": pa.array([[1, 2]] * len(grp), pa.list_(pa.int64()))})
    for size in (1, 7, 50, 10_000):
        parts = list(text._together(iter(table.to_batches(size)), ["p", "q"]))
        assert pa.concat_tables(parts).equals(table)
        ids = [set(zip(t["p"].to_pylist(), t["q"].to_pylist())) for t in parts]
        assert sum(map(len, ids)) == 40 and len(parts) > 1 or size == 10_000


def test_shared_members_beyond_exact_bits():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 4000, k)) for k in (1, 50, 900, 2500, 2500, 3000)]
    bits = text._Bits(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), np.array([len(s) for s in sets]))
    x, y = np.triu_indices(len(sets))
    assert bits.shared(x, y).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]
    for words in (1, 2, 4, 8):
        assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(bits.apart(words, x, y), x, y))
