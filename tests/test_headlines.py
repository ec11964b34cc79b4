"""Similar headlines: pairs that meet are compared within one join, and only alike ones leave it."""

from __future__ import annotations

import random

from tessera.operators import text


def _grams(t: str) -> set[str]:
    return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) >= 2 else {t}


def test_pairs_are_all_pairs_and_leave_one_join(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh\U0001f600é") for _ in range(draw.randint(1, 5)))
    heads = ["", "a", "\U0001f600", "ab", "ba"]
    for _ in range(120):
        base = [word() for _ in range(draw.choice([1, 3, 12, 60]))]
        heads += [" ".join(base), " ".join(base[: len(base) - 1] + [word()])]
    heads = sorted(set(heads))
    docs = spark.createDataFrame([(i, t, "x" if i % 3 else "y") for i, t in enumerate(heads)], "k long, t string, source string")
    out = text.similar_headlines(docs, "k", "t", 0.6, ["source"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    want = {}
    for i, x in enumerate(heads):
        for j in range(i + 1, len(heads)):
            a, b = _grams(x), _grams(heads[j])
            if (i % 3 == 0) == (j % 3 == 0) and len(a & b) / len(a | b) >= 0.6:
                want[i, j] = round(len(a & b) / len(a | b), 6)
    assert len(want) > 50 and {(r["a"], r["b"]): r["similarity"] for r in out.collect()} == want
