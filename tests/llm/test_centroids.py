"""Centroid clustering against plain Python integers, with magnitudes beyond float64 and int64, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm.centroids import centroid_clusters, nearest, packed_block, unpacked, whole

SCHEMA = "vec_id long, embedding array<double>, cluster string, id int, data binary"


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in kept]
    order = sorted(ints, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in ints:
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in cents]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            own = [v for _, label, _, v in got if label == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = assign()
    inertia = [sum(d for _, label, d, _ in got if label == c) for c in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, long(d), long(inertia[c]), long(sum(inertia)), digest[c]) for i, c, d, _ in got), key=str)


def clustered(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(i, v, "x", 1, b"y") for i, v in rows], SCHEMA).repartition(3)
    got, cents = centroid_clusters(df, k=k, rounds=rounds, dims=dims)
    return sorted((tuple(r) for r in got.collect()), key=str), cents


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(i % 5, 0.2) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [rows[9], rows[9]]  # ties and repeats
    got, cents = clustered(spark, rows, 7, 3, 6)
    assert got == brute(rows, 7, 3, 6) and len(cents) == 7


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 1.0]), (None, [0.5, 0.25]), (None, [-0.001, 3.0]), (1, [1.0, 2.0]), (1, [-4.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.0, 0.0])]
    for k in (1, 3, 16):
        assert clustered(spark, rows, k, 3, 2)[0] == brute(rows, k, 3, 2)
    assert clustered(spark, rows[1:8], 16, 3, 2) == ([], [])
    assert clustered(spark, [], 16, 3, 2) == ([], [])


@pytest.mark.parametrize("top", [2.0**20, 2.0**24, 2.0**40, 2.0**58, 1e60, 1.7e308])
def test_magnitudes_beyond_float_and_long(spark, top):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * (top if i % 3 else 1.0) for _ in range(3)]) for i in range(40)] + [(99, [top, -top, top])]
    assert clustered(spark, rows, 4, 2, 3)[0] == brute(rows, 4, 2, 3)


def test_nearest_is_exact_on_both_sides_of_the_guard():
    r = np.random.default_rng(6)
    for bits in (10, 24, 25, 26, 30, 45, 62):
        rows = r.integers(-(1 << bits), 1 << bits, (50, 8))
        cents = [[int(x) for x in c] for c in r.integers(-(1 << bits), 1 << bits, (5, 8))]
        cents.append(list(cents[0]))  # a tie
        labels, distances = nearest(rows, cents)
        for row, label, distance in zip(rows.tolist(), labels.tolist(), distances, strict=True):
            d = [sum((x - y) ** 2 for x, y in zip(row, c, strict=True)) for c in cents]
            assert (label, distance) == (d.index(min(d)), min(d))


def test_blocks_come_back():
    for rows in (np.array([[1, -2]]), np.array([[40000, 0]]), np.array([[1 << 40, -5]]), np.array([[1 << 80, -3]], dtype=object), np.array([[-32768, 1], [3, 4]])):
        width, data = packed_block(rows)
        assert unpacked(width, data, 2).tolist() == rows.tolist()
    assert whole(np.array([[-0.001, 1e300]]), 64).tolist() == [[-1, int(1e300) * 64]]


def test_scale_is_checked(spark):
    with pytest.raises(ValueError, match="power of two"):
        centroid_clusters(spark.createDataFrame([], SCHEMA), scale=3)
