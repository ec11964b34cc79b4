"""Centroid clustering of vectors in whole numbers, with exact distances.

Vectors are packed once into blocks of a few thousand, written in the smallest whole-number
width that holds them. A block's distances are one matrix product, |x|^2 - 2x.c + |c|^2 in
float64, which is exact while every partial sum stays below 2^53; rows that could pass it are
computed in 64-bit integers, and beyond those in Python's own. A tree of partial sums brings
one row per centroid to the driver, never vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

#: Whole numbers below these bounds are exact in float64 and in int64.
EXACT, LONG = 1 << 53, 1 << 63
#: Vectors in a block, and rows in one matrix product.
BLOCK, ROWS = 4096, 2048
WIDTHS = ("<i2", "<i4", "<i8")
#: Ids travel as text, since pandas turns longs beside nulls into doubles.
PACKED = "ids array<string>, dims int, width string, data binary"
CLUSTERED = "id string, cluster int, distance long"

#: A block: whole numbers by row, of a numpy width or, where none holds them, Python's (object).
Block = np.ndarray
Centroids = list[list[int]]


def whole(x: np.ndarray, scale: int) -> Block:
    """floor(scale * x), as exact integers; ``scale`` must be a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not len(y) or np.abs(y).max() < LONG / 2:
        return y.astype(np.int64)
    # from 2^53 on doubles are whole numbers, and scaling them first could overflow
    exact = lambda v: int(v) * scale if abs(v) >= EXACT else math.floor(v * scale)
    return np.array([[exact(v) for v in row] for row in x.tolist()], dtype=object)


def packed_block(rows: Block) -> tuple[str, bytes]:
    if rows.dtype == object:
        return "text", "\n".join(map(str, rows.ravel())).encode()
    most = int(np.abs(rows).max(initial=0))
    width = next(w for w in WIDTHS if most <= np.iinfo(w).max)
    return width, rows.astype(width).tobytes()


def unpacked(width: str, data: bytes, dims: int) -> Block:
    if width == "text":
        return np.array([int(x) for x in bytes(data).decode().split("\n")], dtype=object).reshape(-1, dims)
    return np.frombuffer(data, width).astype(np.int64).reshape(-1, dims)


def _packed(scale: int, dims: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                rows = whole(np.stack(part["vector"].to_numpy()).astype(np.float64), scale)
                width, data = packed_block(rows)
                yield pd.DataFrame({"ids": [part["id"].tolist()], "dims": [dims], "width": [width], "data": [data]})

    return run


def largest(rows: Block) -> list[int]:
    """The largest magnitude of each row, as Python integers (that of -2^63 has no 64-bit form)."""
    return np.maximum(rows.max(axis=1).astype(object), -rows.min(axis=1).astype(object)).tolist()


def nearest(rows: Block, centroids: Centroids) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row (ties: the smaller number) and its exact squared distance."""
    labels, distances = np.zeros(len(rows), np.int32), [0] * len(rows)
    dims, most = rows.shape[1], max(abs(x) for c in centroids for x in c)
    # partial sums of |x|^2, 2x.c and |c|^2 in any order stay within dims * (|x| + |c|)^2
    bounds = np.array([dims * (x + most) ** 2 for x in largest(rows)], dtype=object)
    by_blas, by_long = bounds < EXACT, bounds < LONG
    at = np.flatnonzero(by_blas)
    if len(at):
        c = np.array(centroids, dtype=np.float64)
        squares = (c * c).sum(axis=1)
        for i in range(0, len(at), ROWS):
            own = at[i : i + ROWS]
            x = rows[own].astype(np.float64)
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + squares
            labels[own] = best = d.argmin(axis=1)
            for j, value in zip(own.tolist(), d[np.arange(len(own)), best].astype(np.int64).tolist(), strict=True):
                distances[j] = value
    for own, kind in ((np.flatnonzero(by_long & ~by_blas), np.int64), (np.flatnonzero(~by_long), object)):
        for j in own.tolist():
            x = rows[j].astype(kind)
            d = [int(((x - np.array(c, dtype=kind)) ** 2).sum()) for c in centroids]
            distances[j] = min(d)
            labels[j] = d.index(distances[j])
    return labels, distances


#: Per centroid: vectors, componentwise sums, and summed distance, all exact.
Sums = list[tuple[int, list[int], int]]


def block_sums(rows: Block, centroids: Centroids) -> Sums:
    labels, distances = nearest(rows, centroids)
    ones = (labels[None, :] == np.arange(len(centroids))[:, None]).astype(np.float64)
    if len(rows) * max(largest(rows), default=0) < EXACT:
        sums = (ones @ rows.astype(np.float64)).astype(np.int64).tolist()
    else:
        sums = [[int(x) for x in rows[labels == c].astype(object).sum(axis=0)] if (labels == c).any() else [0] * rows.shape[1] for c in range(len(centroids))]
    inertia = [0] * len(centroids)
    for c, d in zip(labels.tolist(), distances, strict=True):
        inertia[c] += d
    return list(zip(ones.sum(axis=1).astype(int).tolist(), sums, inertia, strict=True))


def added(a: Sums, b: Sums) -> Sums:
    if not a or not b:
        return a or b
    return [(m + n, [x + y for x, y in zip(s, t, strict=True)], p + q) for (m, s, p), (n, t, q) in zip(a, b, strict=True)]


def total(blocks: DataFrame, centroids: Centroids) -> Sums:
    """The sums of every cluster, by a tree of partial sums: one row per centroid from each task."""

    def seen(sums: Sums, block: Row) -> Sums:
        return added(sums, block_sums(unpacked(block["width"], block["data"], block["dims"]), centroids))

    return blocks.select("dims", "width", "data").rdd.treeAggregate([], seen, added)


def moved(centroids: Centroids, sums: Sums) -> Centroids:
    """Floored means; a centroid without vectors stays."""
    return [[x // n for x in s] if n else c for c, (n, s, _) in zip(centroids, sums, strict=True)]


def _assigned(centroids: Centroids) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, dims, width, data in zip(pdf["ids"], pdf["dims"], pdf["width"], pdf["data"], strict=True):
                labels, distances = nearest(unpacked(width, data, dims), centroids)
                long = pd.array([d if d < LONG else None for d in distances], dtype="Int64")
                yield pd.DataFrame({"id": ids, "cluster": labels, "distance": long})

    return run


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, Centroids]:
    """The cluster of each vector of ``vectors``, and the final centroids.

    Vectors of exactly ``dims`` components, none null, NaN or infinite, take part; others
    give no row. A component x becomes floor(scale * x). Centroids start as the ``k`` vectors
    with the smallest SHA-256 of ``seed:id`` and move ``rounds`` times to the floored means of
    their vectors; the last assignment follows.

    The table has id_col, cluster int, distance long (squared), cluster_inertia and inertia
    long (distances summed over the cluster and over all), centroid_sha256 string. A distance
    or a sum of 2^63 or more is null, as a long can't hold it; the clusters stay exact.

    Fewer vectors than ``k``: as many centroids as vectors. Repeated rows and repeated ids
    count as often as they occur, and the one with the smaller components starts a centroid
    first. Null ids: hashed as an empty text, clustered like others. Empty table or no vector
    that takes part: no rows and no centroids. Other columns are not read, whatever they are called.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    x = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is above all numbers here
    x = x.where((F.size("vector") == dims) & finite)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256)
    first = x.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    centroids = [[int(v) for v in row] for row in whole(np.array([r["vector"] for r in first]), scale)] if first else []
    blocks = cut(x.mapInPandas(_packed(scale, dims), PACKED), "blocks")
    if not centroids:
        sums: Sums = []
    else:
        for _ in range(rounds):
            centroids = moved(centroids, total(blocks, centroids))
        sums = total(blocks, centroids)
    long = lambda v: v if v < LONG else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    of = [(c, long(s[2]), long(sum(t[2] for t in sums)), digest(centroids[c])) for c, s in enumerate(sums)]
    named = x.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = blocks.mapInPandas(_assigned(centroids), CLUSTERED) if centroids else x.sparkSession.createDataFrame([], CLUSTERED)
    # one row per centroid: k rows, so its size is bounded
    out = rows.join(F.broadcast(named), "cluster")
    return out.select(F.col("id").cast("long").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
