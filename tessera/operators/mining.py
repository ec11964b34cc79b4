"""Many factors at once: all pair correlations in one pass, greedy clusters, beam search over rank combinations.

Factors are ranked within a date, over the rows that have all the values a measure needs, so
ranks differ from pair to pair where values are missing. A date's rows go through one task as
a matrix (symbols x factors); dates spread over the cluster, and the plan is the same for any
number of factors or combinations. The driver sees a row per pair or combination.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties averaged; exact, as they are whole or half numbers."""
    _, at, times = np.unique(x, return_inverse=True, return_counts=True)
    return (times.cumsum() - (times - 1) / 2)[at]


def correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Of two rank vectors; None where one is constant."""
    x, y = a - a.mean(), b - b.mean()
    scale = (x @ x) * (y @ y)
    return float(x @ y / np.sqrt(scale)) if scale > 0 else None


def _by_date(panel: DataFrame, columns: Sequence[str], kernel: Callable[[np.ndarray], Iterable[tuple]], fields: str) -> DataFrame:
    """The rows that ``kernel`` makes of each date's matrix; values that are not finite are NaN in it."""
    names = [f.split()[0] for f in fields.split(", ")]
    rows = panel.select("date", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[[f"x{i}" for i in range(len(columns))]].to_numpy(np.float64)
        return pd.DataFrame([(pdf["date"].iloc[0], *r) for r in kernel(np.where(np.isfinite(x), x, np.nan))], columns=["date", *names])

    return rows.groupBy("date").applyInPandas(run, f"date date, {fields}")


def daily_correlations(panel: DataFrame, factors: Sequence[str], least: int = 3, against: Sequence[str] | None = None) -> DataFrame:
    """date, a, b, ic, n: rank correlation of each pair of ``factors`` (or of each with ``against``) on the rows that have both.

    ic is null on dates with fewer than ``least`` different values of a, or where one is constant.
    """
    columns = [*factors, *(against or ())]
    last = len(factors)
    pairs = [(i, j) for i in range(last) for j in range(last, len(columns))] if against else list(combinations(range(last), 2))

    def kernel(x: np.ndarray) -> Iterable[tuple]:
        known = ~np.isnan(x)
        masks = [known[:, i].tobytes() for i in range(len(columns))]
        ranked: dict[tuple[int, bytes], tuple[np.ndarray, int]] = {}

        def ranks(i: int, rows: np.ndarray, key: bytes) -> tuple[np.ndarray, int]:
            if (i, key) not in ranked:
                values = x[rows, i]
                ranked[i, key] = (average_ranks(values), len(np.unique(values)))
            return ranked[i, key]

        for i, j in pairs:
            both = known[:, i] & known[:, j]
            key = masks[i] if masks[i] == masks[j] else both.tobytes()  # most columns miss the same rows and are ranked once
            a, values = ranks(i, both, key)
            ic = correlation(a, ranks(j, both, key)[0]) if values >= least else None
            yield columns[i], columns[j], ic, int(both.sum())

    return _by_date(panel, columns, kernel, "a string, b string, ic double, n long")


def pair_correlations(panel: DataFrame, factors: Sequence[str], least: int = 3) -> DataFrame:
    """a, b, corr (mean over dates), n_dates, n: each pair of ``factors`` once, in their order; null and 0 where no date has one."""
    n = F.sum(F.when(F.col("ic").isNotNull(), F.col("n")).otherwise(0))
    return daily_correlations(panel, factors, least).groupBy("a", "b").agg(F.avg("ic").alias("corr"), F.count("ic").alias("n_dates"), n.alias("n"))


@dataclass(frozen=True)
class Placed:
    """A factor, the one that stands for it (itself, if it stands for its own), and their correlation."""

    factor: str
    representative: str
    rho: float | None


def greedy_clusters(correlations: DataFrame, order: Sequence[str], threshold: float, strongest: bool = False) -> list[Placed]:
    """Factors in ``order`` join a representative before them that they are correlated with by ``threshold`` or more either way.

    The first such representative takes a factor, or the one it is most correlated with if
    ``strongest``; a factor without one represents itself. Pairs without a correlation are
    unrelated. The matrix has a row per pair of factors, which the driver holds.
    """
    known = {frozenset((r["a"], r["b"])): r["corr"] for r in correlations.where("corr is not null").collect()}
    out: list[Placed] = []
    heads: list[str] = []
    for name in order:
        near = [(h, known[frozenset((name, h))]) for h in heads if abs(known.get(frozenset((name, h)), 0.0)) >= threshold]
        if near:
            head, rho = max(near, key=lambda x: abs(x[1])) if strongest else near[0]  # max keeps the earlier of equal ones
            out.append(Placed(name, head, rho))
        else:
            heads.append(name)
            out.append(Placed(name, name, None))
    return out


@dataclass(frozen=True)
class Combination:
    """Factors with weights and directions (1 high, -1 low), and what their weighted ranks say of the target."""

    factors: tuple[str, ...]
    weights: tuple[int, ...]
    directions: tuple[int, ...]
    rank_ic: float = 0.0
    ir: float = 0.0
    observations: int = 0
    dates: int = 0


#: Fewest rows of a date that count, and least deviation that an information ratio may divide by.
LEAST_ROWS, NO_DEVIATION = 3, 1e-12


def measured(panel: DataFrame, target: str, tried: Sequence[Combination]) -> list[Combination]:
    """``tried`` with their daily rank correlations with ``target``, all in one job: mean, ratio to the population deviation, rows, dates."""
    columns = sorted({f for c in tried for f in c.factors})
    plans = [([columns.index(f) for f in c.factors], np.array(c.weights) * np.array(c.directions)) for c in tried]

    def kernel(x: np.ndarray) -> Iterable[tuple]:
        known = ~np.isnan(x)
        ranked: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, int]] = {}
        for no, (own, weights) in enumerate(plans):
            key = tuple(own)
            if key not in ranked:
                rows = known[:, [*own, len(columns)]].all(axis=1)
                n = int(rows.sum())
                ranks = np.column_stack([average_ranks(x[rows, i]) for i in own]) if n >= LEAST_ROWS else np.empty((n, len(own)))
                ranked[key] = (ranks, average_ranks(x[rows, len(columns)]), n)
            ranks, y, n = ranked[key]
            if n >= LEAST_ROWS:
                yield no, correlation(average_ranks(ranks @ weights), y), n

    daily = _by_date(panel, [*columns, target], kernel, "no int, ic double, n long").where("ic is not null")
    by = daily.groupBy("no").agg(F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("sd"), F.sum("n").alias("n"), F.count("*").alias("dates"))
    return [replace(tried[r["no"]], rank_ic=r["ic"], ir=r["ic"] / r["sd"] if r["sd"] > NO_DEVIATION else 0.0, observations=r["n"], dates=r["dates"]) for r in by.collect()]


def ordered(found: Iterable[Combination]) -> list[Combination]:
    """Best first; what is equal to eight places goes by names and weights."""
    return sorted(found, key=lambda c: (-round(c.rank_ic, 8), -round(c.ir, 8), c.factors, c.weights))


def beam_search(panel: DataFrame, factors: Sequence[str], target: str, most: int = 3, width: int = 16, trials: int = 256) -> list[Combination]:
    """The best combinations of up to ``most`` factors, equal weights or one factor doubled, best first.

    A factor's direction is the sign of its own correlation. Each level extends the ``width``
    best of the one before by every factor and is measured in one job; levels stop when
    ``trials`` are used up. Give it the rows to train on only. Factors without a measure on
    any date are left out; no rows give no combinations.
    """
    if not factors:
        return []
    left = trials
    singles = [Combination((f,), (1,), (1,)) for f in sorted(set(factors))][:left]
    left -= len(singles)
    found = [replace(c, directions=(1 if c.rank_ic >= 0 else -1,), rank_ic=abs(c.rank_ic), ir=abs(c.ir)) for c in measured(panel, target, singles)]
    way = {c.factors[0]: c.directions[0] for c in found}
    beam = kept = ordered(found)[:width]
    for size in range(2, most + 1):
        sets = sorted({tuple(sorted({*c.factors, f})) for c in beam for f in way if f not in c.factors})
        patterns = [(1,) * size, *[tuple(2 if i == j else 1 for i in range(size)) for j in range(size)]]
        tried = [Combination(s, w, tuple(way[f] for f in s)) for s in sets for w in patterns][: max(left, 0)]
        if not tried:
            break
        left -= len(tried)
        beam = ordered(measured(panel, target, tried))[:width]
        kept = kept + beam
    return ordered(kept)
