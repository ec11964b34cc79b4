"""Guarded rolling, cross-sectional and run-length functions over a panel.

A rolling value is null until its window holds n values that are not null. Functions return
columns; one that builds on another window needs it as a column of an earlier step, since
Spark nests no windows. All frames of one (key, order) share a single sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b)


def unbounded_div(a: str | Column, b: str | Column) -> Column:
    """a / b of doubles, infinite where b is 0, and NaN where both are; null for null alone."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b).when(b == 0, a * float("inf"))


@dataclass(frozen=True)
class Series:
    """Functions that look back along each key."""

    key: str = "symbol"
    order: str = "date"

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.order)

    def frame(self, n: int, end: int = 0) -> WindowSpec:
        return self.spec.rowsBetween(end - n + 1, end)

    def over(self, value: Column, spec: WindowSpec) -> Column:
        """Every window of the functions below."""
        return value.over(spec)

    def guarded(self, x: Column, n: int, value: Column, end: int = 0) -> Column:
        return F.when(self.over(F.count(x), self.frame(n, end)) == n, value)

    def mean(self, x, n: int, end: int = 0) -> Column:
        return self.guarded(_col(x), n, self.over(F.avg(_col(x)), self.frame(n, end)), end)

    def std(self, x, n: int, end: int = 0) -> Column:
        return self.guarded(_col(x), n, self.over(F.stddev_samp(_col(x)), self.frame(n, end)), end)

    def std0(self, x, n: int) -> Column:
        return self.guarded(_col(x), n, self.over(F.stddev_pop(_col(x)), self.frame(n)))

    def sum(self, x, n: int) -> Column:
        return self.guarded(_col(x), n, self.over(F.sum(_col(x)), self.frame(n)))

    def max(self, x, n: int, end: int = 0) -> Column:
        return self.guarded(_col(x), n, self.over(F.max(_col(x)), self.frame(n, end)), end)

    def min(self, x, n: int, end: int = 0) -> Column:
        return self.guarded(_col(x), n, self.over(F.min(_col(x)), self.frame(n, end)), end)

    def skew(self, x, n: int) -> Column:
        return self.guarded(_col(x), n, self.over(F.skewness(_col(x)), self.frame(n)))

    def delay(self, x, n: int = 1) -> Column:
        return self.over(F.lag(_col(x), n), self.spec)

    def delta(self, x, n: int) -> Column:
        return _col(x) - self.delay(x, n)

    def change(self, x, n: int = 1) -> Column:
        return safe_div(x, self.delay(x, n)) - 1

    def zscore(self, x, n: int) -> Column:
        return safe_div(_col(x) - self.mean(x, n), self.std(x, n))

    def cov(self, x, y, n: int) -> Column:
        both = F.when(_col(x).isNotNull() & _col(y).isNotNull(), 1)
        return self.guarded(both, n, self.over(F.covar_samp(_col(x), _col(y)), self.frame(n)))

    def corr(self, x, y, n: int) -> Column:
        """Pearson correlation; null where either side is constant (corr() itself raises there)."""
        return safe_div(self.cov(x, y, n), self.std(x, n) * self.std(y, n))

    def values(self, x, n: int) -> Column:
        """The window's values, oldest first; null until there are n."""
        return self.guarded(_col(x), n, self.over(F.collect_list(_col(x)), self.frame(n)))

    # What follows takes the window's values from ``v``, a column of ``values`` of an earlier step, so that several share them.

    def rank(self, x, n: int, v: Column | None = None) -> Column:
        """Rank of the last value in its window, ties averaged."""
        v, last = self.values(x, n) if v is None else v, _col(x)
        return F.size(F.filter(v, lambda y: y < last)) + (F.size(F.filter(v, lambda y: y == last)) + 1) / 2

    def pctrank(self, x, n: int, v: Column | None = None) -> Column:
        v, last = self.values(x, n) if v is None else v, _col(x)
        return (F.size(F.filter(v, lambda y: y < last)) + F.size(F.filter(v, lambda y: y <= last)) + 1) / (2 * n)

    def quantile(self, x, n: int, q: float, v: Column | None = None) -> Column:
        """Nearest value to the q quantile."""
        return F.get(F.sort_array(self.values(x, n) if v is None else v), F.lit(int((n - 1) * q + 0.5)))

    def qlinear(self, x, n: int, q: float, v: Column | None = None) -> Column:
        """The q quantile, between neighbours by their distance."""
        v = F.sort_array(self.values(x, n) if v is None else v)
        at = (n - 1) * q
        low = int(at)
        if low == at:
            return F.get(v, F.lit(low)).cast("double")
        return (low + 1 - at) * F.get(v, F.lit(low)) + (at - low) * F.get(v, F.lit(low + 1))

    def argmax(self, x, n: int, v: Column | None = None) -> Column:
        """Position of the largest value, 1 the oldest, the first of ties."""
        v = self.values(x, n) if v is None else v
        return F.array_position(v, F.array_max(v))

    def argmin(self, x, n: int, v: Column | None = None) -> Column:
        v = self.values(x, n) if v is None else v
        return F.array_position(v, F.array_min(v))

    def slope(self, x, at: str, n: int) -> Column:
        """Least-squares slope on the row number ``at``, whose variance over n rows is known."""
        return self.guarded(_col(x), n, self.over(F.covar_pop(_col(x), F.col(at)), self.frame(n)) / F.lit((n * n - 1) / 12)) if n > 1 else F.lit(None).cast("double")

    def rsquare(self, x, at: str, n: int) -> Column:
        std0 = self.std0(x, n)
        return F.when(std0 > 0, F.pow(self.slope(x, at, n) * ((n * n - 1) / 12) ** 0.5 / std0, F.lit(2.0)))

    def resi(self, x, at: str, n: int) -> Column:
        """Residual of the line at the last row, half a window after its mean."""
        return _col(x) - (self.mean(x, n) + self.slope(x, at, n) * ((n - 1) / 2))

    def decay_linear(self, x, at: str, n: int) -> Column:
        """Mean with weights n for the newest to 1 for the oldest."""
        weighted = self.over(F.sum(_col(x) * F.col(at)), self.frame(n)) - (F.col(at) - n) * self.over(F.sum(_col(x)), self.frame(n))
        return self.guarded(_col(x), n, weighted / (n * (n + 1) / 2))

    def row(self) -> Column:
        return F.row_number().over(self.spec)

    def crossed_up(self, a, b) -> Column:
        """a above b now and not before; null while any of the four is."""
        a, b = _col(a), _col(b)
        return (a > b) & (F.lag(a).over(self.spec) <= F.lag(b).over(self.spec))

    def crossed_down(self, a, b) -> Column:
        a, b = _col(a), _col(b)
        return (a < b) & (F.lag(a).over(self.spec) >= F.lag(b).over(self.spec))

    def rising_edge(self, x) -> Column:
        """True where x turns true; the first row never fires."""
        x = F.coalesce(_col(x), F.lit(False))
        return x & ~F.coalesce(F.lag(x).over(self.spec), F.lit(True))

    def fill(self, x) -> Column:
        return F.last(_col(x), ignorenulls=True).over(self.spec.rowsBetween(Window.unboundedPreceding, 0))

    def streak(self, x: str, row: str) -> Column:
        """Length of the run of true that ends here; row: column of ``row``. The last row that is not true tells it, in the sort of all other frames."""
        off = F.when(~F.coalesce(_col(x), F.lit(False)), _col(row))
        return F.when(_col(x), (_col(row) - F.coalesce(F.max(off).over(self.spec.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).cast("long")).otherwise(0)


@dataclass(frozen=True)
class Shared(Series):
    """Series whose windows become columns of a step of their own, each of them once: Spark computes equal windows of one select as often as they are written."""

    windows: dict[str, Column] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def over(self, value: Column, spec: WindowSpec) -> Column:
        window = value.over(spec)
        name = self.names.setdefault(str(window), f"__w{len(self.names)}")
        self.windows.setdefault(name, window)
        return F.col(name)


@dataclass(frozen=True)
class Cross:
    """Functions over all keys of one date."""

    by: str | tuple[str, ...] = "date"

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*([self.by] if isinstance(self.by, str) else self.by))

    def average_rank(self, x) -> Column:
        """Rank from 1 with ties averaged; null for null."""
        x = _col(x)
        return F.when(x.isNotNull(), (F.rank().over(self.ordered(x)) + F.count(x).over(self.ordered(x).rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2)

    def rank(self, x) -> Column:
        """Average rank over the number of values."""
        return self.average_rank(x) / self.total(x)

    def ordered(self, x) -> WindowSpec:
        """By the values, null last. What a rank needs comes from one sort in this order: the values up to a row and its ties end where the ties do."""
        return self.spec.orderBy(_col(x).asc_nulls_last())

    def total(self, x) -> Column:
        """Number of values, from the sort that ranks them."""
        return F.count(_col(x)).over(self.ordered(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def zscore(self, x) -> Column:
        x = _col(x)
        return safe_div(x - F.avg(x).over(self.spec), F.stddev_samp(x).over(self.spec))

    def winsorize(self, x, k: float = 3.0) -> Column:
        x = _col(x)
        m, s = F.avg(x).over(self.spec), F.stddev_samp(x).over(self.spec)
        return clamp(x, m - k * s, m + k * s)

    def minmax(self, x) -> Column:
        """0 to 1 within the date, 0.5 where all are equal."""
        x = _col(x)
        lo, hi = F.min(x).over(self.spec), F.max(x).over(self.spec)
        return F.when(hi > lo, (x - lo) / (hi - lo)).when(x.isNotNull(), 0.5)


def clamp(x, lo, hi) -> Column:
    x = _col(x)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_col(lo)), as_col(hi)))


def log(x) -> Column:
    return F.when(_col(x) > 0, F.ln(_col(x)))


def sqrt(x) -> Column:
    return F.when(_col(x) >= 0, F.sqrt(_col(x)))
