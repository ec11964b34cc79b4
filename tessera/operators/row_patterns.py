"""Row patterns: conditions on neighbouring rows of a key, and on rows captured earlier.

A pattern names its rows by letters, oldest first; ``c.close > a.high`` compares the third
row with the first. A pattern may stay open after its last row, until a later row confirms it
against what was captured or its time is up.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import Series

FIELD = re.compile(r"\b([a-h])\.(\w+)")


@dataclass(frozen=True)
class RowPattern:
    """Conditions on ``rows`` rows in a row; the first that holds gives its value."""

    rows: int
    values: tuple[tuple[int, str], ...]

    def fields(self) -> set[tuple[str, int]]:
        """(column, rows before the last) that the conditions read."""
        return {(m[2], self.back(m[1])) for _, text in self.values for m in FIELD.finditer(text)}

    def back(self, letter: str) -> int:
        n = self.rows - 1 - (ord(letter) - ord("a"))
        if n < 0:
            raise ValueError(f"row {letter} is beyond the {self.rows} of the pattern")
        return n

    def sql(self) -> str:
        """The value as SQL on columns ``field``, and ``__row_1.field`` (a row before), ...; 0 where no condition is known to hold."""
        plain = lambda text: FIELD.sub(lambda m: m[2] if not self.back(m[1]) else f"__row_{self.back(m[1])}.{m[2]}", text)
        return f"case {' '.join(f'when {plain(text)} then {value}' for value, text in self.values)} else 0 end"


def pattern(rows: int, rising: str | None = None, falling: str | None = None, value: int = 100) -> RowPattern:
    """A rising condition gives ``value``, a falling one ``-value``."""
    return RowPattern(rows, tuple((v, " ".join(text.split())) for v, text in ((value, rising), (-value, falling)) if text))


def matched(df: DataFrame, patterns: Mapping[str, RowPattern], series: Series | None = None) -> DataFrame:
    """``df`` with a column per pattern. All look back in one window, to whole rows: these are wide where patterns are many, so that Spark makes many methods of the conditions, not one too long to be compiled."""
    series = series or Series()
    before = [(c, n) for p in patterns.values() for c, n in p.fields() if n]
    row = sorted({c for c, _ in before})
    with_rows = df.withColumns({f"__row_{n}": series.delay(F.struct(*row), n) for n in sorted({n for _, n in before})}) if before else df
    return with_rows.select(*df.columns, *[F.expr(p.sql()).alias(name) for name, p in patterns.items()])


def confirmed(df: DataFrame, starts: Mapping[str, int], captured: Mapping[str, str], rising: str, falling: str, value: int = 200, series: Series | None = None) -> DataFrame:
    """``df`` with each of ``starts`` (positive, negative or 0) also set to ``value`` or ``-value`` where a later row confirms it.

    A start stays open for as many rows as ``starts`` tells, with the expressions of ``captured`` as they
    were on its row. The first row on which ``rising`` (after a positive start) or ``falling`` holds
    confirms and closes it; another start takes its place. Conditions may read captured names
    and the row's own columns. All starts share the windows.
    """
    series = series or Series()
    opens, shown, holds, made = {}, {}, {}, {}
    for i, (start, within) in enumerate(starts.items()):
        sign, last, no, held = f"__last_{i}.__sign", f"__last_{i}", f"__no_{i}", f"__holds_{i}"
        opens[f"__open_{i}"] = F.when(F.col(start) != 0, F.struct(F.col(start).alias("__sign"), *[F.expr(e).alias(k) for k, e in captured.items()]))
        shown[no] = F.count(f"__open_{i}").over(series.spec.rowsBetween(Window.unboundedPreceding, 0))
        shown[last] = F.last(f"__open_{i}", ignorenulls=True).over(series.frame(within, end=-1))
        up, down = (re.sub(rf"\b({'|'.join(captured)})\b", rf"{last}.\1", text) for text in (rising, falling))
        holds[held] = F.coalesce(F.expr(f"{start} = 0 and (({sign} > 0 and {up}) or ({sign} < 0 and {down}))"), F.lit(False))
        same = [series.delay(held, n) & (series.delay(no, n) == F.col(no)) for n in range(1, within)]
        before = F.greatest(*[F.coalesce(x, F.lit(False)) for x in (*same, F.lit(False), F.lit(False))])
        made[start] = F.when(F.col(held) & ~before, F.when(F.col(sign) > 0, value).otherwise(-value)).otherwise(F.col(start))
    return df.withColumns(opens).withColumns(shown).withColumns(holds).withColumns(made).select(*df.columns)
