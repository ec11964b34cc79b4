"""Formulas as text, turned into columns of a panel.

Python's own grammar reads the text; only arithmetic, comparisons, ``and``/``or`` and the
functions below pass, so no text becomes code. Windows can't be nested in Spark, so what a
window function takes that holds a window itself becomes a column of an earlier step; equal
parts of several formulas are computed once.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import Cross, Series, Shared, clamp, log, safe_div, sqrt

#: Limits of a formula: depth of its tree, number of its parts, length of a window. Fixed values.
DEPTH, PARTS, WINDOW = 12, 200, 512
ROW = "__row"
S, X = Series(), Cross()


@dataclass(frozen=True)
class Problem:
    """Why a formula is refused; the codes are fixed values.

    E001 unknown name, E002 unknown function, E003 wrong arguments, E004 window out of bounds, E005 looks
    ahead, E006 too deep, E007 too long, E008 divides by 0, E009 cross-section inside a window,
    E010 exponent out of bounds, E011 winsorize out of bounds, E014 not a formula, E016 constant.
    """

    code: str
    text: str


class Refused(Exception):
    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.problem = Problem(code, text)


@dataclass(frozen=True)
class Part:
    """A column, the number of window steps under it, and whether it is a truth value, has a cross-section, is a constant."""

    column: Column
    steps: int = 0
    truth: bool = False
    cross: bool = False
    constant: float | None = None

    @property
    def number(self) -> Column:
        return self.column.cast("double") if self.truth else self.column


def _time(f) -> tuple:
    return "time", 1, f


def _pair(f) -> tuple:
    return "time", 2, f


#: Functions along a symbol: number of columns they take before the window, and the column they make.
ALONG = {
    "ts_mean": _time(lambda s, x, n: s.mean(x, n)), "ts_std": _time(lambda s, x, n: s.std(x, n)), "ts_std0": _time(lambda s, x, n: s.std0(x, n)), "ts_sum": _time(lambda s, x, n: s.sum(x, n)),
    "ts_max": _time(lambda s, x, n: s.max(x, n)), "ts_min": _time(lambda s, x, n: s.min(x, n)), "ts_delay": _time(lambda s, x, n: s.delay(x, n)), "ts_delta": _time(lambda s, x, n: s.delta(x, n)),
    "ts_rank": _time(lambda s, x, n: s.rank(x, n)), "ts_pctrank": _time(lambda s, x, n: s.pctrank(x, n)), "ts_zscore": _time(lambda s, x, n: s.zscore(x, n)),
    "ts_corr": _pair(lambda s, x, y, n: s.corr(x, y, n)), "ts_cov": _pair(lambda s, x, y, n: s.cov(x, y, n)), "ts_quantile": _time(lambda s, x, n, q: s.quantile(x, n, q)), "ts_qlinear": _time(lambda s, x, n, q: s.qlinear(x, n, q)),
    "ts_slope": _time(lambda s, x, n: s.slope(x, ROW, n)), "ts_rsquare": _time(lambda s, x, n: s.rsquare(x, ROW, n)), "ts_resi": _time(lambda s, x, n: s.resi(x, ROW, n)),
    "ts_argmax": _time(lambda s, x, n: s.argmax(x, n)), "ts_argmin": _time(lambda s, x, n: s.argmin(x, n)), "decay_linear": _time(lambda s, x, n: s.decay_linear(x, ROW, n)),
}
#: Functions over a date, and functions of one row: least and most arguments, the column they make.
ACROSS = {"rank": (1, 1, X.rank), "zscore": (1, 1, X.zscore), "winsorize": (1, 2, X.winsorize)}
BY_ROW = {"log": log, "sqrt": sqrt, "abs": F.abs, "sign": F.signum}
COMPARE = {ast.Gt: "gt", ast.GtE: "ge", ast.Lt: "lt", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "ne"}


@dataclass
class Compiler:
    """Formulas over the columns ``names``; ``steps[i]`` holds the columns to add in step i."""

    names: frozenset[str]
    steps: dict[int, dict[str, Column]] = field(default_factory=dict)
    known: dict[str, str] = field(default_factory=dict)
    windows: dict[str, str] = field(default_factory=dict)

    def compile(self, text: str) -> Part:
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except (SyntaxError, ValueError) as e:
            raise Refused("E014", f"not a formula: {e}") from None
        parts = [x for x in ast.walk(tree) if isinstance(x, ast.expr)]
        if len(parts) > PARTS:
            raise Refused("E007", f"{len(parts)} parts")
        if (deep := _depth(tree)) > DEPTH:
            raise Refused("E006", f"depth {deep}")
        made = self.part(tree)
        called = {id(x.func) for x in parts if isinstance(x, ast.Call)}
        if not any(isinstance(x, ast.Name) and id(x) not in called for x in parts):
            raise Refused("E016", "no column")
        return made

    def part(self, node: ast.expr) -> Part:
        match node:
            case ast.Constant(value=bool() | str() | bytes() | complex() | None):
                raise Refused("E014", f"not a number: {node.value!r}")
            case ast.Constant(value=v):
                return Part(F.lit(float(v)), constant=float(v))
            case ast.Name(id=name):
                if name not in self.names:
                    raise Refused("E001", name)
                return Part(F.col(name))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                p = self.part(x)
                return self._join(-p.number, p, constant=None if p.constant is None else -p.constant)
            case ast.BinOp(left=x, op=op, right=y):
                return self._arithmetic(self.part(x), op, self.part(y))
            case ast.Compare(left=x, ops=[op], comparators=[y]) if type(op) in COMPARE:
                a, b = self.part(x), self.part(y)
                u, v = a.number, b.number
                made = {"gt": u > v, "ge": u >= v, "lt": u < v, "le": u <= v, "eq": u == v, "ne": u != v}
                return self._join(made[COMPARE[type(op)]], a, b, truth=True)
            case ast.BoolOp(op=op, values=values):
                parts = [self.part(x) for x in values]
                if not all(p.truth for p in parts):
                    raise Refused("E003", "and, or take conditions")
                out = parts[0].column
                for p in parts[1:]:
                    out = out & p.column if isinstance(op, ast.And) else out | p.column
                return self._join(out, *parts, truth=True)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self._call(name, args)
        raise Refused("E014", f"not allowed: {ast.unparse(node)}")

    def _arithmetic(self, a: Part, op: ast.operator, b: Part) -> Part:
        x, y = a.number, b.number
        match op:
            case ast.Add():
                out = x + y
            case ast.Sub():
                out = x - y
            case ast.Mult():
                out = x * y
            case ast.Div():
                if b.constant == 0:
                    raise Refused("E008", "divides by 0")
                out = x / y if b.constant is not None else safe_div(x, y)
            case _:
                raise Refused("E014", f"not allowed: {type(op).__name__}")
        return self._join(out, a, b)

    @staticmethod
    def _join(column: Column, *parts: Part, truth: bool = False, constant: float | None = None) -> Part:
        return Part(column, max(p.steps for p in parts), truth, any(p.cross for p in parts), constant)

    def _plain(self, node: ast.expr) -> Part:
        """The argument of a window function: without a window in it, or else a column of the step before."""
        p = self.part(node)
        if not p.steps:
            return Part(p.number, 0, cross=p.cross)
        key = ast.dump(node)
        if key not in self.known:
            self.known[key] = f"__f{len(self.known)}"
            self.steps.setdefault(p.steps, {})[self.known[key]] = p.number
        return Part(F.col(self.known[key]), p.steps, cross=p.cross)

    def _numbers(self, name: str, args: Iterable[ast.expr]) -> list[float]:
        out = []
        for x in args:
            p = self.part(x) if not isinstance(x, ast.Name) else None
            if p is None or p.constant is None:
                raise Refused("E003", f"{name} takes numbers after its columns")
            out.append(p.constant)
        return out

    def _call(self, name: str, args: list[ast.expr]) -> Part:
        if name in ALONG:
            _, columns, make = ALONG[name]
            extra = name in ("ts_quantile", "ts_qlinear")
            if len(args) != columns + 1 + extra:
                raise Refused("E003", f"{name} takes {columns + 1 + extra} arguments")
            n, *q = self._numbers(name, args[columns:])
            if n < 0:
                raise Refused("E005", f"{name} looks ahead")
            if n != int(n) or not (0 if name == "ts_delta" else 1) <= n <= WINDOW:
                raise Refused("E004", f"{name} over {n:g}")
            if q and not 0 < q[0] < 1:
                raise Refused("E004", f"quantile {q[0]:g}")
            taken = [self._plain(x) for x in args[:columns]]
            if any(p.cross for p in taken):
                raise Refused("E009", f"{name} over a cross-section")
            if name in ("ts_slope", "ts_rsquare", "ts_resi", "decay_linear"):
                self.steps.setdefault(0, {})[ROW] = S.row()
            steps = max(p.steps for p in taken) + 1
            # windows are computed once, in a step of their own, for all that look at them
            shared = Shared(windows=self.steps.setdefault(steps, {}), names=self.windows)
            return Part(make(shared, *[p.column for p in taken], int(n), *q), steps + 1)
        if name in ACROSS:
            least, most, make = ACROSS[name]
            if not least <= len(args) <= most:
                raise Refused("E003", f"{name} takes {least} to {most} arguments")
            k = self._numbers(name, args[1:])
            if k and not 1 <= k[0] <= 6:
                raise Refused("E011", f"winsorize by {k[0]:g}")
            p = self._plain(args[0])
            return Part(make(p.column, *k), p.steps + 1, cross=True)
        if name in BY_ROW:
            if len(args) != 1:
                raise Refused("E003", f"{name} takes one argument")
            p = self.part(args[0])
            return self._join(BY_ROW[name](p.number), p)
        if name == "power":
            if len(args) != 2:
                raise Refused("E003", "power takes two arguments")
            (c,) = self._numbers(name, args[1:])
            if abs(c) > 4:
                raise Refused("E010", f"exponent {c:g}")
            p = self.part(args[0])
            return self._join(F.pow(p.number, F.lit(c)), p)
        if name == "clamp":
            if len(args) != 3:
                raise Refused("E003", "clamp takes three arguments")
            lo, hi = self._numbers(name, args[1:])
            if lo > hi:
                raise Refused("E003", "clamp takes the lower bound first")
            p = self.part(args[0])
            return self._join(clamp(p.number, lo, hi), p)
        if name == "if_else":
            if len(args) != 3:
                raise Refused("E003", "if_else takes three arguments")
            c, a, b = map(self.part, args)
            if not c.truth:
                raise Refused("E003", "if_else takes a condition first")
            return self._join(F.when(c.column, a.number).otherwise(b.number), c, a, b)
        if name in ("min", "max"):
            if len(args) != 2:
                raise Refused("E003", f"{name} takes two arguments")
            a, b = map(self.part, args)
            return self._join((F.least if name == "min" else F.greatest)(a.number, b.number), a, b)
        raise Refused("E002", name)


def _depth(node: ast.AST) -> int:
    below = [_depth(x) for x in ast.iter_child_nodes(node)]
    return isinstance(node, ast.expr) + max(below, default=0)


def check(text: str, columns: Iterable[str]) -> Problem | None:
    """What is wrong with a formula; None if it can be computed. Needs a session, as columns do."""
    try:
        Compiler(frozenset(columns)).compile(text)
    except Refused as e:
        return e.problem
    return None


def with_formulas(panel: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """``panel`` with a column for each formula, by name. Raises Refused for one that can't be computed.

    All windows of a step share one sort by symbol and date; a window yields null until it
    holds as many values as it is long. Division by 0 is null.
    """
    compiler = Compiler(frozenset(panel.columns))
    made = {name: compiler.compile(text).number for name, text in formulas.items()}
    out = panel
    for step in sorted(compiler.steps):
        out = out.withColumns(compiler.steps[step])
    helpers = [c for step in compiler.steps.values() for c in step]
    return out.withColumns(made).drop(*helpers)
