"""Scalar expressions that Spark and ANSI SQL engines read alike.

An `Ex` is the text of a scalar SQL expression, in the common subset of Spark SQL
and DuckDB wherever there is one (doubles are written as casts, so neither
engine reads decimals).
`Ex.col` makes a Spark Column of it, which Catalyst optimises like any other, and
the text itself serves as the mirror in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ex:
    """A scalar expression; `spark` differs from `sql` only where the two dialects do."""

    __slots__ = ("spark", "sql")

    def __init__(self, sql: str, spark: str | None = None):
        self.sql, self.spark = sql, spark or sql

    @property
    def col(self) -> Column:
        return F.expr(self.spark)

    def __add__(self, o):
        return joined("({} + {})", self, o)

    def __radd__(self, o):
        return ex(o) + self

    def __sub__(self, o):
        return joined("({} - {})", self, o)

    def __rsub__(self, o):
        return ex(o) - self

    def __mul__(self, o):
        return joined("({} * {})", self, o)

    def __rmul__(self, o):
        return ex(o) * self

    def __truediv__(self, o):
        return joined("({} / {})", self, o)

    def __rtruediv__(self, o):
        return ex(o) / self

    def __neg__(self):
        return joined("(- {})", self)

    def __pow__(self, o):
        return joined("pow({}, {})", self, o)

    def __lt__(self, o):
        return joined("({} < {})", self, o)

    def __le__(self, o):
        return joined("({} <= {})", self, o)

    def __gt__(self, o):
        return joined("({} > {})", self, o)

    def __ge__(self, o):
        return joined("({} >= {})", self, o)

    def eq(self, o):
        return joined("({} = {})", self, o)

    def __and__(self, o):
        return joined("({} AND {})", self, o)

    def __or__(self, o):
        return joined("({} OR {})", self, o)

    def cast(self, kind: str):
        return joined(f"CAST({{}} AS {kind})", self)


def ex(value) -> Ex:
    """`value` as an expression: an Ex, a number, or the name of a column."""
    if isinstance(value, Ex):
        return value
    if isinstance(value, str):
        return Ex(value)
    if isinstance(value, bool):
        return Ex("TRUE" if value else "FALSE")
    if isinstance(value, int):
        return Ex(f"CAST({value} AS DOUBLE)")
    return Ex(f"CAST({float(value)!r} AS DOUBLE)")


def joined(template: str, *parts) -> Ex:
    """`template` filled with the parts' texts, in each dialect."""
    parts = [ex(p) for p in parts]
    return Ex(template.format(*[p.sql for p in parts]), template.format(*[p.spark for p in parts]))


def _call(name: str):
    def call(*args) -> Ex:
        return joined(f"{name}({', '.join(['{}'] * len(args))})", *args)

    call.__name__ = name
    return call


absolute, sqrt, exp, ln, log10, log2 = map(_call, ("abs", "sqrt", "exp", "ln", "log10", "log2"))
sin, cos, atan2, acos, greatest, least = map(_call, ("sin", "cos", "atan2", "acos", "greatest", "least"))
power = _call("pow")


def floor(x) -> Ex:
    return joined("CAST(floor({}) AS DOUBLE)", x)


def integer(x) -> Ex:
    """The floor of `x` as an integer."""
    return joined("CAST(floor({}) AS INT)", x)


def rounded(x, digits: int = 6) -> Ex:
    """`x` rounded half away from zero; negative zero becomes zero."""
    return joined(f"(round({{}}, {digits}) + CAST(0.0 AS DOUBLE))", x)


def when(*pairs) -> Ex:
    """CASE: (condition, value) pairs and a last default."""
    *cases, default = pairs
    flat = [e for pair in cases for e in pair]
    return joined(f"CASE {' '.join(['WHEN {} THEN {}'] * len(cases))} ELSE {{}} END", *flat, default)


def numbers(values) -> Ex:
    """A constant array of doubles."""
    items = [ex(float(v)).sql for v in values]
    return Ex(f"[{', '.join(items)}]", f"array({', '.join(items)})")


def at(array, index) -> Ex:
    """The element of an array at a place counted from 0."""
    a, i = ex(array), ex(index)
    return Ex(f"{a.sql}[({i.sql}) + 1]", f"get({a.spark}, {i.spark})")


def clamp(x, low=0.0, high=1.0) -> Ex:
    return greatest(low, least(high, x))


def lerp(a, b, t) -> Ex:
    a, b = ex(a), ex(b)
    return a + (b - a) * t


def dot(row, values) -> Ex:
    """The sum of products of numbers and expressions."""
    out = None
    for w, v in zip(row, values, strict=True):
        term = ex(v) * float(w)
        out = term if out is None else out + term
    return out


def luma(r, g, b) -> Ex:
    """Rec.709 luma."""
    return dot(LUMA, (r, g, b))


#: Rec.709 luma weights. Fixed values.
LUMA = (0.2126, 0.7152, 0.0722)


class Op:
    """A per-pixel operation: intermediate columns, step by step, then outputs."""

    def __init__(self, out: dict[str, object], *steps: dict[str, object]):
        self.out, self.steps = {k: ex(v) for k, v in out.items()}, [{k: ex(v) for k, v in s.items()} for s in steps]

    def frame(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """`df` after the operation: `keys` as they are, then the outputs."""
        for step in self.steps:
            df = df.withColumns({k: v.col for k, v in step.items()})
        return df.select(*keys, *[v.col.alias(k) for k, v in self.out.items()])

    def sql(self, source: str, keys: list[str]) -> str:
        """The same as a query over `source` (a table's name or a subquery)."""
        source = f"({source})" if source.lstrip().upper().startswith(("SELECT", "WITH")) else source
        known = {"r", "g", "b", "a"}
        for i, step in enumerate(self.steps):
            again = ", ".join(f"{v.sql} AS {k}" for k, v in step.items() if k in known)
            new = "".join(f", {v.sql} AS {k}" for k, v in step.items() if k not in known)
            source = f"(SELECT *{f' REPLACE ({again})' if again else ''}{new} FROM {source} AS s{i})"
            known |= set(step)
        outs = [*keys, *(f"{v.sql} AS {k}" for k, v in self.out.items())]
        return f"SELECT {', '.join(outs)} FROM {source} AS src"
