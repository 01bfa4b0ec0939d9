"""How worksheet values map to columns: coercions, error values as null, and the table of functions.

Columns are typed.  An error value is null; where its kind matters, the
functions that test for errors take the null.  Arguments may be columns or
Python values; a string is a text value, never a column name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def fn(*names: str):
    """Register a function under its worksheet names."""

    def keep(f):
        for name in names:
            FUNCTIONS[name] = f
        return f

    return keep


def call(name: str, *args) -> Column:
    """A worksheet function by its name, in any case."""
    found = FUNCTIONS.get(name.upper())
    if found is None:
        raise ValueError(f"#NAME? {name}")
    return found(*args)


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def dbl(x) -> Column:
    """A number; what can't be read as one is null."""
    return F.lit(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else col(x).try_cast("double")


def whole(x) -> Column:
    """A number cut to an integer."""
    return F.lit(int(x)).cast("long") if isinstance(x, (int, float)) else col(x).try_cast("double").try_cast("long")


def text(x) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def finite(x: Column) -> Column:
    """Null for what is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def only(condition: Column, value) -> Column:
    """The value where the condition holds, else an error (null)."""
    return F.when(condition, col(value))


def num(x) -> Column:
    """A number read from text as a worksheet reads it: blanks, thousands commas and a percent sign allowed."""
    bare = F.trim(F.regexp_replace(col(x).cast("string"), ",", ""))
    plain = bare.try_cast("double")
    return F.when(bare.endswith("%"), F.regexp_replace(bare, "%$", "").try_cast("double") / 100).otherwise(F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain))


def fold(values: Column, start, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, col(start), step)


def numbers(first, last) -> Column:
    """The integers from first to last; none if last is smaller."""
    a, b = whole(first), whole(last)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
