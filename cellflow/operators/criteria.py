"""Criteria such as ``">=25"`` or ``"A*"`` as boolean columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import col, text
from cellflow.functions.text import wildcard


def criterion(x: Column, wanted) -> Column:
    """Whether a cell meets a criterion; never null.

    A string may begin with an operator.  Numbers are compared as numbers;
    texts without regard to case, with ``*``, ``?`` and ``~`` for equality.
    ``"="`` is met by blanks, ``"<>"`` by all others.
    """
    if not isinstance(wanted, str):
        return F.coalesce(x == col(wanted), F.lit(False))
    sign, value = re.fullmatch(r"(<=|>=|<>|=|<|>)?(.*)", wanted, re.S).groups()
    sign = sign or "="
    try:
        number = float(value)
    except ValueError:
        number = None
    if value == "":
        blank = x.isNull() | (text(x) == "")
        return blank if sign == "=" else F.coalesce(~blank, F.lit(False)) if sign == "<>" else F.lit(False)
    if number is not None:
        n = x.try_cast("double")
        met = {"=": n == number, "<>": F.coalesce(n != number, F.lit(True)), "<": n < number, "<=": n <= number, ">": n > number, ">=": n >= number}[sign]
    elif sign in ("=", "<>"):
        low = F.lower(text(x))
        same = low.rlike(f"(?s)^{wildcard(value.lower())}$") if re.search(r"[*?~]", value) else low == value.lower()
        met = same if sign == "=" else ~same
    else:
        low = F.lower(x.cast("string"))
        met = {"<": low < value.lower(), "<=": low <= value.lower(), ">": low > value.lower(), ">=": low >= value.lower()}[sign]
    return F.coalesce(met, F.lit(False))


def every(*pairs) -> Column:
    """All of ``column, criterion, column, criterion, ...``."""
    out = F.lit(True)
    for x, wanted in zip(pairs[::2], pairs[1::2], strict=True):
        out = out & criterion(x, wanted)
    return out


def any_row(db, rows: list[dict[str, object]]) -> Column:
    """A criteria range: each row is met if all its cells are, headers matched without regard to case."""
    names = {c.lower(): c for c in db.columns}
    out = F.lit(False)
    for row in rows:
        met = F.lit(True)
        for header, wanted in row.items():
            met = met & criterion(db[names[header.lower()]], wanted)
        out = out | met
    return out
