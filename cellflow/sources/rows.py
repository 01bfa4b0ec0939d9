"""Rows mapped to typed columns: by position, header or alias, with converters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.functions.core import num
from cellflow.functions.datetime import from_serial, serial


@dataclass(frozen=True)
class Field:
    """A column wanted: where it stands and what it becomes.

    An index counts before an order, an order before the place in the list.
    ``pattern`` is a date pattern; ``convert`` replaces the built-in converter.
    """

    name: str
    kind: str = "string"
    headers: tuple[str, ...] = ()
    index: int | None = None
    order: int = 1 << 30
    pattern: str | None = None
    default: object = None
    convert: Callable[[Column], Column] | None = field(default=None, compare=False)


def converted(x: Column, kind: str, pattern: str | None = None) -> Column:
    """Text as a typed value; what can't be read is null."""
    plain = F.trim(x)
    if kind == "string":
        return x
    low = F.lower(plain)
    if kind == "boolean":
        return F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False).otherwise(num(x) == 1)
    if kind in ("date", "timestamp"):
        moment = F.try_to_timestamp(plain, F.lit(pattern)) if pattern else F.coalesce(plain.try_cast("timestamp"), F.try_to_timestamp(plain, F.lit("yyyy/M/d")))
        number = F.when(plain.rlike(r"^\d{1,6}(\.\d*)?$"), plain.try_cast("double"))
        seconds = F.round((number - F.floor(number)) * 86400).cast("decimal(18,6)")
        return F.coalesce(from_serial(number).cast("timestamp") + F.make_dt_interval(secs=seconds), moment).cast(kind)
    truth = F.when(low == "true", 1).when(low == "false", 0)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        exact = num(x)
        return F.coalesce(F.when(exact == F.floor(exact), exact.try_cast("decimal(38,0)")).try_cast(kind), truth.cast(kind))
    if kind.startswith("decimal"):
        return F.coalesce(F.regexp_replace(plain, ",", "").try_cast(kind), truth.cast(kind))
    return F.coalesce(num(x).try_cast(kind), truth.cast(kind))


def stored(x: Column, kind: str, cell: str, pattern: str | None = None) -> Column:
    """A typed value as a cell of text, number or boolean; of numbers only 1 is true, dates are serial numbers."""
    if cell == "boolean":
        return x.cast("boolean") if kind in ("boolean", "string") else x == 1
    if cell == "number":
        if kind == "timestamp":
            return serial(x) + (F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)) / 86400
        return serial(x).cast("double") if kind == "date" else x.cast("int").cast("double") if kind == "boolean" else num(x) if kind == "string" else x.cast("double")
    if pattern and kind in ("date", "timestamp"):
        return F.date_format(x, pattern)
    return F.upper(x.cast("string")) if kind == "boolean" else x.cast("string")


def chosen(
    fields: list[Field],
    include: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
    include_at: Iterable[int] | None = None,
    exclude_at: Iterable[int] = (),
    as_included: bool = False,
) -> list[Field]:
    """The fields wanted by name and by place in the effective order; ``as_included`` keeps the order of the inclusion."""
    placed = sorted(fields, key=lambda f: (f.index if f.index is not None else 1 << 31, f.order))
    names, places = None if include is None else list(include), None if include_at is None else list(include_at)
    without, without_at = set(exclude), set(exclude_at)
    kept = [(i, f) for i, f in enumerate(placed) if f.name not in without and i not in without_at and (names is None or f.name in names) and (places is None or i in places)]
    if as_included and (names is not None or places is not None):
        kept.sort(key=lambda at: names.index(at[1].name) if names is not None else places.index(at[0]))
    return [f for _, f in kept]


def _source(df: DataFrame, f: Field) -> str | None:
    """The column of a field: by index, else by its first header that a column has, else by name."""
    if f.index is not None:
        return df.columns[f.index] if f.index < len(df.columns) else None
    by_header = {c.strip(): c for c in reversed(df.columns)}
    return next((by_header[h] for h in (*f.headers, f.name) if h in by_header), None)


def map_rows(df: DataFrame, fields: list[Field], include: Iterable[str] | None = None, exclude: Iterable[str] = (), keep_blank: bool = False, trim: bool = False, **selection) -> DataFrame:
    """Columns of text as the fields wanted, in their order; a field without a column takes its default.

    Headers match without blanks around them; rows without any filled cell go.
    ``trim`` takes blanks off both ends of texts; ``selection`` goes to ``chosen``.
    """
    wanted = chosen(fields, include, exclude, **selection)
    out = []
    for f in wanted:
        source = _source(df, f)
        x = F.lit(None).cast("string") if source is None else F.col(f"`{source}`").cast("string")
        x = F.trim(x) if trim else x
        value = f.convert(x) if f.convert else converted(x, f.kind, f.pattern)
        out.append((F.coalesce(value, F.lit(f.default)) if f.default is not None else value).cast(f.kind).alias(f.name))
    rows = df if keep_blank else df.where(F.greatest(*[(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) != "").cast("int") for c in df.columns], F.lit(0)) == 1)
    return rows.select(*out)


def failures(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Filled cells that their field's converter can't read, as ``(field, value)``."""
    parts = []
    for f in fields:
        source = _source(df, f)
        if source is not None:
            x = F.col(f"`{source}`").cast("string")
            value = f.convert(x) if f.convert else converted(x, f.kind, f.pattern)
            parts.append(F.when((F.trim(x) != "") & value.isNull(), F.struct(F.lit(f.name).alias("field"), x.alias("value"))))
    cells = df.select(F.explode(F.filter(F.array(*parts), lambda c: c.isNotNull())).alias("c")) if parts else df.limit(0).select(F.struct(F.lit("").alias("field"), F.lit("").alias("value")).alias("c"))
    return cells.select("c.*")


def with_missing(df: DataFrame, row: str, first: int, last: int) -> DataFrame:
    """All rows numbered from ``first`` to ``last``; numbers that ``df`` lacks give rows of nulls."""
    numbers = df.sparkSession.range(first, last + 1).select(F.col("id").cast(df.schema[row].dataType).alias(row))
    return numbers.join(df, row, "left").select(*df.columns)


def within_limits(df: DataFrame, columns: int = 16_384, characters: int = 1 << 20) -> DataFrame:
    """``df`` unchanged; too many columns are an error now, too long a cell when it is read."""
    if len(df.columns) > columns:
        raise ValueError(f"{len(df.columns)} columns, {columns} are allowed")
    texts = {c for c, t in df.dtypes if t == "string"}
    long = F.lit(f"a cell of more than {characters} characters")
    return df.select(*[F.when(F.length(F.col(f"`{c}`")) > characters, F.raise_error(long)).otherwise(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
