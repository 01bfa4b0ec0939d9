"""Dynamic arrays: sort, filter, distinct, limits, stacking and reshaping of tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellflow.functions.core import fold
from cellflow.operators.ordinal import numbered


def sort_key(df: DataFrame, name: str, descending: bool = False) -> Column:
    """Texts without regard to case."""
    key = F.lower(name) if dict(df.dtypes)[name] == "string" else F.col(name)
    return key.desc() if descending else key.asc()


def sort(df: DataFrame, *by: str, descending: tuple[str, ...] = (), row: str | None = None) -> DataFrame:
    """SORT and SORTBY: stable if ``row`` names the column of the present order."""
    keys = [sort_key(df, c, c in descending) for c in by]
    return df.orderBy(*keys, *([F.col(row)] if row else []))


def filter_rows(df: DataFrame, mask: Column) -> DataFrame:
    """FILTER: rows whose mask is true."""
    return df.where(mask)


def unique(df: DataFrame, *by: str, row: str | None = None, exactly_once: bool = False) -> DataFrame:
    """UNIQUE: one row for each key without regard to case, the first by ``row``; or the keys that stand once.

    A hash aggregate keeps the first row of each key, so duplicates leave no task twice.
    """
    by = by or tuple(df.columns)
    keys = [(F.lower(c) if dict(df.dtypes)[c] == "string" else F.col(c)).alias(f"_key{i}") for i, c in enumerate(by)]
    whole = F.struct(*df.columns)
    first = F.min_by(whole, F.col(row)) if row else F.min(whole)
    found = df.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (found.where("_n = 1") if exactly_once else found).select("_first.*")


def take(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """TAKE: the first n rows in the order, or the last if n is negative."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    if n >= 0:
        return df.orderBy(*keys).limit(n)
    rows = numbered(df, *keys)
    last = rows.agg(F.max("_row").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("_row") > F.col("_last") + n).drop("_row", "_last")  # one row


def drop(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """DROP: all but the first n rows, or all but the last if n is negative."""
    rows = numbered(df, *order)
    if n >= 0:
        return rows.where(F.col("_row") > n).drop("_row")
    last = rows.agg(F.max("_row").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("_row") <= F.col("_last") + n).drop("_row", "_last")  # one row


def choose_rows(df: DataFrame, indexes: list[int], *order: Column | str) -> DataFrame:
    """CHOOSEROWS: rows by number in the order given; negative ones from the end, repeats repeated."""
    spark = df.sparkSession
    rows = numbered(df, *order)
    n = rows.count()
    wanted = [(i, k if k > 0 else n + k + 1) for i, k in enumerate(indexes)]
    if any(not 1 <= k <= n for _, k in wanted):
        raise ValueError("#VALUE!")
    picks = spark.createDataFrame(wanted, "_at int, _row bigint")
    return rows.join(F.broadcast(picks), "_row").orderBy("_at").drop("_row", "_at")  # the list given


def choose_columns(df: DataFrame, indexes: list[int]) -> DataFrame:
    """CHOOSECOLS: by number from 1, or from the end."""
    names = df.columns
    return df.select(*[F.col(names[k - 1 if k > 0 else k]).alias(names[k - 1 if k > 0 else k] if indexes.count(k) == 1 else f"{names[k - 1 if k > 0 else k]}_{i}") for i, k in enumerate(indexes)])


def vstack(*tables: DataFrame) -> DataFrame:
    """VSTACK by position; missing columns are null."""
    width = max(len(t.columns) for t in tables)
    names = next(t.columns for t in tables if len(t.columns) == width)
    return reduce(DataFrame.unionAll, [t.select(*[F.col(c).alias(n) for c, n in zip(t.columns, names, strict=False)], *[F.lit(None).alias(n) for n in names[len(t.columns) :]]) for t in tables])


def hstack(*tables: tuple[DataFrame, str]) -> DataFrame:
    """HSTACK of ``(table, order)`` by row number; shorter tables leave nulls."""
    rows = [numbered(t, order) for t, order in tables]
    return reduce(lambda a, b: a.join(b, "_row", "full"), rows).orderBy("_row").drop("_row")


def to_column(df: DataFrame, order: str, ignore_blank: bool = False) -> DataFrame:
    """TOCOL: all cells, row by row, as ``(_row, _column, value)``."""
    names = [c for c in df.columns if c != order]
    cells = numbered(df, order).select("_row", F.posexplode(F.array(*[F.col(c).cast("string") for c in names])).alias("_column", "value"))
    return cells.where("value IS NOT NULL") if ignore_blank else cells


def to_row(df: DataFrame, order: str, ignore_blank: bool = False) -> DataFrame:
    """TOROW: all cells, row by row, as ``(_cell, value)``, numbered along one row from 1."""
    width = len(df.columns) - 1
    cells = to_column(df, order).select(((F.col("_row") - 1) * width + F.col("_column") + 1).alias("_cell"), "value")
    return numbered(cells.where("value IS NOT NULL").withColumnRenamed("_cell", "_at"), "_at", name="_cell").select("_cell", "value") if ignore_blank else cells


def wrap_columns(df: DataFrame, value: str, order: str, height: int, pad=None) -> DataFrame:
    """WRAPCOLS: a column laid out in columns of ``height`` cells, as ``(_line, _column, value)``; there may be any number of columns."""
    at = numbered(df.select(value, order), order).select(((F.col("_row") - 1) % height + 1).alias("_line"), (F.floor((F.col("_row") - 1) / height) + 1).alias("_column"), F.col(value).alias("value"))
    if pad is None:
        return at
    last = at.agg(F.max("_column").alias("_last"), F.count(F.lit(1)).alias("_n"))
    missing = last.select(F.explode(F.sequence((F.col("_n") - 1) % height + 2, F.lit(height).cast("long") + 1)).alias("_line"), F.col("_last").alias("_column")).where(F.col("_line") <= height)
    return at.unionByName(missing.withColumn("value", F.lit(pad).cast(dict(at.dtypes)["value"])))


def wrap_rows(df: DataFrame, value: str, order: str, width: int, pad=None) -> DataFrame:
    """WRAPROWS: a column laid out in rows of ``width`` cells."""
    at = numbered(df.select(value, order), order).withColumn("_line", F.floor((F.col("_row") - 1) / width)).withColumn("_cell", (F.col("_row") - 1) % width)
    cells = [F.coalesce(F.max(F.when(F.col("_cell") == i, F.col(value))), F.lit(pad)).alias(f"c{i + 1}") for i in range(width)]
    return at.groupBy("_line").agg(*cells).orderBy("_line")


def sequence(spark: SparkSession, rows: int, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE of one column."""
    return spark.range(rows).select((F.col("id") + 1).alias("_row"), (F.col("id") * step + start).cast("double").alias("value"))


def random_array(spark: SparkSession, rows: int, low: float = 0, high: float = 1, whole: bool = False, seed: int | None = None) -> DataFrame:
    """RANDARRAY of one column."""
    x = F.rand(seed)
    return spark.range(rows).select((F.col("id") + 1).alias("_row"), (F.floor(x * (high - low + 1)) + low if whole else x * (high - low) + low).alias("value"))


def expand(df: DataFrame, rows: int, order: str, pad=None) -> DataFrame:
    """EXPAND to so many rows, padded at the end."""
    own = numbered(df, order)
    if own.count() > rows:
        raise ValueError("#VALUE!")
    grid = df.sparkSession.range(1, rows + 1).withColumnRenamed("id", "_row")
    filled = grid.join(own, "_row", "left")
    return filled.select("_row", *[(F.coalesce(c, F.lit(pad).cast(t)) if pad is not None else F.col(c)).alias(c) for c, t in df.dtypes])


def trim_range(df: DataFrame, order: str) -> DataFrame:
    """TRIMRANGE: without the blank rows at either end."""
    filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in df.columns if c != order])
    edge = df.where(filled).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    return df.crossJoin(F.broadcast(edge)).where(F.col(order).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")  # one row


def transpose(df: DataFrame, key: str) -> DataFrame:
    """TRANSPOSE of a small table: its rows become columns named by ``key``."""
    names = [c for c in df.columns if c != key]
    long = df.select(key, F.explode(F.create_map(*[v for c in names for v in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    return long.groupBy("field").pivot(key).agg(F.first("value"))


def scan(df: DataFrame, value: str, order: str, name: str = "value") -> DataFrame:
    """SCAN with addition: the running sum in order, partition sums first."""
    from cellflow.operators.aggregates import running_total

    return running_total(df, order, value).withColumnRenamed("upto", name)


def map_cells(df: DataFrame, name: str, step: Callable[..., Column], *columns: str) -> DataFrame:
    """MAP: a column made of others, cell by cell."""
    return df.withColumn(name, step(*[F.col(c) for c in columns]))


def reduce_row(values: Column, start: float, step: Callable[[Column, Column], Column]) -> Column:
    """REDUCE over the cells of a row, an array: the last value of a left fold of numbers."""
    return fold(values, F.lit(float(start)), lambda so_far, x: step(so_far, x).cast("double"))


def scan_row(values: Column, start: float, step: Callable[[Column, Column], Column]) -> Column:
    """SCAN over the cells of a row, an array: all values of a left fold of numbers."""

    def add(state: Column, x: Column) -> Column:
        value = step(state["last"], x).cast("double")
        return F.struct(value.alias("last"), F.concat(state["all"], F.array(value)).alias("all"))

    first = F.struct(F.lit(float(start)).alias("last"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(values, first, add, lambda state: state["all"])


def outer(df: DataFrame, value: str, across: list, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """A column against a line of values, each with each: a row for each cell, its ``_column`` from 0.

    The line is a Python list, so a row only grows by its length and nothing is joined.
    """
    cells = F.array(*[step(F.col(value), F.lit(v)) for v in across])
    return df.select("*", F.posexplode(cells).alias("_column", name))


def large_small(df: DataFrame, x: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE and SMALL over a table: the last of the top k; no row beyond the count."""
    key = F.col(x).desc() if largest else F.col(x).asc()
    top = df.where(F.col(x).isNotNull()).select(x).orderBy(key).limit(k)
    out = top.agg((F.min(x) if largest else F.max(x)).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select(F.when(F.col("n") == k, F.col("value")).alias("value"))


def rank(df: DataFrame, x: str, descending: bool = True, average: bool = False, name: str = "rank") -> DataFrame:
    """RANK.EQ and RANK.AVG: from the counts of distinct values, summed by range; rows only join their value's rank."""
    from cellflow.operators.aggregates import running_total

    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", -F.col("_value") if descending else F.col("_value"))
    ranks = running_total(counts, "_key", "_n").select("_value", (F.col("upto") - F.col("_n") + 1 + (((F.col("_n") - 1) / 2) if average else 0)).alias(name))
    return df.join(ranks, F.col(x) == F.col("_value"), "left").drop("_value")


def modes(df: DataFrame, x: str, order: str) -> DataFrame:
    """MODE.MULT: the most frequent values by first appearance; values that stand once are no modes."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    top = counts.agg(F.max("_n").alias("_most"))
    return counts.crossJoin(F.broadcast(top)).where("_n = _most AND _n > 1").orderBy("_first").select(x)  # one row


def frequency(df: DataFrame, x: str, bins: list[float]) -> DataFrame:
    """FREQUENCY: counts up to each bin and beyond the last, in one pass."""
    edges = sorted(bins)
    at = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        at = F.when(F.col(x) <= edges[i], i).otherwise(at)
    found = df.where(F.col(x).isNotNull()).groupBy(at.alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(i, float(edges[i]) if i < len(edges) else None) for i in range(len(edges) + 1)], "_bin int, upper double")
    return grid.join(found, "_bin", "left").select("_bin", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def percent_rank(df: DataFrame, x: str, name: str = "percentrank") -> DataFrame:
    """PERCENTRANK.INC of each row among all, cut to three digits."""
    n = df.where(F.col(x).isNotNull()).count()
    out = rank(df, x, descending=False, name="_rank")
    return out.withColumn(name, F.floor((F.col("_rank") - 1) / F.lit(max(n - 1, 1)) * 1000) / 1000).drop("_rank")


def percent_rank_exc(df: DataFrame, x: str, name: str = "percentrank") -> DataFrame:
    """PERCENTRANK.EXC of each row among all, cut to three digits."""
    n = df.where(F.col(x).isNotNull()).count()
    out = rank(df, x, descending=False, name="_rank")
    return out.withColumn(name, F.floor(F.col("_rank") / F.lit(n + 1) * 1000) / 1000).drop("_rank")


def column_letters(n: Column | int) -> Column:
    """A column's letters: 1 is A, 27 is AA; up to three letters."""
    n = F.lit(n) if isinstance(n, int) else n
    letter = lambda k: F.chr(F.lit(65) + k.cast("int"))
    one = letter((n - 1) % 26)
    two = F.concat(letter(F.floor((n - 27) / 26) % 26), one)
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(F.concat(letter(F.floor((n - 703) / 676) % 26), two))


def address(row: Column | int, column: Column | int, absolute: int = 1, sheet: str | None = None) -> Column:
    """ADDRESS in the A1 style."""
    row = F.lit(row) if isinstance(row, int) else row
    prefix = "" if sheet is None else (f"'{sheet}'!" if re.search(r"\W", sheet) else f"{sheet}!")
    return F.concat(F.lit(prefix + ("$" if absolute in (1, 3) else "")), column_letters(column), F.lit("$" if absolute in (1, 2) else ""), row.cast("string"))
