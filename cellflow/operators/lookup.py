"""Lookups as joins: first or last match, positions, and the nearest value in sorted order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellflow.functions.text import wildcard
from cellflow.operators.ordinal import materialised, numbered


def _key(df: DataFrame, name: str) -> Column:
    """Texts match without regard to case."""
    return F.lower(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def xlookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, if_not_found=None, last: bool = False, name: str | None = None) -> DataFrame:
    """VLOOKUP, INDEX/MATCH and XLOOKUP with exact match: every row of ``df`` once, with the first (last) match's value.

    The table is cut to one row a key before the join, so matches never multiply rows.
    """
    pick = F.max_by if last else F.min_by
    whole = F.struct(F.col(value).alias("v"))
    found = table.where(F.col(table_key).isNotNull()).groupBy(_key(table, table_key).alias("_key")).agg(pick(whole, F.col(order)).alias("_found"))
    out = df.join(found, _key(df, key) == F.col("_key"), "left")
    got = F.col("_found.v")
    got = got if if_not_found is None else F.when(F.col("_found").isNull(), F.lit(if_not_found)).otherwise(got)
    return out.withColumn(name or value, got).drop("_key", "_found")


vlookup = xlookup


def match(df: DataFrame, key: str, table: DataFrame, table_key: str, order: str, last: bool = False, name: str = "position") -> DataFrame:
    """MATCH and XMATCH with exact match: the position in the table's order, null where there is none."""
    rows = numbered(table.select(*dict.fromkeys([table_key, order])), order)
    return xlookup(df, key, rows, table_key, "_row", "_row", last=last, name=name)


def wildcard_match(df: DataFrame, pattern: str, table_key: str, order: str) -> DataFrame:
    """The first row whose text fits a pattern of ``*`` and ``?``."""
    return df.where(F.lower(table_key).rlike(f"(?s)^{wildcard(pattern.lower())}$")).orderBy(order).limit(1)


def nearest(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, larger: bool = False, name: str | None = None) -> DataFrame:
    """LOOKUP and the approximate matches: the value at the largest key not above (the smallest not below).

    Both sides are sorted together by range; a partition starts from the last
    table row of those before it, so no task sees more than its range.  Of
    equal table keys the last (for ``larger`` the first) by ``order`` counts.
    """
    left = df.select(F.col(key).alias("_at"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row"), F.lit(None).cast(table.schema[order].dataType).alias("_order"), F.lit(None).cast(f"struct<v:{table.schema[value].dataType.simpleString()}>").alias("_value"))
    right = table.where(F.col(table_key).isNotNull()).select(F.col(table_key).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(order).alias("_order"), F.struct(F.col(value).alias("v")).alias("_value"))
    both = left.unionByName(right)
    way = (lambda c: F.col(c).desc()) if larger else (lambda c: F.col(c).asc())
    parts = materialised(both.repartitionByRange(way("_at")).withColumn("_part", F.spark_partition_id()))
    keys = [way("_at"), F.col("_side"), way("_order")]
    edge = parts.where("_side = 0").groupBy("_part").agg((F.min_by if larger else F.max_by)("_value", F.struct("_at", "_order")).alias("_edge"))
    grid = parts.select("_part").distinct().join(edge, "_part", "left")
    carried = grid.withColumn("_carried", F.last("_edge", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_carried")
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    found = parts.join(F.broadcast(carried), "_part")  # a row for each partition
    found = found.withColumn("_found", F.coalesce(F.last("_value", True).over(inside), F.col("_carried"))).where("_side = 1")
    got = F.when(F.col("_at").isNotNull(), F.col("_found.v")).alias(name or value)
    return found.select("_row.*", got)


def index(df: DataFrame, row: int, order: str, column: str | None = None) -> DataFrame:
    """INDEX: a row by number (0: all), of one column or all."""
    rows = numbered(df, order) if row else df
    rows = rows.where(F.col("_row") == row).drop("_row") if row else rows
    return rows.select(column) if column else rows


def hlookup(table: DataFrame, header: str, row: int, order: str) -> DataFrame:
    """HLOOKUP: the cell of a row under a header, found without regard to case; the header is row 1."""
    names = [c for c in table.columns if c.lower() == header.lower()]
    if not names:
        raise KeyError("#N/A")
    return index(table, row - 1, order, names[0])


def offset(df: DataFrame, first: int, height: int, order: str, columns: list[str]) -> DataFrame:
    """OFFSET: a window of rows and columns."""
    return numbered(df, order).where(F.col("_row").between(first, first + height - 1)).select(*columns)


def matching(df: DataFrame, key: str, table: DataFrame, table_key: str, absent: bool = False) -> DataFrame:
    """FILTER by COUNTIF or MATCH: rows whose key is in the table, or is not."""
    keys = table.select(_key(table, table_key).alias("_key")).where("_key IS NOT NULL")
    return df.join(keys, _key(df, key) == F.col("_key"), "left_anti" if absent else "left_semi")
