"""Database functions: aggregates of the rows that a criteria range lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellflow.operators.aggregates import max_, min_, product, sum_
from cellflow.operators.criteria import any_row

#: Aggregates by name.
AGGREGATES = {"DSUM": sum_, "DAVERAGE": F.avg, "DCOUNTA": F.count, "DMAX": max_, "DMIN": min_, "DPRODUCT": product, "DSTDEV": F.stddev_samp, "DSTDEVP": F.stddev_pop, "DVAR": F.var_samp, "DVARP": F.var_pop}


def aggregate(name: str, db: DataFrame, field: str, criteria: list[dict[str, object]]) -> DataFrame:
    """One row ``value``: the rows of ``criteria`` are alternatives, the cells of a row hold together."""
    names = {c.lower(): c for c in db.columns}
    x: Column = F.col(names[field.lower()])
    rows = db.where(any_row(db, criteria))
    if name == "DCOUNT":
        return rows.agg(F.count(x.try_cast("double")).alias("value"))
    if name == "DGET":
        return rows.agg(F.when(F.count(F.lit(1)) == 1, F.first(x)).alias("value"))
    return rows.agg(AGGREGATES[name](x).alias("value"))
