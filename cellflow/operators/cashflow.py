"""Rates of return of groups of cash flows, by root finding on each group's own flows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellflow.functions.financial import newton


def internal_rate(df: DataFrame, key: str, value: str, order: str, guess: float = 0.1) -> DataFrame:
    """IRR per key, of flows in order; both signs must occur.  Flows are summed by place first, so a group is as long as its periods."""
    places = df.groupBy(key, order).agg(F.sum(value).alias("flow"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        flows = group.sort_values(order)["flow"].fillna(0).tolist()
        return pd.DataFrame({key: group[key].iloc[:1], "irr": [_root(flows, range(len(flows)), guess)]})

    return places.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, irr double")


def dated_rate(df: DataFrame, key: str, value: str, date: str, guess: float = 0.1) -> DataFrame:
    """XIRR per key: years are days since the first flow by 365."""
    places = df.groupBy(key, F.col(date).cast("date").alias("_date")).agg(F.sum(value).alias("flow"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dates = pd.to_datetime(group["_date"])
        years = ((dates - dates.min()).dt.days / 365).tolist()
        return pd.DataFrame({key: group[key].iloc[:1], "xirr": [_root(group["flow"].fillna(0).tolist(), years, guess)]})

    return places.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, xirr double")


def _root(flows, years, guess: float) -> float | None:
    if not any(f > 0 for f in flows) or not any(f < 0 for f in flows):
        return None
    try:
        return newton(lambda r: sum(f / (1 + r) ** t for f, t in zip(flows, years, strict=True)), guess)
    except (ValueError, OverflowError, ZeroDivisionError):
        return None
