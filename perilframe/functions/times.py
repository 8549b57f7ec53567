"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_instant(df: DataFrame, column: str) -> Column:
    """The column as an instant; a zone-less timestamp is read as UTC."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())
    return F.col(column).cast("timestamp")


def utc_seconds(df: DataFrame, column: str) -> Column:
    return F.unix_seconds(as_instant(df, column))
