"""SQL fragments and rounding shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.spatial import SHORELINE

FIRST_YEAR, LAST_YEAR = 1995, 2001


def rounded(df, digits: int = 4, **per_column):
    """Round every double, so that the order of float sums does not show."""
    return df.withColumns(
        {c: F.round(c, per_column.get(c, digits)) for c, kind in df.dtypes if kind == "double"}
    )


def longs(df):
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})


def tidy(df, digits: int = 4, **per_column):
    return longs(rounded(df, digits, **per_column))


def haversine_sql(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(2*6371e0*asin(sqrt(least(greatest(pow(sin((radians({lat2})-radians({lat1}))/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2),0e0),1e0))))"
    )


def millimetres_sql(km: str) -> str:
    return f"(floor({km}*1e6+5e-1)/1e6)"


RMW_SQL = "least(greatest(60e0-4e-1*(max_wind_kt-50e0),15e0),60e0)"


def wind_sql(distance: str, rmw: str = RMW_SQL) -> str:
    return (
        f"(case when {distance} <= {rmw} then max_wind_kt"
        f" else max_wind_kt*sqrt({rmw}/greatest({distance},1e-6)) end)"
    )


MIDPOINT_SQL = (
    "(case construction_class when 'frame' then 95e0 when 'masonry_veneer' then 105e0"
    " when 'masonry_cbs' then 120e0 else 140e0 end"
    " + case roof_type when 'hip' then 8e0 when 'gable' then 0e0 else -5e0 end)"
)
STEEPNESS_SQL = (
    "(case construction_class when 'frame' then 45e-3 when 'masonry_veneer' then 45e-3"
    " when 'masonry_cbs' then 40e-3 else 35e-3 end)"
)


def damage_sql(wind: str) -> str:
    return f"least(greatest(1e0/(1e0+exp(-{STEEPNESS_SQL}*({wind}-{MIDPOINT_SQL}))),0e0),1e0)"


COAST_SQL = "least(" + ",".join(haversine_sql("lat", "lon", f"{a}e0", f"{b}e0") for a, b in SHORELINE) + ")"

LOCATION_YEARS_SQL = f"SELECT location_id, y AS year FROM locations, range({FIRST_YEAR}, {LAST_YEAR + 1}) r(y)"
