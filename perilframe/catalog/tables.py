"""Domain tables over the test tables.

Each is a list of expressions on one source, the same text for Spark
(``selectExpr``) and for the SQL twin.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.support import dealt, tasks_for

LOCATIONS = [
    "c_custkey as location_id",
    "24.5e0 + (c_custkey*37 % 640)*1e-2 as lat",
    "-87.5e0 + (c_custkey*53 % 770)*1e-2 as lon",
    "c_nationkey as region_code",
    "1900 + c_custkey % 125 as year_built",
    "case c_custkey % 4 when 0 then 'frame' when 1 then 'masonry_veneer' when 2 then 'masonry_cbs'"
    " else 'reinforced_concrete' end as construction_class",
    "case c_custkey % 3 when 0 then 'hip' when 1 then 'gable' else 'flat' end as roof_type",
    "cast(floor(75000e0 + abs(c_acctbal)*1e2) as double) as tiv_usd",
]
_PCT = "case location_id % 3 when 0 then 2e-2 when 1 then 5e-2 else 1e-1 end"
POLICIES = [
    "location_id as policy_id",
    "location_id",
    "tiv_usd as limit_usd",
    f"{_PCT} as deductible_pct",
    f"cast(floor(tiv_usd * {_PCT}) as double) as deductible_usd",
]
TRACKS = [
    "event_id as obs_id",
    "user_id % 40 as storm_id",
    "ts as obs_ts",
    "1995 + (user_id % 40) % 7 as obs_year",
    "20e0 + (event_id*7 % 150)*1e-1 as lat",
    "-92e0 + (event_id*11 % 170)*1e-1 as lon",
    "cast(floor(20e0 + value*3e-1) as double) as max_wind_kt",
    "cast(floor(1015e0 - value*2e-1) as double) as min_pressure_mb",
]
GRID = [
    "event_id as cell_obs_id",
    "24.5e0 + (event_id % 27)*25e-2 as lat",
    "-87.5e0 + (floor(event_id/27) % 32)*25e-2 as lon",
    "ts as obs_ts",
    "case when event_id % 3 = 0 then null when event_id % 5 = 0 then cast('NaN' as double)"
    " else 26e0 + (event_id % 60)*1e-1 end as sst_celsius",
    "1000e0 + (event_id % 40)*5e-1 as mslp_hpa",
    "value*5e-2 as wind_speed_ms",
]
CLAIMS = [
    "l_orderkey*10 + l_linenumber as claim_id",
    "o_custkey as location_id",
    "o_custkey as policy_id",
    "l_suppkey % 40 as storm_id",
    "l_shipdate as loss_date",
    "40e0 + l_quantity*2e0 as max_wind_experienced_kt",
    "l_discount*5e0 + l_tax as damage_ratio",
    "l_extendedprice as incurred_loss_usd",
    "floor(l_extendedprice*(1e0 - l_discount)*1e2 + 5e-1)/1e2 as paid_loss_usd",
]
SCORED = [
    "doc_id as row_id",
    "doc_id % 12 as fold_year",
    "quality as y",
    "(doc_id*7919 % 997)/997e0 as p",
]


def _select(exprs: list[str], source: str) -> str:
    return "SELECT " + ",\n       ".join(exprs) + f"\nFROM {source}"


SQL_TABLES = {
    "locations": _select(LOCATIONS, "customer"),
    "policies": _select(POLICIES, "locations"),
    "tracks": _select(TRACKS, "events"),
    "grid": _select(GRID, "events"),
    "claims": _select(CLAIMS, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "annual_losses": "SELECT o_orderkey % 2000 as season, floor(sum(o_totalprice)*1e2 + 5e-1)/1e2 as annual_loss\n"
    "FROM orders GROUP BY o_orderkey % 2000",
    "scored": _select(SCORED, "labels"),
}


class Tables:
    """Lazy access to the test tables of one folder and to the domain tables over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def locations(self) -> DataFrame:
        return self.raw("customer").selectExpr(*LOCATIONS)

    @cached_property
    def policies(self) -> DataFrame:
        return self.locations.selectExpr(*POLICIES)

    @cached_property
    def tracks(self) -> DataFrame:
        return self.raw("events").selectExpr(*TRACKS)

    @cached_property
    def grid(self) -> DataFrame:
        return self.raw("events").selectExpr(*GRID)

    @cached_property
    def claims(self) -> DataFrame:
        lines, orders = self.raw("lineitem"), self.raw("orders")
        tasks = tasks_for(lines, 500_000)  # a sort of the join, and what follows it in its task, has its share of lines however many there are
        lines, orders = dealt(lines, tasks, "l_orderkey"), dealt(orders, tasks, "o_orderkey")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*CLAIMS)

    @cached_property
    def annual_losses(self) -> DataFrame:
        per = self.raw("orders").groupBy((F.col("o_orderkey") % 2000).alias("season"))
        return per.agg((F.floor(F.sum("o_totalprice") * 1e2 + 0.5) / 1e2).alias("annual_loss"))

    @cached_property
    def scored(self) -> DataFrame:
        return self.raw("labels").selectExpr(*SCORED)
