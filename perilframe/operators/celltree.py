"""An adaptive tree of latitude-longitude cells, computed as tables.

The world is cut into start cells about as high as a circle of the largest radius; each may be halved both ways DEPTH times.
Rows are counted in the cells of every level, and a cell is split as long as it holds more than a given number of rows: leaves
are many and small where rows are dense, few and large where they are not. Nothing runs on the driver: the tree is one
aggregate, and a window over the cells of each parent.

A circle finds its leaves from above: the start cells that its box touches, then the nodes halfway down, then the leaves
below. A node has at most 4 ** HALF children, so no step makes more rows than that from one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

DEPTH = 8  # levels below a start cell
HALF = 4
DEEPEST_START = 18  # a cell number has 28 bits for each axis
KM_PER_DEGREE = math.pi * geo.EARTH_RADIUS_KM / 180.0


def start_level(radius_km: float) -> int:
    """The deepest level whose cells are at least twice as high as the radius."""
    high = 2 * max(radius_km, 1e-6) / KM_PER_DEGREE
    return min(max(math.floor(math.log2(180.0 / high)), 0), DEEPEST_START)


def fine_cell(lat: str, lon: str, start: int) -> dict[str, Column]:
    """Row and column of a position's cell on the deepest level."""
    n = 1 << (start + DEPTH)
    y = F.least(F.greatest(F.floor((F.col(lat) + 90.0) / 180.0 * n), F.lit(0)), F.lit(n - 1))
    x = F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * n), F.lit(n))
    return {"_y": y.cast("long"), "_x": x.cast("long")}


def cell_id(level: Column, y: Column, x: Column) -> Column:
    return level.cast("long") * F.lit(1 << 56) + y * F.lit(1 << 28) + x


def up(axis: str, levels) -> Column:
    """A cell's row or column, so many levels up."""
    return F.call_function("shiftright", F.col(axis), levels.cast("int") if isinstance(levels, Column) else F.lit(levels))


def path(cells: DataFrame) -> DataFrame:
    """Each fine cell on every level: ``level, y, x`` beside its own columns."""
    down = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
    return down.withColumns({"y": up("_y", DEPTH - F.col("level")), "x": up("_x", DEPTH - F.col("level"))})


def fine_counts(placed: DataFrame) -> DataFrame:
    """(_y, _x, n): rows in each cell of the deepest level."""
    return placed.groupBy("_y", "_x").agg(F.count("*").alias("n"))


def leaves(counts: DataFrame, most: int) -> DataFrame:
    """(_leaf, level, y, x, _parts): cells of at most ``most`` rows under a parent of more; on the deepest level, in parts of that many."""
    cells = path(counts).groupBy("level", "y", "x").agg(F.sum("n").alias("n"))
    siblings = Window.partitionBy("level", up("y", 1), up("x", 1))  # at most four cells, which hold what their parent holds
    cells = cells.withColumn("_above", F.sum("n").over(siblings))
    ends = ((F.col("n") <= most) | (F.col("level") == DEPTH)) & ((F.col("level") == 0) | (F.col("_above") > most))
    return cells.where(ends).select(cell_id(F.col("level"), F.col("y"), F.col("x")).alias("_leaf"), "level", "y", "x", F.ceil(F.col("n") / most).cast("int").alias("_parts"))


def leaf_of_cells(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """(_y, _x, _leaf, _parts): the leaf that holds each fine cell."""
    ways = path(counts.select("_y", "_x")).select("_y", "_x", cell_id(F.col("level"), F.col("y"), F.col("x")).alias("_leaf"))
    return ways.join(tree.select("_leaf", "_parts"), "_leaf")


def box_of(lat: str, lon: str, radius_km: Column) -> dict[str, Column]:
    """Centre and half sizes, in degrees, of the box around a circle; all the way round if it covers a pole."""
    rho = F.degrees(radius_km / geo.EARTH_RADIUS_KM) + 1e-9
    widest = F.asin(F.least(F.sin(F.radians(rho)) / F.cos(F.radians(F.col(lat))), F.lit(1.0)))
    half = F.when(F.abs(F.col(lat)) + rho < 89.999, F.degrees(widest) + 1e-9).otherwise(F.lit(180.0))
    return {"_lat": F.col(lat), "_lon": F.col(lon), "_rho": rho, "_half": half}


def start_cells(start: int) -> Column:
    """Array of the start cells that the box touches."""
    n = 1 << start
    row = lambda lat: F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")
    lo = F.floor((F.col("_lon") - F.col("_half") + 180.0) / 360.0 * n).cast("long")
    hi = F.floor((F.col("_lon") + F.col("_half") + 180.0) / 360.0 * n).cast("long")
    columns = F.sequence(lo, F.least(hi, lo + n - 1))
    rows = F.sequence(row(F.col("_lat") - F.col("_rho")), row(F.col("_lat") + F.col("_rho")))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: cell_id(F.lit(0), y, F.pmod(x, F.lit(n))))))


def touching(start: int, level: str, y: str, x: str) -> Column:
    """Whether the box touches the cell."""
    high = F.lit(180.0) / F.pow(F.lit(2.0), F.col(level) + start)
    north = F.abs(F.col("_lat") - ((F.col(y) + 0.5) * high - 90.0)) <= F.col("_rho") + high / 2 + 1e-9
    off = F.col("_lon") - ((F.col(x) + 0.5) * 2 * high - 180.0)  # a cell is twice as wide as high
    east = F.abs(F.pmod(off + 180.0, F.lit(360.0)) - 180.0) <= F.col("_half") + high + 1e-9
    return north & east


def cover(rows: DataFrame, tree: DataFrame, start: int) -> DataFrame:
    """``rows`` (with the columns of ``box_of``), once for each leaf that its box touches, with ``_leaf`` and ``_parts``."""
    above = F.greatest(F.col("level") - HALF, F.lit(0))
    nodes = tree.select("_leaf", "_parts", F.col("level").alias("_l"), F.col("y").alias("_ly"), F.col("x").alias("_lx"), F.least(F.col("level"), F.lit(HALF)).alias("_m"), up("y", above).alias("_my"), up("x", above).alias("_mx"))
    nodes = nodes.withColumn("_node", cell_id(F.col("_m"), F.col("_my"), F.col("_mx")))
    tops = nodes.select("_node", "_m", "_my", "_mx").distinct().withColumn("_start", cell_id(F.lit(0), up("_my", F.col("_m")), up("_mx", F.col("_m"))))
    met = rows.withColumn("_start", F.explode(start_cells(start))).join(tops, "_start").where(touching(start, "_m", "_my", "_mx"))
    met = met.drop("_start", "_m", "_my", "_mx").join(nodes.drop("_m", "_my", "_mx"), "_node").where(touching(start, "_l", "_ly", "_lx"))
    return met.drop("_node", "_l", "_ly", "_lx")


def crowds(circles: DataFrame, start: int) -> DataFrame:
    """Circles (rows with ``box_of``) counted by the cell of their centres: ``n``, under a box that holds all of theirs."""
    high = 180.0 / (1 << (start + HALF))
    cells = circles.withColumns(fine_cell("_lat", "_lon", start)).groupBy(up("_y", DEPTH - HALF).alias("_y"), up("_x", DEPTH - HALF).alias("_x"))
    held = cells.agg(F.count("*").alias("n"), F.max("_rho").alias("_r"), F.max("_half").alias("_h"))
    centre = {"_lat": (F.col("_y") + 0.5) * high - 90.0, "_lon": (F.col("_x") + 0.5) * 2 * high - 180.0}
    return held.select("n", *(c.alias(k) for k, c in centre.items()), (F.col("_r") + high / 2).alias("_rho"), F.least(F.col("_h") + high, F.lit(180.0)).alias("_half"))
