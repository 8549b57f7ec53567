"""Region-year series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import ocean_phase
from ..operators import yeargrid
from .common import FIRST_YEAR, LAST_YEAR, longs, rounded, tidy
from .registry import query

SERIES_SQL = f"""a AS (SELECT location_id, year(loss_date) AS y, count(*) AS n, avg(damage_ratio) AS m FROM claims GROUP BY 1, 2),
    g AS (SELECT region_code, y, sum(n) AS f, avg(m) AS s FROM a JOIN locations USING (location_id) GROUP BY 1, 2),
    series AS (SELECT cast(k.region_code AS varchar) AS region_id, r.y AS year, cast(coalesce(f, 0) AS bigint) AS frequency, coalesce(s, 0) AS severity
    FROM (SELECT DISTINCT region_code FROM locations) k CROSS JOIN range({FIRST_YEAR}, {LAST_YEAR + 1}) r(y) LEFT JOIN g ON g.region_code = k.region_code AND g.y = r.y)"""


def series(t):
    return yeargrid.region_series(t.locations, t.claims, FIRST_YEAR, LAST_YEAR)


@query("e10_region_series", f"WITH {SERIES_SQL} SELECT region_id, year, frequency, round(severity, 9) AS severity FROM series")
def e10(t):
    return tidy(series(t), 9)


# Some years have no climate row, and some rows no value.
CLIMATE_SQL = """clim AS (SELECT cast(1994 + event_id % 9 AS int) AS year, avg(value) AS basin_sst_celsius_mean, max(value) AS basin_sst_celsius_max,
    max(case when event_id % 9 <> 3 then event_type end) AS enso_phase FROM events WHERE event_id % 9 NOT IN (1, 5) GROUP BY 1)"""
_CARRIED = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a) AS {c}"
    for c in ("basin_sst_celsius_mean", "basin_sst_celsius_max", "enso_phase")
)


@query(
    "e10_region_climate",
    f"""WITH {SERIES_SQL}, {CLIMATE_SQL}, f AS (SELECT region_id, s.year, frequency, severity, {_CARRIED} FROM series s LEFT JOIN clim ON clim.year = s.year
          WINDOW b AS (PARTITION BY region_id ORDER BY s.year ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY region_id ORDER BY s.year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT region_id, year, frequency, round(severity, 9) AS severity, round(basin_sst_celsius_mean, 9) AS basin_sst_celsius_mean, basin_sst_celsius_max, enso_phase FROM f""",
)
def e10_climate(t):
    slot = F.col("event_id") % 9
    climate = t.raw("events").where(~slot.isin(1, 5)).groupBy((1994 + slot).cast("int").alias("year")).agg(
        F.avg("value").alias("basin_sst_celsius_mean"), F.max("value").alias("basin_sst_celsius_max"),
        F.max(F.when(slot != 3, F.col("event_type"))).alias("enso_phase"),
    )
    return tidy(yeargrid.region_series(t.locations, t.claims, FIRST_YEAR, LAST_YEAR, climate=climate), 9)


@query(
    "e32_naive_baselines",
    f"""WITH {SERIES_SQL} SELECT region_id, round(avg(severity), 8) AS historical_mean, round(arg_max(severity, year), 8) AS last_value,
        round(regr_slope(severity, year), 8) AS slope, round(regr_intercept(severity, year), 6) AS intercept FROM series GROUP BY 1""",
)
def e32(t):
    return rounded(yeargrid.fit_baselines(series(t), "severity"), 8, intercept=6)


_GAPPY_SQL = """c AS (SELECT user_id % 7 AS region_id, cast(2000 + event_id % 30 AS bigint) AS year, avg(value) AS v,
        max(event_type) AS lab FROM events GROUP BY 1, 2),
    gap AS (SELECT k.region_id, r.y AS year, case when (r.y + k.region_id) % 3 = 0 then v end AS v, case when (r.y + k.region_id) % 4 = 1 then lab end AS lab
    FROM (SELECT DISTINCT region_id FROM c) k CROSS JOIN range(2000, 2030) r(y) LEFT JOIN c ON c.region_id = k.region_id AND c.year = r.y)"""


@query(
    "f2_gap_fill",
    f"""WITH {_GAPPY_SQL}, w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1,
        last_value(case when v IS NOT NULL then year end IGNORE NULLS) OVER b AS x0, first_value(case when v IS NOT NULL then year end IGNORE NULLS) OVER a AS x1,
        last_value(lab IGNORE NULLS) OVER b AS l0, first_value(lab IGNORE NULLS) OVER a AS l1 FROM gap
        WINDOW b AS (PARTITION BY region_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY region_id ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT region_id, year, round(case when v IS NOT NULL then v when v0 IS NULL then v1 when v1 IS NULL then v0 else v0 + (v1-v0)/(x1-x0)*(year-x0) end, 6) AS v,
               coalesce(l0, l1) AS lab FROM w""",
)
def f2(t):
    ev = t.raw("events")
    c = ev.groupBy((F.col("user_id") % 7).alias("region_id"), (2000 + F.col("event_id") % 30).alias("year")).agg(
        F.avg("value").alias("v"), F.max("event_type").alias("lab")
    )
    grid = c.select("region_id").distinct().withColumn("year", F.explode(F.sequence(F.lit(2000).cast("long"), F.lit(2029).cast("long"))))
    at = F.col("year") + F.col("region_id")
    gappy = grid.join(c, ["region_id", "year"], "left").withColumns(
        {"v": F.when(at % 3 == 0, F.col("v")), "lab": F.when(at % 4 == 1, F.col("lab"))}
    )
    return rounded(yeargrid.fill_gaps(gappy, linear=["v"], carry=["lab"], by="region_id"), 6)


@query(
    "f2_climate_summary",
    """WITH i AS (SELECT 1990 + o_orderkey % 40 AS year, avg(o_totalprice)/1e5 - 15e-1 AS a FROM orders GROUP BY 1 HAVING avg(o_totalprice) < 151e3),
       s AS (SELECT year(o_orderdate) AS year, avg(o_totalprice)/1e4 AS m, max(o_totalprice)/1e4 AS x FROM orders GROUP BY 1),
       y AS (SELECT r.y AS year, m, x, a, case when a >= 5e-1 then 'el_nino' when a <= -5e-1 then 'la_nina' when a IS NOT NULL then 'neutral' end AS ph
             FROM range(1992, 2020) r(y) LEFT JOIN s ON s.year = r.y LEFT JOIN i ON i.year = r.y),
       w AS (SELECT *, last_value(m IGNORE NULLS) OVER b AS m0, first_value(m IGNORE NULLS) OVER f AS m1, last_value(x IGNORE NULLS) OVER b AS x0, first_value(x IGNORE NULLS) OVER f AS x1,
             last_value(a IGNORE NULLS) OVER b AS a0, first_value(a IGNORE NULLS) OVER f AS a1, last_value(ph IGNORE NULLS) OVER b AS p0, first_value(ph IGNORE NULLS) OVER f AS p1,
             last_value(case when a IS NOT NULL then year end IGNORE NULLS) OVER b AS y0, first_value(case when a IS NOT NULL then year end IGNORE NULLS) OVER f AS y1 FROM y
             WINDOW b AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT year, round(coalesce(m0, m1), 6) AS basin_sst_celsius_mean, round(coalesce(x0, x1), 6) AS basin_sst_celsius_max,
              round(case when a IS NOT NULL then a when a0 IS NULL then a1 when a1 IS NULL then a0 else a0 + (a1-a0)/(y1-y0)*(year-y0) end, 6) AS oni_anomaly_celsius,
              coalesce(p0, p1) AS enso_phase FROM w""",
)
def f2_climate(t):
    o = t.raw("orders")
    index = o.groupBy((1990 + F.col("o_orderkey") % 40).alias("year")).agg(F.avg("o_totalprice").alias("price"))
    # Expensive years are missing from the index, so that there are gaps to fill.
    index = index.where("price < 151e3").select("year", (F.col("price") / 1e5 - 1.5).alias("oni_anomaly_celsius"))
    index = index.withColumns({"season": F.lit("SON"), "enso_phase": ocean_phase("oni_anomaly_celsius")})
    sst = o.groupBy(F.year("o_orderdate").alias("year")).agg(
        (F.avg("o_totalprice") / 1e4).alias("basin_sst_celsius_mean"), (F.max("o_totalprice") / 1e4).alias("basin_sst_celsius_max")
    )
    return tidy(yeargrid.climate_summary(sst, index, 1992, 2019), 6)


@query(
    "f5_training_windows",
    """WITH s AS (SELECT l_suppkey % 25 AS region_id, cast(year(l_shipdate)*12 + month(l_shipdate) AS bigint) AS year, count(*) AS f FROM lineitem
                  WHERE month(l_shipdate) <> 7 GROUP BY 1, 2)
       SELECT a.region_id, a.year, (SELECT cast(sum(f) AS bigint) FROM s h WHERE h.region_id = a.region_id AND h.year BETWEEN a.year - hn + 1 AND a.year) AS history_sum, hn AS history_len,
              (SELECT cast(sum(f) AS bigint) FROM s h WHERE h.region_id = a.region_id AND h.year BETWEEN a.year + 1 AND a.year + 5) AS target_sum
       FROM (SELECT region_id, year, least(10, row_number() OVER (PARTITION BY region_id, run ORDER BY year)) AS hn, count(*) OVER (PARTITION BY region_id, run) AS len,
                    row_number() OVER (PARTITION BY region_id, run ORDER BY year) AS rn
             FROM (SELECT *, year - row_number() OVER (PARTITION BY region_id ORDER BY year) AS run FROM s) q) a
       WHERE hn >= 5 AND len - rn >= 5""",
)
def f5(t):
    rows = t.raw("lineitem").where(F.month("l_shipdate") != 7)
    s = rows.groupBy((F.col("l_suppkey") % 25).alias("region_id"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("year")).agg(F.count("*").alias("f"))
    w = yeargrid.training_windows(s, "f")

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)

    return longs(
        w.select("region_id", "year", total("history").alias("history_sum"), F.size("history").alias("history_len"), total("targets").alias("target_sum"))
    )


@query(
    "e31_attention_importance",
    """WITH p AS (SELECT unnest(embedding) AS w, unnest(range(64)) AS i FROM embeddings)
       SELECT 'feature_' || i AS feature_name, round(avg(w::double), 7) AS importance_score FROM p GROUP BY i""",
)
def e31(t):
    weights = t.raw("embeddings").select(F.col("embedding").cast("array<double>").alias("weights"))
    return rounded(yeargrid.attention_importance(weights, [f"feature_{i}" for i in range(64)]), 7)
