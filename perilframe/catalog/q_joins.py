"""Spatial, equi, interval and theta joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, explain, exposure, graph, hazard, pairs, portfolio, spatial, text, yeargrid
from ..plans import lake
from .common import (
    COAST_SQL,
    FIRST_YEAR,
    LAST_YEAR,
    LOCATION_YEARS_SQL,
    damage_sql,
    haversine_sql,
    millimetres_sql,
    rounded,
    tidy,
    wind_sql,
)
from .q_rowwise import BASIN_SQL, with_basin
from .registry import query

_PAIR_KM = haversine_sql("l.lat", "l.lon", "k.lat", "k.lon")
SNAP_SQL = """ax AS (SELECT DISTINCT lat AS v FROM grid), ay AS (SELECT DISTINCT lon AS v FROM grid),
    sx AS (SELECT location_id, arg_min(v, row(abs(v - lat), v)) AS grid_lat FROM locations, ax GROUP BY location_id),
    sy AS (SELECT location_id, arg_min(v, row(abs(v - lon), v)) AS grid_lon FROM locations, ay GROUP BY location_id),
    snapped AS (SELECT * FROM sx JOIN sy USING (location_id))"""


@query("d1_snap_to_grid", f"WITH {SNAP_SQL} SELECT location_id, grid_lat, grid_lon FROM snapped")
def d1(t):
    return spatial.snap_to_grid(t.locations, t.grid).select("location_id", "grid_lat", "grid_lon")


@query(
    "d2_grid_join",
    f"""WITH {SNAP_SQL} SELECT location_id, cell_obs_id, mslp_hpa, wind_speed_ms FROM snapped
        JOIN grid ON grid.lat = grid_lat AND grid.lon = grid_lon""",
)
def d2(t):
    return spatial.grid_join(t.locations, t.grid).select("location_id", "cell_obs_id", "mslp_hpa", "wind_speed_ms")


@query(
    "d2_snap_coverage",
    f"""WITH {SNAP_SQL}, c AS (SELECT DISTINCT lat, lon, 1 AS hit FROM grid),
        j AS (SELECT location_id, hit FROM snapped LEFT JOIN c ON c.lat = grid_lat AND c.lon = grid_lon)
        SELECT count(*) AS locations, count(hit) AS matched, round((count(*)-count(hit))*100/count(*), 4) AS unmatched_pct FROM j""",
)
def d2_coverage(t):
    return spatial.snap_coverage(t.locations, t.grid)


HISTORY_SQL = """hist AS (SELECT location_id, count(*) AS historical_claim_count, sum(incurred_loss_usd) AS historical_incurred_loss_usd,
    max(max_wind_experienced_kt) AS historical_max_wind_kt, avg(damage_ratio) AS historical_mean_damage_ratio,
    count(DISTINCT storm_id) AS distinct_storms_experienced FROM claims GROUP BY location_id)"""
HISTORY_OUT = """coalesce(historical_claim_count, 0) AS historical_claim_count, round(coalesce(historical_incurred_loss_usd, 0), 2) AS historical_incurred_loss_usd,
    coalesce(historical_max_wind_kt, 0) AS historical_max_wind_kt, round(coalesce(historical_mean_damage_ratio, 0), 10) AS historical_mean_damage_ratio,
    coalesce(distinct_storms_experienced, 0) AS distinct_storms_experienced"""
CLIMATE_SQL = """clim AS (SELECT location_id, avg(mslp_hpa) AS mslp_hpa_mean, min(mslp_hpa) AS mslp_hpa_min,
    avg(wind_speed_ms) AS era5_wind_speed_ms_mean, max(wind_speed_ms) AS era5_wind_speed_ms_max
    FROM snapped JOIN grid ON grid.lat = grid_lat AND grid.lon = grid_lon GROUP BY location_id)"""
CLIMATE_OUT = """round(mslp_hpa_mean, 9) AS mslp_hpa_mean, mslp_hpa_min, round(era5_wind_speed_ms_mean, 9) AS era5_wind_speed_ms_mean,
    era5_wind_speed_ms_max"""


def tidy_features(df):
    return tidy(df, 9, historical_mean_damage_ratio=10, historical_incurred_loss_usd=2, distance_to_coast_km=4)


@query(
    "d3_gold_features",
    f"""WITH {SNAP_SQL}, {CLIMATE_SQL}, {HISTORY_SQL} SELECT location_id, tiv_usd, {CLIMATE_OUT}, {HISTORY_OUT},
        round({COAST_SQL}, 4) AS distance_to_coast_km
        FROM locations LEFT JOIN clim USING (location_id) LEFT JOIN hist USING (location_id)""",
)
def d3(t):
    gold = lake.gold_features(t.locations, t.grid, t.claims)
    return tidy_features(gold.drop("lat", "lon", "region_code", "year_built", "construction_class", "roof_type"))


@query(
    "d3_missing_counts",
    f"""WITH {SNAP_SQL}, {CLIMATE_SQL} SELECT count(*) AS rows, count(*) - count(mslp_hpa_mean) AS missing_mslp_hpa_mean,
        count(*) - count(era5_wind_speed_ms_max) AS missing_era5_wind_speed_ms_max
        FROM locations LEFT JOIN clim USING (location_id)""",
)
def d3_missing(t):
    gold = lake.gold_features(t.locations, t.grid, t.claims)
    return exposure.missing_counts(gold, ["mslp_hpa_mean", "era5_wind_speed_ms_max"])


@query(
    "d4_zero_filled_universe",
    f"WITH {HISTORY_SQL} SELECT location_id, {HISTORY_OUT} FROM locations LEFT JOIN hist USING (location_id)",
)
def d4(t):
    return tidy_features(exposure.hazard_history(t.locations, t.claims))


@query("d5_location_years", LOCATION_YEARS_SQL)
def d5(t):
    return tidy(hazard.location_years(t.locations.select("location_id"), FIRST_YEAR, LAST_YEAR))


SST_SQL = """sst AS (SELECT year(obs_ts) AS y, avg(sst_celsius) AS basin_sst_celsius_mean, max(sst_celsius) AS basin_sst_celsius_max
    FROM grid WHERE sst_celsius IS NOT NULL AND NOT isnan(sst_celsius) GROUP BY 1)"""


@query(
    "d6_year_covariate",
    f"""WITH {SST_SQL}, x AS ({LOCATION_YEARS_SQL}) SELECT location_id, year, round(basin_sst_celsius_mean, 9) AS basin_sst_celsius_mean
        FROM x LEFT JOIN sst ON y - 26 = year""",
)
def d6(t):
    sst = hazard.basin_sst(t.grid).withColumn("year", F.col("year") - 26)
    years = hazard.location_years(t.locations.select("location_id"), FIRST_YEAR, LAST_YEAR)
    return tidy(years.join(sst.select("year", "basin_sst_celsius_mean"), "year", "left"), 9)


@query(
    "d7_claims_to_policies",
    "SELECT claim_id, policies.policy_id, limit_usd, deductible_usd, incurred_loss_usd FROM claims JOIN policies USING (location_id)",
)
def d7(t):
    claims = t.claims.select("claim_id", "location_id", "incurred_loss_usd")
    return claims.join(t.policies, "location_id").select(
        "claim_id", "policy_id", "limit_usd", "deductible_usd", "incurred_loss_usd"
    )


@query(
    "d8_radius_join",
    f"""WITH p AS (SELECT location_id, {_PAIR_KM} AS km FROM locations l, tracks k)
        SELECT location_id, count(*) AS pairs, round(sum(km), 3) AS total_km, round(min(km), 5) AS nearest_km
        FROM p WHERE km <= 400e0 GROUP BY location_id""",
)
def d8(t):
    near = spatial.radius_join(
        t.locations.select("location_id", "lat", "lon"), hazard.track_points(t.tracks, "obs_id"), 400.0, totals="left"
    )
    out = near.groupBy("location_id").agg(
        F.sum("pairs").alias("pairs"), F.sum("total_km").alias("total_km"), F.min("nearest_km").alias("nearest_km")
    )
    return rounded(out, 3, nearest_km=5)


@query(
    "d8_radius_join_shuffled",
    f"""WITH p AS (SELECT storm_id, {_PAIR_KM} AS km FROM locations l, tracks k)
        SELECT storm_id, count(*) AS pairs, round(avg(km), 5) AS mean_km FROM p WHERE km <= 150e0 GROUP BY storm_id""",
)
def d8_salted(t):
    near = spatial.radius_join(
        t.locations.select("location_id", "lat", "lon"), hazard.track_points(t.tracks, "storm_id"), 150.0, most=64, totals="right",
    )
    pairs, km = F.sum("pairs"), F.sum("total_km")
    return rounded(near.groupBy("storm_id").agg(pairs.alias("pairs"), (km / pairs).alias("mean_km")), 5)


@query("d9_distance_to_coast", f"SELECT location_id, round({COAST_SQL}, 5) AS distance_to_coast_km FROM locations")
def d9(t):
    return rounded(spatial.distance_to_coast(t.locations).select("location_id", "distance_to_coast_km"), 5)


@query(
    "d10_storm_distances",
    f"""WITH p AS (SELECT location_id, storm_id, {millimetres_sql(_PAIR_KM)} AS km, epoch_us(obs_ts)//1000000 AS s, max_wind_kt, min_pressure_mb
                   FROM locations l, tracks k WHERE {_PAIR_KM} <= 500e0)
        SELECT location_id, storm_id, min(km) AS min_distance_km, arg_min(max_wind_kt, row(km, s)) AS wind_at_closest_kt,
               arg_min(min_pressure_mb, row(km, s)) AS pressure_at_closest_mb FROM p GROUP BY location_id, storm_id""",
)
def d10(t):
    return spatial.storm_distances(t.tracks, t.locations)


KNN_SQL = f"""pr AS (SELECT l.location_id AS src, k.location_id AS dst, {millimetres_sql(_PAIR_KM)} AS distance_km
    FROM locations l JOIN locations k ON l.location_id <> k.location_id WHERE {_PAIR_KM} <= %s),
    knn AS (SELECT src, dst, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance_km, dst) AS n FROM pr) q WHERE n <= %d)"""


@query("d11_nearest_neighbours", f"WITH {KNN_SQL % ('100e0', 5)} SELECT src, dst, distance_km FROM knn")
def d11(t):
    return spatial.k_nearest(t.locations, 5, 100.0)


@query(
    "d12_basin_pairs",
    f"""WITH b AS ({BASIN_SQL}), h AS (SELECT coastal_basin, min(location_id) AS key_a FROM b GROUP BY 1)
        SELECT coastal_basin, key_a, location_id AS key_b FROM b JOIN h USING (coastal_basin) WHERE location_id <> key_a""",
)
def d12(t):
    return pairs.group_edges(with_basin(t), "coastal_basin")


CO_LOSS_SQL = """act AS (SELECT location_id FROM claims GROUP BY 1 HAVING count(*) >= 3),
    cy AS (SELECT location_id, cast(year(loss_date) AS bigint) AS y, sum(damage_ratio) AS v, count(*) AS n FROM claims
           WHERE location_id IN (SELECT location_id FROM act) GROUP BY 1, 2),
    full_ AS (SELECT a.location_id, c.y, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM act a CROSS JOIN (SELECT DISTINCT y FROM cy) c
              LEFT JOIN cy ON cy.location_id = a.location_id AND cy.y = c.y),
    co AS (SELECT a.location_id AS key_a, b.location_id AS key_b, corr(a.v, b.v) AS correlation,
                  sum(case when a.n + b.n >= 2 then a.n + b.n else 0 end) AS joint_claims
           FROM full_ a JOIN full_ b ON a.y = b.y AND a.location_id < b.location_id GROUP BY 1, 2),
    colo AS (SELECT * FROM co WHERE NOT isnan(correlation) AND abs(correlation) >= 3e-1 AND joint_claims >= 3)"""


@query(
    "d13_co_loss_pairs",
    f"""WITH {CO_LOSS_SQL} SELECT key_a, count(*) AS partners, round(sum(correlation), 3) AS total_correlation,
        cast(sum(joint_claims) AS bigint) AS joint_claims FROM colo GROUP BY key_a""",
)
def d13(t):
    out = pairs.co_loss_pairs(t.claims, per_key=True).withColumnRenamed("correlation", "total_correlation")
    return rounded(out, 3)


@query(
    "d14_shared_storms",
    f"""WITH {KNN_SQL % ('150e0', 10)}, seen AS (SELECT DISTINCT location_id, storm_id FROM locations l, tracks k WHERE {_PAIR_KM} <= 150e0),
        sh AS (SELECT src, dst, count(*) AS n FROM knn JOIN seen a ON a.location_id = src JOIN seen b ON b.location_id = dst AND a.storm_id = b.storm_id GROUP BY 1, 2)
        SELECT src, dst, cast(coalesce(n, 0) AS double) AS weight FROM knn LEFT JOIN sh USING (src, dst)""",
)
def d14(t):
    return graph.footprint_edges(t.tracks, t.locations, 10, 150.0)


@query(
    "d15_key_alignment",
    f"""WITH u AS (SELECT DISTINCT location_id FROM locations), c AS (SELECT location_id, year(loss_date) AS y FROM claims),
        e AS (SELECT user_id AS location_id, 1990 + event_id % 9 AS y FROM events),
        cy AS (SELECT DISTINCT y FROM c), ey AS (SELECT DISTINCT y FROM e)
        SELECT 'locations_in_exposure' AS metric, (SELECT count(*) FROM u) AS value
        UNION ALL SELECT 'locations_in_claims', (SELECT count(DISTINCT location_id) FROM c)
        UNION ALL SELECT 'missing_from_claims', (SELECT count(*) FROM u WHERE location_id NOT IN (SELECT location_id FROM c))
        UNION ALL SELECT 'orphaned_claims', (SELECT count(*) FROM c WHERE location_id NOT IN (SELECT location_id FROM u))
        UNION ALL SELECT 'locations_in_event_features', (SELECT count(DISTINCT location_id) FROM e)
        UNION ALL SELECT 'missing_from_event_features', (SELECT count(*) FROM u WHERE location_id NOT IN (SELECT location_id FROM e))
        UNION ALL SELECT 'orphaned_event_features', (SELECT count(*) FROM e WHERE location_id NOT IN (SELECT location_id FROM u))
        UNION ALL SELECT 'years_in_claims', (SELECT count(*) FROM cy)
        UNION ALL SELECT 'years_in_event_features', (SELECT count(*) FROM ey)
        UNION ALL SELECT 'year_overlap', (SELECT count(*) FROM cy WHERE y IN (SELECT y FROM ey))""",
)
def d15(t):
    ev = t.raw("events").select(F.col("user_id").alias("location_id"), (1990 + F.col("event_id") % 9).alias("year"))
    return exposure.alignment_report(t.locations, t.claims, ev)


_MITIGATION_VALUES = ", ".join(f"('{k}','{f}','{a}','{b}',{r}::double)" for k, f, a, b, r in explain.MITIGATIONS)


@query(
    "d16_mitigation_options",
    f"""WITH m(scenario_type, feature_changed, old, target_value, reduction) AS (VALUES {_MITIGATION_VALUES}),
        b AS (SELECT *, least(greatest(40e-2*exp(-{COAST_SQL}/40e0)+5e-2, 2e-2), 80e-2) AS base FROM locations),
        o AS (SELECT location_id, tiv_usd, base, scenario_type, feature_changed, case feature_changed when 'roof_type' then roof_type else construction_class end AS original_value,
                     target_value, reduction FROM b, m WHERE contains(case feature_changed when 'roof_type' then roof_type else construction_class end, old)
              UNION ALL SELECT location_id, tiv_usd, base, 'full_fortification', 'roof_type + construction_class', roof_type || ' / ' || construction_class,
                     'reinforced_hip / reinforced_concrete', 65e-2 FROM b)
        SELECT location_id, scenario_type, feature_changed, original_value, target_value, round_even(base, 4) AS baseline_damage_ratio,
               round_even(base*tiv_usd*15e-2, 2) AS baseline_annual_loss, round_even(base*(1-reduction)*tiv_usd*15e-2, 2) AS new_annual_loss,
               round_even(reduction*100, 1) AS pct_loss_reduction FROM o""",
)
def d16(t):
    out = explain.mitigation_options(spatial.distance_to_coast(t.locations))
    out = out.select(
        "location_id", "scenario_type", "feature_changed", "original_value", "target_value", "baseline_damage_ratio",
        "baseline_annual_loss", "new_annual_loss", "pct_loss_reduction",
    )
    return out


TOP_K_SQL = """n AS (SELECT vec_id, label, embedding::double[] AS e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x*x))) AS len FROM embeddings),
    sc AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e)/(a.len*b.len), 9) AS score FROM n a, n b),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 6)"""


def top_hits(t):
    e = t.raw("embeddings")
    return text.vector_top_k(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
        e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")),
    )


@query("d17_vector_top_k", f"WITH {TOP_K_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top")
def d17(t):
    return tidy(top_hits(t), 6)


@query(
    "d17_answer_or_refuse",
    f"WITH {TOP_K_SQL} SELECT query_id, round(max(score), 6) AS best_score, count(*) AS hits, max(score) >= 25e-2 AS answered FROM top GROUP BY query_id",
)
def d17_refuse(t):
    return rounded(text.accept_or_refuse(top_hits(t)), 6)


@query(
    "d18_baseline_forecast",
    """WITH r AS (SELECT region_code, cast(year(loss_date) AS bigint) AS y, cast(count(*) AS double) AS f FROM claims JOIN locations USING (location_id) GROUP BY 1, 2),
       m AS (SELECT region_code, avg(f) AS mu, arg_max(f, y) AS lv, regr_slope(f, y) AS sl, regr_intercept(f, y) AS ic FROM r WHERE y <= 1999 GROUP BY 1),
       tst AS (SELECT n_nationkey + 3 AS region_code, y FROM nation, range(2000, 2002) q(y))
       SELECT tst.region_code, tst.y AS year, round(coalesce(mu, 0), 4) AS mean_pred, round(coalesce(lv, 0), 4) AS persistence_pred,
              round(coalesce(sl*tst.y + ic, 0), 3) AS trend_pred FROM tst LEFT JOIN m USING (region_code)""",
)
def d18(t):
    joined = t.claims.join(t.locations.select("location_id", "region_code"), "location_id")
    series = joined.groupBy("region_code", F.year("loss_date").cast("long").alias("year")).agg(
        F.count("*").cast("double").alias("frequency")
    )
    fitted = yeargrid.fit_baselines(series.where(F.col("year") <= 1999), "frequency", key="region_code")
    test = t.raw("nation").select((F.col("n_nationkey") + 3).alias("region_code"))
    test = test.withColumn("year", F.explode(F.array(F.lit(2000), F.lit(2001))))
    return tidy(yeargrid.predict_baselines(test, fitted, key="region_code"), 4, trend_pred=3)


EVENTS_SQL = """ev AS (SELECT n_nationkey AS event_id, timestamp '1995-03-01 12:00:00' + to_days(cast(n_nationkey*90 AS integer)) AS day0 FROM nation),
    near AS (SELECT event_id, location_id, damage_ratio, incurred_loss_usd FROM claims, ev WHERE loss_date BETWEEN day0 - interval 7 day AND day0 + interval 7 day)"""


def near_events(t):
    start = F.lit("1995-03-01 12:00:00").cast("timestamp_ntz")
    ev = t.raw("nation").select(
        F.col("n_nationkey").cast("long").alias("event_id"),
        (start + F.make_dt_interval(F.col("n_nationkey") * 90)).cast("string").alias("event_ts"),
    )
    ev = ev.unionByName(ev.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("no date").alias("event_ts")))
    return events.claims_near_events(t.claims, ev)


@query(
    "d19_claims_near_events",
    f"WITH {EVENTS_SQL} SELECT event_id, count(*) AS claims, round(sum(incurred_loss_usd), 2) AS incurred_loss_usd FROM near GROUP BY event_id",
)
def d19(t):
    out = near_events(t).groupBy("event_id").agg(F.count("*").alias("claims"), F.sum("incurred_loss_usd").alias("incurred_loss_usd"))
    return rounded(out, 2)


@query(
    "d20_scenario_metrics",
    """WITH v AS (SELECT quantile_cont(annual_loss, 995e-3) AS var FROM annual_losses),
       m AS (SELECT max(var) AS value_at_risk, avg(annual_loss) FILTER (annual_loss >= var) AS tail_value_at_risk, avg(annual_loss) AS mean_annual_loss FROM annual_losses, v),
       s(scenario_id, mult) AS (VALUES ('baseline', 1e0), ('p100_1x', 135e-2), ('p200_1x', 16e-1), ('climate_change_1c', 115e-2), ('climate_change_2c', 13e-1), ('concentrated_coastal', 15e-1))
       SELECT scenario_id, round(value_at_risk*mult, 2) AS value_at_risk, round(tail_value_at_risk*mult, 2) AS tail_value_at_risk,
              round(mean_annual_loss*mult, 2) AS mean_annual_loss FROM m, s""",
)
def d20(t):
    base = portfolio.tail_metrics(t.annual_losses, t.locations.agg(F.sum("tiv_usd")).scalar())
    out = portfolio.scenario_metrics(base)
    return rounded(out.select("scenario_id", "value_at_risk", "tail_value_at_risk", "mean_annual_loss"), 2)


EVENT_LOSS_SQL = f"""near AS (SELECT DISTINCT storm_id FROM tracks WHERE lat BETWEEN 18e0 AND 36e0 AND lon BETWEEN -93e0 AND -74e0),
    k AS (SELECT * FROM tracks WHERE storm_id IN (SELECT storm_id FROM near)),
    p AS (SELECT location_id, storm_id, max_wind_kt, epoch_us(obs_ts)//1000000 AS s, epoch_us(obs_ts) AS us, {_PAIR_KM} AS km FROM locations l, k),
    w AS (SELECT location_id, storm_id, s, us, floor({wind_sql("km")}*1e6+5e-1)/1e6 AS wind FROM p WHERE km <= 400e0),
    pk AS (SELECT location_id, storm_id, max(wind) AS wind, arg_min(us, row(-wind, s)) AS us FROM w GROUP BY 1, 2),
    r AS (SELECT pk.*, tiv_usd, {damage_sql("wind")} AS ratio FROM pk JOIN locations USING (location_id) WHERE wind >= 50e0),
    i AS (SELECT r.*, policy_id, deductible_usd, limit_usd, round_even(ratio*tiv_usd, 2) AS incurred FROM r JOIN policies USING (location_id) WHERE ratio >= 5e-3),
    losses AS (SELECT location_id, policy_id, storm_id, us, wind, ratio, incurred AS incurred_loss_usd,
               round_even(least(greatest(incurred - deductible_usd, 0), limit_usd), 2) AS paid_loss_usd FROM i)"""


def event_losses(t):
    return hazard.event_losses(t.locations, t.policies, t.tracks)


_TOP_SQL = f"""WITH {EVENT_LOSS_SQL} SELECT storm_id, count(*) AS claims, round(sum(incurred_loss_usd), 2) AS incurred_loss_usd,
    round(sum(paid_loss_usd), 2) AS paid_loss_usd FROM losses GROUP BY storm_id ORDER BY sum(incurred_loss_usd) DESC, storm_id LIMIT 10"""


@query("e8_top_events", _TOP_SQL)
def e8(t):
    return rounded(lake.headline(t.locations, t.policies, t.tracks), 2)


@query(
    "e7_event_losses",
    f"""WITH {EVENT_LOSS_SQL} SELECT location_id, policy_id, storm_id, us AS loss_us, wind AS max_wind_experienced_kt,
        round(ratio, 9) AS damage_ratio, incurred_loss_usd, paid_loss_usd FROM losses""",
)
def e7(t):
    e = event_losses(t)
    micros = F.unix_micros(F.from_utc_timestamp(F.col("loss_date").cast("timestamp"), F.current_timezone()))
    out = e.select(
        "location_id", "policy_id", "storm_id", micros.alias("loss_us"), "max_wind_experienced_kt",
        F.round("damage_ratio", 9).alias("damage_ratio"), "incurred_loss_usd", "paid_loss_usd",
    )
    return out


@query(
    "e9_book_totals",
    f"""WITH {EVENT_LOSS_SQL} SELECT count(*) AS claims, count(DISTINCT location_id) AS locations, max(wind) AS max_wind_kt,
        round(sum(incurred_loss_usd), 2) AS incurred_loss_usd, round(sum(paid_loss_usd), 2) AS paid_loss_usd FROM losses""",
)
def e9(t):
    return rounded(hazard.event_summary(event_losses(t)), 2, max_wind_kt=6)


@query(
    "e6_peak_winds",
    f"""WITH p AS (SELECT location_id, storm_id, max_wind_kt, epoch_us(obs_ts)//1000000 AS s, epoch_us(obs_ts) AS us, {_PAIR_KM} AS km FROM locations l, tracks k),
        w AS (SELECT location_id, storm_id, s, us, floor({wind_sql("km")}*1e6+5e-1)/1e6 AS wind FROM p WHERE km <= 400e0)
        SELECT location_id, storm_id, max(wind) AS max_wind_experienced_kt, arg_min(us, row(-wind, s)) AS loss_us FROM w GROUP BY 1, 2""",
)
def e6(t):
    peaks = hazard.peak_winds(t.tracks, t.locations)
    micros = F.unix_micros(F.from_utc_timestamp(F.col("loss_date").cast("timestamp"), F.current_timezone()))
    return peaks.select("location_id", "storm_id", "max_wind_experienced_kt", micros.alias("loss_us"))


@query(
    "e5_yearly_event_features",
    f"""WITH p AS (SELECT location_id, storm_id, obs_year, max_wind_kt, min_pressure_mb, {_PAIR_KM} AS km FROM locations l, tracks k),
        a AS (SELECT location_id, cast(obs_year AS bigint) AS year, count(DISTINCT storm_id) AS storm_count, min(km) AS km, max(max_wind_kt) AS w, min(min_pressure_mb) AS mb,
              {", ".join(f"count(*) FILTER (max_wind_kt >= {v}) AS d{v}" for v in (34, 50, 64, 100))} FROM p WHERE km <= 500e0 GROUP BY 1, 2),
        x AS ({LOCATION_YEARS_SQL.replace(str(LAST_YEAR + 1), str(LAST_YEAR + 3))})
        SELECT x.location_id, x.year, coalesce(storm_count, 0) AS storm_count, round(km, 4) AS min_distance_to_track_km, coalesce(w, 0) AS max_wind_nearby_kt,
               mb AS min_pressure_nearby_mb, {", ".join(f"coalesce(d{v}, 0) AS days_above_{v}kt" for v in (34, 50, 64, 100))} FROM x LEFT JOIN a USING (location_id, year)""",
)
def e5(t):
    return tidy(hazard.yearly_event_features(t.tracks, t.locations, FIRST_YEAR, LAST_YEAR + 2))


