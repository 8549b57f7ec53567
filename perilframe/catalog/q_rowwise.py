"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, hazard, labels
from ..operators import encode, exposure, hazard as hz, metrics, portfolio, spatial, support
from .common import COAST_SQL, RMW_SQL, damage_sql, haversine_sql, rounded, tidy, wind_sql
from .registry import query

MIAMI = (25.7617, -80.1918)
_TO_MIAMI = haversine_sql("lat", "lon", "25.7617e0", "-80.1918e0")


@query("c1_haversine", f"SELECT location_id, round({_TO_MIAMI}, 6) AS km FROM locations")
def c1(t):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(MIAMI[0]), F.lit(MIAMI[1]))
    return t.locations.select("location_id", F.round(km, 6).alias("km"))


@query("c2_radius_of_max_wind", f"SELECT obs_id, round({RMW_SQL}, 6) AS rmw_km FROM tracks")
def c2(t):
    return t.tracks.select("obs_id", F.round(hazard.max_wind_radius_km("max_wind_kt"), 6).alias("rmw_km"))


@query(
    "c3_wind_decay",
    f"WITH d AS (SELECT obs_id, max_wind_kt, {_TO_MIAMI} AS km FROM tracks) "
    f"SELECT obs_id, round({wind_sql('km')}, 6) AS wind_kt FROM d",
)
def c3(t):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(MIAMI[0]), F.lit(MIAMI[1]))
    felt = hazard.wind_at_distance("max_wind_kt", "km", hazard.max_wind_radius_km("max_wind_kt"))
    return t.tracks.withColumn("km", km).select("obs_id", F.round(felt, 6).alias("wind_kt"))


@query(
    "c4_damage_ratio",
    f"SELECT location_id, round({damage_sql('(40e0 + location_id % 120)')}, 9) AS damage_ratio FROM locations",
)
def c4(t):
    wind = 40.0 + F.col("location_id") % 120
    return t.locations.select("location_id", F.round(hazard.damage_ratio(wind), 9).alias("damage_ratio"))


@query(
    "c5_policy_terms",
    """WITH j AS (SELECT claim_id, round_even(damage_ratio*tiv_usd, 2) AS incurred_loss_usd, deductible_usd, limit_usd
       FROM claims JOIN locations USING (location_id) JOIN policies USING (location_id))
       SELECT claim_id, incurred_loss_usd,
              round_even(least(greatest(incurred_loss_usd - deductible_usd, 0), limit_usd), 2) AS paid_loss_usd FROM j""",
)
def c5(t):
    book = t.locations.join(t.policies.select("location_id", "deductible_usd", "limit_usd"), "location_id")
    j = t.claims.select("claim_id", "location_id", "damage_ratio").join(book, "location_id")
    j = j.withColumn("incurred_loss_usd", hazard.incurred_loss("damage_ratio", "tiv_usd"))
    paid = hazard.paid_loss("incurred_loss_usd", "deductible_usd", "limit_usd")
    return j.select("claim_id", "incurred_loss_usd", paid.alias("paid_loss_usd"))


@query(
    "c6_storms_in_box",
    "SELECT DISTINCT storm_id FROM tracks WHERE lat BETWEEN 24e0 AND 26e0 AND lon BETWEEN -84e0 AND -82e0",
)
def c6(t):
    box = {"lat_min": 24.0, "lat_max": 26.0, "lon_min": -84.0, "lon_max": -82.0}
    return hz.storms_in_box(t.tracks, box).orderBy("storm_id")


@query(
    "c7_year_range",
    """SELECT claim_id, cast(year(loss_date) AS bigint) AS year, incurred_loss_usd FROM claims
       WHERE year(loss_date) BETWEEN 1996 AND 1999""",
)
def c7(t):
    year = F.year("loss_date").cast("long")
    return t.claims.select("claim_id", year.alias("year"), "incurred_loss_usd").where(F.col("year").between(1996, 1999))


@query("c8_present_values", "SELECT cell_obs_id, sst_celsius FROM grid WHERE sst_celsius IS NOT NULL AND NOT isnan(sst_celsius)")
def c8(t):
    return t.grid.where(labels.is_present("sst_celsius")).select("cell_obs_id", "sst_celsius")


BASIN_SQL = f"""SELECT location_id, case when not (km <= 50e0) then 'inland' when lon < -85e0 then 'western_gulf'
    when lon < -82e0 then 'eastern_gulf' when lon < -80e0 then 'florida_atlantic' else 'atlantic_north' end AS coastal_basin
    FROM (SELECT location_id, lon, {COAST_SQL} AS km FROM locations) x"""


def with_basin(t):
    coast = spatial.distance_to_coast(t.locations)
    return coast.withColumn("coastal_basin", labels.coastal_basin("distance_to_coast_km", "lon"))


@query("c9_coastal_basin", BASIN_SQL)
def c9(t):
    return with_basin(t).select("location_id", "coastal_basin")


@query(
    "c10_ocean_phase",
    """SELECT obs_id, case when a >= 5e-1 then 'el_nino' when a <= -5e-1 then 'la_nina' else 'neutral' end AS enso_phase
       FROM (SELECT obs_id, (obs_id % 41 - 20)/10e0 AS a FROM tracks) x""",
)
def c10(t):
    a = t.tracks.select("obs_id", ((F.col("obs_id") % 41 - 20) / 10.0).alias("a"))
    return a.select("obs_id", labels.ocean_phase("a").alias("enso_phase"))


@query(
    "c11_z_scores",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("lat", "lon", "tiv_usd", "year_built"))
    + " FROM locations) SELECT location_id, "
    + ", ".join(f"round(({c}-m_{c})/(s_{c}+1e-8), 6) AS z_{c}" for c in ("lat", "lon", "tiv_usd", "year_built"))
    + " FROM locations, s",
)
def c11(t):
    cols = ["lat", "lon", "tiv_usd", "year_built"]
    z = encode.z_scores(t.locations, cols)
    return rounded(z.select("location_id", *[f"z_{c}" for c in cols]), 6)


@query(
    "c12_one_hot",
    "SELECT location_id, "
    + ", ".join(
        f"cast({c} = '{v}' AS bigint) AS {c}_{v}"
        for c, vs in (("construction_class", ("frame", "masonry_cbs", "masonry_veneer")), ("roof_type", ("flat", "gable", "hip")))
        for v in vs
    )
    + " FROM locations",
)
def c12(t):
    train = t.locations.where(F.col("construction_class") != "reinforced_concrete")
    known = encode.categories(train, ["construction_class", "roof_type"])
    coded = encode.one_hot(t.locations.select("location_id", "construction_class", "roof_type"), known)
    return tidy(coded)


@query(
    "c13_finite_numbers",
    "SELECT cell_obs_id, case when sst_celsius IS NULL OR isnan(sst_celsius) OR isinf(sst_celsius) then 0e0 else sst_celsius end AS sst_celsius FROM grid",
)
def c13(t):
    return encode.clean_numbers(t.grid.select("cell_obs_id", "sst_celsius"), ["sst_celsius"])


@query(
    "c14_score_multiplier",
    """WITH s AS (SELECT location_id, sum(damage_ratio) AS score FROM claims GROUP BY location_id),
       m AS (SELECT avg(score) AS a, stddev_pop(score) AS d FROM s)
       SELECT location_id, round(case when d > 0 then 1 + 5e-1*tanh((score-a)/d) else 1e0 end, 6) AS multiplier FROM s, m""",
)
def c14(t):
    s = t.claims.groupBy("location_id").agg(F.sum("damage_ratio").alias("score"))
    return rounded(encode.score_multiplier(s, "score").select("location_id", "multiplier"), 6)


@query(
    "c15_beta_parameters",
    """WITH m AS (SELECT location_id, least(greatest(avg(damage_ratio), 1e-2), 99e-2) AS mu FROM claims GROUP BY location_id),
       v AS (SELECT location_id, mu, least(pow(mu*5e-1, 2), mu*(1-mu)*99e-2) AS var FROM m)
       SELECT location_id, round(least(greatest(mu*(mu*(1-mu)/var-1), 1e-1), 1e2), 8) AS alpha,
              round(least(greatest((1-mu)*(mu*(1-mu)/var-1), 1e-1), 1e2), 8) AS beta FROM v""",
)
def c15(t):
    m = t.claims.groupBy("location_id").agg(F.avg("damage_ratio").alias("severity"))
    return rounded(m.withColumns(portfolio.beta_parameters("severity")).select("location_id", "alpha", "beta"), 8)


@query("c16_log_loss_column", "SELECT claim_id, round(ln(1+incurred_loss_usd), 6) AS log1p_incurred_loss_usd FROM claims")
def c16(t):
    logged = encode.log_column(t.claims, "incurred_loss_usd")
    return rounded(logged.select("claim_id", "log1p_incurred_loss_usd"), 6)


@query("c17_name_filter", "SELECT n_nationkey, n_name FROM nation WHERE upper(n_name) = 'NATION_7'")
def c17(t):
    return t.raw("nation").where(labels.name_is("n_name", "nation_7")).select("n_nationkey", "n_name")


_WORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in labels.SCENARIO_WORDS)


@query("c18_keyword_flag", f"SELECT conv_id, turn, ({_WORDS} OR contains(lower(text), 'th')) AS flagged FROM conversations")
def c18(t):
    words = (*labels.SCENARIO_WORDS, "th")
    return t.raw("conversations").select("conv_id", "turn", labels.mentions_any("text", words).alias("flagged"))


CLASSES = [f"class_{i}" for i in range(64)]
CLASSIFIED_SQL = """c AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::double - list_max(embedding)::double)) AS e,
       list_position(embedding, list_max(embedding)) AS pos FROM embeddings),
   classified AS (SELECT vec_id, label, 'class_' || (pos-1) AS predicted_class, e[pos]/list_sum(e) AS confidence FROM c)"""


def classified(t):
    scores = F.transform("embedding", lambda x: x.cast("double"))
    return metrics.classify(t.raw("embeddings").select("vec_id", "label", scores.alias("scores")), "scores", CLASSES)


@query(
    "c19_class_scores",
    f"WITH {CLASSIFIED_SQL} SELECT vec_id, predicted_class, round(confidence, 6) AS confidence FROM classified",
)
def c19(t):
    return rounded(classified(t).select("vec_id", "predicted_class", "confidence"), 6)


@query("c20_required_columns", "SELECT count(*) AS policies, sum(limit_usd) AS limit_usd FROM policies")
def c20(t):
    checked = support.require_columns(t.policies, ["policy_id", "location_id", "limit_usd", "deductible_usd"], "policies")
    return checked.agg(F.count("*").alias("policies"), F.sum("limit_usd").alias("limit_usd"))


@query(
    "c21_default_columns",
    """SELECT location_id, '' AS metro_center, roof_type, 0e0 AS distance_to_coast_km, 281e-1 AS basin_sst_celsius_mean,
       359e-1 AS basin_sst_celsius_max FROM locations""",
)
def c21(t):
    out = support.add_default_columns(t.locations, exposure.FEATURE_DEFAULTS)
    return out.select(
        "location_id", "metro_center", "roof_type", "distance_to_coast_km", "basin_sst_celsius_mean", "basin_sst_celsius_max"
    )


@query(
    "c22_policy_derivation",
    """WITH b AS (SELECT location_id, round_even(tiv_usd*(75e-2 + (location_id % 26)*1e-2)/1e3, 0)*1e3 AS limit_usd, deductible_pct,
                 date '2015-01-01' + cast(location_id % 3000 AS integer) AS effective_date
          FROM locations JOIN policies USING (location_id))
       SELECT location_id, limit_usd, round_even(limit_usd*deductible_pct/1e2, 0)*1e2 AS deductible_usd,
              strftime(effective_date + interval 1 year, '%Y-%m-%d') AS expiry_date FROM b""",
)
def c22(t):
    base = t.locations.join(t.policies.select("location_id", "deductible_pct"), "location_id")
    base = base.withColumns(
        {
            "coverage_ratio": F.lit(0.75) + (F.col("location_id") % 26) * F.lit(0.01),
            "effective_date": F.date_add(F.lit("2015-01-01").cast("date"), (F.col("location_id") % 3000).cast("int")),
        }
    )
    terms = hazard.policy_terms("tiv_usd", "coverage_ratio", "deductible_pct", "effective_date")
    return base.select(
        "location_id", terms["limit_usd"].alias("limit_usd"), terms["deductible_usd"].alias("deductible_usd"),
        F.date_format(terms["expiry_date"], "yyyy-MM-dd").alias("expiry_date"),
    )


@query(
    "c23_loss_layer",
    """WITH l AS (SELECT least(greatest(annual_loss - 8e5, 0), 5e5) AS layered FROM annual_losses)
       SELECT count(*) AS seasons, count(*) FILTER (layered > 0) AS seasons_hit, round(avg(layered), 4) AS mean_layer_loss,
              round(avg(layered)/5e5, 8) AS rate_on_line FROM l""",
)
def c23(t):
    return rounded(portfolio.layer_price(t.annual_losses, 8e5, 5e5), 4, rate_on_line=8)


RAW_GRID_SQL = """raw AS (SELECT cell_obs_id, lat, lon, obs_ts, case when cell_obs_id % 7 = 0 then null else sst_celsius + 27315e-2 end AS sst,
        case when cell_obs_id % 7 = 0 then null else mslp_hpa*1e2 end AS msl, case when cell_obs_id % 7 = 0 then null else wind_speed_ms*6e-1 end AS u10,
        wind_speed_ms*8e-1 AS v10 FROM grid)"""


@query(
    "a6_grid_units",
    f"""WITH {RAW_GRID_SQL}, n AS (SELECT lat, lon, epoch_us(obs_ts) AS at_us, case when isnan(sst) then null else sst end - 27315e-2 AS sst_celsius,
          msl/1e2 AS mslp_hpa, sqrt(u10*u10+v10*v10) AS wind_speed_ms FROM raw)
        SELECT lat, lon, at_us, round(sst_celsius, 6) AS sst_celsius, round(mslp_hpa, 6) AS mslp_hpa, round(wind_speed_ms, 6) AS wind_speed_ms
        FROM n WHERE NOT (sst_celsius IS NULL AND mslp_hpa IS NULL AND wind_speed_ms IS NULL)""",
)
def a6(t):
    gone = F.col("cell_obs_id") % 7 == 0
    raw = t.grid.select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("obs_ts").alias("valid_time"),
        F.when(~gone, F.col("sst_celsius") + 273.15).alias("sst"), F.when(~gone, F.col("mslp_hpa") * 100.0).alias("msl"),
        F.when(~gone, F.col("wind_speed_ms") * 0.6).alias("u10"), (F.col("wind_speed_ms") * 0.8).alias("v10"),
    )
    flat = hz.normalise_grid(raw)
    micros = F.unix_micros(F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), F.current_timezone()))
    return rounded(flat.select("lat", "lon", micros.alias("at_us"), "sst_celsius", "mslp_hpa", "wind_speed_ms"), 6)


