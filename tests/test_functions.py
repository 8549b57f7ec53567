"""Golden values and invariants of the Column functions."""

import math

import pytest
from pyspark.sql import functions as F

from perilframe.functions import draws, geo, hazard, labels


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_haversine_known_distance(rows):
    df = rows([(25.7617, -80.1918, 28.5383, -81.3792), (0.0, 0.0, 0.0, 0.0), (10.0, 20.0, -10.0, -160.0)], "a double, b double, c double, d double")
    km = [r[0] for r in values(df, geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")))]
    assert 320 < km[0] < 345 and km[1] == 0.0
    assert km[2] == pytest.approx(math.pi * 6371.0, rel=1e-6)


def test_chord_agrees_with_haversine(rows):
    df = rows([(24.5, -87.5, 31.0, -80.0), (25.0, -80.0, 25.0001, -80.0)], "a double, b double, c double, d double")
    direct = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    chord = geo.chord_sq_to_km(geo.chord_sq(geo.unit_vector(F.col("a"), F.col("b")), geo.unit_vector(F.col("c"), F.col("d"))))
    for x, y in values(df, direct, chord):
        assert x == pytest.approx(y, abs=1e-6)


def test_short_distance_series(rows):
    df = rows([(x,) for x in (0.0, 1e-9, 1.0, 120.0, 399.99, 500.0)], "km double")
    for km, fast, slow in values(df, "km", geo.chord_sq_to_km(geo.chord_sq_limit(F.col("km")), 500.0), geo.chord_sq_to_km(geo.chord_sq_limit(F.col("km")))):
        assert fast == pytest.approx(km, rel=1e-12, abs=1e-12) and fast == pytest.approx(slow, rel=1e-12, abs=1e-12)


def test_rmw_and_wind(rows):
    df = rows([(20.0, 0.0), (120.0, 10.0), (120.0, 200.0), (300.0, 50.0)], "w double, d double")
    rmw = hazard.max_wind_radius_km("w")
    got = values(df, rmw, hazard.wind_at_distance("w", "d", rmw))
    assert all(15.0 <= r <= 60.0 for r, _ in got)
    assert got[1][1] == 120.0  # on the track
    assert got[2][1] == pytest.approx(120.0 * math.sqrt(32.0 / 200.0))


def test_damage_order_and_unknown_class(rows):
    df = rows([(c, r) for c in hazard.CONSTRUCTION_CURVES for r in hazard.ROOF_SHIFTS], "construction_class string, roof_type string")
    got = {(c, r): x for c, r, x in values(df, "construction_class", "roof_type", hazard.damage_ratio(F.lit(110.0)))}
    assert got["frame", "gable"] > got["masonry_veneer", "gable"] > got["masonry_cbs", "gable"] > got["reinforced_concrete", "gable"]
    assert got["frame", "flat"] > got["frame", "gable"] > got["frame", "hip"]
    bad = rows([("straw", "hip")], "construction_class string, roof_type string")
    with pytest.raises(Exception, match="unknown construction class: straw"):
        bad.select(hazard.damage_ratio(F.lit(100.0))).collect()


def test_policy_terms_round_half_to_even(rows):
    df = rows([(2500.0, 1.0, 0.1, "2020-02-29")], "tiv double, ratio double, pct double, eff string").withColumn("eff", F.col("eff").cast("date"))
    t = hazard.policy_terms("tiv", "ratio", "pct", "eff")
    assert values(df, t["limit_usd"], t["deductible_usd"], t["expiry_date"].cast("string")) == [(2000.0, 200.0, "2021-02-28")]


def test_basin_defaults_to_inland(rows):
    df = rows([(10.0, -86.0), (10.0, -85.0), (10.0, -81.0), (10.0, -80.0), (60.0, -81.0), (float("nan"), -81.0), (None, -81.0)], "d double, x double")
    got = [r[0] for r in values(df, labels.coastal_basin("d", "x"))]
    assert got == ["western_gulf", "eastern_gulf", "florida_atlantic", "atlantic_north", "inland", "inland", "inland"]


def test_missing_values(rows):
    df = rows([(1.5,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in values(df, labels.finite_or_zero("x"))] == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert df.where(labels.is_present("x")).count() == 3


def test_uniform_draws_look_uniform(spark):
    u = spark.range(200).select(F.col("id").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(200))))
    u = u.select("a", draws.uniform(F.col("a"), F.col("b"), 42).alias("u"))
    stats = u.agg(F.avg("u"), F.stddev_pop("u"), F.min("u"), F.max("u")).first()
    assert abs(stats[0] - 0.5) < 0.01 and abs(stats[1] - 1 / math.sqrt(12)) < 0.01 and stats[2] >= 0 and stats[3] < 1
    per_season = u.groupBy("a").agg(F.avg("u").alias("m")).agg(F.stddev_pop("m")).first()[0]
    assert 0.015 < per_season < 0.026  # independent cells give about 0.0204
