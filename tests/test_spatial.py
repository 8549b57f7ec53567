"""Joins in space against brute force, with hot cells, poles and the date line."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from perilframe.operators import celltree, hazard, pairs, spatial


def km(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def world(n, seed):
    """A third of all points on one spot; others around the poles, the date line and Florida."""
    rnd = random.Random(seed)
    pts = []
    for i in range(n):
        if i % 3 == 0:
            pts.append((27.5, -81.5))
        elif i % 3 == 1:
            pts.append((rnd.uniform(24, 31), rnd.uniform(-88, -79)))
        else:
            pts.append((rnd.choice([rnd.uniform(84, 90), rnd.uniform(-90, -84), rnd.uniform(-5, 5)]), rnd.choice([rnd.uniform(175, 180), rnd.uniform(-180, -175)])))
    return pts


@pytest.mark.parametrize("options", [{}, {"most": 1}, {"most": 5, "share": 3}, {"most": 1000, "share": 1}])
def test_radius_join_is_brute_force(rows, options):
    left, right = world(120, 1), world(90, 2)
    a = rows([(i, *p) for i, p in enumerate(left)], "a int, lat double, lon double")
    b = rows([(i, *p) for i, p in enumerate(right)], "b int, track_lat double, track_lon double")
    got = {(r.a, r.b): r.distance_km for r in spatial.radius_join(a, b, 400.0, **options).select("a", "b", "distance_km").collect()}
    want = {(i, j): km(p, q) for i, p in enumerate(left) for j, q in enumerate(right) if km(p, q) <= 400.0}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_radius_join_has_no_duplicates_and_takes_own_reach(rows):
    left, right = world(60, 3), world(60, 4)
    a = rows([(i, *p) for i, p in enumerate(left)], "a int, lat double, lon double")
    b = rows([(i, *p, 50.0 + 10 * (i % 20)) for i, p in enumerate(right)], "b int, track_lat double, track_lon double, own double")
    for options in ({}, {"most": 4, "share": 2}):
        got = [(r.a, r.b) for r in spatial.radius_join(a, b, 400.0, reach="own", **options).select("a", "b").collect()]
        want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if km(p, q) <= 50.0 + 10 * (j % 20)}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("search", [64, 1])
def test_k_nearest_is_exact_with_copies(rows, search, monkeypatch):
    monkeypatch.setattr(spatial, "SEARCH_ROWS", search)
    pts = world(90, 5)
    df = rows([(i, *p) for i, p in enumerate(pts)], "location_id long, lat double, lon double")
    got = {}
    for r in spatial.k_nearest(df, 4, 300.0).collect():
        got.setdefault(r.src, []).append((round(r.distance_km, 3), r.dst))
    for i, p in enumerate(pts):
        near = sorted((math.floor(km(p, q) * 1e6 + 0.5), j) for j, q in enumerate(pts) if j != i and km(p, q) <= 300.0)[:4]
        assert sorted(got.get(i, [])) == sorted((round(d / 1e6, 3), j) for d, j in near), i


def test_snap_ties_and_edges(rows):
    grid = rows([(a, b) for a in (24.0, 25.0) for b in (-81.0, -80.0)], "lat double, lon double")
    loc = rows([(1, 24.5, -80.5), (2, 30.0, -70.0), (3, 24.9, -81.4)], "location_id int, lat double, lon double")
    got = {r.location_id: (r.grid_lat, r.grid_lon) for r in spatial.snap_to_grid(loc, grid).collect()}
    assert got == {1: (24.0, -81.0), 2: (25.0, -80.0), 3: (25.0, -81.0)}
    with pytest.raises(Exception, match="not a grid axis"):
        spatial.snap_to_grid(loc, grid, max_axis_values=1).collect()


def test_grid_join_rows(rows):
    grid = rows([(25.0, -80.0, t, 29.0) for t in (1, 2)] + [(27.0, -82.0, t, 27.0) for t in (1, 2)], "lat double, lon double, ts int, sst double")
    loc = rows([(1, 25.1, -80.1), (2, 26.9, -82.0)], "location_id int, lat double, lon double")
    out = spatial.grid_join(loc, grid).collect()
    assert len(out) == 4 and {r.sst for r in out if r.location_id == 1} == {29.0}


@pytest.mark.parametrize("pairs", [spatial.GRID_PAIRS, 60, 1])
def test_grid_join_writes_cell_by_cell(rows, pairs):
    """Grid rows arrive with their cells mixed, the joined rows leave cell by cell; a crowded cell is dealt over shares, and none is lost."""
    nan = float("nan")
    spots = [(25.0, -80.0), (27.0, -82.0), (29.0, -84.0), (25.0, -84.0)]
    obs = [(*spots[i % 3], i // 6, (None, nan, 27.0)[i % 5 % 3]) for i in range(120)] + [(None, -80.0, 1, 1.0), (25.0, None, 1, 1.0)]
    grid = rows(obs, "lat double, lon double, ts int, sst double")
    stands = [(i, 25.1 + 2 * (i % 2), -80.1 - 2 * (i % 2)) for i in range(20)] + [(3, 27.1, -82.1), (3, 27.1, -82.1), (None, 25.0, -80.0), (50, 25.0, -84.0)]
    loc = rows(stands, "location_id int, lat double, lon double")
    out = spatial.grid_join(loc, grid, pairs)
    got = [(str(r.location_id), r.grid_lat, r.grid_lon, str(r.ts), str(r.sst)) for r in out.collect()]
    cell = lambda lat, lon: min(spots, key=lambda c: abs(c[0] - lat) + abs(c[1] - lon))
    expected = [(str(i), *cell(lat, lon), str(ts), str(sst)) for i, lat, lon in stands for a, b, ts, sst in obs if (a, b) == cell(lat, lon)]
    assert sorted(got) == sorted(expected) and out.columns[:3] == ["ts", "sst", "location_id"]
    shares = len({r[0] for r in out.select(F.spark_partition_id()).distinct().collect()})
    assert shares > 1
    changes = sum(a[1:3] != b[1:3] for a, b in zip(got, got[1:], strict=False))
    assert changes < 2 * spatial.COPIES  # of up to 120, were they in the order of the grid


def test_event_losses_terms_and_far_storm(rows):
    loc = rows([("A", 25.0, -80.0, "frame", "gable", 300000.0), ("B", 25.3, -80.2, "masonry_cbs", "hip", 500000.0)], "location_id string, lat double, lon double, construction_class string, roof_type string, tiv_usd double")
    pol = rows([("A", "P1", 6000.0, 100000.0), ("B", "P2", 10000.0, 500000.0)], "location_id string, policy_id string, deductible_usd double, limit_usd double")
    near = [("S1", "2005-08-25 00:00:00", 25.1, -80.15, 130.0), ("S1", "2005-08-25 06:00:00", 25.15, -80.1, 130.0)]
    far = [("S2", "2006-08-25 00:00:00", 19.0, -92.0, 130.0)]
    schema = "storm_id string, obs_ts string, lat double, lon double, max_wind_kt double"

    def tracks(data):
        return rows(data, schema).withColumn("obs_ts", F.col("obs_ts").cast("timestamp_ntz"))

    out = hazard.event_losses(loc, pol, tracks(near + far)).collect()
    assert {(r.location_id, r.storm_id) for r in out} == {("A", "S1"), ("B", "S1")}
    terms = {"P1": (6000.0, 100000.0), "P2": (10000.0, 500000.0)}
    for r in out:
        ded, limit = terms[r.policy_id]
        assert r.paid_loss_usd == pytest.approx(min(max(r.incurred_loss_usd - ded, 0), limit), abs=0.01)
        assert r.paid_loss_usd <= r.incurred_loss_usd and r.max_wind_experienced_kt == 130.0
    assert {str(r.loss_date) for r in out if r.location_id == "A"} == {"2005-08-25 00:00:00"}  # first of equal peaks
    assert hazard.event_losses(loc, pol, tracks(far)).count() == 0


def test_floor_does_not_change_peaks(rows):
    rnd = random.Random(9)
    loc = rows([(i, rnd.uniform(24, 31), rnd.uniform(-88, -79)) for i in range(40)], "location_id int, lat double, lon double")
    obs = rows([(i % 5, i, rnd.uniform(22, 33), rnd.uniform(-90, -77), rnd.uniform(30, 260)) for i in range(80)], "storm_id int, s int, lat double, lon double, max_wind_kt double")
    obs = obs.withColumn("obs_ts", F.timestamp_seconds("s"))
    everything = hazard.peak_winds(obs, loc).where("max_wind_experienced_kt >= 50")
    floored = hazard.peak_winds(obs, loc, floor_kt=50.0)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(everything) == key(floored)


def test_group_edges_tie_every_member_to_the_first(rows):
    data = [(i, "big" if i % 3 else "small") for i in range(60)] + [(100, "one"), (101, None), (1, "big"), (None, "big")]
    got = sorted((r.g, r.key_a, r.key_b) for r in pairs.group_edges(rows(data, "location_id long, g string"), "g").collect())
    assert got == sorted([("big", 1, i) for i in range(2, 60) if i % 3] + [("small", 0, i) for i in range(3, 60, 3)])
    assert pairs.group_edges(rows([], "location_id long, g string"), "g").count() == 0


def test_leaves_of_a_coast(rows):
    """15,000 sites on one coast at 500 km: leaves as small as asked for, more of them than tasks, and few copies of a circle."""
    rnd = random.Random(11)
    a = rows([(rnd.uniform(24.5, 31), rnd.uniform(-98, -79.5)) for _ in range(15000)] + [(27.5, -81.5)] * 3000, "lat double, lon double")
    start = celltree.start_level(500.0)
    placed = a.withColumns(celltree.fine_cell("lat", "lon", start))
    counts = celltree.fine_counts(placed)
    tree = celltree.leaves(counts, 256)
    held = placed.join(celltree.leaf_of_cells(counts, tree), ["_y", "_x"])
    assert held.count() == 18000
    per_leaf = held.groupBy("_leaf", "_parts").count().collect()
    assert len(per_leaf) == tree.count() > 100
    assert all(r["count"] <= 256 * r._parts for r in per_leaf) and max(r._parts for r in per_leaf) >= 11
    assert sum(r._parts > 1 for r in per_leaf) == 1  # the spot alone
    circles = rows([(27.0, -85.0, 500.0), (29.0, -95.0, 20.0), (60.0, 0.0, 500.0)], "lat double, lon double, km double").withColumns(celltree.box_of("lat", "lon", F.col("km")))
    copies = {r.km: r["count"] for r in celltree.cover(circles, tree, start).groupBy("km").count().collect()}
    assert copies[500.0] < len(per_leaf) and copies[20.0] <= 4


def test_a_hot_spot_is_dealt_over_many_keys(rows):
    """A third of both sides on one spot: no key of the join holds more than a small part of the rows."""
    a = rows([(i, 27.5, -81.5 - (i % 3 > 0) * i / 500) for i in range(900)], "a int, lat double, lon double")
    b = rows([(i, 27.5, -81.5 - (i % 3 > 0) * i / 500) for i in range(900)], "b int, track_lat double, track_lon double")
    joined = spatial.radius_join(a, b, 50.0, most=16, share=32)
    keys = re.findall(r"SortMergeJoin \[(_leaf#\d+L?), (_part#\d+), (_share#\d+)\]", joined._jdf.queryExecution().executedPlan().toString())
    assert len(keys) == 1
    got = joined.groupBy("a").count().collect()
    want = {i: sum(abs(x - y) * 98.65 <= 50 for y in [(j % 3 > 0) * j / 500 for j in range(900)]) for i, x in ((i, (i % 3 > 0) * i / 500) for i in range(900))}
    assert len(got) == 900 and all(abs(r["count"] - want[r.a]) <= 2 for r in got)


@pytest.mark.parametrize("radius", [400.0, 1200.0, 25000.0])
def test_closest_approach_at_any_radius(rows, radius):
    sites, obs = world(20, 7), world(30, 8)
    loc = rows([(i, *p) for i, p in enumerate(sites)], "location_id int, lat double, lon double")
    track = rows([(i % 4, i, *p, 50 + i, 1000 - i) for i, p in enumerate(obs)], "storm_id int, s int, lat double, lon double, max_wind_kt int, min_pressure_mb int")
    got = {(r.location_id, r.storm_id): (r.min_distance_km, r.wind_at_closest_kt) for r in spatial.storm_distances(track.withColumn("obs_ts", F.timestamp_seconds("s")), loc, radius).collect()}
    want = {}
    for i, p in enumerate(sites):
        for j, q in enumerate(obs):
            if km(p, q) <= radius:
                want[i, j % 4] = min(want.get((i, j % 4), (1e9, 0, 0)), (round(km(p, q), 6), j, 50 + j))
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-4 for k in want)


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_copies_are_bounded_where_all_reach_all(rows, monkeypatch, spread):
    """Leaves, or parts of one hot position, grow with the left rows instead of the copies of a right row; the pairs are all there."""
    rnd = random.Random(12)
    a = rows([(i, 27 + spread * rnd.random(), -82 + spread * rnd.random()) for i in range(400)], "a int, lat double, lon double")
    b = rows([(i, 27 + rnd.random(), -82 + rnd.random()) for i in range(300)], "b int, track_lat double, track_lon double")
    covers, whole = [], celltree.cover
    monkeypatch.setattr(celltree, "cover", lambda circles, tree, start: covers.append(whole(circles, tree, start)) or covers[-1])
    near = spatial.radius_join(a, b, 400.0, most=1, share=1)
    assert near.select("a", "b").distinct().count() == near.count() == 400 * 300
    sent = max(c.where("b is not null").agg(F.sum("_parts")).first()[0] for c in covers if "b" in c.columns)
    assert sent <= 300 * 4 * spatial.COPIES  # a split makes four leaves at once


def test_climate_from_joined_rows_joins_a_cell_once(rows):
    nan = float("nan")
    obs = [(25.0, -80.0, 1, 1000.0, 3.0), (25.0, -80.0, 2, None, 5.0), (27.0, -82.0, 1, 990.0, None), (27.0, -82.0, 2, 994.0, nan), (27.0, -82.0, 3, 1.0, 2.0), (29.0, -84.0, 1, None, None)]
    grid = rows(obs, "lat double, lon double, obs_ts int, mslp_hpa double, wind_speed_ms double")
    stands = [(1, 25.1, -80.1), (2, 24.8, -79.9), (3, 26.9, -82.1), (4, 29.0, -84.0), (5, 25.0, -82.0), (6, None, -80.0)]
    stands += [(7, 25.0, -80.0), (7, 27.0, -82.0), (7, 27.0, -82.0), (None, 25.0, -80.0), (None, 27.0, -82.0), (2, 24.8, -79.9)]  # ids in two cells, or none
    loc = rows(stands, "location_id int, lat double, lon double")
    told = lambda df: sorted((str(r.location_id), *(round(v, 9) if v is not None else -1.0 for v in r[1:])) for r in df.na.fill(-2.0).select("location_id", *hazard.CLIMATE_AGGREGATES).collect())
    out = hazard.climate_from_joined_rows(loc, grid)
    assert str(told(out)) == str(told(hazard.climate_per_location(spatial.grid_join(loc, grid)))) and out.count() == 7
    many = loc.crossJoin(rows([(i,) for i in range(50)], "copy int")).selectExpr("location_id + 10 * copy as location_id", "lat", "lon")
    seen = []
    real, hazard.grid_join = hazard.grid_join, lambda a, b: seen.append(real(a, b)) or seen[0]
    try:
        hazard.climate_from_joined_rows(many, grid)
    finally:
        hazard.grid_join = real
    assert seen[0].count() <= grid.count()


@pytest.mark.parametrize("radius, options", [(400.0, {}), (400.0, {"most": 5, "share": 3}), (3000.0, {"most": 1})])
def test_totals_of_the_radius_join_are_those_of_its_pairs(rows, monkeypatch, radius, options):
    monkeypatch.setattr(spatial, "TILE_ROWS", (7, 16))
    monkeypatch.setattr(spatial, "BLOCK", (4, 5))
    left, right = world(120, 1), world(90, 2)
    right[::9] = left[:10]  # some at no distance
    a = rows([(i // 2, *p) for i, p in enumerate(left)] + [(99, None, 1.0), (99, float("nan"), 1.0)], "a int, lat double, lon double")
    b = rows([(f"s{i % 7}", *p) for i, p in enumerate(right)], "b string, track_lat double, track_lon double")
    for side, key in (("left", "a"), ("right", "b")):
        want = {}
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                if km(p, q) <= radius:
                    want.setdefault(i // 2 if side == "left" else f"s{j % 7}", []).append(km(p, q))
        out = spatial.radius_join(a, b, radius, totals=side, **options).groupBy(key).agg(F.sum("pairs"), F.sum("total_km"), F.min("nearest_km"))
        got = {r[0]: r[1:] for r in out.collect()}
        assert {k: r[0] for k, r in got.items()} == {k: len(v) for k, v in want.items()}
        assert all(abs(got[k][1] - sum(v)) < 1e-6 * len(v) and abs(got[k][2] - min(v)) < 1e-4 for k, v in want.items())
    with pytest.raises(ValueError, match="one radius"):
        spatial.radius_join(a, b, radius, totals="left", reach="track_lat")


def test_totals_are_added_up_in_tiles(rows):
    """No row of the join is a pair: a task meets tiles of rows, and adds up what it finds there."""
    a = rows([(i, 27.0, -82.0) for i in range(700)], "a int, lat double, lon double")
    b = rows([(i, 27.5, -82.0) for i in range(900)], "b int, track_lat double, track_lon double")
    out = spatial.radius_join(a, b, 400.0, totals="left")
    assert out.columns == ["a", "lat", "lon", "pairs", "total_km", "nearest_km"]
    assert 700 <= out.count() <= 700 * spatial.COPIES and out.agg(F.sum("pairs")).first()[0] == 700 * 900
