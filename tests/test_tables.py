"""Feature, training, quality, split and ranking operators on hand-made rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators import encode, exposure, hazard, metrics, quality, ranking, splits, support, yeargrid


def test_hazard_history_golden(rows):
    loc = rows([("L1",), ("L2",), ("L3",)], "location_id string")
    claims = rows(
        [("C1", "L1", "S1", 100.0, 0.1, 20000.0), ("C2", "L1", "S2", 120.0, 0.3, 30000.0), ("C3", "L2", "S1", 90.0, 0.05, 5000.0)],
        "claim_id string, location_id string, storm_id string, max_wind_experienced_kt double, damage_ratio double, incurred_loss_usd double",
    )
    got = {r.location_id: r for r in exposure.hazard_history(loc, claims).collect()}
    one = got["L1"]
    assert (one.historical_claim_count, one.historical_incurred_loss_usd, one.historical_max_wind_kt, one.distinct_storms_experienced) == (2, 50000.0, 120.0, 2)
    assert one.historical_mean_damage_ratio == pytest.approx(0.2)
    assert got["L3"].historical_claim_count == 0 and got["L3"].historical_mean_damage_ratio == 0


def test_sst_ignores_null_and_nan(rows):
    grid = rows([(28.0,), (30.0,), (None,), (float("nan"),)], "sst_celsius double")
    r = hazard.basin_sst(grid).first()
    assert (r.basin_sst_celsius_mean, r.basin_sst_celsius_max) == (29.0, 30.0)


def test_training_table_golden(rows):
    feats = rows([("L1", "frame", "hip", 1.0), ("L2", "frame", "hip", 2.0)], "location_id string, construction_class string, roof_type string, tiv_usd double")
    claims = rows(
        [("C1", "L1", "1992-08-24", 50000.0, 0.2), ("C2", "L1", "1992-09-24", 30000.0, 0.12), ("C3", "L1", "1980-01-01", 9.0, 0.9)],
        "claim_id string, location_id string, loss_date string, incurred_loss_usd double, damage_ratio double",
    ).withColumn("loss_date", F.col("loss_date").cast("date"))
    table = exposure.training_table(feats, claims, None, 1990, 1994)
    got = {(r.location_id, r.year): r for r in table.collect()}
    assert len(got) == 10
    hit = got["L1", 1992]
    assert (hit.incurred_loss_usd, hit.max_damage_ratio, hit.claim_count_in_year, hit.had_claim) == (80000.0, 0.2, 2, 1)
    assert sum(r.had_claim for r in got.values()) == 1 and hit.basin_sst_celsius_mean == 28.1
    with pytest.raises(ValueError, match="tiv_usd"):
        exposure.training_table(feats.drop("tiv_usd"), claims, None, 1990, 1994)


def test_grid_units(rows):
    raw = rows([(0, 25.0, -80.0, 300.15, 101300.0, 3.0, 4.0), (1, 25.0, -80.0, None, None, None, None), (2, 25.0, -80.0, float("nan"), 1e5, 0.0, 0.0)],
               "time int, latitude double, longitude double, sst double, msl double, u10 double, v10 double")
    got = {r.timestamp: r for r in hazard.normalise_grid(raw).collect()}
    assert set(got) == {0, 2} and got[0].wind_speed_ms == 5.0 and got[0].mslp_hpa == 1013.0
    assert got[0].sst_celsius == pytest.approx(27.0) and got[2].sst_celsius is None


def test_quality_suites_pass_and_catch_corruption(rows):
    schema = "location_id string, lat double, lon double, construction_class string, roof_type string, year_built int, tiv_usd double"
    good = [("A", 25.0, -80.0, "frame", "hip", 1990, 200000.0), ("B", 26.0, -81.0, "masonry_cbs", "flat", 2001, 300000.0)]

    def failed(data):
        return {r.rule for r in quality.check_suite(rows(data, schema), quality.LOCATION_RULES, "t").collect() if not r.passed}

    assert failed(good) == set()
    assert failed(good + [good[0]]) == {"unique:location_id"}
    assert failed(good + [("C", 45.0, -80.0, "frame", "hip", 1990, 2e5)]) == {"between:lat"}
    assert failed(good + [("C", 25.0, -80.0, "straw", "dome", 1800, 1.0)]) == {"in_set:construction_class", "in_set:roof_type", "between:year_built", "between:tiv_usd"}
    assert failed(good + [(None, None, None, None, None, None, None)]) == {"not_null:location_id"}


def test_metric_gate(rows):
    m = rows([(0.7, 0.6, 0.5, 0.4, 0.6, 0.62, 0.55)], "train_auc double, test_auc double, train_r2 double, test_r2 double, first_auc double, second_auc double, blended_auc double")
    gate = quality.metric_gate(m)
    assert {r.rule for r in gate.collect() if not r.passed} == {"ensemble_against_members"}
    with pytest.raises(ValueError, match="ensemble_against_members"):
        quality.enforce_gate(gate)
    quality.enforce_gate(quality.metric_gate(m.select("train_auc", "test_auc")))


@pytest.mark.parametrize("activity", ["spread", "constant"])
def test_stratified_split(spark, activity):
    years = spark.range(1950, 2024).select(F.col("id").cast("int").alias("year"))
    hits = F.lit(1) if activity == "constant" else (F.col("year") % 9).cast("int")
    df = years.select("year", hits.alias("had_claim"))
    train, test = splits.stratified_year_split(df)
    n = test.count()
    assert 12 <= n <= 18 and train.count() + n == 74
    splits.assert_no_year_overlap(train, test)
    again = sorted(r.year for r in splits.stratified_year_split(df)[1].collect())
    assert again == sorted(r.year for r in test.collect())
    with pytest.raises(AssertionError, match="leakage"):
        splits.assert_no_year_overlap(df, test)
    with pytest.raises(ValueError, match="test_size"):
        splits.stratified_year_split(df, test_size=1.5)


def test_skewed_ranks_quantiles_and_auc(rows):
    """A third of all rows share one value."""
    rnd = random.Random(3)
    data = [(i, 0.5 if i % 3 == 0 else round(rnd.random(), 3), rnd.random() < 0.4) for i in range(900)]
    df = rows([(i, p, int(y)) for i, p, y in data], "id long, p double, y int")
    pos, neg = [p for _, p, y in data if y], [p for _, p, y in data if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(df, "y", "p").first().auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
    u = metrics.rank_sum_test(df.withColumn("g", F.col("y") == 1), "g", "p").first()
    assert u.u == pytest.approx(wins) and 0 <= u.p_value <= 1
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = {r.quantile: r.value for r in ranking.exact_quantiles(df, "p", qs).collect()}
    want = np.quantile([p for _, p, _ in data], qs)
    assert [got[q] for q in qs] == pytest.approx(list(want), abs=1e-12)


def test_positions_and_ids_in_a_hot_group(rows):
    data = [(k, "hot" if k % 3 else f"g{k % 7}") for k in random.Random(1).sample(range(10000), 600)]
    df = rows(data, "k long, g string")
    got = {r.k: r.position for r in ranking.positions(df, "k", by="g").collect()}
    for g in {g for _, g in data}:
        assert [got[k] for k in sorted(k for k, h in data if h == g)] == list(range(sum(h == g for _, h in data)))
    ids = ranking.sequential_ids(df, "g", "k").orderBy("claim_id").collect()
    assert [(r.g, r.k) for r in ids] == sorted((g, k) for k, g in data)
    assert ids[0].claim_id == "CLM00000001" and ids[-1].claim_id == "CLM00000600"


def test_dedupe_keep_last(rows):
    df = rows([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")] + [(3, i, str(i)) for i in range(200)], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in ranking.dedupe_keep_last(df, ["k"], ["o"]).collect()) == [(1, "b"), (2, "c"), (3, "199")]


def test_regression_metrics_against_numpy(rows):
    rnd = np.random.default_rng(4)
    a, p = rnd.normal(5, 2, 200), rnd.normal(5, 2, 200)
    df = rows([(float(x), float(y)) for x, y in zip(a, p)] + [(None, 1.0), (float("nan"), 2.0)], "a double, p double")
    m = metrics.regression_metrics(df, "a", "p").first()
    assert m.n == 200 and m.rmse == pytest.approx(np.sqrt(np.mean((a - p) ** 2))) and m.mae == pytest.approx(np.mean(np.abs(a - p)))
    assert m.r2 == pytest.approx(1 - np.sum((a - p) ** 2) / np.sum((a - a.mean()) ** 2)) and m.bias == pytest.approx(np.mean(p - a))
    assert metrics.regression_metrics(rows([(0.0, 1.0)], "a double, p double"), "a", "p").first().mape is None


def test_confusion_extremes(rows):
    df = rows([("a", "a", "b"), ("b", "b", "c"), ("c", "c", "a")], "actual string, good string, bad string")
    assert {r.accuracy for r in metrics.class_report(df, "actual", "good").collect()} == {1.0}
    assert {r.accuracy for r in metrics.class_report(df, "actual", "bad").collect()} == {0.0}
    assert metrics.confusion(df, "actual", "bad").count() == 9


def test_fill_gaps_inside_and_at_ends(rows):
    df = rows([("r", y, v, s) for y, v, s in [(1, None, None), (2, 10.0, "x"), (3, None, None), (4, None, None), (5, 40.0, None), (6, None, "y")]], "k string, year int, v double, s string")
    got = sorted((r.year, r.v, r.s) for r in yeargrid.fill_gaps(df, ["v"], ["s"], by="k").collect())
    assert got == [(1, 10.0, "x"), (2, 10.0, "x"), (3, 20.0, "x"), (4, 30.0, "x"), (5, 40.0, "x"), (6, 40.0, "y")]


def test_training_windows_never_span_a_gap(rows):
    years = [y for y in range(1, 31) if y != 14]
    df = rows([("r", y, float(y)) for y in years], "region_id string, year int, f double")
    for r in yeargrid.training_windows(df, "f").collect():
        span = [*r.history, *r.targets]
        assert span == list(map(float, range(int(span[0]), int(span[0]) + len(span)))) and 5 <= len(r.history) <= 10 and 14.0 not in span


def test_one_hot_and_guards(rows):
    train = rows([("a",), ("b",)], "c string")
    known = encode.categories(train, ["c", "absent"])
    got = [tuple(r) for r in encode.one_hot(rows([("a",), ("z",), (None,)], "c string"), known).collect()]
    assert got == [(1, 0), (0, 0), (0, 0)]
    assert encode.one_hot(rows([(1,)], "x int"), known).first().asDict() == {"x": 1, "c_a": 0, "c_b": 0}
    with pytest.raises(ValueError, match="more than 1 categories"):
        encode.categories(train, ["c"], limit=1)
    with pytest.raises(ValueError, match="lat"):
        support.require_columns(train, ["lat", "c"], "train")


def test_folds_are_balanced(spark):
    df = spark.range(1950, 2024).select(F.col("id").cast("int").alias("year"))
    counts = Counter(r.fold for r in splits.year_folds(df).collect())
    assert sorted(counts.values()) == [14, 15, 15, 15, 15]


def test_large_joins_are_dealt_by_their_size(spark, rows, tmp_path, monkeypatch):
    from perilframe.catalog import q_text, tables

    lines = [(o, n, 7 + n, float(10 * n), 100.0 * o + n, 0.01 * n, 0.02 * n, "1996-03-0%d" % n) for o in range(1, 9) for n in range(1, 4)]
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string"
    rows(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows([(o, o % 3) for o in range(1, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    table = rows([(i,) for i in range(100)], "i int")
    assert support.tasks_for(table, 1) == 100 and support.tasks_for(table) is None
    t = tables.Tables(spark, str(tmp_path))
    told = lambda df: sorted(map(str, df.collect()))
    builds = {"claims": lambda: tables.Tables(spark, str(tmp_path)).claims, "numbers": lambda: q_text.i5(t), "payloads": lambda: q_text.i5_payloads(t)}
    small = {name: told(build()) for name, build in builds.items()}
    for module in (tables, q_text):
        monkeypatch.setattr(module, "tasks_for", lambda df, rows=0: 37)
    for name, build in builds.items():
        df = build()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert told(df) == small[name] and len(small[name]) >= 8
        wide = {"claims": 2, "numbers": 5, "payloads": 1}[name]  # no sort or join of them is left to the fixed number
        assert plan.count(", 37), REPARTITION_BY_NUM") >= wide, plan
        assert plan.count("ENSURE_REQUIREMENTS") <= (name == "numbers"), plan


def test_training_table_is_dealt_over_named_tasks(rows):
    loc = rows([(i, "frame", "hip", 1.0) for i in range(6)], "location_id int, construction_class string, roof_type string, tiv_usd double")
    data = [(i, i % 5, f"199{5 + i % 3}-02-01", float(i), 0.1 * i) for i in range(40)]
    claims = rows(data, "claim_id int, location_id int, loss_date string, incurred_loss_usd double, damage_ratio double")
    plain, wide = (exposure.training_table(loc, claims, None, 1995, 1999, tasks=n) for n in (None, 37))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 37), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    told = lambda df: sorted(map(str, df.collect()))
    assert told(plain) == told(wide) and wide.count() == 30
