"""Chunks, numbers, retrieval, graph tables, learners."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.operators import events, explain, graph, metrics, models, text

NUMBER = re.compile(text.NUMBER_PATTERN.replace("(?iU)", "(?i)"))


def slow_chunks(s, size, overlap):
    """Straight reading of the chunk rule, character by character."""
    if len(s) <= size:
        return [s.strip()] if s.strip() else []
    out, start = [], 0
    while True:
        piece = s[start : start + size].strip()
        if piece:
            out.append(piece)
        if start + size >= len(s):
            return out
        start += size - overlap


@pytest.mark.parametrize("size,overlap", [(800, 120), (10, 3), (10, 8)])
def test_chunks_match_the_rule(rows, size, overlap):
    rnd = random.Random(size)
    docs = ["", "  ", "x", "é" * size, "é" * (size + 1)] + ["".join(rnd.choice("ab \n\té😀 ") for _ in range(rnd.randrange(5 * size))) for _ in range(25)]
    df = rows(list(enumerate(docs)), "doc_id int, text string")
    got = {}
    for r in text.chunk_documents(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(r.chunk)
    for i, s in enumerate(docs):
        assert got.get(i, []) == slow_chunks(s, size, overlap), i


def test_numbers(rows):
    cases = ["USD 1,234.50 and $5 or 12%", "v2.0 x3 1.2.3 7.", "10 percent of 999,999,999", "año 2024é 15", "no digits", "1234567.00"]
    df = rows(list(enumerate(cases)), "i int, t string")
    for i, got in df.select("i", text.extract_numbers(F.col("t"))).collect():
        assert got == [m.group(0).strip() for m in NUMBER.finditer(cases[i])], cases[i]
    norm = rows([("USD 1,234.50",), ("$5",), ("12%",), ("3.00",), ("10 percent",)], "t string").select(text.normalise_number(F.col("t")))
    assert [r[0] for r in norm.collect()] == ["1234.50", "5", "12", "3", "10 PERCENT"]


def test_grounding_flags_invented_numbers(rows):
    docs = rows(
        [(1, "Loss 500,000 is 45% of the limit, see 2023 and item 7 below"), (2, "Invented 999,999,999 and 888888 and 777777"), (3, "nothing"), (4, "rate 0.45 and 1234567")],
        "doc_id int, text string",
    )
    allowed = rows([(1, "500000"), (1, "0.45"), (2, "1"), (4, "45")], "doc_id int, norm string")
    numbers = text.document_numbers(docs)
    got = {r.doc_id: (r.numbers, r.unsupported, r.passed) for r in text.ground_numbers(numbers, allowed).collect()}
    assert got == {1: (4, 0, True), 2: (3, 3, False), 4: (2, 1, True)}
    whole = {r.doc_id: (r.numbers, r.unsupported, r.passed) for r in text.ground_documents(docs, allowed).collect()}
    assert whole == {**got, 3: (0, 0, True)}
    strict = {r.doc_id: r.passed for r in text.ground_numbers(numbers, allowed, extras=0).collect()}
    assert strict == {1: True, 2: False, 4: False}


def test_payload_numbers(rows):
    deep = json.dumps({"7": [1, 2.50, {"a": "cost 1,234.50 USD", "b": [[["-3.0", True, None, 1e3]]]}], "x": 'quote " 12: @', "k:9": {}}).replace("@", "\\u0034")
    data = [(1, deep), (1, "[5]"), (2, None), (3, "no json, but 4.0 and 17"), (4, "8"), (5, '"in text 6"'), (6, "{}")]
    got = {}
    for r in text.payload_numbers(rows(data, "doc_id int, payload string")).collect():
        got.setdefault(r.doc_id, set()).add(r.norm)
    assert got == {1: {"1", "2.5", "1234.50", "3", "1000", "12", "4", "5"}, 3: {"4", "17"}, 4: {"8"}, 5: {"6"}}
    docs = rows([(1, "paid 1,234.50 and 99 and 98 and 97"), (3, "17 of 40")], "doc_id int, text string")
    checked = {r.doc_id: (r.unsupported, r.passed) for r in text.ground_payloads(docs, rows(data, "doc_id int, payload string")).collect()}
    assert checked == {1: (3, False), 3: (1, True)}


def test_graph_tables_with_a_hub(rows):
    edges = rows([(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39)], "src int, dst int")
    scores = rows([(i, float(i % 10)) for i in range(40)], "node int, score double")
    top = graph.top_neighbours(edges, scores, 3).where("node = 0").orderBy("rank").collect()
    assert [(r.neighbour, r.score) for r in top] == [(9, 9.0), (19, 9.0), (29, 9.0)]
    assert graph.neighbour_counts(edges).where("node = 0").first().num_neighbors == 39
    s = graph.high_risk_summary(edges, scores, 2, 10).orderBy("node").first()
    assert (s.node, s.num_neighbors, s.top_neighbor_ids) == (9, 3, "8,0,10")
    nodes, inside = graph.induced_subgraph(edges, scores, 9, 2)
    assert {r.node for r in nodes.collect()} == {9, 8, 0} and {tuple(r) for r in inside.collect()} == {(8, 9), (0, 8), (0, 9)}
    with pytest.raises(ValueError, match="no edge layer"):
        graph.portfolio_edges(scores, layers=("none",))
    with pytest.raises(ValueError, match="no edges"):
        graph.require_edges(edges.limit(0))
    alone = rows([(1, 20.0, -80.0), (2, 40.0, -80.0)], "location_id int, lat double, lon double")
    with pytest.raises(ValueError, match="no edges"):
        graph.portfolio_edges(alone, layers=("spatial",))


def test_event_window_edges(rows):
    claims = rows([(1, "A", "2022-09-21 12:00:00", 0.1), (2, "A", "2022-10-05 12:00:00", 0.3), (3, "B", "2022-10-05 12:00:01", 0.5), (4, "B", "no date", 0.5)], "claim_id int, location_id string, loss_date string, damage_ratio double")
    ev = rows([(7, "2022-09-28 12:00:00"), (8, "bad")], "event_id int, event_ts string")
    near = events.claims_near_events(claims, ev)
    assert {r.claim_id for r in near.collect()} == {1, 2}
    j = events.joint_losses(near).first()
    assert (j.event_id, j.location_id, j.claim_count) == (7, "A", 2) and j.total_loss == pytest.approx(0.4)


def test_mitigations_substring_rule(rows):
    loc = rows([("A", "reinforced_hip", "frame", 1e6, 0.0)], "location_id string, roof_type string, construction_class string, tiv_usd double, distance_to_coast_km double")
    got = {(r.scenario_type, r.target_value): r for r in explain.mitigation_options(loc).collect()}
    assert set(got) == {("roof_reinforcement", "reinforced_hip"), ("construction_upgrade", "masonry_cbs"), ("construction_upgrade", "reinforced_concrete"), ("full_fortification", "reinforced_hip / reinforced_concrete")}
    full = got["full_fortification", "reinforced_hip / reinforced_concrete"]
    assert full.baseline_annual_loss == pytest.approx(0.45 * 1e6 * 0.15) and full.pct_loss_reduction == 65.0


def test_fitted_attributions_are_exact(rows):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(60, 2))
    y = 2 * x[:, 0] - 3 * x[:, 1] + 1
    df = rows([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "location_id int, a double, b double, y double")
    out = explain.fit_linear_attributions(df, ["a", "b"], "y").collect()
    for r in out:
        coef, col = {"a": (2, 0), "b": (-3, 1)}[r.feature_name]
        assert r.shap_value == pytest.approx(coef * (x[r.location_id, col] - x[:, col].mean()), abs=1e-6)
    assert sum(r.shap_value for r in out if r.location_id == 0) == pytest.approx(y[0] - y.mean(), abs=1e-6)
    assert {r.rank for r in out} == {1, 2}


@pytest.fixture(scope="module")
def model_rows(spark):
    base = spark.range(40).select(F.col("id").alias("location_id"), (25 + F.col("id") % 6).cast("double").alias("lat"), F.when(F.col("id") % 2 == 0, "frame").otherwise("masonry_cbs").alias("construction_class"))
    table = base.withColumn("year", F.explode(F.sequence(F.lit(1990), F.lit(2009))))
    heat = (F.col("year") % 7).cast("double")
    noise = F.pmod(F.xxhash64("location_id", "year"), F.lit(100)) / 100.0
    risk = heat / 7 + F.when(F.col("construction_class") == "frame", 0.3).otherwise(0.0)
    table = table.withColumn("basin_sst_celsius_mean", 26 + heat).withColumn("had_claim", (noise < risk * 0.8).cast("int"))
    return table.withColumn("max_damage_ratio", F.when(F.col("had_claim") == 1, 0.05 * heat + 0.1 * noise).otherwise(0.0)).cache()


def test_classifier_finds_the_signal(model_rows):
    train, test = model_rows.where("year < 2005"), model_rows.where("year >= 2005")
    model = models.ClaimClassifier.fit(train, trees=10)
    report = {(r.part, r.learner): r for r in models.claim_report(model, train, test).collect()}
    assert report["test", "p_blend"].auc > 0.55 and len(report) == 6
    unseen = test.withColumn("construction_class", F.lit("straw")).drop("lat")
    assert model.predict(unseen).count() == test.count()


def test_severity_only_on_claims(model_rows):
    model = models.SeverityRegressor.fit(model_rows, trees=8)
    m = metrics.regression_metrics(model.predict(model_rows.where("had_claim = 1")), "max_damage_ratio", "severity_pred").first()
    assert m.r2 > 0.3
    with pytest.raises(ValueError, match="no claims"):
        models.SeverityRegressor.fit(model_rows.where("had_claim = 0"))


def test_monotone_regions_platt(model_rows):
    curve = models.monotone_curve(model_rows.where("had_claim = 1"), "basin_sst_celsius_mean", "max_damage_ratio").orderBy("basin_sst_celsius_mean").collect()
    fitted = [r.fitted for r in curve]
    assert fitted == sorted(fitted)
    assert models.region_codes(model_rows.select("location_id", "lat", F.col("lat").alias("lon")).distinct(), 3).count() == 40
    scored = model_rows.select("had_claim", ((F.col("basin_sst_celsius_mean") - 26) / 7).alias("p_first"))
    scaled = models.platt_scaling(scored, "had_claim", "p_first")(scored)
    report = {r.scores: r for r in models.calibration_report(scaled, "had_claim").collect()}
    assert report["calibrated"].auc == pytest.approx(report["raw"].auc, abs=1e-9) and report["calibrated"].brier <= report["raw"].brier + 0.01


def test_cross_validation_shape(model_rows):
    out = {r.setting: r for r in models.cross_validate(model_rows, folds=2, trees=2).collect()}
    assert set(out) == {"baseline", "regularized"} and all(r.folds == 2 and 0 <= r.mean_auc <= 1 and r.std_auc >= 0 for r in out.values())


def test_registered_learners_have_their_default_sizes(monkeypatch):
    from perilframe.catalog import q_learning

    class Fitted(Exception):
        pass

    def caught(*args, **options):
        raise Fitted(sorted(options))

    monkeypatch.setattr(q_learning, "model_table", lambda t: None)
    monkeypatch.setattr(q_learning.splits, "stratified_year_split", lambda table: (None, None))
    monkeypatch.setattr(models.ClaimClassifier, "fit", caught)
    monkeypatch.setattr(models.SeverityRegressor, "fit", caught)
    monkeypatch.setattr(models, "cross_validate", caught)
    for build, options in ((q_learning.j1, ["second"]), (q_learning.j2, []), (q_learning.j3, []), (q_learning.j7, [])):
        with pytest.raises(Fitted) as e:
            build(None)
        assert e.value.args[0] == options


def test_bootstrap_draws_are_neither_counted_nor_made_in_one_task(rows):
    n, reps, m = 40, 30, 2147483647
    err = [((i * 37) % 11 - 5) / 10 for i in range(n)]
    df = rows([(i, 0.0, e) for i, e in enumerate(err)], "id int, y double, p double").coalesce(1)

    def drawn(rep, slot):
        start = (rep * 48271 + slot * 69621 + 7 * 40692) % m
        once = start * (start + 16807) % m
        return err[(once * (once + 48271) + start) % m % n]

    sets = [[drawn(r, i) for i in range(n)] for r in range(reps)]
    values = {"mae": [np.mean(np.abs(x)) for x in sets], "rmse": [np.sqrt(np.mean(np.square(x))) for x in sets]}
    out = metrics.bootstrap_intervals(df, "y", "p", "id", replicates=reps, seed=7)
    for r in out.collect():
        v = values[r.metric]
        assert (r.lower, r.upper, r.mean) == pytest.approx((np.percentile(v, 2.5), np.percentile(v, 97.5), np.mean(v)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "REPARTITION_BY_NUM" in plan
    assert not re.search(r"Aggregate\(keys=\[[^\]]*position", plan)


def test_a_pass_over_training_rows_keeps_the_cores_busy():
    assert [models.learning_tasks(n, 12) for n in (0, 1, 25_000, 100_000, 504_000, 3_000_000, 5_000_000)] == [1, 1, 1, 4, 12, 12, 24]
    assert models.learning_tasks(504_000, 1) == 3  # one of many fits at a time


def test_report_scores_a_row_once(rows, monkeypatch):
    rnd = np.random.default_rng(3)
    data = [(float(a), float(b), int(a + b > 0)) for a, b in rnd.normal(size=(200, 2))]
    df = rows(data, "lat double, lon double, had_claim int")
    model = models.ClaimClassifier.fit(df, trees=3, depth=2)
    stored = []
    monkeypatch.setattr(models, "cut_lineage", lambda d, f=models.cut_lineage: stored.append(d.columns) or f(d))
    report = models.claim_report(model, df, df)
    assert stored == [["had_claim", "p_first", "p_second", "p_blend"]] * 2
    got = {(r.part, r.learner): (r.n, r.brier, r.auc) for r in report.collect()}
    assert len(got) == 6
    for learner in ("p_first", "p_second", "p_blend"):
        want = metrics.classification_metrics(model.predict(df), "had_claim", learner).first()
        assert got["train", learner] == got["test", learner] == pytest.approx((want.n, want.brier, want.auc))


def test_a_learner_takes_all_rows(spark):
    n = 5_200_000  # more than a learner once took
    table = spark.range(n).select(F.col("id").cast("double").alias("lat"), (F.col("id") % 7 == 0).cast("int").alias("had_claim"))
    data = models.training_rows(models.FeatureSpace(table), table, "had_claim")
    assert data.agg(F.count("*"), F.sum("_y")).first() == (n, -(-n // 7))
