"""Tail metrics and pair computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilframe.operators import graph, pairs, portfolio, vectors
from perilframe.plans import lake


def test_tail_metrics_and_scenarios(rows):
    annual = rows([(i, float((i * 37) % 101)) for i in range(200)], "season int, annual_loss double")
    book = rows([("A", 400.0), ("B", 600.0)], "location_id string, tiv_usd double")
    table = lake.tail_risk(annual, book)
    m = table.first()
    assert m.tail_value_at_risk >= m.value_at_risk >= m.median_annual_loss and m.total_tiv == 1000.0
    assert m.min_annual_loss <= m.mean_annual_loss <= m.max_annual_loss and m.num_seasons == 200
    got = {r.scenario_id: r.value_at_risk for r in portfolio.scenario_metrics(table).collect()}
    assert got["baseline"] == m.value_at_risk and got["p200_1x"] == pytest.approx(1.6 * m.value_at_risk)
    with pytest.raises(ValueError, match="unknown scenarios"):
        portfolio.scenario_rows(["p999"])


def test_quantile_matches_numpy(rows):
    losses = np.random.default_rng(0).gamma(2, 1e6, 500)
    df = rows([(i, float(x)) for i, x in enumerate(losses)], "season int, annual_loss double")
    m = portfolio.tail_metrics(df, 1e9).first()
    var = np.percentile(losses, 99.5)
    assert m.value_at_risk == pytest.approx(var) and m.tail_value_at_risk == pytest.approx(losses[losses >= var].mean())
    assert m.std_annual_loss == pytest.approx(losses.std()) and m.expected_loss_ratio == pytest.approx(losses.mean() / 1e9)


def test_layer(rows):
    df = rows([(0, 10.0), (1, 60.0), (2, 500.0), (3, 0.0)], "season int, annual_loss double")
    r = portfolio.layer_price(df, 50.0, 100.0).first()
    assert (r.seasons_hit, r.mean_layer_loss, r.rate_on_line) == (2, 27.5, 0.275)


def test_co_loss_joint_rule(rows):
    # A and B move together, C is constant, D has too few claims.
    data = []
    for y, (a, b) in enumerate([(0.1, 0.2), (0.3, 0.5), (0.2, 0.4), (0.5, 0.9)]):
        data += [("A", f"{2000 + y}-06-01", a), ("B", f"{2000 + y}-07-01", b), ("C", f"{2000 + y}-08-01", 0.25)]
    data.append(("D", "2001-01-01", 0.9))
    claims = rows(data, "location_id string, loss_date string, damage_ratio double").withColumn("loss_date", F.col("loss_date").cast("date"))
    got = pairs.co_loss_pairs(claims).collect()
    assert [(r.key_a, r.key_b, r.joint_claims) for r in got] == [("A", "B", 8)]
    assert got[0].correlation == pytest.approx(np.corrcoef([0.1, 0.3, 0.2, 0.5], [0.2, 0.5, 0.4, 0.9])[0, 1])
    assert pairs.co_loss_pairs(claims, min_joint=9).count() == 0


def test_co_loss_totals_are_those_of_the_pairs(rows, monkeypatch):
    monkeypatch.setattr(vectors, "UNIT_ROWS", 8)
    monkeypatch.setattr(vectors, "PROBE_ROWS", 16)
    rnd = np.random.default_rng(5)
    data = [(f"k{i:02d}", f"{2000 + int(y)}-06-01", float(round(v, 3))) for i in range(60) for y, v in zip(rnd.integers(5, size=4), rnd.uniform(size=4))]
    claims = rows(data, "location_id string, loss_date string, damage_ratio double").withColumn("loss_date", F.col("loss_date").cast("date"))
    among = rows([(f"k{i:02d}",) for i in range(0, 60, 2)] + [("none",)], "location_id string")
    for known in (None, among):
        want = {}
        for r in pairs.co_loss_pairs(claims, min_joint=5, among=known).collect():
            n, c, j = want.get(r.key_a, (0, 0.0, 0))
            want[r.key_a] = (n + 1, c + r.correlation, j + r.joint_claims)
            assert known is None or (int(r.key_a[1:]) % 2 == 0 and int(r.key_b[1:]) % 2 == 0)
        got = {r.key_a: (r.partners, r.correlation, r.joint_claims) for r in pairs.co_loss_pairs(claims, min_joint=5, among=known, per_key=True).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    places = rows([(f"k{i:02d}", 25.0 + i / 100, -80.0, "a" if i % 3 else "b") for i in range(50)], "location_id string, lat double, lon double, coastal_basin string")
    edges = graph.portfolio_edges(places, claims).groupBy("src", "edge_type").agg(F.count("*"), F.sum("weight"))
    totals = {(r.src, r.edge_type): (r.edges, r.weight) for r in graph.portfolio_edges(places, claims, per_source=True).collect()}
    assert totals == {(r[0], r[1]): (r[2], pytest.approx(r[3])) for r in edges.collect()} and len({k for _, k in totals}) == 3


@pytest.mark.parametrize("sizes", [(300, 520), (7, 300), (1, 1)])
def test_co_loss_sums_of_tiles(sizes):
    """Rows with few claims, constant and missing ones, mixed keys: the sums are those of judging every pair by itself."""
    rnd = np.random.default_rng(sum(sizes))
    total = sum(sizes)
    keys, counts = rnd.permutation(total), rnd.poisson(0.7, size=(total, 6)).astype(float)
    vec = np.where(counts > 0, rnd.uniform(size=counts.shape), 0.0)
    vec[::11], vec[3::50] = 0.5, np.nan
    a, b = (
        pa.table({"key": keys[s], "vec": list(map(list, vec[s])), "counts": list(map(list, counts[s]))}) for s in (slice(sizes[0]), slice(sizes[0], total))
    )
    wanted = rnd.random(sizes) < 0.9
    want = np.zeros((total, 3))
    for i in range(sizes[0]):
        for j in range(sizes[0], total):
            both = counts[i] + counts[j]
            with np.errstate(invalid="ignore", divide="ignore"):
                r, joint = np.corrcoef(vec[i], vec[j])[0, 1], both[both >= 2].sum()
            if wanted[i, j - sizes[0]] and abs(r) >= 0.3 and joint >= 3:
                want[i if keys[i] < keys[j] else j] += 1, r, joint
    assert np.concatenate(pairs.co_loss_sums(a, b, wanted, 0.3, 3)) == pytest.approx(want)
