"""Frequency, severity, tail metrics and the risk book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exposure, portfolio
from ..operators.support import cut_lineage
from ..plans import lake
from .common import FIRST_YEAR, LAST_YEAR, rounded, tidy
from .q_aggregates import RISK_SQL
from .registry import query

_YEARS = LAST_YEAR - FIRST_YEAR + 1
FREQUENCY_SQL = f"""fr AS (SELECT l.location_id, least(greatest(count(DISTINCT year(loss_date))/{_YEARS}e0, 1e-3), 1e0) AS frequency
    FROM locations l LEFT JOIN claims c ON c.location_id = l.location_id AND year(loss_date) BETWEEN {FIRST_YEAR} AND {LAST_YEAR} GROUP BY 1)"""
SEVERITY_SQL = """sv AS (SELECT l.location_id, case when avg(damage_ratio) > 0 then avg(damage_ratio) else (SELECT avg(damage_ratio) FROM claims) end AS severity
    FROM locations l LEFT JOIN claims c ON c.location_id = l.location_id GROUP BY 1)"""
TAIL_SQL = """v AS (SELECT quantile_cont(annual_loss, 995e-3) AS var, median(annual_loss) AS med FROM annual_losses), tv AS (SELECT sum(tiv_usd) AS tiv FROM locations)"""


@query("e11_frequency_baseline", f"WITH {FREQUENCY_SQL} SELECT location_id, round(frequency, 9) AS frequency FROM fr")
def e11(t):
    return rounded(portfolio.frequency_baseline(t.locations, t.claims, FIRST_YEAR, LAST_YEAR), 9)


@query("e12_severity_baseline", f"WITH {SEVERITY_SQL} SELECT location_id, round(severity, 10) AS severity FROM sv")
def e12(t):
    return rounded(portfolio.severity_baseline(t.locations, t.claims), 10)


@query(
    "e13_tail_metrics",
    f"""WITH {TAIL_SQL}, m AS (SELECT max(var) AS var, avg(annual_loss) FILTER (annual_loss >= var) AS tvar, avg(annual_loss) AS mean, max(med) AS med,
        stddev_pop(annual_loss) AS sd, max(annual_loss) AS hi, min(annual_loss) AS lo, count(*) AS n, max(tiv) AS tiv FROM annual_losses, v, tv)
        SELECT round(var, 3) AS value_at_risk, round(tvar, 3) AS tail_value_at_risk, round(mean, 3) AS mean_annual_loss, round(med, 3) AS median_annual_loss,
        round(sd, 3) AS std_annual_loss, hi AS max_annual_loss, lo AS min_annual_loss, n AS num_seasons, tiv AS total_tiv, round(mean/tiv, 9) AS expected_loss_ratio,
        round(var/tiv*100, 7) AS var_pct_tiv, round(tvar/tiv*100, 7) AS tvar_pct_tiv FROM m""",
)
def e13(t):
    out = portfolio.tail_metrics(t.annual_losses, t.locations.agg(F.sum("tiv_usd")).scalar())
    return rounded(out, 3, expected_loss_ratio=9, var_pct_tiv=7, tvar_pct_tiv=7)


@query(
    "e14_trend_multiplier",
    """WITH r AS (SELECT region_code, year(loss_date) AS y, cast(count(*) AS double) AS f FROM claims JOIN locations USING (location_id) GROUP BY 1, 2),
       m AS (SELECT avg(f) AS a, avg(f) FILTER (y >= (SELECT max(y) FROM r) - 5) AS b FROM r)
       SELECT round(a, 6) AS long_term_mean, round(b, 6) AS recent_mean, round(least(greatest(b/a, 5e-1), 3), 9) AS trend_multiplier FROM m""",
)
def e14(t):
    joined = t.claims.join(t.locations.select("location_id", "region_code"), "location_id")
    series = joined.groupBy("region_code", F.year("loss_date").alias("year")).agg(F.count("*").cast("double").alias("storms"))
    return rounded(portfolio.trend_multiplier(series, "storms"), 6, trend_multiplier=9)


def book(t):
    scores = cut_lineage(exposure.composite_risk(t.locations, t.claims).withColumnRenamed("risk_score", "score"))
    return lake.risk_book(t.locations, t.claims, scores, FIRST_YEAR, LAST_YEAR)


BOOK_SQL = f"""{FREQUENCY_SQL}, {SEVERITY_SQL}, {RISK_SQL}, ms AS (SELECT avg(risk_score) AS a, stddev_pop(risk_score) AS d FROM risk),
    mu AS (SELECT location_id, 1 + 5e-1*tanh((risk_score-a)/d) AS multiplier FROM risk, ms)"""


@query(
    "k4_risk_book",
    f"""WITH {BOOK_SQL} SELECT location_id, tiv_usd, round(frequency, 9) AS frequency, round(severity, 9) AS severity, round(multiplier, 8) AS multiplier
        FROM locations JOIN fr USING (location_id) JOIN sv USING (location_id) JOIN mu USING (location_id)""",
)
def k4_book(t):
    return rounded(book(t), 9, multiplier=8)
