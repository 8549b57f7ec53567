"""Declarative data-quality suites, coverage and metric gates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value ranges and sets of the three suites.
LAT_RANGE = (24.3, 31.1)
LON_RANGE = (-87.7, -79.7)
CONSTRUCTION_CLASSES = ["frame", "masonry_cbs", "reinforced_concrete", "masonry_veneer"]
ROOF_TYPES = ["hip", "gable", "flat"]
DEDUCTIBLE_PCTS = [0.02, 0.05, 0.10]


@dataclass(frozen=True)
class Rule:
    """One expectation: kind, column and its bounds, set or partner column."""

    kind: str
    column: str
    low: Any = None
    high: Any = None
    members: tuple = ()
    other: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"

    def broken(self):
        """Rows that break the rule; NULLs only break not_null."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "between":
            below = c < F.lit(self.low) if self.low is not None else F.lit(False)
            above = c > F.lit(self.high) if self.high is not None else F.lit(False)
            return below | above
        if self.kind == "in_set":
            return ~c.isin(*self.members)
        if self.kind == "greater":
            return ~(c > F.col(self.other))
        if self.kind == "greater_or_equal":
            return ~(c >= F.col(self.other))
        raise ValueError(f"unknown rule kind {self.kind}")


def not_null(c):
    return Rule("not_null", c)


def unique(c):
    return Rule("unique", c)


def between(c, low=None, high=None):
    return Rule("between", c, low=low, high=high)


def in_set(c, members):
    return Rule("in_set", c, members=tuple(members))


def greater(c, other, or_equal=False):
    return Rule("greater_or_equal" if or_equal else "greater", c, other=other)


LOCATION_RULES = [
    not_null("location_id"),
    unique("location_id"),
    between("lat", *LAT_RANGE),
    between("lon", *LON_RANGE),
    in_set("construction_class", CONSTRUCTION_CLASSES),
    in_set("roof_type", ROOF_TYPES),
    between("year_built", 1900, 2024),
    between("tiv_usd", 75_000, 5_000_000),
]
POLICY_RULES = [
    not_null("policy_id"),
    unique("policy_id"),
    not_null("location_id"),
    in_set("deductible_pct", DEDUCTIBLE_PCTS),
    between("limit_usd", 1),
    between("deductible_usd", 0),
    greater("expiry_date", "effective_date"),
]
CLAIM_RULES = [
    not_null("claim_id"),
    unique("claim_id"),
    not_null("location_id"),
    not_null("policy_id"),
    between("damage_ratio", 0.0, 1.0),
    between("incurred_loss_usd", 0),
    between("paid_loss_usd", 0),
    greater("incurred_loss_usd", "paid_loss_usd", or_equal=True),
]


def check_suite(df: DataFrame, rules: list[Rule], table: str) -> DataFrame:
    """(table_name, rule, rows, broken, passed): one pass for all row rules, one per unique key."""
    row_rules = [r for r in rules if r.kind != "unique"]
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(r.broken()).alias(r.name) for r in row_rules],
    )
    long = counts.unpivot("_rows", [f"`{r.name}`" for r in row_rules], "rule", "broken")
    results = [long.select("rule", F.col("_rows").alias("rows"), "broken")]
    for r in rules:
        if r.kind == "unique":
            # Copies of a hot key are counted before the shuffle.
            per_key = df.groupBy(r.column).agg(F.count("*").alias("_n"))
            repeated = (F.col("_n") > 1) & F.col(r.column).isNotNull()
            results.append(
                per_key.agg(
                    F.lit(r.name).alias("rule"),
                    F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                    F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).alias("broken"),
                )
            )
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select(
        F.lit(table).alias("table_name"), "rule", F.col("rows").cast("long").alias("rows"),
        F.col("broken").cast("long").alias("broken"), (F.col("broken") == 0).alias("passed"),
    )


def suite_verdicts(results: DataFrame) -> DataFrame:
    """Per table, and overall under the name ``all``: rules, failed rules, verdict."""
    facts = [
        F.count("*").alias("rules"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.bool_and("passed").alias("passed"),
    ]
    per_table = results.groupBy("table_name").agg(*facts)
    return per_table.unionByName(results.agg(F.lit("all").alias("table_name"), *facts))


def year_coverage(df: DataFrame, ts: str, first_year: int, last_year: int) -> DataFrame:
    """Every year of the range with its row count and whether it is present."""
    per_year = df.groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("rows"))
    years = df.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    out = years.join(per_year, "year", "left").na.fill(0, ["rows"])
    return out.withColumn("present", F.col("rows") > 0)


# Fixed thresholds of the metric gate: (rule, left metric, operator, bound).
GATE_RULES = [
    ("frequency_floor", "test_auc", "at_least", 0.50),
    ("frequency_ceiling", "test_auc", "at_most", 0.95),
    ("frequency_gap", "auc_gap", "at_most", 0.15),
    ("severity_floor", "test_r2", "at_least", 0.0),
    ("severity_ceiling", "test_r2", "at_most", 0.90),
    ("severity_gap", "r2_gap", "at_most", 0.30),
    ("ensemble_floor", "blended_auc", "at_least", 0.50),
    ("ensemble_against_members", "blend_margin", "at_least", -0.01),
]


def metric_gate(metrics: DataFrame) -> DataFrame:
    """Check a one-row table of model metrics; one row per rule whose metric is there.

    Expects any of train_auc, test_auc, train_r2, test_r2, first_auc, second_auc, blended_auc.
    """
    have = set(metrics.columns)
    derived = {}
    if {"train_auc", "test_auc"} <= have:
        derived["auc_gap"] = F.col("train_auc") - F.col("test_auc")
    if {"train_r2", "test_r2"} <= have:
        derived["r2_gap"] = F.col("train_r2") - F.col("test_r2")
    if {"first_auc", "second_auc", "blended_auc"} <= have:
        derived["blend_margin"] = F.col("blended_auc") - F.least("first_auc", "second_auc")
    known = metrics.withColumns(derived) if derived else metrics
    lines = []
    for rule, metric, op, bound in GATE_RULES:
        if metric in have or metric in derived:
            ok = F.col(metric) >= bound if op == "at_least" else F.col(metric) <= bound
            lines.append(
                F.struct(
                    F.lit(rule).alias("rule"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"),
                    F.lit(bound).alias("bound"), F.coalesce(ok, F.lit(False)).alias("passed"),
                )
            )
    return known.select(F.inline(F.array(*lines)))


def enforce_gate(gate: DataFrame) -> None:
    """Raise if a rule failed; the gate has at most one row per rule."""
    failed = [r["rule"] for r in gate.where(~F.col("passed")).select("rule").collect()]
    if failed:
        raise ValueError(f"metric gate failed: {failed}")
