"""Mitigation options and feature attributions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed reduction factors: feature, from, to, share of damage avoided.
MITIGATIONS = [
    ("roof_reinforcement", "roof_type", "flat", "hip", 0.35),
    ("roof_reinforcement", "roof_type", "gable", "hip", 0.25),
    ("roof_reinforcement", "roof_type", "hip", "reinforced_hip", 0.30),
    ("roof_reinforcement", "roof_type", "flat", "reinforced_hip", 0.55),
    ("construction_upgrade", "construction_class", "frame", "masonry_cbs", 0.40),
    ("construction_upgrade", "construction_class", "frame", "reinforced_concrete", 0.60),
    ("construction_upgrade", "construction_class", "joisted_masonry", "masonry_cbs", 0.25),
    ("construction_upgrade", "construction_class", "joisted_masonry", "reinforced_concrete", 0.50),
    ("construction_upgrade", "construction_class", "masonry_cbs", "reinforced_concrete", 0.30),
]
FULL_REDUCTION = 0.65
STORM_PROBABILITY = 0.15


# Fixed values of the baseline damage ratio.
AT_COAST = 0.40
INLAND = 0.05
DECAY_KM = 40.0
UNKNOWN_KM = 20.0
LEAST_RATIO = 0.02
MOST_RATIO = 0.80


def mitigation_options(locations: DataFrame) -> DataFrame:
    """Every applicable upgrade per location, plus the full fortification, with its savings.

    An option applies when its "from" value is part of the current value. The
    option list is a literal of ten entries, filtered and unrolled inside the row:
    a projection without join or shuffle.
    """
    current = {
        "roof_type": F.lower(F.coalesce("roof_type", F.lit("flat"))),
        "construction_class": F.lower(F.coalesce("construction_class", F.lit("frame"))),
    }
    options = [
        F.struct(
            F.lit(kind).alias("scenario_type"), F.lit(feature).alias("feature_changed"), current[feature].alias("original_value"),
            F.lit(new).alias("target_value"), F.lit(share).alias("reduction"), current[feature].contains(old).alias("applies"),
        )
        for kind, feature, old, new, share in MITIGATIONS
    ]
    options.append(
        F.struct(
            F.lit("full_fortification").alias("scenario_type"),
            F.lit("roof_type + construction_class").alias("feature_changed"),
            F.concat_ws(" / ", current["roof_type"], current["construction_class"]).alias("original_value"),
            F.lit("reinforced_hip / reinforced_concrete").alias("target_value"),
            F.lit(FULL_REDUCTION).alias("reduction"),
            F.lit(True).alias("applies"),
        )
    )
    base = AT_COAST * F.exp(-F.coalesce("distance_to_coast_km", F.lit(UNKNOWN_KM)) / DECAY_KM) + INLAND
    base = F.least(F.greatest(base, F.lit(LEAST_RATIO)), F.lit(MOST_RATIO))
    rows = locations.withColumn("_base", base).select(
        "location_id", "tiv_usd", "_base", F.inline(F.filter(F.array(*options), lambda o: o["applies"]))
    )
    before = F.col("_base") * F.col("tiv_usd") * STORM_PROBABILITY
    new_ratio = F.col("_base") * (1 - F.col("reduction"))
    after = new_ratio * F.col("tiv_usd") * STORM_PROBABILITY
    return rows.select(
        "location_id", "tiv_usd", "scenario_type", "feature_changed", "original_value", "target_value",
        F.bround("_base", 4).alias("baseline_damage_ratio"), F.bround(new_ratio, 4).alias("new_damage_ratio"),
        F.bround(before, 2).alias("baseline_annual_loss"), F.bround(after, 2).alias("new_annual_loss"),
        F.bround(before - after, 2).alias("annual_loss_reduction_usd"),
        F.bround(F.col("reduction") * 100, 1).alias("pct_loss_reduction"),
    )


def rank_attributions(values: DataFrame, key: str = "prediction_id", top: int | None = None) -> DataFrame:
    """Add ``rank`` by |shap_value| inside a prediction (one row per feature, so groups are short)."""
    order = Window.partitionBy(key).orderBy(F.desc(F.abs("shap_value")), "feature_name")
    ranked = values.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def linear_attributions(
    df: DataFrame, features: list[str], coefficients: list[float], key: str = "location_id"
) -> DataFrame:
    """(key, feature_name, feature_value, shap_value): coef * (x - mean), long form."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in features]).alias("m")).scalar()
    cells = [
        F.struct(
            F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("feature_value"),
            (F.lit(float(b)) * (F.col(c) - means.getField(c))).alias("shap_value"),
        )
        for c, b in zip(features, coefficients)
    ]
    return df.select(key, F.inline(F.array(*cells)))


def fit_linear_attributions(df: DataFrame, features: list[str], label: str, key: str = "location_id") -> DataFrame:
    """Fit a linear model with MLlib and explain every row with it, ranked."""
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    model = LinearRegression(featuresCol="_x", labelCol=label, regParam=0.0).fit(data)
    long = linear_attributions(df, features, [float(c) for c in model.coefficients], key)
    long = long.withColumn("prediction_id", F.concat(F.lit("PRED_"), F.col(key).cast("string")))
    return rank_attributions(long)
