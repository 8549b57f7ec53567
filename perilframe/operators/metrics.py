"""Model and diagnostic metrics as single-pass aggregates or rank sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, draws
from .ranking import column_quantiles, positions, running_totals, value_counts
from .support import short_list, task_count

PROBABILITY_FLOOR = 2.220446049250313e-16


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half; one row ``auc``.

    Works on positives and negatives per distinct score, so equal scores never
    meet in one task as raw rows.
    """
    rows = df.where(F.col(label).isNotNull())
    per_score = value_counts(
        rows, score, {"pos": F.sum(F.col(label).cast("long")), "neg": F.sum(1 - F.col(label).cast("long"))}
    )
    ranked = running_totals(per_score, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return ranked.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def classification_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: n, base_rate, auc, log_loss, brier."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    p = F.least(F.greatest(F.col(score), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    y = F.col(label)
    basic = rows.agg(
        F.count("*").alias("n"),
        F.avg(y).alias("base_rate"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"),
    )
    return basic.withColumn("auc", roc_auc(rows, label, score).scalar())


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, mae, rmse, r2, bias, mape (NULL if an actual is 0); missing pairs dropped."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = df.where(a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p)).select(a.alias("a"), p.alias("p"))
    err = F.col("p") - F.col("a")
    safe = F.nullif(F.col("a"), F.lit(0.0))
    total = F.var_pop("a") * F.count("*")
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.nullif(total, F.lit(0.0))).alias("r2"),
        F.avg(err).alias("bias"),
        F.when(F.count_if(F.col("a") == 0) == 0, F.avg(F.abs(err / safe)) * 100).alias("mape"),
    )


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per uniform bin; empty bins are absent."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(bin_).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("observed_rate")
    )


def label_correlations(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, correlation) with the label, strongest first; constant columns give NULL.

    All correlations come from one pass.
    """
    row = df.agg(*[_pearson(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    long = row.unpivot([], columns, "feature", "correlation")
    return long.orderBy(F.desc_nulls_last(F.abs("correlation")), "feature")


def _pearson(x, y):
    both = x.isNotNull() & y.isNotNull()
    flat = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)) == 0
    return F.when(~flat, F.corr(x, y))


def feature_drift(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, train_mean, test_mean, diff) by |diff|; one pass over the two parts."""
    both = train.select(*columns, F.lit(True).alias("_train")).unionByName(
        test.select(*columns, F.lit(False).alias("_train"))
    )
    means = both.agg(
        *[F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(F.col("_train"), F.col(c).cast("double"))).alias("train_mean"),
            F.avg(F.when(~F.col("_train"), F.col(c).cast("double"))).alias("test_mean"),
        ).alias(c) for c in columns]
    )
    rows = means.select(F.inline(F.array(*columns)))
    rows = rows.withColumn("diff", F.col("test_mean") - F.col("train_mean"))
    return rows.orderBy(F.desc(F.abs("diff")), "feature")


def bootstrap_intervals(
    df: DataFrame, actual: str, predicted: str, key: str, replicates: int = 1000, level: float = 0.95, seed: int = 42
) -> DataFrame:
    """Percentile intervals of MAE and RMSE: (metric, lower, upper, mean).

    Each of n slots of each replicate draws a row number by arithmetic hash. All draws cross one shuffle, dealt by the row
    number, which is uniform by construction; the rows of a partition are its hash table, and what leaves the task is one sum per
    replicate. No draw is sorted or counted, and no task holds more than its share of the rows.
    """
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = df.where(a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p))
    rows = positions(rows.select(key, (p - a).alias("_err")), key).select("position", "_err")
    size = rows.agg(F.count("*")).scalar()
    # few rows make many draws: the tasks are dealt before, not as the input's size suggests
    slots = rows.select(F.col("position").alias("slot")).repartition(task_count(df.sparkSession), "slot")
    slots = slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = slots.select("rep", F.pmod(draws.mixed(F.col("rep"), F.col("slot"), seed), size).alias("position"))
    hits = drawn.join(rows.hint("shuffle_hash"), "position")
    per_rep = hits.groupBy("rep").agg(F.avg(F.abs("_err")).alias("mae"), F.sqrt(F.avg(F.col("_err") * F.col("_err"))).alias("rmse"))
    tail = (1 - level) / 2
    # As many values as replicates: the built-in percentile is safe here.
    return (
        per_rep.unpivot("rep", ["mae", "rmse"], "metric", "v")
        .groupBy("metric")
        .agg(
            F.percentile("v", tail).alias("lower"),
            F.percentile("v", 1 - tail).alias("upper"),
            F.avg("v").alias("mean"),
        )
    )


def rank_sum_test(df: DataFrame, group: str, score: str) -> DataFrame:
    """Mann-Whitney U of rows with a true ``group`` against the others, one-sided greater.

    One row: u, both means, their difference, the normal-approximation z (tie and
    continuity corrected) and p value.
    """
    rows = df.where(F.col(group).isNotNull())
    inside = F.col(group).cast("int")
    per_score = value_counts(rows, score, {"a": F.sum(inside), "b": F.sum(1 - inside)})
    ranked = running_totals(per_score, score, ["b"])
    v, n = F.col(score), F.col("n").cast("double")
    sums = ranked.agg(
        F.sum(F.col("a") * (F.col("before_b") + F.col("b") / 2)).alias("u"),
        F.sum("a").alias("n_inside"),
        F.sum("b").alias("n_outside"),
        F.sum(n * n * n - n).alias("_ties"),
        (F.sum(v * F.col("a")) / F.nullif(F.sum("a"), F.lit(0))).alias("mean_inside"),
        (F.sum(v * F.col("b")) / F.nullif(F.sum("b"), F.lit(0))).alias("mean_outside"),
    )
    n1, n2 = F.col("n_inside").cast("double"), F.col("n_outside").cast("double")
    size = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (size + 1 - F.col("_ties") / F.nullif(size * (size - 1), F.lit(0.0))))
    z = (F.col("u") - n1 * n2 / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    out = sums.withColumn("mean_difference", F.col("mean_inside") - F.col("mean_outside")).withColumn("z", z)
    return out.withColumn("p_value", upper_tail(F.col("z"))).drop("_ties")


def upper_tail(z):
    """P(Z > z) of the standard normal by a published rational approximation (error below 8e-8)."""
    # Fixed coefficients: Abramowitz and Stegun 26.2.17.
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def classify(df: DataFrame, scores: str, names: list[str]) -> DataFrame:
    """Add predicted_class, confidence and all_probabilities from an array of raw scores."""
    probs = df.withColumn("all_probabilities", arrays.softmax(F.col(scores)))
    best = arrays.argmax(F.col(scores))
    labels = F.array(*[F.lit(n) for n in names])
    return probs.withColumns(
        {
            "predicted_class": F.element_at(labels, best + 1),
            "confidence": F.element_at("all_probabilities", best + 1),
        }
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over the full grid of occurring classes.

    The grid is classes squared: each class row is expanded by the class list, a
    scalar of the size of the label set.
    """
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    classes = cells.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct()
    every = short_list(classes, "actual", 10_000, "a set of classes")
    grid = classes.withColumn("predicted", F.explode(every))
    return grid.join(cells, ["actual", "predicted"], "left").na.fill(0, ["n"])


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, f1; plus overall accuracy on every row."""
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.alias("hits")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    overall = cells.agg((F.sum(hit) / F.sum("n")).alias("accuracy")).scalar()
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("called"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = 2 * F.col("hits") / F.nullif(F.col("called") + F.col("support"), F.lit(0))
    return per.select(
        "class", "support", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"), overall.alias("accuracy"),
    )


def describe_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max) with exact quartiles.

    The moments of all columns come from one pass; the quartiles of each column
    from its distinct values, never from the whole column in one task.
    """
    facts = df.agg(
        *[F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c) for c in columns]
    )
    rows = facts.select(F.inline(F.array(*columns)))
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("feature").agg(
        *[F.max(F.when(F.col("quantile") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    )
    return rows.join(wide, "feature").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def class_counts(df: DataFrame, column: str, score: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"), F.avg(score).alias("mean_confidence"))
