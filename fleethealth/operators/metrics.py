"""Scores of predictions, from counts and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn over classes that occur in truth or prediction."""
    pairs = df.groupBy(truth, predicted).count()
    each = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t")))).alias("e"), (F.col(truth) == F.col(predicted)).alias("hit"), "count").select("e.*", "hit", "count")
    total = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    return each.groupBy("label").agg(total((F.col("t") == 1) & F.col("hit")).alias("tp"), total((F.col("t") == 0) & ~F.col("hit")).alias("fp"), total((F.col("t") == 1) & ~F.col("hit")).alias("fn"))


def classification_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro_f1 (unweighted over classes, 0 where undefined), classes."""
    counts = class_counts(df, truth, predicted)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.agg(F.try_divide(F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.count("*").alias("classes"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row per true label in the given order, zero cells kept."""
    spark = df.sparkSession
    order = spark.createDataFrame([(k, x) for k, x in enumerate(labels)], f"position int, {truth} string")
    counts = df.groupBy(truth).pivot(predicted, labels).count()
    return order.join(counts, truth, "left").na.fill(0, labels).orderBy("position").drop("position")


def recall_by(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("recall"), F.count("*").alias("rows"))


def regression_scores(df: DataFrame, truth: str, predicted: str, cap: float, near: float) -> DataFrame:
    """mae, rmse, r2, mae_pct_range, rmse_capped, rmse_constant, rmse_near: errors, also near failure."""
    d = F.col(predicted) - F.col(truth)
    capped = F.least(F.col(predicted), F.lit(cap)) - F.least(F.col(truth), F.lit(cap))
    root = lambda c: F.sqrt(F.avg(c * c))
    mae = F.avg(F.abs(d))
    return df.agg(mae.alias("mae"), root(d).alias("rmse"), (1 - F.try_divide(F.sum(d * d), F.count("*") * F.var_pop(truth))).alias("r2"), F.try_divide(100 * mae, F.max(truth) - F.min(truth)).alias("mae_pct_range"), root(capped).alias("rmse_capped"), F.stddev_pop(truth).alias("rmse_constant"), root(F.when(F.col(truth) <= near, d)).alias("rmse_near"))


def nasa_score(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Asymmetric score: late predictions cost more than early ones."""
    d = F.col(predicted) - F.col(truth)
    return df.agg(F.sum(F.when(d < 0, F.exp(-d / 13) - 1).otherwise(F.exp(d / 10) - 1)).alias("nasa_score"))
