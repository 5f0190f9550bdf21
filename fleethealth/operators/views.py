"""Analyst views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleethealth.operators.labels import latest_per_machine


def fleet_view(scored: DataFrame, plan: DataFrame, asset: str, time: str, rul: str) -> DataFrame:
    """The latest row of each machine with its plan and status, shortest life first."""
    j = latest_per_machine(scored, asset, time).join(plan, asset, "left")
    status = F.when(F.col("alarm_confirmed"), "alarm").when(F.col("service_day").isNotNull(), "due").otherwise("ok")
    return j.withColumn("status", status).orderBy(F.asc_nulls_last(rul), asset)


def fleet_counts(view: DataFrame, rul: str) -> DataFrame:
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    return view.agg(F.count("*").alias("machines"), n("alarm").alias("in_alarm"), n("due").alias("due"), F.percentile(rul, F.lit(0.5)).alias("median_rul"))


def worst_sample_per_day(scored: DataFrame, asset: str, time: str, score: str = "health_score") -> DataFrame:
    """The row of highest score of each machine and day."""
    return scored.groupBy(asset, F.date_trunc("day", time).alias("day")).agg(F.max_by(F.struct(time, score), F.struct(score, time)).alias("_w")).select(asset, "day", "_w.*")


def alarm_share_and_lead(scored: DataFrame, asset: str, time: str, confirmed: str) -> DataFrame:
    """Share of time in alarm, and days from the first alarm to the end of each machine's window."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return scored.groupBy(asset).agg(F.avg(F.col(confirmed).cast("int")).alias("alarm_share"), ((micros(F.max(time)) - micros(F.min(F.when(F.col(confirmed), F.col(time))))) / 8.64e10).alias("lead_days"))


def agreement(df: DataFrame, truth: str, predicted: str, tier: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("rows"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("agreement"))


def melt_pred_actual(df: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    return df.unpivot(keys, [predicted, actual], "kind", "value")
