"""Conventional alarm limits to compare with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleethealth.functions.quantiles import exact_quantiles
from fleethealth.sources.scratch import written


def _one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.join(F.broadcast(stats))  # a single row of statistics


def fixed_limit(df: DataFrame, healthy: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    """fixed_alarm: above the healthy mean plus so many deviations."""
    limit = healthy.agg((F.avg(column) + sigmas * F.stddev_samp(column)).alias("fixed_limit"))
    return _one_row(df, limit).withColumn("fixed_alarm", F.col(column) > F.col("fixed_limit"))


def load_aware_limit(z: Column, sigmas: float = 3.0) -> Column:
    return F.abs(z) > sigmas


def training_max_limit(df: DataFrame, training: DataFrame, sensors: list[str]) -> DataFrame:
    """max_alarm: any sensor above its training maximum."""
    tops = training.agg(*(F.max(s).alias(f"_top_{s}") for s in sensors))
    return _one_row(df, tops).withColumn("max_alarm", reduce(Column.__or__, (F.coalesce(F.col(s) > F.col(f"_top_{s}"), F.lit(False)) for s in sensors))).drop(*(f"_top_{s}" for s in sensors))


def three_sigma_any(z: list[Column], sigmas: float = 3.0) -> Column:
    return F.greatest(F.lit(0.0), F.lit(0.0), *(F.abs(c) for c in z)) > sigmas


def directional_limit(df: DataFrame, reference: DataFrame, column: str, high: bool, by: str, sigmas: float = 3.0) -> DataFrame:
    """direction_alarm against the mean and deviation of each fold's reference rows."""
    sign = 1 if high else -1
    limit = reference.groupBy(by).agg((F.avg(column) + sign * sigmas * F.stddev_samp(column)).alias("direction_limit"))
    out = df.join(limit, by, "left")
    return out.withColumn("direction_alarm", F.col(column) > F.col("direction_limit") if high else F.col(column) < F.col("direction_limit"))


def univariate_limits(healthy: DataFrame, sensors: list[str], target: float = 0.05, cells: int = 64, rounds: int = 2) -> DataFrame:
    """sensor, low, high: limits at quantiles q and 1 - q, the largest q with joint alarms within ``target``.

    Every quantile of a grid is judged in one pass, and the bracketing cell is refined; joint alarms
    grow with q, so this equals a bisection without its many passes."""
    healthy = written(healthy.select(*sensors), "healthy")
    lo, hi = 0.0, target
    for _ in range(rounds):
        grid = [lo + (hi - lo) * k / cells for k in range(cells + 1)]
        edges = {s: [0.0 if e is None else e for e in q] for s, q in exact_quantiles(healthy, sensors, grid + [1 - q for q in grid]).items()}
        out = lambda k: reduce(Column.__or__, ((F.col(s) < edges[s][k]) | (F.col(s) > edges[s][k + cells + 1]) for s in sensors))
        rates = healthy.agg(*(F.avg(out(k).cast("int")).alias(f"r{k}") for k in range(cells + 1))).first()
        best = max((k for k in range(cells + 1) if (rates[f"r{k}"] or 0.0) <= target), default=0)
        lo, hi = grid[best], grid[min(cells, best + 1)]
        if lo == hi:
            break
    limits = [(s, a, b) for s, (a, b) in exact_quantiles(healthy, sensors, [lo, 1 - lo]).items()]
    return healthy.sparkSession.createDataFrame(limits, "sensor string, low double, high double")  # a row per sensor
