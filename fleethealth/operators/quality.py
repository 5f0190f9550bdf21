"""Data-quality gate: checks as rows, and a stop before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.columns import no_nan


class QualityError(ValueError):
    """The gate's checks did not pass."""


def normalise_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN becomes null, once, so that later aggregates skip it."""
    return df.withColumns({c: no_nan(F.col(c)) for c in columns})


def default_ranges(history: DataFrame, sensors: list[str], widen: float = 0.25) -> DataFrame:
    """sensor, low, high: the extremes of history, widened by a share of their span."""
    wide = history.agg(*(f(no_nan(F.col(s))).alias(f"{n}_{s}") for s in sensors for n, f in (("min", F.min), ("max", F.max))))
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(f"min_{s}").alias("lo"), F.col(f"max_{s}").alias("hi")) for s in sensors)))
    span = (F.col("hi") - F.col("lo")) * widen
    return wide.select(rows.alias("r")).select("r.*").select("sensor", (F.col("lo") - span).alias("low"), (F.col("hi") + span).alias("high"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """duplicate_keys: how many keys have more than one row."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("duplicate_keys"))


def stuck_sensors(df: DataFrame, sensors: list[str], asset: str, time: str, window: int = 20) -> DataFrame:
    """sensor, machines: machines with a full trailing window that doesn't vary at all."""
    w = Window.partitionBy(asset).orderBy(time).rowsBetween(-(window - 1), 0)
    flat = df.select(asset, *((F.count(no_nan(F.col(s))).over(w) >= window) & (F.stddev(no_nan(F.col(s))).over(w) == 0) for s in sensors)).toDF(asset, *(f"s{k}" for k in range(len(sensors))))
    machines = flat.groupBy(asset).agg(*(F.max(F.col(f"s{k}").cast("int")).alias(f"s{k}") for k in range(len(sensors))))
    total = machines.agg(*(F.coalesce(F.sum(f"s{k}"), F.lit(0)).alias(f"s{k}") for k in range(len(sensors))))
    return total.select(F.explode(F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(f"s{k}").alias("machines")) for k, s in enumerate(sensors)))).alias("r")).select("r.*")


def freshness(df: DataFrame, asset: str, time: str) -> DataFrame:
    """spread: the newest last reading minus the oldest last reading."""
    return df.groupBy(asset).agg(F.max(time).alias("last")).agg((F.max("last") - F.min("last")).alias("spread"))


def quality_report(df: DataFrame, sensors: list[str], asset: str, time: str, ranges: dict[str, tuple[float, float]] | None = None, stuck_window: int = 20, max_null_share: float = 0.05) -> DataFrame:
    """Rows (check, passed, warning, detail). Only the schema row if columns are missing."""
    spark = df.sparkSession
    missing = missing_columns(df, [asset, time, *sensors])
    if missing:
        return spark.sql("SELECT 'schema' AS check, false AS passed, false AS warning, :d AS detail", args={"d": ",".join(missing)})
    clean = normalise_nan(df, sensors)
    ranges = ranges or {}
    scalars = clean.agg(
        *(F.coalesce(F.avg(F.col(s).isNull().cast("int")), F.lit(0.0)).alias(f"null_{s}") for s in sensors),
        *(F.coalesce(F.sum(((F.col(s) < lo) | (F.col(s) > hi)).cast("int")), F.lit(0)).alias(f"out_{s}") for s, (lo, hi) in ranges.items()),
    )

    def entry(check: str, passed, warning, detail):
        return F.struct(F.lit(check).alias("check"), passed.alias("passed"), warning.alias("warning"), detail.alias("detail"))

    none = F.lit(False)
    rows = scalars.select(F.explode(F.array(
        entry("schema", F.lit(True), none, F.lit("")),
        entry("nulls", F.greatest(F.lit(0.0), *(F.col(f"null_{s}") for s in sensors)) <= max_null_share, none, F.concat_ws(",", *(F.when(F.col(f"null_{s}") > max_null_share, F.concat_ws("=", F.lit(s), F.bround(f"null_{s}", 4).cast("string"))) for s in sensors))),
        entry("range", F.greatest(F.lit(0), F.lit(0), *(F.col(f"out_{s}") for s in ranges)) == 0, none, F.concat_ws(",", F.lit(None).cast("string"), *(F.when(F.col(f"out_{s}") > 0, F.concat_ws("=", F.lit(s), F.col(f"out_{s}").cast("string"))) for s in ranges))),
    )).alias("r")).select("r.*")
    dup = duplicate_keys(df, [asset, time]).select(F.lit("duplicates").alias("check"), (F.col("duplicate_keys") == 0).alias("passed"), none.alias("warning"), F.col("duplicate_keys").cast("string").alias("detail"))
    stuck = stuck_sensors(clean, sensors, asset, time, stuck_window).filter("machines > 0").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "sensor", F.col("machines").cast("string")))), ",").alias("detail"))
    stuck = stuck.select(F.lit("stuck").alias("check"), F.lit(True).alias("passed"), (F.col("detail") != "").alias("warning"), "detail")
    fresh = freshness(df, asset, time).select(F.lit("freshness").alias("check"), F.lit(True).alias("passed"), F.coalesce(F.col("spread").cast("string") != (F.col("spread") - F.col("spread")).cast("string"), none).alias("warning"), F.coalesce(F.col("spread").cast("string"), F.lit("")).alias("detail"))
    return rows.unionByName(dup).unionByName(stuck).unionByName(fresh)


def gate(report: DataFrame) -> DataFrame:
    """The report, or an error that names the failed checks; runs before any scoring."""
    failed = [f"{r.check}: {r.detail}" for r in report.filter("not passed").collect()]  # a row per check
    if failed:
        raise QualityError("; ".join(failed))
    return report


def quarantine(df: DataFrame, sensors: list[str], ranges: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by nulls and ranges."""
    ok = F.lit(True)
    for s in sensors:
        ok = ok & no_nan(F.col(s)).isNotNull()
    for s, (lo, hi) in ranges.items():
        ok = ok & F.coalesce(F.col(s).between(lo, hi), F.lit(False))
    return df.filter(ok), df.filter(~ok)
