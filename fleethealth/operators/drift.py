"""Has the healthy baseline moved?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.quantiles import exact_quantiles
from fleethealth.sources.scratch import written

#: Bins, least share, and limits of the retrain flag.
BINS, FLOOR, PSI_LIMIT, ENVELOPE_LIMIT, LEAST_ROWS = 10, 1e-4, 0.25, 0.05, 50


def quantile_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """column, edges: inner quantile edges, each once; the outer ends are open."""
    found = exact_quantiles(df, columns, [k / bins for k in range(1, bins)])
    rows = [(c, sorted({float(e) for e in edges if e is not None})) for c, edges in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, edges array<double>")  # a row per column


def bin_of(x: Column, edges: Column) -> Column:
    """Number of edges at or below the value."""
    return F.size(F.filter(edges, lambda e: e <= x))


def shares(df: DataFrame, columns: list[str], edges: DataFrame) -> DataFrame:
    """column, bin, share of the values, for bins that occur."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "x").filter("x is not null")
    counts = long.join(F.broadcast(edges), "column").groupBy("column", bin_of(F.col("x"), F.col("edges")).alias("bin")).count()  # a row per column
    return counts.select("column", "bin", (F.col("count") / F.sum("count").over(Window.partitionBy("column"))).alias("share"))


def psi(reference: DataFrame, current: DataFrame) -> DataFrame:
    """column, psi of two share tables, with shares of at least FLOOR."""
    j = reference.withColumnRenamed("share", "r").join(current.withColumnRenamed("share", "c"), ["column", "bin"], "full")
    r, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(FLOOR)) for x in "rc")
    return j.groupBy("column").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def envelope(df: DataFrame, regime: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """column, low, high of each regime feature."""
    rows = [(c, a, b) for c, (a, b) in exact_quantiles(df, regime, [low, high]).items()]
    return df.sparkSession.createDataFrame(rows, "column string, low double, high double")  # a row per column


def outside_share(df: DataFrame, bounds: DataFrame, regime: list[str]) -> DataFrame:
    """column, outside: share of rows outside the envelope."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in regime)).unpivot([], regime, "column", "x").filter("x is not null")
    return long.join(F.broadcast(bounds), "column").groupBy("column").agg(F.avg((~F.col("x").between(F.col("low"), F.col("high"))).cast("int")).alias("outside"))  # a row per column


def drift_reference(healthy: DataFrame, columns: list[str], regime: list[str]) -> dict[str, DataFrame]:
    healthy = written(healthy.select(*dict.fromkeys([*columns, *regime])), "reference")
    edges = quantile_edges(healthy, columns)
    return {"edges": edges, "shares": shares(healthy, columns, edges), "envelope": envelope(healthy, regime)}


def drift_report(current: DataFrame, reference: dict[str, DataFrame], columns: list[str], regime: list[str], normal: Column | None = None) -> DataFrame:
    """kind, column, value, flagged: PSI on samples judged normal (if there are enough), and envelope shares."""
    calm = current.filter(normal) if normal is not None else current
    enough = calm.agg(F.count("*").alias("_n"))
    p = psi(reference["shares"], shares(calm, columns, reference["edges"])).join(F.broadcast(enough)).filter(F.col("_n") >= LEAST_ROWS)  # one row
    p = p.select(F.lit("psi").alias("kind"), "column", F.col("psi").alias("value"), (F.col("psi") > PSI_LIMIT).alias("flagged"))
    o = outside_share(current, reference["envelope"], regime)
    return p.unionByName(o.select(F.lit("envelope").alias("kind"), "column", F.col("outside").alias("value"), (F.col("outside") > ENVELOPE_LIMIT).alias("flagged")))


def retrain_flag(report: DataFrame) -> DataFrame:
    """retrain_recommended, reasons."""
    reason = F.when(F.col("flagged"), F.concat_ws(" ", "kind", "column"))
    return report.agg(F.coalesce(F.max("flagged"), F.lit(False)).alias("retrain_recommended"), F.array_join(F.array_sort(F.collect_list(reason)), "; ").alias("reasons"))


def what_if_offset(df: DataFrame, sensor: str, offset: float, asset: str, time: str) -> DataFrame:
    """The sensor shifted in the second half of each machine's history."""
    w = Window.partitionBy(asset)
    late = F.row_number().over(w.orderBy(time)) > F.count("*").over(w) / 2
    return df.withColumn(sensor, F.when(late, F.col(sensor) + offset).otherwise(F.col(sensor)))


def drift_by_asset(reference: DataFrame, shares_by_asset: DataFrame, asset: str) -> DataFrame:
    """Worst PSI of each asset against its own reference shares; both have (asset, column, bin, share)."""
    j = reference.withColumnRenamed("share", "r").join(shares_by_asset.withColumnRenamed("share", "c"), [asset, "column", "bin"], "full")
    r, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(FLOOR)) for x in "rc")
    return j.groupBy(asset, "column").agg(F.sum((c - r) * F.ln(c / r)).alias("psi")).groupBy(asset).agg(F.max("psi").alias("worst_psi"))
