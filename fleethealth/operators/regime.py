"""Operating-mode residuals and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.columns import trailing

DISCRETE_MOST = 50


def regime_mode(healthy: DataFrame, regime: list[str]) -> str:
    """none, discrete (at most 50 combinations in healthy data) or continuous."""
    if not regime:
        return "none"
    n = healthy.select(*regime).distinct().limit(DISCRETE_MOST + 1).count()
    return "discrete" if n <= DISCRETE_MOST else "continuous"


def asset_baseline(df: DataFrame, columns: list[str], asset: str, time: str, rows: int) -> DataFrame:
    """Columns less the mean of the machine's first rows; one window sort, no self-join.

    Rows of one time are ordered by their values, so a rerun picks the same ones."""
    w = Window.partitionBy(asset).orderBy(time, *columns)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    base = {c: F.col(c) - F.coalesce(F.avg(F.when(F.col("_rn") <= rows, F.col(c))).over(Window.partitionBy(asset)), F.lit(0.0)) for c in columns}
    return ranked.withColumns(base).drop("_rn")


def regime_means(healthy: DataFrame, sensors: list[str], regime: list[str]) -> DataFrame:
    """mean_<sensor> of each regime and gmean_<sensor> of all, which stands in for unseen regimes."""
    total = healthy.agg(*(F.avg(s).alias(f"gmean_{s}") for s in sensors))
    if not regime:
        return total.select("*", *(F.col(f"gmean_{s}").alias(f"mean_{s}") for s in sensors))
    return healthy.groupBy(*regime).agg(*(F.avg(s).alias(f"mean_{s}") for s in sensors)).join(F.broadcast(total))  # one row


def _looked_up(df: DataFrame, params: DataFrame, regime: list[str], sensors: list[str], kind: str) -> DataFrame:
    """``df`` with _<kind>_<sensor>: the regime's value or else the global one."""
    whole = params.agg(*(F.first(f"g{kind}_{s}").alias(f"g{kind}_{s}") for s in sensors))
    if not regime:
        return df.join(F.broadcast(whole)).withColumns({f"_{kind}_{s}": F.col(f"g{kind}_{s}") for s in sensors}).drop(*(f"g{kind}_{s}" for s in sensors))
    out = df.join(params.select(*regime, *(f"{kind}_{s}" for s in sensors)), regime, "left").join(F.broadcast(whole))
    return out.withColumns({f"_{kind}_{s}": F.coalesce(F.col(f"{kind}_{s}"), F.col(f"g{kind}_{s}")) for s in sensors}).drop(*(f"{k}{kind}_{s}" for s in sensors for k in ("", "g")))


def residuals(df: DataFrame, means: DataFrame, sensors: list[str], regime: list[str]) -> DataFrame:
    """r_<sensor>: the sensor less what its regime leads to expect."""
    out = _looked_up(df, means, regime, sensors, "mean")
    return out.withColumns({f"r_{s}": F.col(s) - F.col(f"_mean_{s}") for s in sensors}).drop(*(f"_mean_{s}" for s in sensors))


def regime_spreads(healthy_residuals: DataFrame, sensors: list[str], regime: list[str]) -> DataFrame:
    """std_<sensor> of each regime (zero becomes null) and gstd_<sensor> of all (zero becomes 1e-9)."""
    total = healthy_residuals.agg(*(F.when(F.stddev_samp(f"r_{s}") == 0, 1e-9).otherwise(F.stddev_samp(f"r_{s}")).alias(f"gstd_{s}") for s in sensors))
    if not regime:
        return total
    each = healthy_residuals.groupBy(*regime).agg(*(F.nullif(F.stddev_samp(f"r_{s}"), F.lit(0.0)).alias(f"std_{s}") for s in sensors))
    return each.join(F.broadcast(total))  # one row


def residual_z(df: DataFrame, spreads: DataFrame, sensors: list[str], regime: list[str]) -> DataFrame:
    """z_<sensor> from r_<sensor>."""
    out = _looked_up(df, spreads, regime, sensors, "std")
    return out.withColumns({f"z_{s}": F.col(f"r_{s}") / F.col(f"_std_{s}") for s in sensors}).drop(*(f"_std_{s}" for s in sensors))


def fit_regime(healthy: DataFrame, sensors: list[str], regime: list[str], asset: str | None = None, time: str | None = None, baseline_rows: int = 30) -> tuple[DataFrame, DataFrame]:
    """(means, spreads) as tables; spreads are of residuals after the machine's baseline, if it has one."""
    means = regime_means(healthy, sensors, regime)
    r = residuals(healthy, means, sensors, regime)
    if asset:
        r = asset_baseline(r, [f"r_{s}" for s in sensors], asset, time, baseline_rows)
    return means, regime_spreads(r, sensors, regime)


def transform_regime(df: DataFrame, means: DataFrame, spreads: DataFrame, sensors: list[str], regime: list[str], asset: str | None = None, time: str | None = None, baseline_rows: int = 30, smoothing_rows: int = 1) -> DataFrame:
    """z_<sensor> of any rows, smoothed over trailing rows if asked for."""
    r = residuals(df, means, sensors, regime)
    if asset:
        r = asset_baseline(r, [f"r_{s}" for s in sensors], asset, time, baseline_rows)
    z = residual_z(r, spreads, sensors, regime)
    return smooth(z, [f"z_{s}" for s in sensors], asset, time, smoothing_rows) if asset and smoothing_rows > 1 else z


def smooth(df: DataFrame, columns: list[str], asset: str, time: str, rows: int) -> DataFrame:
    w = trailing([asset], [time], rows)
    return df.withColumns({c: F.avg(c).over(w) for c in columns})


def warm_start(history: DataFrame, new: DataFrame, columns: list[str], asset: str, time: str, rows: int) -> DataFrame:
    """New rows, smoothed over windows that reach back into history."""
    both = history.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return smooth(both, columns, asset, time, rows).filter("_new").drop("_new")


def trend_slope(df: DataFrame, columns: list[str], asset: str, time: str, rows: int) -> DataFrame:
    """slope_<column>: least-squares slope over trailing rows; 0 with under 3 rows or constant time."""
    w = trailing([asset], [time], rows)
    t = F.col(time).cast("double")
    return df.withColumns({f"slope_{c}": F.when(F.count(c).over(w) >= 3, F.coalesce(F.regr_slope(F.col(c), t).over(w), F.lit(0.0))).otherwise(0.0) for c in columns})


def residual_features(df: DataFrame, sensors: list[str], mean: dict[str, float], std: dict[str, float], asset: str, time: str, per_asset_baseline: bool = True, baseline_window: int = 30, smoothing_window: int = 1, trend_window: int = 20) -> DataFrame:
    """z and slopes of every sensor in one plan; all windows share the machine's sort."""
    out = df.withColumns({f"z_{s}": (F.col(s) - mean[s]) / std[s] for s in sensors})
    z = [f"z_{s}" for s in sensors]
    if per_asset_baseline:
        out = asset_baseline(out, z, asset, time, baseline_window)
    if smoothing_window > 1:
        out = smooth(out, z, asset, time, smoothing_window)
    return trend_slope(out, z, asset, time, trend_window)


def rul_features(df: DataFrame, sensors: list[str], time: str) -> DataFrame:
    """z, slopes, log of the health score and time, as feature columns."""
    return df.select("*", F.log1p(F.greatest(F.col("health_score"), F.lit(0.0))).alias("log_health"), F.col(time).cast("double").alias("time_feature"))


def fit_continuous(healthy: DataFrame, sensors: list[str], regime: list[str], trees: int = 40) -> dict:
    """Boosted trees of each sensor on the regime columns, as MLlib pipelines."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from fleethealth.operators.learn import boosted_regressor

    assembler = lambda: VectorAssembler(inputCols=regime, outputCol="_raw")
    grown = lambda s: GBTRegressor(featuresCol="_raw", labelCol=s, predictionCol=f"_mean_{s}", maxIter=trees, maxDepth=4, stepSize=0.1, seed=0)
    return {s: boosted_regressor(healthy.select(*regime, s).dropna(), regime, s, assembler(), grown(s)) for s in sensors}


def continuous_residuals(df: DataFrame, models: dict, sensors: list[str]) -> DataFrame:
    from fleethealth.operators.learn import without_bins

    out = df
    for s in sensors:
        out = without_bins(models[s].transform(out)).withColumn(f"r_{s}", F.col(s) - F.col(f"_mean_{s}")).drop("_raw", f"_mean_{s}")
    return out
