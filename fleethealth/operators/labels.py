"""Labels, derivations and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.columns import clip, trailing


def rul_label(df: DataFrame, asset: str, time: str, cap: float | None = None) -> DataFrame:
    """``life`` of the machine and ``rul``, the life that is left, capped if asked for."""
    life = F.max(time).over(Window.partitionBy(asset))
    rul = life - F.col(time)
    return df.withColumn("life", life).withColumn("rul", F.least(rul, F.lit(cap)) if cap is not None else rul)


def true_rul_truncated(df: DataFrame, truth: DataFrame, asset: str, time: str) -> DataFrame:
    """``rul`` of histories cut before failure; ``truth`` has the asset and ``rul_at_end``."""
    return df.join(truth, asset).withColumn("rul", F.col("rul_at_end") + F.max(time).over(Window.partitionBy(asset)) - F.col(time))


def state_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dense number, from 0 in key order, of each combination; ranks the distinct combinations only."""
    ids = df.select(*keys).distinct().withColumn("state_id", F.dense_rank().over(Window.orderBy(*keys)) - 1)
    same = [df[k].eqNullSafe(ids[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(ids, on).select(df["*"], ids["state_id"])


def trailing_mean(df: DataFrame, column: str, asset: str, time: str, rows: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(column).over(trailing([asset], [time], rows)))


def status_whitelist(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """For cleaning training history only: the prediction period must not be filtered by status."""
    return df.filter(F.col(column).isin(*allowed))


def segment_id(df: DataFrame, settings: list[str], order: str, partition: list[str]) -> DataFrame:
    """A new segment whenever a setting differs from the row before, numbered from 0."""
    w = Window.partitionBy(*partition).orderBy(order)
    changed = F.lit(False)
    for s in settings:
        changed = changed | ~F.lag(s).over(w).eqNullSafe(F.col(s))
    step = F.when(F.row_number().over(w) == 1, 0).otherwise(changed.cast("int"))
    return df.withColumn("_step", step).withColumn("segment", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def onset_flag(df: DataFrame, fault: str, sample: str, onset: Column | int) -> DataFrame:
    return df.withColumn("faulty", (F.col(fault) > 0) & (F.col(sample) >= onset))


def label_states(df: DataFrame, components: dict[str, tuple[float, float]], minimum: float, healthy_below: float) -> DataFrame:
    """Severities, ``severity``, ``faulty`` and ``condition`` from each component's (new, worst) values.

    healthy if all are below ``healthy_below``, combined if several reach ``minimum``, else the worst
    component, the first in order among equals."""
    sev = {c: clip((F.lit(new) - F.col(c)) / (new - worst), 0.0, 1.0) for c, (new, worst) in components.items()}
    out = df.withColumns({f"severity_{c}": x for c, x in sev.items()})
    top = F.greatest(*(F.col(f"severity_{c}") for c in components)) if len(components) > 1 else F.col(f"severity_{next(iter(components))}")
    worst = F.coalesce(*(F.when(F.col(f"severity_{c}") == top, F.lit(c)) for c in components))
    many = sum((F.col(f"severity_{c}") >= minimum).cast("int") for c in components)
    return out.withColumn("severity", top).withColumn("faulty", top >= minimum).withColumn("condition", F.when(top < healthy_below, "healthy").when(many > 1, "combined").otherwise(worst))


def tier(grades: list[str], critical: dict[str, list], normal: dict[str, list]) -> Column:
    """critical if any component's grade is critical, normal_wear if all are normal, else degraded."""
    any_critical, all_normal = F.lit(False), F.lit(True)
    for g in grades:
        any_critical = any_critical | F.col(g).isin(*critical[g])
        all_normal = all_normal & F.col(g).isin(*normal[g])
    return F.when(any_critical, "critical").when(all_normal, "normal_wear").otherwise("degraded")


def severity_bin(x: Column) -> Column:
    """Left-closed fifths from 0.2 on; null below."""
    return F.when(x < 0.2, F.lit(None)).when(x < 0.4, "0.2-0.4").when(x < 0.6, "0.4-0.6").when(x < 0.8, "0.6-0.8").when(x < 1.0001, "0.8-1.0")


def fault_class(faulty: Column, fault: Column, healthy: str = "healthy") -> Column:
    return F.when(faulty, fault).otherwise(F.lit(healthy))


def healthy_window(df: DataFrame, asset: str, time: str, rows: int) -> DataFrame:
    """The first rows of each machine."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(asset).orderBy(time))).filter(F.col("_rn") <= rows).drop("_rn")


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def latest_per_machine(df: DataFrame, asset: str, time: str) -> DataFrame:
    """The newest row of each machine: a pre-aggregated maximum, no sort."""
    return df.groupBy(asset).agg(F.max_by(F.struct(*df.columns), time).alias("_last")).select("_last.*")


def stratified_sample(df: DataFrame, stratum: str, keys: list[str], rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` of each class, by hash order."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows).drop("_rn")


def split_held_out(df: DataFrame, column: str, value, healthy: Column, order: str, fraction: float) -> DataFrame:
    """``split``: faulty rows by a held-out value; healthy ones by time, the last fraction is test."""
    w = Window.partitionBy(healthy)
    n_test = F.bround(F.count("*").over(w) * fraction)
    late = F.row_number().over(w.orderBy(order)) > F.count("*").over(w) - n_test
    return df.withColumn("split", F.when(healthy & late | ~healthy & (F.col(column) == F.lit(value)), "test").otherwise("train"))
