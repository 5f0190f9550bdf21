"""Failure-effect risk register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.columns import normal_cdf
from fleethealth.operators.labels import latest_per_machine

#: Upper edges of likelihood bands 1 to 4, and risk classes by band times severity.
BANDS = (0.001, 0.01, 0.1, 0.5)
HIGH, MEDIUM = 12, 6
DEFAULT_EFFECT, DEFAULT_SEVERITY = "unspecified", 2


def p_fail(rul: Column, sigma: Column | float, horizon: Column | float) -> Column:
    """Probability of failure within the horizon, for a normally distributed remaining life."""
    s = F.greatest(sigma if isinstance(sigma, Column) else F.lit(float(sigma)), F.lit(1e-6))
    return normal_cdf((horizon - rul) / s)


def unit_likelihoods(scored: DataFrame, machine: str, horizon: float, sigma: float = 10.0, rul: str | None = None, critical: list[str] = (), diagnosis: str | None = None, confidence: str | None = None, confirmed: str | None = None, healthy: list[str] = ("healthy",)) -> DataFrame:
    """machine, failure_mode, p_fail in long form.

    Remaining life gives ``degradation``; each p_critical_<c> gives c; without these a confirmed alarm
    gives its diagnosis with its confidence, or with no diagnosis 0.5; healthy labels are left out."""
    parts = []
    row = lambda mode, p: scored.select(machine, mode.alias("failure_mode"), p.cast("double").alias("p_fail"))
    if rul:
        parts.append(row(F.lit("degradation"), p_fail(F.col(rul), sigma, F.lit(float(horizon)))))
    if critical:
        parts.append(scored.select(machine, *critical).unpivot([machine], list(critical), "failure_mode", "p_fail").withColumn("failure_mode", F.regexp_replace("failure_mode", "^p_critical_", "")))
    if not parts and diagnosis:
        parts.append(row(F.col(diagnosis), F.when(F.col(confirmed), F.col(confidence)).otherwise(0.0)).filter(~F.col("failure_mode").isin(*healthy)))
    elif not parts:
        parts.append(row(F.lit("anomaly"), F.when(F.col(confirmed), 0.5).otherwise(0.0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("failure_mode").isNotNull() & F.col("p_fail").isNotNull())


def map_effects(modes: DataFrame, effects: DataFrame, mode: str = "failure_mode") -> DataFrame:
    """effect, severity, note of each mode; ``*`` in the table stands for modes that it doesn't name."""
    wild = effects.filter(F.col(mode) == "*").agg(*(F.first(c).alias(f"_w_{c}") for c in ("effect", "severity", "note")))
    out = modes.join(effects.filter(F.col(mode) != "*"), mode, "left").join(F.broadcast(wild))  # one row
    default = {"effect": DEFAULT_EFFECT, "severity": DEFAULT_SEVERITY, "note": ""}
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_w_{c}"), F.lit(d)) for c, d in default.items()}).drop(*(f"_w_{c}" for c in default))


def likelihood_band(p: Column) -> Column:
    return 1 + sum((p >= edge).cast("int") for edge in BANDS)


def risk_class(p: Column, severity: Column) -> Column:
    level = likelihood_band(p) * severity
    return F.when(level >= HIGH, "high").when(level >= MEDIUM, "medium").otherwise("low")


def class_order(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def risk_register(likelihoods: DataFrame, effects: DataFrame, machine: str) -> DataFrame:
    """The worst probability of each machine and mode with band, class, effect and action, in order of risk."""
    worst = likelihoods.groupBy(machine, "failure_mode").agg(F.max("p_fail").alias("p_fail"))
    out = map_effects(worst, effects).withColumn("band", likelihood_band(F.col("p_fail"))).withColumn("risk", risk_class(F.col("p_fail"), F.col("severity")))
    action = F.when(F.col("risk") == "high", "plan service now").when(F.col("risk") == "medium", "inspect at next stop").otherwise("monitor")
    return out.withColumn("action", action).orderBy(class_order(F.col("risk")), F.desc("severity"), F.desc("p_fail"), machine, "failure_mode")


def latest_register(scored: DataFrame, effects: DataFrame, machine: str, time: str, **likelihood_columns) -> DataFrame:
    return risk_register(unit_likelihoods(latest_per_machine(scored, machine, time), machine, **likelihood_columns), effects, machine)


def k_out_of_n_failure(p: Column, required: Column | int) -> Column:
    """Probability that fewer than ``required`` of the units stay up, from an array of failure probabilities."""
    n = F.size(p)
    start = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    step = lambda d, q: F.transform(d, lambda v, k: v * (1 - q) + F.when(k > 0, F.get(d, k - 1)).otherwise(0.0) * q)
    failed = F.aggregate(p, start, step)
    need = n - required + 1
    tail = F.aggregate(F.slice(failed, F.greatest(need, F.lit(0)) + 1, n + 1), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.lit(required) > n if not isinstance(required, Column) else required > n, 1.0).otherwise(F.least(F.lit(1.0), tail))


def system_risk(register: DataFrame, units: DataFrame, machine: str, system: str = "system") -> DataFrame:
    """system, units, required, worst_p, p_lost, risk; ``units`` has (system, machine, required)."""
    worst = register.groupBy(machine).agg(F.max("p_fail").alias("p"), F.max("severity").alias("s"))
    j = units.join(worst, machine, "left")
    g = j.groupBy(system).agg(F.count("*").alias("units"), F.max("required").alias("required"), F.max(F.coalesce("p", F.lit(0.0))).alias("worst_p"), F.array_sort(F.collect_list(F.coalesce("p", F.lit(0.0)))).alias("ps"), F.coalesce(F.max("s"), F.lit(DEFAULT_SEVERITY)).alias("severity"))
    out = g.withColumn("p_lost", k_out_of_n_failure(F.col("ps"), F.col("required"))).drop("ps")
    return out.withColumn("risk", risk_class(F.col("p_lost"), F.col("severity"))).orderBy(class_order(F.col("risk")), F.desc("p_lost"), system)


def group_units(machines: DataFrame, machine: str, size: int, site: str) -> DataFrame:
    """Systems of ``size`` machines within a site, in machine order; incomplete ones are dropped."""
    w = Window.partitionBy(site)
    rn = F.row_number().over(w.orderBy(machine)) - 1
    out = machines.withColumn("system", F.floor(rn / size)).withColumn("_n", F.count("*").over(Window.partitionBy(site, "system")))
    return out.filter(F.col("_n") == size).drop("_n")
