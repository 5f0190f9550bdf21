"""Is the service used, and are its alerts right?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleethealth.functions.columns import wilson

#: Hourly cost of a processor, allowed actions and outcomes, limits of the policies.
CPU_HOUR = 0.05
ACTIONS = ("inspected", "work_order", "deferred", "false_alarm")
OUTCOMES = ("fault_confirmed", "no_fault_found")
MIN_PRECISION, MIN_ACK, MIN_LABELS, MIN_ALERTS, MIN_SLICE = 0.5, 0.6, 20, 20, 10


def log_calls(calls: DataFrame) -> DataFrame:
    """Calls to append; a missing cost follows from processor time."""
    return calls.withColumn("cost_usd", F.coalesce(F.col("cost_usd"), F.col("cpu_ms") / 3.6e6 * CPU_HOUR))


def record_alerts(scored: DataFrame, asset: Column, machine: str, time: str, slice_by: Column) -> DataFrame:
    """Confirmed alarms as alerts; the id follows from asset, machine and time, so a rerun adds none."""
    rows = scored.filter("alarm_confirmed").withColumn("asset", asset)
    return rows.select(F.sha2(F.concat_ws("|", "asset", F.col(machine).cast("string"), F.col(time).cast("string")), 256).alias("alert_id"), F.col(time).alias("ts"), "asset", F.col(machine).alias("machine"), "health_score", slice_by.alias("slice"))


def apply_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with the latest valid acknowledgement: acked_ts, action."""
    last = acks.filter(F.col("action").isin(*ACTIONS)).groupBy("alert_id").agg(F.max("ts").alias("acked_ts"), F.max_by("action", F.struct("ts", "action")).alias("action"))
    return alerts.join(last, "alert_id", "left")


def unknown_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    return acks.join(alerts, "alert_id", "left_anti")


def apply_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("outcome").isin(*OUTCOMES))


def last_labels(labels: DataFrame) -> DataFrame:
    return apply_labels(labels).groupBy("alert_id").agg(F.max_by("outcome", F.struct("ts", "outcome")).alias("outcome"))


def service_health(calls: DataFrame) -> DataFrame:
    """calls, latency quantiles, cost and tokens in all (endpoint is null) and by endpoint."""
    q = lambda p: F.percentile("latency_ms", F.lit(p))
    return calls.rollup("endpoint").agg(F.count("*").alias("calls"), q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), F.sum("cost_usd").alias("cost_usd"), F.sum("tokens").alias("tokens"))


def adoption(alerts: DataFrame) -> DataFrame:
    """alerts, ack_rate, median_hours_to_ack, acted_on_share, dismissed_share; ``ts`` and ``acked_ts`` in seconds."""
    acked = F.col("acked_ts").isNotNull()
    n = F.sum(acked.cast("int"))
    share = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")) / F.greatest(n, F.lit(1))
    return alerts.agg(F.count("*").alias("alerts"), F.avg(acked.cast("int")).alias("ack_rate"), F.percentile((F.col("acked_ts") - F.col("ts")) / 3600, F.lit(0.5)).alias("median_hours_to_ack"), share(F.col("action").isin("inspected", "work_order")).alias("acted_on_share"), share(F.col("action") == "false_alarm").alias("dismissed_share"))


def alert_precision(labels: DataFrame) -> DataFrame:
    """labelled, precision, ci_low, ci_high over the last label of each alert."""
    g = last_labels(labels).agg(F.count("*").alias("labelled"), F.coalesce(F.sum((F.col("outcome") == "fault_confirmed").cast("int")), F.lit(0)).alias("_tp"))
    low, high = wilson(F.col("_tp"), F.col("labelled"))
    return g.select("labelled", F.try_divide(F.col("_tp").cast("double"), F.col("labelled")).alias("precision"), low.alias("ci_low"), high.alias("ci_high"))


def slice_false_alarms(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """slice, labelled, false_alarm_share, ci_low, ci_high; an empty slice is ``all``."""
    j = alerts.join(last_labels(labels), "alert_id").withColumn("slice", F.when(F.col("slice") == "", "all").otherwise(F.col("slice")))
    g = j.groupBy("slice").agg(F.count("*").alias("labelled"), F.sum((F.col("outcome") == "no_fault_found").cast("int")).alias("_fp"))
    low, high = wilson(F.col("_fp"), F.col("labelled"))
    return g.select("slice", "labelled", (F.col("_fp") / F.col("labelled")).alias("false_alarm_share"), low.alias("ci_low"), high.alias("ci_high"))


def disparity(slices: DataFrame, min_n: int = MIN_SLICE, ratio: float = 2.0, gap: float = 0.1) -> DataFrame:
    """disparity_flag, worst_slice, best_slice, worst_rate, best_rate over slices with enough labels."""
    g = slices.filter(F.col("labelled") >= min_n).agg(F.count("*").alias("_n"), F.min_by("slice", F.struct(-F.col("false_alarm_share"), F.col("slice"))).alias("worst_slice"), F.min_by("slice", F.struct("false_alarm_share", "slice")).alias("best_slice"), F.max("false_alarm_share").alias("worst_rate"), F.min("false_alarm_share").alias("best_rate"))
    flag = (F.col("_n") >= 2) & (F.col("worst_rate") - F.col("best_rate") > gap) & (F.col("worst_rate") > ratio * F.greatest(F.col("best_rate"), F.lit(1e-9)))
    return g.select(F.coalesce(flag, F.lit(False)).alias("disparity_flag"), "worst_slice", "best_slice", "worst_rate", "best_rate")


def slice_parity(predictions: DataFrame, slice_by: str, alarm: str, fault: str) -> DataFrame:
    """Rates of each slice with bounds; flagged if much worse than the best slice."""
    hit, bad = F.col(alarm).cast("int"), F.col(fault).cast("boolean")
    g = predictions.groupBy(slice_by).agg(F.sum((~bad).cast("int")).alias("healthy"), F.sum(bad.cast("int")).alias("faulty"), F.sum(F.when(~bad, hit).otherwise(0)).alias("_fa"), F.sum(F.when(bad, hit).otherwise(0)).alias("_det"))
    fa, det = F.try_divide(F.col("_fa").cast("double"), F.col("healthy")), F.try_divide(F.col("_det").cast("double"), F.col("faulty"))
    out = g.select(slice_by, "healthy", "faulty", fa.alias("false_alarm_rate"), wilson(F.col("_fa"), F.col("healthy"))[1].alias("fa_ci_high"), det.alias("detection_rate"), wilson(F.col("_det"), F.col("faulty"))[0].alias("det_ci_low"))
    best = out.agg(F.max("detection_rate").alias("_best_det"), F.min("false_alarm_rate").alias("_best_fa"))
    flag = F.coalesce(F.col("detection_rate") < F.col("_best_det") - 0.15, F.lit(False)) | F.coalesce(F.col("false_alarm_rate") > F.col("_best_fa") + 0.05, F.lit(False))
    return out.join(F.broadcast(best)).withColumn("flag", flag).drop("_best_det", "_best_fa")  # one row


def retrain_policy(drift: DataFrame, precision: DataFrame, adopted: DataFrame, slices: DataFrame) -> DataFrame:
    """action, why: what the monitored signals call for; each input is one row."""
    pct = lambda c: F.concat(F.bround(100 * F.col(c), 0).cast("int").cast("string"), F.lit("%"))
    rules = [
        drift.filter("retrain_recommended").select(F.lit("retrain").alias("action"), F.col("reasons").alias("why")),
        precision.filter((F.col("labelled") >= MIN_LABELS) & (F.col("ci_high") < MIN_PRECISION)).select(F.lit("recalibrate").alias("action"), F.concat(F.lit("alert precision "), pct("precision"), F.lit(" (upper CI "), pct("ci_high"), F.lit(")")).alias("why")),
        adopted.filter((F.col("alerts") >= MIN_ALERTS) & (F.col("ack_rate") < MIN_ACK)).select(F.lit("process_review").alias("action"), F.concat(F.lit("only "), pct("ack_rate"), F.lit(" of alerts acknowledged")).alias("why")),
        slices.filter("disparity_flag").select(F.lit("investigate_slice").alias("action"), F.concat(F.lit("false alarms "), pct("worst_rate"), F.lit(" on "), F.col("worst_slice"), F.lit(" vs "), pct("best_rate"), F.lit(" on "), F.col("best_slice")).alias("why")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    none = out.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("none").alias("action"), F.lit("all monitored signals within limits").alias("why"))
    return out.unionByName(none)


def recent(df: DataFrame, time: str, now: Column, days: float) -> DataFrame:
    """Rows of the last days; labels are not cut this way, as they come late."""
    return df.filter(F.col(time) >= now - days * 86400)


def summary(calls: DataFrame, alerts: DataFrame, labels: DataFrame, now: Column, since_days: float) -> DataFrame:
    """section, key, value of the recent window."""
    c, a = recent(calls, "ts", now, since_days), recent(alerts, "ts", now, since_days)
    parts = [("service", service_health(c).filter("endpoint is null").drop("endpoint")), ("adoption", adoption(a)), ("accuracy", alert_precision(labels))]
    out = None
    for name, df in parts:
        long = df.select(*(F.col(x).cast("double").alias(x) for x in df.columns)).unpivot([], df.columns, "key", "value").select(F.lit(name).alias("section"), "key", "value")
        out = long if out is None else out.unionByName(long)
    return out


