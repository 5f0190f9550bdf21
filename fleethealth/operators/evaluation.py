"""How well alarms warned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alarm_table(df: DataFrame, confirmed: str, asset: str, time: str, warm_up: float = 0, early_fraction: float = 0.5) -> DataFrame:
    """life, alarm_at, lead, false_early, missed of each machine; alarms during warm-up don't count."""
    g = df.groupBy(asset).agg(F.max(time).alias("life"), F.min(F.when(F.col(confirmed) & (F.col(time) > warm_up), F.col(time))).alias("alarm_at"))
    return g.select(asset, "life", "alarm_at", (F.col("life") - F.col("alarm_at")).alias("lead"), F.coalesce(F.col("alarm_at") <= early_fraction * F.col("life"), F.lit(False)).alias("false_early"), F.col("alarm_at").isNull().alias("missed"))


def warning_summary(table: DataFrame, enough: float = 20) -> DataFrame:
    share = lambda c: F.bround(100 * F.avg(c.cast("int")), 1)
    good = ~F.col("false_early") & ~F.col("missed")
    return table.agg(F.count("*").alias("machines"), share(good).alias("pct_warned"), F.percentile("lead", F.lit(0.5)).alias("median_lead"), F.min("lead").alias("min_lead"), share(F.coalesce(good & (F.col("lead") >= enough), F.lit(False))).alias("pct_lead_enough"), share(F.col("false_early")).alias("pct_false_early"), share(F.col("missed")).alias("pct_missed"))


def long_methods(df: DataFrame, keep: list[str], methods: list[str]) -> DataFrame:
    """keep, method, alarm."""
    return df.unpivot(keep, methods, "method", "alarm")


def detection_table(df: DataFrame, faulty: str, methods: list[str]) -> DataFrame:
    """method, false_alarm_rate on healthy rows, detection_rate on faulty rows."""
    x = long_methods(df, [faulty], methods)
    hit = F.col("alarm").cast("int")
    return x.groupBy("method").agg(F.avg(F.when(~F.col(faulty), hit)).alias("false_alarm_rate"), F.avg(F.when(F.col(faulty), hit)).alias("detection_rate"))


def detection_by(df: DataFrame, group: str, methods: list[str], groups: list | None = None) -> DataFrame:
    """A row per group, a column per method; numbered groups sort by their number."""
    x = long_methods(df.filter(F.col(group).isNotNull()), [group], methods)
    out = x.groupBy(group).pivot("method", methods).agg(F.avg(F.col("alarm").cast("int")))
    return out.orderBy(F.regexp_extract(F.col(group).cast("string"), r"^(\D*)", 1), F.expr(f"try_cast(regexp_extract(cast(`{group}` as string), '([0-9]+)', 1) as int)"), group)


def detection_delay(df: DataFrame, run: str, sample: str, faulty: str, alarm: str, persistence: int) -> DataFrame:
    """onset, detected_at, delay of each run with an onset; persistence starts anew at the onset."""
    after = df.withColumn("onset", F.min(F.when(F.col(faulty), F.col(sample))).over(Window.partitionBy(run))).filter(F.col(sample) >= F.col("onset"))
    w = Window.partitionBy(run).orderBy(sample).rowsBetween(-(persistence - 1), 0)
    held = after.withColumn("_ok", (F.min(F.col(alarm).cast("int")).over(w) == 1) & (F.count(F.lit(1)).over(w) == persistence))
    return held.groupBy(run, "onset").agg(F.min(F.when(F.col("_ok"), F.col(sample))).alias("detected_at")).withColumn("delay", F.col("detected_at") - F.col("onset"))


def delay_summary(delays: DataFrame) -> DataFrame:
    return delays.agg(F.count("*").alias("runs"), F.bround(100 * F.avg(F.col("delay").isNotNull().cast("int")), 1).alias("pct_detected"), F.percentile("delay", F.lit(0.5)).alias("median_delay"))


def event_outcome(rows: DataFrame, events: DataFrame, event: str, ident: str, time: str, confirmed: str, normal: str | None = None) -> DataFrame:
    """Outcome of each event of (event, start_id, end_id, event_end): an equi-join on the event, then the interval.

    any_alarm, hit, false_before, first_hit, lead_hours, alarm_rate on normal rows."""
    j = rows.join(events, event)
    inside, on = F.col(ident).between(F.col("start_id"), F.col("end_id")), F.coalesce(F.col(confirmed), F.lit(False))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    calm = F.col(normal) & ~inside if normal else ~inside
    out = j.groupBy(event).agg(F.max(on.cast("int")).cast("boolean").alias("any_alarm"), F.max((on & inside).cast("int")).cast("boolean").alias("hit"), F.max((on & (F.col(ident) < F.col("start_id"))).cast("int")).cast("boolean").alias("false_before"), F.min(F.when(on & inside, F.col(time))).alias("first_hit"), F.max("event_end").alias("event_end"), F.avg(F.when(calm, on.cast("int"))).alias("alarm_rate"))
    return out.withColumn("lead_hours", (micros(F.col("event_end")) - micros(F.col("first_hit"))) / 3.6e9)


def event_summary(outcomes: DataFrame, by: str, is_fault: str) -> DataFrame:
    """Per method: events, detected, median lead, early alarms, false alarms on normal events, mean rate."""
    fault = F.col(is_fault)
    n = lambda c: F.sum(c.cast("int"))
    return outcomes.groupBy(by).agg(n(fault).alias("fault_events"), n(fault & F.col("hit")).alias("detected"), F.percentile(F.when(fault, F.col("lead_hours")), F.lit(0.5)).alias("median_lead_hours"), n(fault & F.col("false_before")).alias("early_alarms"), n(~fault & F.col("any_alarm")).alias("false_alarms"), F.avg("alarm_rate").alias("mean_alarm_rate"))


def root_cause(rows: DataFrame, events: DataFrame, event: str, ident: str, confirmed: str, contributions: str) -> DataFrame:
    """The contribution map at the first confirmed alarm inside each event."""
    j = rows.join(events, event).filter(F.col(confirmed) & F.col(ident).between(F.col("start_id"), F.col("end_id")))
    return j.groupBy(event).agg(F.min_by(contributions, ident).alias("root_cause"))


def critical_detection(df: DataFrame, tier: str, methods: list[str]) -> DataFrame:
    """A row per method, a column of alarm rates per tier."""
    tiers = ["critical", "normal_wear", "degraded"]
    return long_methods(df, [tier], methods).groupBy("method").pivot(tier, tiers).agg(F.avg(F.col("alarm").cast("int")))


def example_alert(df: DataFrame, alarm: str, group: str, severity: str, keys: list[str]) -> DataFrame:
    """The alarmed row of median severity of each class."""
    w = Window.partitionBy(group)
    ranked = df.filter(F.col(alarm)).withColumn("_rn", F.row_number().over(w.orderBy(severity, *keys)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("_rn") == F.floor(F.col("_n") / 2)).drop("_rn", "_n")


def alarm_rate(df: DataFrame, alarm: str) -> DataFrame:
    return df.agg(F.avg(F.col(alarm).cast("int")).alias("alarm_rate"))
