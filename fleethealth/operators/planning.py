"""Service planning: costs, assignment per group, and what plans bring."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.quantiles import exact_quantiles
from fleethealth.operators.risk import p_fail

AT_RISK = 0.01


def service_cost_matrix(assets: DataFrame, rul: str, horizon: int, sigma: float = 10.0, preventive: float = 20.0, failure: float = 200.0, waste: float = 0.5, safety: float = 0.0, keep: list[str] = ()) -> DataFrame:
    """keep, day, cost, skip_cost, p_day, p_end of machines with at least a 1 % chance of failing in the horizon."""
    risky = assets.withColumn("p_end", p_fail(F.col(rul), sigma, F.lit(float(horizon)))).filter(F.col("p_end") >= AT_RISK)
    days = risky.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    p = p_fail(F.col(rul), sigma, F.col("day").cast("double"))
    cost = preventive * (1 - F.col("p_day")) + (failure + safety) * F.col("p_day") + waste * F.greatest(F.col(rul) - F.col("day"), F.lit(0.0))
    return days.withColumn("p_day", p).withColumn("cost", cost).withColumn("skip_cost", (failure + safety) * F.col("p_end")).select(*keep, rul, "day", "cost", "skip_cost", "p_day", "p_end")


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            r = match[j]
            free = ~used[1:]
            cur = cost[r - 1] - u[r] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j
            nxt = int(np.argmin(np.where(free, low[1:], np.inf))) + 1
            step = low[nxt]
            u[match[used]] += step
            v[used] -= step
            low[1:][free] -= step
            j = nxt
        while j:
            match[j], j = match[way[j]], way[j]
    out = np.zeros(n, int)
    for c in range(1, m + 1):
        if match[c]:
            out[match[c] - 1] = c - 1
    return out


def _solve(pdf: pd.DataFrame, asset: str) -> pd.DataFrame:
    """The days that save most, one for a machine and ``slots`` machines for a day; rows are (asset, day, saving, slots)."""
    pdf = pdf.sort_values(["day", asset])
    machines, column = np.unique(pdf[asset].to_numpy(), return_inverse=True)
    days, row = np.unique(pdf["day"].to_numpy(), return_inverse=True)
    places = np.repeat(np.arange(len(days)), pdf.groupby("day")["slots"].first().to_numpy())
    saving = np.full((len(days), len(machines)), -np.inf)
    saving[row, column] = pdf["saving"]
    cost = np.hstack([np.where(np.isfinite(saving), -saving, 1e12)[places], np.zeros((len(places), len(places)))])  # a slot may stay empty
    chosen = assign(cost)
    served = [(machines[c], int(days[places[k]])) for k, c in enumerate(chosen) if c < len(machines) and cost[k, c] < 0]
    return pd.DataFrame(served, columns=[asset, "service_day"])


#: Rows that a task holds before it lets go of those that can't be among the best.
HELD_ROWS = 200_000


def _leading(options: DataFrame, group: str, asset: str, most: int) -> DataFrame:
    """``options`` less rows that at least ``most`` others of their group and day come before, within the task.

    A sort of a task's rows would take memory with their number; this holds HELD_ROWS beside what it keeps."""

    def run(batches):
        held, rows, limit = [], 0, HELD_ROWS

        def best() -> pa.Table:
            t = pa.Table.from_batches(held).sort_by([(group, "ascending"), ("day", "ascending"), ("saving", "descending"), (asset, "ascending")])
            keys = [t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (group, "day")]
            new = np.ones(len(t), bool)
            new[1:] = (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)
            at = np.arange(len(t))
            return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < most))

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= limit:
                kept = best()
                if len(kept) > rows // 2:  # little can be let go of here; the window decides
                    yield from kept.to_batches()
                    kept = kept.slice(0, 0)
                held, rows = kept.to_batches(), len(kept)
                limit = rows + HELD_ROWS
        if rows:
            yield from best().to_batches()

    return options.mapInArrow(run, options.schema)


def _plan(options: DataFrame, group: str, asset: str) -> DataFrame:
    """group, asset, service_day from options (group, asset, day, cost, skip_cost, slots), exact within each group.

    With K slots in a group, a machine is only worth looking at on days on which it is among the K that save most:
    if it were served on another day, one of the K better ones would be idle and could take its place. So a group's
    task gets at most K machines a day, however many machines the group has; tasks keep K of a group and day before they are ranked."""
    kinds = dict(options.dtypes)
    useful = options.withColumn("saving", F.col("skip_cost") - F.col("cost")).filter("saving > 0 and slots > 0")
    slots = useful.select(group, "day", "slots").distinct().groupBy(group).agg(F.sum("slots").alias("_k"))
    best = F.row_number().over(Window.partitionBy(group, "day").orderBy(F.desc("saving"), asset))
    most = slots.agg(F.max("_k")).first()[0] or 0
    near = _leading(useful.select(group, asset, "day", "saving", "slots"), group, asset, most).withColumn("_rn", best).filter(F.col("_rn") <= most).join(slots, group).filter("_rn <= _k").select(group, asset, "day", "saving", "slots")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solve(pdf, asset).assign(**{group: pdf[group].iloc[0]})[[group, asset, "service_day"]]

    return near.groupBy(group).applyInPandas(solve, f"`{group}` {kinds[group]}, `{asset}` {kinds[asset]}, service_day long")


def plan_service(matrix: DataFrame, group: str, asset: str, horizon: int, capacity: int) -> DataFrame:
    """group, asset, service_day (null: not scheduled) of every machine: the cheapest plan with ``capacity`` services a day.

    Exact within each planning group; groups are solved in parallel."""
    plan = _plan(matrix.filter(F.col("day") <= horizon).withColumn("slots", F.lit(capacity)), group, asset)
    return matrix.select(group, asset).distinct().join(plan, [group, asset], "left")


def service_slots(calendar: DataFrame, capacity: int, installed: int, at_sea: bool = True) -> DataFrame:
    """slots of each (group, day, port, required): all in port; at sea only the margin above what is required."""
    sea = F.least(F.lit(capacity), F.greatest(F.lit(0), installed - F.col("required") - 1)) if at_sea else F.lit(0)
    return calendar.withColumn("slots", F.when(F.col("port"), capacity).otherwise(sea).cast("int"))


def plan_service_itinerary(matrix: DataFrame, slots: DataFrame, group: str, asset: str, max_risk: float | None = None) -> DataFrame:
    """group, asset, service_day, at_sea of every machine: the cheapest plan within each day's slots.

    Days on which a machine's risk is over ``max_risk`` are removed; if none with a slot is left, its
    first slot is forced; machines over the limit at the end of the horizon may not be skipped. A machine whose
    group has no slot is not scheduled."""
    j = matrix.join(slots.select(group, "day", "slots", "port"), [group, "day"]).filter("slots > 0")
    if max_risk is not None:
        own = Window.partitionBy(group, asset)
        calm = F.col("p_day") <= max_risk
        forced = ~F.max(calm).over(own) & (F.col("day") == F.min("day").over(own))
        j = j.withColumn("_open", calm | forced).filter("_open").withColumn("skip_cost", F.when(F.col("p_end") > max_risk, 1e6).otherwise(F.col("skip_cost")))
    plan = _plan(j, group, asset).join(slots.select(group, F.col("day").alias("service_day"), (~F.col("port")).alias("at_sea")), [group, "service_day"])
    return matrix.select(group, asset).distinct().join(plan, [group, asset], "left").select(group, asset, "service_day", "at_sea")


def plan_costs(plan: DataFrame, rul_true: str, horizon: int, preventive: float = 20.0, failure: float = 200.0, waste: float = 0.5) -> DataFrame:
    """served, failed, cost of each machine, once its true life is known."""
    served = F.coalesce(F.col("service_day") <= F.col(rul_true), F.lit(False))
    failed = ~F.col("served") & (F.col(rul_true) <= horizon)
    cost = F.when(F.col("served"), preventive + waste * F.greatest(F.col(rul_true) - F.col("service_day"), F.lit(0.0))).otherwise(0.0) + F.when(F.col("failed"), failure).otherwise(0.0)
    return plan.withColumn("served", served).withColumn("failed", failed).withColumn("cost", cost)


def evaluate_plan(costs: DataFrame, by: list[str] = ()) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("int"))
    return costs.groupBy(*by).agg(n("served").alias("served"), n("failed").alias("failures"), F.sum("cost").alias("total_cost"))


def age_based_plan(units: DataFrame, lives: DataFrame, ports: DataFrame, group: str, age: str, horizon: int, quantile: float = 0.1) -> DataFrame:
    """Service at the group's first port day once age plus horizon reaches a quantile of lives."""
    limit = exact_quantiles(lives, ["life"], [quantile])["life"][0]
    first = ports.groupBy(group).agg(F.min("day").alias("first_port"))
    due = F.col(age) + horizon >= F.lit(limit).cast("double")
    return units.join(first, group, "left").withColumn("service_day", F.when(due, F.coalesce("first_port", F.lit(1)))).drop("first_port")


def availability_ledger(units: DataFrame, demand: DataFrame, group: str, asset: str, horizon: int, service_days: int = 1, repair_days: int = 5) -> DataFrame:
    """group, day, available, required, blackout, no_margin from service_day and fail_day of each unit.

    A unit serviced no later than its failure day never fails; service wins on the day itself."""
    served = F.col("service_day").isNotNull() & (F.col("fail_day").isNull() | (F.col("service_day") <= F.col("fail_day")))
    start = F.when(served, F.col("service_day")).otherwise(F.col("fail_day"))
    length = F.when(served, service_days).otherwise(repair_days)
    down = units.withColumn("_start", start).withColumn("_end", F.least(F.lit(horizon), F.col("_start") + length - 1)).filter("_start <= _end").select(group, asset, F.explode(F.sequence(F.col("_start").cast("int"), F.col("_end").cast("int"))).alias("day")).distinct()
    per_day = down.groupBy(group, "day").agg(F.count("*").alias("_down"))
    installed = units.groupBy(group).agg(F.count("*").alias("_installed"))
    out = demand.join(installed, group).join(per_day, [group, "day"], "left").withColumn("available", F.col("_installed") - F.coalesce("_down", F.lit(0)))
    return out.select(group, "day", "available", "required", (F.col("available") < F.col("required")).alias("blackout"), (F.col("available") == F.col("required")).alias("no_margin"))


def policy_kpis(runs: DataFrame, policy: str, measure: str, voyages: Column) -> DataFrame:
    """Mean and 95 % range per 100 voyages of each policy."""
    rate = 100 * F.col(measure) / voyages
    return runs.groupBy(policy).agg(F.avg(rate).alias("mean"), F.percentile(rate, F.lit(0.025)).alias("low"), F.percentile(rate, F.lit(0.975)).alias("high"))


def paired_differences(runs: DataFrame, policy: str, policies: list[str], measure: str, keys: list[str]) -> DataFrame:
    """A row per pair of run keys: each policy's measure less the first policy's."""
    wide = runs.groupBy(*keys).pivot(policy, policies).agg(F.first(measure))
    return wide.select(*keys, *((F.col(f"`{p}`") - F.col(f"`{policies[0]}`")).alias(f"diff_{p}") for p in policies[1:]))
