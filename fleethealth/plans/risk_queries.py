"""Risk register, service plans, drift and operations monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleethealth.functions.columns import normal_cdf_sql, wilson_sql
from fleethealth.operators import drift, monitor, planning, risk
from fleethealth.plans.registry import EV, SENSORS, query, ranked, rounded, sensors, table

# --- risk ---

PARTS = "pt AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS rul, CASE WHEN p_type = 'ECONOMY' THEN 'pump' ELSE lower(p_type) END AS mode, p_size / 100.0 AS conf, p_partkey % 4 = 0 AS alarm FROM part)"
PF = normal_cdf_sql("((30.0 - rul) / 10.0)")
EFFECTS = [("degradation", "loss of output", 4, "plan ahead"), ("pump", "loss of cooling", 3, ""), ("*", "reduced margin", 1, "watch")]
EFFECTS_SQL = "fx(mode, effect, severity, note) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{n}')" for a, b, c, n in EFFECTS) + ")"
LIKE = f"{PARTS}, lk AS (SELECT p_partkey, 'degradation' AS failure_mode, {PF} AS p_fail FROM pt UNION ALL SELECT p_partkey, mode, conf FROM pt WHERE alarm)"
BAND = "(1 + (p_fail >= 0.001)::INT + (p_fail >= 0.01)::INT + (p_fail >= 0.1)::INT + (p_fail >= 0.5)::INT)"
REG = f"""{LIKE}, {EFFECTS_SQL}, wk AS (SELECT p_partkey, failure_mode, max(p_fail) AS p_fail FROM lk GROUP BY 1, 2),
rg AS (SELECT p_partkey, failure_mode, p_fail, coalesce(f.effect, w.effect) AS effect, coalesce(f.severity, w.severity) AS severity, coalesce(f.note, w.note) AS note, {BAND} AS band FROM wk LEFT JOIN fx f ON f.mode = failure_mode AND f.mode <> '*' JOIN fx w ON w.mode = '*'),
rr AS (SELECT *, CASE WHEN band * severity >= 12 THEN 'high' WHEN band * severity >= 6 THEN 'medium' ELSE 'low' END AS risk FROM rg)"""


def fleet(spark, d):
    mode = F.when(F.col("p_type") == "ECONOMY", "pump").otherwise(F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("rul"), mode.alias("mode"), (F.col("p_size") / 100.0).alias("conf"), (F.col("p_partkey") % 4 == 0).alias("alarm"))


def likelihoods(spark, d):
    f = fleet(spark, d)
    life = risk.unit_likelihoods(f, "p_partkey", 30, 10.0, rul="rul")
    named = risk.unit_likelihoods(f.filter("alarm"), "p_partkey", 30, diagnosis="mode", confidence="conf", confirmed="alarm")
    return life.unionByName(named)


def effects(spark):
    return spark.createDataFrame(EFFECTS, "failure_mode string, effect string, severity int, note string")


@query(f"WITH {LIKE} SELECT p_partkey, failure_mode, round(p_fail, 6) AS p_fail FROM lk")
def r1_unit_likelihoods(spark, d):
    return rounded(likelihoods(spark, d))


@query(f"WITH {REG} SELECT failure_mode, effect, severity, note, count(*) AS n FROM rg GROUP BY ALL")
def r2_map_effects(spark, d):
    worst = likelihoods(spark, d).groupBy("p_partkey", "failure_mode").agg(F.max("p_fail").alias("p_fail"))
    return risk.map_effects(worst, effects(spark)).groupBy("failure_mode", "effect", "severity", "note").agg(F.count("*").alias("n"))


@query(f"WITH {LIKE} SELECT {BAND} AS band, count(*) AS n FROM lk GROUP BY 1")
def r3_likelihood_band(spark, d):
    return likelihoods(spark, d).groupBy(risk.likelihood_band(F.col("p_fail")).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {LIKE} SELECT s AS severity, CASE WHEN {BAND} * s >= 12 THEN 'high' WHEN {BAND} * s >= 6 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM lk, (SELECT unnest([1, 2, 3, 4]) AS s) GROUP BY 1, 2")
def r4_risk_class(spark, d):
    x = likelihoods(spark, d).withColumn("severity", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3, 4)))))
    return x.groupBy("severity", risk.risk_class(F.col("p_fail"), F.col("severity")).alias("risk")).agg(F.count("*").alias("n"))


@query(f"WITH {REG} SELECT p_partkey, failure_mode, round(p_fail, 6) AS p_fail, effect, severity, note, band, risk, CASE risk WHEN 'high' THEN 'plan service now' WHEN 'medium' THEN 'inspect at next stop' ELSE 'monitor' END AS action FROM rr")
def r5_risk_register(spark, d):
    return rounded(risk.risk_register(likelihoods(spark, d), effects(spark), "p_partkey"))


@query(f"""WITH {PARTS}, g AS (SELECT p_partkey // 3 AS system, list(conf ORDER BY p_partkey) AS p FROM pt GROUP BY 1 HAVING count(*) = 3)
SELECT system, round(p[1] * p[2] * p[3] + p[1] * p[2] * (1 - p[3]) + p[1] * (1 - p[2]) * p[3] + (1 - p[1]) * p[2] * p[3], 6) AS p_lost FROM g""")
def r6_k_out_of_n(spark, d):
    g = fleet(spark, d).groupBy(F.floor(F.col("p_partkey") / 3).alias("system")).agg(F.array_sort(F.collect_list("conf")).alias("p")).filter(F.size("p") == 3)
    return rounded(g.select("system", risk.k_out_of_n_failure(F.col("p"), 2).alias("p_lost")))


@query(f"""WITH {REG}, w AS (SELECT p_partkey, max(p_fail) AS p, max(severity) AS s FROM rr WHERE p_partkey % 10 <> 0 GROUP BY 1), u AS (SELECT p_partkey, p_partkey // 2 AS system FROM part),
g AS (SELECT system, count(*) AS units, max(coalesce(p, 0)) AS worst_p, list(coalesce(p, 0)) AS ps, coalesce(max(s), 2) AS severity FROM u LEFT JOIN w USING (p_partkey) GROUP BY 1),
l AS (SELECT *, CASE WHEN units < 2 THEN CASE WHEN units = 1 THEN ps[1] END ELSE ps[1] * ps[2] END AS p_fail FROM g)
SELECT system, units, round(worst_p, 6) AS worst_p, round(p_fail, 6) AS p_lost, severity, CASE WHEN {BAND} * severity >= 12 THEN 'high' WHEN {BAND} * severity >= 6 THEN 'medium' ELSE 'low' END AS risk FROM l""")
def r7_system_risk(spark, d):
    reg = risk.risk_register(likelihoods(spark, d), effects(spark), "p_partkey").filter("p_partkey % 10 <> 0")
    units = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 2).alias("system"), "p_partkey", F.lit(1).alias("required"))
    return rounded(risk.system_risk(reg, units, "p_partkey").drop("required"))


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 2 AS system FROM supplier) SELECT s_nationkey, s_suppkey, system FROM r QUALIFY count(*) OVER (PARTITION BY s_nationkey, system) = 2""")
def r8_group_units(spark, d):
    return risk.group_units(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_suppkey", 2, "s_nationkey")


# --- planning ---

H = 30
PEND, PDAY = normal_cdf_sql("((30.0 - rul) / 10.0)"), normal_cdf_sql("((day - rul) / 10.0)")
COST = f"""{PARTS}, rk AS (SELECT *, {PEND} AS p_end FROM pt), dy AS (SELECT rk.*, day::INT AS day FROM rk, generate_series(1, 30) AS g(day) WHERE p_end >= 0.01), cm AS (SELECT p_partkey, p_brand, rul, day, p_end, {PDAY} AS p_day FROM dy),
mx AS (SELECT *, 20 * (1 - p_day) + 200 * p_day + 0.5 * greatest(rul - day, 0) AS cost, 200 * p_end AS skip_cost FROM cm)"""


def matrix(spark, d):
    return planning.service_cost_matrix(fleet(spark, d), "rul", H, keep=["p_partkey", "p_brand"])


@query(f"WITH {PARTS} SELECT p_partkey, round({PF}, 6) AS p FROM pt")
def p1_p_fail(spark, d):
    return rounded(fleet(spark, d).select("p_partkey", risk.p_fail(F.col("rul"), 10.0, F.lit(30.0)).alias("p")))


@query(f"WITH {COST} SELECT p_partkey, day, round(cost, 5) AS cost, round(skip_cost, 5) AS skip_cost FROM mx")
def p2_service_cost_matrix(spark, d):
    return rounded(matrix(spark, d).select("p_partkey", "day", "cost", "skip_cost"), 5)


@query()
def p3_plan_service(spark, d):
    return planning.plan_service(matrix(spark, d), "p_brand", "p_partkey", H, 2)


CAL = "cal AS (SELECT p_brand, day::INT AS day, (day + b) % 5 = 0 AS port, 2 + (day + b) % 2 AS required FROM (SELECT DISTINCT p_brand, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS b FROM part), generate_series(1, 30) AS g(day))"


def calendar(spark, d):
    b = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    x = table(spark, d, "part").select("p_brand", b.alias("b")).distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(H))))
    return x.select("p_brand", "day", ((F.col("day") + F.col("b")) % 5 == 0).alias("port"), (2 + (F.col("day") + F.col("b")) % 2).alias("required"))


@query(f"WITH {CAL} SELECT p_brand, day, port, required, CASE WHEN port THEN 3 ELSE least(3, greatest(0, 4 - required - 1)) END AS slots FROM cal")
def p4_service_slots(spark, d):
    return planning.service_slots(calendar(spark, d), 3, 4)


@query()
def p5_plan_itinerary(spark, d):
    return planning.plan_service_itinerary(matrix(spark, d), planning.service_slots(calendar(spark, d), 3, 4), "p_brand", "p_partkey", 0.5)


PLAN = f"""{PARTS}, pl AS (SELECT p_partkey, p_brand, rul AS rul_true, CASE WHEN p_partkey % 3 = 0 THEN 1 + p_partkey % 20 END AS service_day FROM pt),
sv AS (SELECT *, coalesce(service_day <= rul_true, false) AS served FROM pl), fl AS (SELECT *, NOT served AND rul_true <= 30 AS failed FROM sv),
cs AS (SELECT *, CASE WHEN served THEN 20 + 0.5 * greatest(rul_true - service_day, 0) ELSE 0 END + CASE WHEN failed THEN 200 ELSE 0 END AS cost FROM fl)"""


def plan(spark, d):
    return fleet(spark, d).select("p_partkey", "p_brand", F.col("rul").alias("rul_true"), F.when(F.col("p_partkey") % 3 == 0, 1 + F.col("p_partkey") % 20).alias("service_day"))


@query(f"WITH {PLAN} SELECT p_partkey, service_day, served, failed, cost::DOUBLE AS cost FROM cs")
def p6_plan_costs(spark, d):
    return planning.plan_costs(plan(spark, d), "rul_true", H).select("p_partkey", "service_day", "served", "failed", "cost")


@query(f"WITH {PLAN} SELECT p_brand, sum(served::INT)::BIGINT AS served, sum(failed::INT)::BIGINT AS failures, sum(cost)::DOUBLE AS total_cost FROM cs GROUP BY 1")
def p7_evaluate_plan(spark, d):
    return planning.evaluate_plan(planning.plan_costs(plan(spark, d), "rul_true", H), ["p_brand"])


@query(f"WITH {CAL}, {PARTS}, fp AS (SELECT p_brand, min(day) AS first_port FROM cal WHERE port GROUP BY 1), lm AS (SELECT quantile_cont(rul, 0.1) AS age_limit FROM pt) SELECT p_partkey, CASE WHEN p_partkey % 40 + 3 >= age_limit THEN coalesce(first_port, 1) END AS service_day FROM pt LEFT JOIN fp USING (p_brand), lm")
def p8_age_based_plan(spark, d):
    units = fleet(spark, d).select("p_partkey", "p_brand", (F.col("p_partkey") % 40).alias("age"))
    return planning.age_based_plan(units, fleet(spark, d).select(F.col("rul").alias("life")), calendar(spark, d).filter("port"), "p_brand", "age", 3).select("p_partkey", "service_day")


LEDGER = f"""{CAL}, un AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 1 + p_partkey % 20 END AS sd, CASE WHEN p_size <= 30 THEN p_size END AS fd FROM part),
iv AS (SELECT *, CASE WHEN sd IS NOT NULL AND (fd IS NULL OR sd <= fd) THEN sd ELSE fd END AS a, CASE WHEN sd IS NOT NULL AND (fd IS NULL OR sd <= fd) THEN 1 ELSE 5 END AS l FROM un),
dn AS (SELECT p_brand, g.day, count(DISTINCT p_partkey) AS down FROM iv, generate_series(1, 30) AS g(day) WHERE g.day BETWEEN a AND least(30, a + l - 1) GROUP BY 1, 2), ins AS (SELECT p_brand, count(*) AS n FROM un GROUP BY 1),
lg AS (SELECT p_brand, cal.day, n - coalesce(down, 0) AS available, required FROM cal JOIN ins USING (p_brand) LEFT JOIN dn ON dn.p_brand = cal.p_brand AND dn.day = cal.day)"""


def ledger(spark, d):
    p = table(spark, d, "part")
    units = p.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, 1 + F.col("p_partkey") % 20).alias("service_day"), F.when(F.col("p_size") <= 30, F.col("p_size")).alias("fail_day"))
    return planning.availability_ledger(units, calendar(spark, d), "p_brand", "p_partkey", H)


@query(f"WITH {LEDGER} SELECT p_brand, day, available, required, available < required AS blackout, available = required AS no_margin FROM lg")
def p9_availability_ledger(spark, d):
    return ledger(spark, d)


RUNS = "rn AS (SELECT o_orderpriority AS policy, o_custkey % 20 AS rep, count(*) AS blackouts FROM orders GROUP BY 1, 2)"


def runs(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("policy"), (F.col("o_custkey") % 20).alias("rep")).agg(F.count("*").alias("blackouts"))


@query(f"WITH {RUNS} SELECT policy, round(avg(100 * blackouts / 500.0), 6) AS mean, round(quantile_cont(100 * blackouts / 500.0, 0.025), 6) AS low, round(quantile_cont(100 * blackouts / 500.0, 0.975), 6) AS high FROM rn GROUP BY 1")
def p10_policy_kpis(spark, d):
    return rounded(planning.policy_kpis(runs(spark, d), "policy", "blackouts", F.lit(500.0)))


@query(f"WITH {RUNS}, w AS (SELECT rep, max(CASE WHEN policy = '1-URGENT' THEN blackouts END) AS a, max(CASE WHEN policy = '5-LOW' THEN blackouts END) AS b FROM rn GROUP BY 1) SELECT rep, b - a AS \"diff_5-LOW\" FROM w")
def p10_paired_differences(spark, d):
    return planning.paired_differences(runs(spark, d), "policy", ["1-URGENT", "5-LOW"], "blackouts", ["rep"])


# --- drift ---

DR = f"""{EV}, ls AS (SELECT asset, rn, unnest(['value', 'k']) AS "column", unnest([value, k]) AS x FROM ev), eg AS (SELECT "column", list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM ls WHERE rn <= 30 GROUP BY 1),
bn AS (SELECT asset, rn, "column", len(list_filter(edges, lambda e: e <= x)) AS bin FROM ls JOIN eg USING ("column")),
rf AS (SELECT "column", bin, count(*) / sum(count(*)) OVER (PARTITION BY "column") AS r FROM bn WHERE rn <= 30 GROUP BY 1, 2), cr AS (SELECT "column", bin, count(*) / sum(count(*)) OVER (PARTITION BY "column") AS c FROM bn WHERE rn > 30 GROUP BY 1, 2),
ps AS (SELECT "column", sum((greatest(coalesce(c, 0), 1e-4) - greatest(coalesce(r, 0), 1e-4)) * ln(greatest(coalesce(c, 0), 1e-4) / greatest(coalesce(r, 0), 1e-4))) AS psi FROM rf FULL JOIN cr USING ("column", bin) GROUP BY 1)"""


@query(f'WITH {DR} SELECT "column", round(e, 6) AS edge FROM (SELECT "column", unnest(edges) AS e FROM eg)')
def v1_quantile_edges(spark, d):
    e = drift.quantile_edges(ranked(spark, d).filter("rn <= 30"), SENSORS)
    return rounded(e.select("column", F.explode("edges").alias("edge")))


@query(f'WITH {DR} SELECT "column", round(psi, 6) AS psi FROM ps')
def v2_psi(spark, d):
    x = ranked(spark, d)
    edges = drift.quantile_edges(x.filter("rn <= 30"), SENSORS)
    return rounded(drift.psi(drift.shares(x.filter("rn <= 30"), SENSORS, edges), drift.shares(x.filter("rn > 30"), SENSORS, edges)))


@query(f'WITH {DR} SELECT "column", bin::BIGINT AS bin, round(r, 6) AS share FROM rf')
def v3_drift_reference(spark, d):
    return rounded(drift.drift_reference(ranked(spark, d).filter("rn <= 30"), SENSORS, ["k"])["shares"].select("column", F.col("bin").cast("long").alias("bin"), "share"))


@query(f"""WITH {DR}, en AS (SELECT quantile_cont(k, 0.005) AS lo, quantile_cont(k, 0.995) AS hi FROM ev WHERE rn <= 30), ot AS (SELECT avg((k NOT BETWEEN lo AND hi)::INT) AS o FROM ev, en WHERE rn > 30)
SELECT 'psi' AS kind, "column", round(psi, 6) AS value, psi > 0.25 AS flagged FROM ps UNION ALL SELECT 'envelope', 'k', round(o, 6), o > 0.05 FROM ot""")
def v4_drift_report(spark, d):
    x = ranked(spark, d)
    return rounded(drift.drift_report(x.filter("rn > 30"), drift.drift_reference(x.filter("rn <= 30"), SENSORS, ["k"]), SENSORS, ["k"]))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN rn > count(*) OVER (PARTITION BY asset) / 2 THEN value + 25 ELSE value END, 6) AS value FROM ev")
def v5_what_if_offset(spark, d):
    return rounded(drift.what_if_offset(sensors(spark, d), "value", 25.0, "asset", "t").select("event_id", "value"))


@query(f"""WITH {DR}, a AS (SELECT asset % 10 AS fleet, * FROM bn), r AS (SELECT fleet, "column", bin, count(*) / sum(count(*)) OVER (PARTITION BY fleet, "column") AS r FROM a WHERE rn <= 30 GROUP BY 1, 2, 3), c AS (SELECT fleet, "column", bin, count(*) / sum(count(*)) OVER (PARTITION BY fleet, "column") AS c FROM a WHERE rn > 30 GROUP BY 1, 2, 3),
p AS (SELECT fleet, "column", sum((greatest(coalesce(c, 0), 1e-4) - greatest(coalesce(r, 0), 1e-4)) * ln(greatest(coalesce(c, 0), 1e-4) / greatest(coalesce(r, 0), 1e-4))) AS psi FROM r FULL JOIN c USING (fleet, "column", bin) GROUP BY 1, 2) SELECT fleet, round(max(psi), 6) AS worst_psi FROM p GROUP BY 1""")
def w6_drift_by_asset(spark, d):
    from pyspark.sql import Window

    x = ranked(spark, d).withColumn("fleet", F.col("asset") % 10)
    edges = drift.quantile_edges(x.filter("rn <= 30"), SENSORS)

    def shares(rows):
        long = rows.select("fleet", *SENSORS).unpivot(["fleet"], SENSORS, "column", "x")
        g = long.join(F.broadcast(edges), "column").groupBy("fleet", "column", drift.bin_of(F.col("x"), F.col("edges")).alias("bin")).count()
        return g.select("fleet", "column", "bin", (F.col("count") / F.sum("count").over(Window.partitionBy("fleet", "column"))).alias("share"))

    return rounded(drift.drift_by_asset(shares(x.filter("rn <= 30")), shares(x.filter("rn > 30")), "fleet"))


# --- monitoring ---

CALLS = "ca AS (SELECT event_id, epoch_us(ts) / 1e6 AS ts, event_type AS endpoint, value AS latency_ms, CASE WHEN event_id % 2 = 0 THEN value / 1000 ELSE value * 3 / 3.6e6 * 0.05 END AS cost_usd, event_id % 50 AS tokens FROM events)"
AL = """al AS (SELECT o_orderkey AS alert_id, epoch(o_orderdate)::DOUBLE AS ts, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS slice FROM orders),
ak AS (SELECT alert_id, ts + 3600 * (1 + alert_id % 9) AS ats, CASE alert_id % 6 WHEN 0 THEN 'inspected' WHEN 1 THEN 'work_order' WHEN 2 THEN 'deferred' WHEN 3 THEN 'false_alarm' ELSE 'nonsense' END AS action FROM al WHERE alert_id % 3 <> 0),
lb AS (SELECT alert_id, CASE WHEN (alert_id // 5) % 4 = 0 OR slice = '1-URGENT' THEN 'no_fault_found' ELSE 'fault_confirmed' END AS outcome FROM al WHERE alert_id % 2 = 0),
ac AS (SELECT al.*, ats AS acked_ts, action FROM al LEFT JOIN (SELECT * FROM ak WHERE action <> 'nonsense') USING (alert_id))"""


def calls(spark, d):
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6
    x = table(spark, d, "events").select("event_id", t.alias("ts"), F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"), (F.col("value") * 3).alias("cpu_ms"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 1000).alias("cost_usd"), (F.col("event_id") % 50).alias("tokens"))
    return monitor.log_calls(x)


def alerts(spark, d):
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)") / 1e6
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id"), t.alias("ts"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("slice"))


def acks(spark, d):
    m = F.col("alert_id") % 6
    action = F.when(m == 0, "inspected").when(m == 1, "work_order").when(m == 2, "deferred").when(m == 3, "false_alarm").otherwise("nonsense")
    return alerts(spark, d).filter("alert_id % 3 <> 0").select("alert_id", (F.col("ts") + 3600 * (1 + F.col("alert_id") % 9)).alias("ts"), action.alias("action"))


def outcomes(spark, d):
    bad = (F.floor(F.col("alert_id") / 5) % 4 == 0) | (F.col("slice") == "1-URGENT")
    return alerts(spark, d).filter("alert_id % 2 = 0").select("alert_id", "ts", F.when(bad, "no_fault_found").otherwise("fault_confirmed").alias("outcome"))


@query(f"WITH {CALLS} SELECT event_id, round(cost_usd, 9) AS cost_usd FROM ca")
def o1_log_calls(spark, d):
    return rounded(calls(spark, d).select("event_id", "cost_usd"), 9)


@query("SELECT sha2 AS alert_id, s_suppkey AS machine, slice FROM (SELECT sha256('site|' || s_suppkey || '|' || s_nationkey) AS sha2, s_suppkey, s_nationkey::VARCHAR AS slice FROM supplier WHERE s_acctbal > 5000)")
def o2_record_alerts(spark, d):
    s = table(spark, d, "supplier").withColumn("alarm_confirmed", F.col("s_acctbal") > 5000).withColumn("health_score", F.col("s_acctbal"))
    return monitor.record_alerts(s, F.lit("site"), "s_suppkey", "s_nationkey", F.col("s_nationkey").cast("string")).select("alert_id", "machine", "slice")


@query(f"WITH {AL} SELECT alert_id, acked_ts, action FROM ac")
def o3_apply_acks(spark, d):
    return monitor.apply_acks(alerts(spark, d), acks(spark, d)).select("alert_id", "acked_ts", "action")


@query(f"WITH {AL} SELECT count(*) AS unknown FROM ak WHERE alert_id % 10 = 0")
def o3_unknown_acks(spark, d):
    return monitor.unknown_acks(alerts(spark, d).filter("alert_id % 10 <> 0"), acks(spark, d)).agg(F.count("*").alias("unknown"))


@query(f"WITH {AL} SELECT outcome, count(*) AS n FROM lb GROUP BY 1")
def o4_apply_labels(spark, d):
    return monitor.apply_labels(outcomes(spark, d)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT endpoint, count(*) AS calls, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(sum(cost_usd), 6) AS cost_usd, sum(tokens)::BIGINT AS tokens FROM ca GROUP BY ROLLUP (endpoint)")
def o5_service_health(spark, d):
    return rounded(monitor.service_health(calls(spark, d)))


ADOPT = "count(*) AS alerts, round(avg((acked_ts IS NOT NULL)::INT), 6) AS ack_rate, round(quantile_cont((acked_ts - ts) / 3600, 0.5), 6) AS median_hours_to_ack, round(sum(coalesce(action IN ('inspected', 'work_order'), false)::INT) / greatest(count(acked_ts), 1), 6) AS acted_on_share, round(sum(coalesce(action = 'false_alarm', false)::INT) / greatest(count(acked_ts), 1), 6) AS dismissed_share"


@query(f"WITH {AL} SELECT {ADOPT} FROM ac")
def o6_adoption(spark, d):
    return rounded(monitor.adoption(monitor.apply_acks(alerts(spark, d), acks(spark, d))))


WL, WH = wilson_sql("tp", "labelled")


@query(f"WITH {AL}, g AS (SELECT count(*) AS labelled, sum((outcome = 'fault_confirmed')::INT) AS tp FROM lb) SELECT labelled, round(tp / labelled, 6) AS precision, round({WL}, 6) AS ci_low, round({WH}, 6) AS ci_high FROM g")
def o7_alert_precision(spark, d):
    return rounded(monitor.alert_precision(outcomes(spark, d)))


SLICES = f"{AL}, sl AS (SELECT CASE WHEN slice = '' THEN 'all' ELSE slice END AS slice, count(*) AS labelled, sum((outcome = 'no_fault_found')::INT) AS tp FROM al JOIN lb USING (alert_id) GROUP BY 1)"


@query(f"WITH {SLICES} SELECT slice, labelled, round(tp / labelled, 6) AS false_alarm_share, round({WL}, 6) AS ci_low, round({WH}, 6) AS ci_high FROM sl")
def o8_slice_false_alarms(spark, d):
    return rounded(monitor.slice_false_alarms(alerts(spark, d), outcomes(spark, d)))


@query(f"WITH {SLICES}, s AS (SELECT slice, tp / labelled AS r FROM sl WHERE labelled >= 10) SELECT max(r) - min(r) > 0.1 AND max(r) > 2 * greatest(min(r), 1e-9) AS disparity_flag, (SELECT slice FROM s ORDER BY r DESC, slice LIMIT 1) AS worst_slice, (SELECT slice FROM s ORDER BY r, slice LIMIT 1) AS best_slice, round(max(r), 6) AS worst_rate, round(min(r), 6) AS best_rate FROM s")
def o9_disparity(spark, d):
    return rounded(monitor.disparity(monitor.slice_false_alarms(alerts(spark, d), outcomes(spark, d))))


DL, FH = wilson_sql("det", "faulty")[0], wilson_sql("fa", "healthy")[1]


@query(f"""WITH p AS (SELECT o_orderpriority AS slice, o_totalprice > 300000 AS alarm, o_orderstatus = 'F' AS fault FROM orders), g AS (SELECT slice, sum((NOT fault)::INT) AS healthy, sum(fault::INT) AS faulty, sum((NOT fault AND alarm)::INT) AS fa, sum((fault AND alarm)::INT) AS det FROM p GROUP BY 1)
SELECT slice, healthy::BIGINT AS healthy, faulty::BIGINT AS faulty, round(fa / healthy, 6) AS false_alarm_rate, round({FH}, 6) AS fa_ci_high, round(det / faulty, 6) AS detection_rate, round({DL}, 6) AS det_ci_low, det / faulty < max(det / faulty) OVER () - 0.15 OR fa / healthy > min(fa / healthy) OVER () + 0.05 AS flag FROM g""")
def o10_slice_parity(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("slice"), (F.col("o_totalprice") > 300000).alias("alarm"), (F.col("o_orderstatus") == "F").alias("fault"))
    return rounded(monitor.slice_parity(p, "slice", "alarm", "fault"))


@query(f"""WITH {AL}, a AS (SELECT avg((acked_ts IS NOT NULL)::INT) AS r, count(*) AS n FROM ac), sl AS (SELECT CASE WHEN slice = '' THEN 'all' ELSE slice END AS slice, count(*) AS labelled, sum((outcome = 'no_fault_found')::INT) AS tp FROM al JOIN lb USING (alert_id) GROUP BY 1),
s AS (SELECT slice, tp / labelled AS r FROM sl WHERE labelled >= 10), pr AS (SELECT count(*) AS labelled, sum((outcome = 'fault_confirmed')::INT) AS tp FROM lb), pc AS (SELECT labelled, {WH} AS hi FROM pr),
o AS (SELECT 'process_review' AS action FROM a WHERE n >= 20 AND r < 0.6 UNION ALL SELECT 'investigate_slice' FROM s HAVING max(r) - min(r) > 0.1 AND max(r) > 2 * greatest(min(r), 1e-9) UNION ALL SELECT 'recalibrate' FROM pc WHERE labelled >= 20 AND hi < 0.5)
SELECT action FROM o UNION ALL SELECT 'none' WHERE NOT EXISTS (SELECT 1 FROM o)""")
def o11_retrain_policy(spark, d):
    al, lb = alerts(spark, d), outcomes(spark, d)
    x = ranked(spark, d)
    calm = drift.retrain_flag(drift.drift_report(x.filter("rn > 30"), drift.drift_reference(x.filter("rn <= 30"), SENSORS, ["k"]), SENSORS, ["k"]))
    return monitor.retrain_policy(calm, monitor.alert_precision(lb), monitor.adoption(monitor.apply_acks(al, acks(spark, d))), monitor.disparity(monitor.slice_false_alarms(al, lb))).select("action")


@query(f"""WITH {AL}, {CALLS}, c AS (SELECT * FROM ca WHERE ts >= 1706572800 - 10 * 86400), a AS (SELECT * FROM ac WHERE ts >= 1706572800 - 10 * 86400)
SELECT 'service' AS section, 'calls' AS key, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'adoption', 'alerts', count(*)::DOUBLE FROM a UNION ALL SELECT 'accuracy', 'labelled', count(*)::DOUBLE FROM lb""")
def o12_summary(spark, d):
    s = monitor.summary(calls(spark, d), monitor.apply_acks(alerts(spark, d), acks(spark, d)), outcomes(spark, d), F.lit(1706572800.0), 10)
    return s.filter(F.col("key").isin("calls", "alerts", "labelled"))
