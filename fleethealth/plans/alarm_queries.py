"""Health scores, alarms, their evaluation, and the analyst views."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleethealth.operators import alarms, detector, evaluation, metrics, views
from fleethealth.plans.registry import EV, HEALTHY, SCORED, SENSORS, Z, fit_sql, fitted, query, ranked, rounded, scored, sensors, table, z_table

ZS = [f"z_{s}" for s in SENSORS]


@query(f"WITH {SCORED} SELECT 'z_value' AS \"column\", round(m1, 6) AS mean, round(p11, 6) AS p_first, round(p12, 6) AS p_second FROM fit UNION ALL SELECT 'z_k', round(m2, 6), round(p12, 6), round(p22, 6) FROM fit")
def d1_fit_detector(spark, d):
    f = fitted(z_table(spark, d))
    rows = [(c, float(m), float(p[0]), float(p[1])) for c, m, p in zip(f.columns, f.mean, f.precision, strict=True)]
    return rounded(spark.createDataFrame(rows, "column string, mean double, p_first double, p_second double"))


@query()
def d2_isolation_forest(spark, d):
    z = z_table(spark, d)
    trees = detector.fit_isolation_forest(z.filter(F.col("rn") <= HEALTHY), ZS, ["event_id"])
    return detector.score_isolation_forest(z, ZS, trees).select("event_id", "isolation_score")


@query(f"""WITH {Z}, hz AS (SELECT *, ('0x' || substr(md5('0|' || event_id), 1, 8))::BIGINT % 1000 < 300 AS held FROM z WHERE rn <= 20), ft AS (SELECT * FROM hz WHERE NOT held), {fit_sql("ft", "fit")},
sc AS (SELECT held, (z1 - m1) ** 2 * p11 + 2 * (z1 - m1) * (z2 - m2) * p12 + (z2 - m2) ** 2 * p22 AS s FROM hz, fit), th AS (SELECT quantile_cont(s, 0.99) AS threshold FROM sc WHERE held)
SELECT round(threshold, 6) AS threshold, round(avg((s > threshold)::INT), 6) AS healthy_rate FROM sc, th GROUP BY threshold""")
def d3_calibrate_random(spark, d):
    z = z_table(spark, d).filter(F.col("rn") <= HEALTHY)
    f = detector.calibrate_random(z, ZS, ["event_id"])
    return rounded(z.agg(F.lit(f.threshold).alias("threshold"), F.avg((detector.health_score(f) > f.threshold).cast("int")).alias("healthy_rate")))


def _blocked_sql() -> str:
    parts = [f"b{k} AS (SELECT * FROM hb WHERE block <> {k}), " + fit_sql(f"b{k}", f"fb{k}") for k in range(3)]
    score = " UNION ALL ".join(f"SELECT (z1 - m1) ** 2 * p11 + 2 * (z1 - m1) * (z2 - m2) * p12 + (z2 - m2) ** 2 * p22 AS s FROM hb, fb{k} WHERE block = {k}" for k in range(3))
    return f"WITH {Z}, hz AS (SELECT * FROM z WHERE rn <= 20), eg AS (SELECT quantile_cont(t, 0.3333333333333333) AS e1, quantile_cont(t, 0.6666666666666666) AS e2 FROM hz), hb AS (SELECT hz.*, (t > e1)::INT + (t > e2)::INT AS block FROM hz, eg), {', '.join(parts)} SELECT round(quantile_cont(s, 0.99), 6) AS threshold FROM ({score})"


@query(_blocked_sql())
def d4_calibrate_blocked(spark, d):
    z = z_table(spark, d).filter(F.col("rn") <= HEALTHY)
    return rounded(spark.createDataFrame([(detector.calibrate_blocked(z, ZS, "t", 0.99, 3).threshold,)], "threshold double"))


@query(f"WITH {SCORED} SELECT event_id, round(health_score, 6) AS health_score FROM scored")
def d5_health_score(spark, d):
    z = z_table(spark, d)
    return rounded(z.select("event_id", detector.health_score(fitted(z)).alias("health_score")))


@query(f"WITH {SCORED} SELECT event_id, round(c1, 6) AS c_value, round(c2, 6) AS c_k FROM scored")
def d6_contributions(spark, d):
    z = z_table(spark, d)
    c = detector.contributions(fitted(z))
    return rounded(z.select("event_id", c[0].alias("c_value"), c[1].alias("c_k")))


@query(f"""WITH {SCORED} SELECT CASE WHEN greatest(c1, 0) >= greatest(c2, 0) THEN 'z_value' ELSE 'z_k' END AS top, count(*) AS n, round(avg(round_even(coalesce(greatest(c1, c2) / nullif(greatest(c1, 0) + greatest(c2, 0), 0), 0), 3)), 5) AS share FROM scored GROUP BY 1""")
def d7_top_sensors(spark, d):
    z = z_table(spark, d)
    top = z.select(detector.top_sensors(fitted(z), 1).alias("m")).select(F.map_keys("m")[0].alias("top"), F.map_values("m")[0].alias("share"))
    return top.groupBy("top").agg(F.count("*").alias("n"), F.round(F.avg("share"), 5).alias("share"))


@query(f"""WITH {SCORED} SELECT event_id, 'unit ' || asset || ': abnormal ' || CASE WHEN greatest(c1, 0) >= greatest(c2, 0) THEN 'reading, z k' ELSE 'z k, reading' END || '; risk of ' || lower(regime) || '. What caused similar failures, what should be checked, and which barriers failed?' AS question FROM scored WHERE alarm""")
def g15_alarm_questions(spark, d):
    """The question behind every alarm, from its sensors and its regime."""
    from fleethealth.operators.text import alert_to_question

    s = scored(spark, d).filter("alarm")
    terms = F.create_map(F.lit("z_value"), F.lit("reading"))
    q = alert_to_question(F.concat(F.lit("unit "), F.col("asset").cast("string")), F.lit(None).cast("string"), F.col("top_sensors"), F.col("regime"), F.lit(""), terms)
    return s.select("event_id", q.alias("question"))


@query(f"WITH {SCORED} SELECT event_id, alarm FROM scored")
def d8_alarm_flag(spark, d):
    return scored(spark, d).select("event_id", "alarm")


@query(f"WITH {SCORED} SELECT event_id, alarm, alarm_confirmed FROM scored WHERE alarm")
def d9_confirm_alarm(spark, d):
    return scored(spark, d).filter("alarm").select("event_id", "alarm", "alarm_confirmed")


@query(f"WITH {SCORED} SELECT asset, min(CASE WHEN alarm THEN rn END) AS alarm_at FROM scored GROUP BY asset")
def d10_first_alarm(spark, d):
    return detector.first_alarm(scored(spark, d), "alarm", "asset", "rn").select("asset", F.col("alarm_at").cast("long").alias("alarm_at"))


@query(f"WITH {SCORED} SELECT event_id, asset, round(health_score, 6) AS health_score, round(threshold, 6) AS threshold, alarm, alarm_confirmed FROM scored")
def d11_score(spark, d):
    return rounded(scored(spark, d).select("event_id", "asset", "health_score", "threshold", "alarm", "alarm_confirmed"))


@query(f"WITH {EV} SELECT event_id, round(abs(value - median(value) OVER (PARTITION BY asset)), 6) AS distance FROM ev")
def d12_score_grouped(spark, d):
    def model(pdf):
        out = pdf[["event_id"]].copy()
        out["distance"] = (pdf["value"] - pdf["value"].median()).abs()
        return out

    return rounded(detector.score_grouped(sensors(spark, d).select("asset", "event_id", "value"), "asset", model, "event_id long, distance double"))


# --- conventional limits ---


@query(f"WITH {EV}, l AS (SELECT avg(value) + 3 * stddev_samp(value) AS u FROM ev WHERE rn <= 20) SELECT value > u AS fixed_alarm, count(*) AS n, round(max(u), 6) AS lim FROM ev, l GROUP BY 1")
def b1_fixed_limit(spark, d):
    x = ranked(spark, d)
    return rounded(alarms.fixed_limit(x, x.filter("rn <= 20"), "value").groupBy("fixed_alarm").agg(F.count("*").alias("n"), F.max("fixed_limit").alias("lim")))


@query(f"WITH {Z} SELECT abs(z1) > 3 AS alarm, count(*) AS n FROM z GROUP BY 1")
def b2_load_aware_limit(spark, d):
    return z_table(spark, d).groupBy(alarms.load_aware_limit(F.col("z_value")).alias("alarm")).agg(F.count("*").alias("n"))


def quantile_sql(values: str, q: str) -> str:
    """Interpolated quantile of a sorted list at a share that isn't constant."""
    p = f"(({q}) * (len({values}) - 1))"
    low, high = f"{values}[floor({p})::BIGINT + 1]", f"{values}[ceil({p})::BIGINT + 1]"
    return f"(CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({p} - floor({p})) END)"


def grid_sql(p: str, ends: str) -> str:
    """One round over 64 cells of a table (lo, hi): {p} has the ends of the cell in which joint alarms pass 5 %."""
    limits = ", ".join(f"{quantile_sql(c + 's', share)} AS {c}_{end}" for c in ("v", "w") for end, share in (("low", "q"), ("high", "1 - q")))
    return f"""{p}g AS (SELECT i, lo + (hi - lo) * i / 64 AS q, lo + (hi - lo) * least(64, i + 1) / 64 AS nx FROM {ends}, generate_series(0, 64) AS t(i)), {p}e AS (SELECT i, q, nx, {limits} FROM {p}g, ls),
{p}r AS (SELECT i, q, nx, avg((coalesce(value < v_low OR value > v_high, false) OR coalesce(k < w_low OR k > w_high, false))::INT) AS rate FROM {p}e, hl GROUP BY 1, 2, 3), {p} AS (SELECT q AS lo, nx AS hi FROM {p}r WHERE rate <= 0.05 ORDER BY i DESC LIMIT 1)"""


ENDS = ", ".join(f"({sensor!r}, {quantile_sql(c + 's', 'lo')}, {quantile_sql(c + 's', '1 - lo')})" for sensor, c in (("value", "v"), ("k", "w")))


@query(f"""WITH {EV}, hl AS (SELECT value, k FROM ev WHERE rn <= 20), ls AS (SELECT list_sort(list(value) FILTER (value IS NOT NULL)) AS vs, list_sort(list(k) FILTER (k IS NOT NULL)) AS ws FROM hl), r0 AS (SELECT 0.0::DOUBLE AS lo, 0.05::DOUBLE AS hi),
{grid_sql('r1', 'r0')}, {grid_sql('r2', 'r1')}, fn AS (SELECT unnest([{ENDS}]) AS x FROM r2, ls) SELECT x[1] AS sensor, round(x[2], 6) AS low, round(x[3], 6) AS high FROM fn""")
def b3_univariate_limits(spark, d):
    return rounded(alarms.univariate_limits(ranked(spark, d).filter("rn <= 20"), SENSORS, 0.05))


@query(f"WITH {Z} SELECT greatest(abs(z1), abs(z2)) > 3 AS alarm, count(*) AS n FROM z GROUP BY 1")
def b4_three_sigma_any(spark, d):
    return z_table(spark, d).groupBy(alarms.three_sigma_any([F.col(c) for c in ZS]).alias("alarm")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, l AS (SELECT regime, avg(k) - 1.5 * stddev_samp(k) AS u FROM ev WHERE rn <= 20 GROUP BY 1) SELECT ev.regime, k < u AS alarm, count(*) AS n FROM ev JOIN l USING (regime) GROUP BY 1, 2")
def b5_directional_limit(spark, d):
    x = ranked(spark, d)
    return alarms.directional_limit(x, x.filter("rn <= 20"), "k", False, "regime", 1.5).groupBy("regime", F.col("direction_alarm").alias("alarm")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, l AS (SELECT max(value) AS u, max(k) AS v FROM ev WHERE rn <= 10) SELECT value > u OR k > v AS alarm, count(*) AS n FROM ev, l GROUP BY 1")
def b6_training_max_limit(spark, d):
    x = ranked(spark, d)
    return alarms.training_max_limit(x, x.filter("rn <= 10"), SENSORS).groupBy(F.col("max_alarm").alias("alarm")).agg(F.count("*").alias("n"))


# --- evaluation ---

AT = f"""{SCORED}, ta AS (SELECT asset, max(rn) AS life, min(CASE WHEN alarm AND rn > 5 THEN rn END) AS alarm_at FROM scored GROUP BY asset),
tb AS (SELECT asset, life, alarm_at, life - alarm_at AS lead, coalesce(alarm_at <= 0.5 * life, false) AS false_early, alarm_at IS NULL AS missed FROM ta)"""


def table_of(spark, d):
    return evaluation.alarm_table(scored(spark, d), "alarm", "asset", "rn", 5, 0.5)


@query(f"WITH {AT} SELECT * FROM tb")
def e1_alarm_table(spark, d):
    return table_of(spark, d).select("asset", *(F.col(c).cast("long").alias(c) for c in ("life", "alarm_at", "lead")), "false_early", "missed")


@query(f"""WITH {AT}, g AS (SELECT *, NOT false_early AND NOT missed AS good FROM tb)
SELECT count(*) AS machines, round_even(100 * avg(good::INT), 1) AS pct_warned, quantile_cont(lead, 0.5)::DOUBLE AS median_lead, min(lead) AS min_lead, round_even(100 * avg(coalesce(good AND lead >= 20, false)::INT), 1) AS pct_lead_enough,
round_even(100 * avg(false_early::INT), 1) AS pct_false_early, round_even(100 * avg(missed::INT), 1) AS pct_missed FROM g""")
def e2_warning_summary(spark, d):
    return evaluation.warning_summary(table_of(spark, d))


METHODS = f"""{SCORED}, fl AS (SELECT avg(value) + 3 * stddev_samp(value) AS u FROM ev WHERE rn <= 20), lm AS (SELECT event_id, asset, rn, regime, asset % 3 = 0 AS faulty, alarm AS multivariate, abs(z1) > 3 AS load_aware, value > u AS fixed FROM scored, fl),
lo AS (SELECT event_id, asset, rn, regime, faulty, unnest(['multivariate', 'load_aware', 'fixed']) AS method, unnest([multivariate, load_aware, fixed]) AS alarm FROM lm)"""


def methods_of(spark, d):
    s = scored(spark, d)
    s = alarms.fixed_limit(s, s.filter("rn <= 20"), "value")
    return s.select("event_id", "asset", "rn", "regime", (F.col("asset") % 3 == 0).alias("faulty"), F.col("alarm").alias("multivariate"), (F.abs("z_value") > 3).alias("load_aware"), F.col("fixed_alarm").alias("fixed"))


NAMES = ["multivariate", "load_aware", "fixed"]


@query(f"WITH {METHODS} SELECT method, round(avg(CASE WHEN NOT faulty THEN alarm::INT END), 6) AS false_alarm_rate, round(avg(CASE WHEN faulty THEN alarm::INT END), 6) AS detection_rate FROM lo GROUP BY 1")
def e3_detection_table(spark, d):
    return rounded(evaluation.detection_table(methods_of(spark, d), "faulty", NAMES))


@query(f"WITH {METHODS} SELECT 'c' || (asset % 12) AS bin, " + ", ".join(f"round(avg(CASE WHEN method = '{m}' THEN alarm::INT END), 6) AS {m}" for m in NAMES) + " FROM lo GROUP BY 1")
def e4_detection_by_bin(spark, d):
    x = methods_of(spark, d).withColumn("bin", F.concat(F.lit("c"), (F.col("asset") % 12).cast("string")))
    return rounded(evaluation.detection_by(x, "bin", NAMES))


@query(f"WITH {METHODS} SELECT regime, " + ", ".join(f"round(avg(CASE WHEN method = '{m}' THEN alarm::INT END), 6) AS {m}" for m in NAMES) + " FROM lo GROUP BY 1")
def e5_detection_by_class(spark, d):
    return rounded(evaluation.detection_by(methods_of(spark, d), "regime", NAMES))


@query(f"""WITH {METHODS}, o AS (SELECT *, 30 AS onset FROM lm WHERE asset IN (SELECT asset FROM lm GROUP BY 1 HAVING max(rn) >= 30) AND rn >= 30), c AS (SELECT *, min(load_aware::INT) OVER w = 1 AND count(*) OVER w = 1 AS ok FROM o WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS BETWEEN 0 PRECEDING AND CURRENT ROW))
SELECT asset, onset, min(CASE WHEN ok THEN rn END) AS detected_at, min(CASE WHEN ok THEN rn END) - onset AS delay FROM c GROUP BY 1, 2""")
def e6_detection_delay(spark, d):
    x = methods_of(spark, d).withColumn("faulty", F.col("rn") >= 30)
    return evaluation.detection_delay(x, "asset", "rn", "faulty", "load_aware", 1).select("asset", *(F.col(c).cast("long").alias(c) for c in ("onset", "detected_at", "delay")))


OUT = f"""{SCORED}, evs AS (SELECT asset, max(rn) // 2 AS start_id, max(rn) AS end_id, max(ts) AS event_end, asset % 2 = 0 AS is_fault FROM scored GROUP BY asset),
oc AS (SELECT asset, is_fault, bool_or(alarm) AS any_alarm, bool_or(alarm AND rn BETWEEN start_id AND end_id) AS hit, bool_or(alarm AND rn < start_id) AS false_before, min(CASE WHEN alarm AND rn BETWEEN start_id AND end_id THEN ts END) AS first_hit, max(event_end) AS event_end, avg(CASE WHEN rn < start_id THEN alarm::INT END) AS alarm_rate FROM scored JOIN evs USING (asset) GROUP BY 1, 2),
ol AS (SELECT *, (epoch_us(event_end) - epoch_us(first_hit)) / 3.6e9 AS lead_hours FROM oc)"""


def events_of(s):
    return s.groupBy("asset").agg(F.floor(F.max("rn") / 2).alias("start_id"), F.max("rn").alias("end_id"), F.max("ts").alias("event_end"))


def outcomes(spark, d):
    s = scored(spark, d)
    return evaluation.event_outcome(s, events_of(s), "asset", "rn", "ts", "alarm").withColumn("is_fault", F.col("asset") % 2 == 0)


@query(f"WITH {OUT} SELECT asset, any_alarm, hit, false_before, round(lead_hours, 6) AS lead_hours, round(alarm_rate, 6) AS alarm_rate FROM ol")
def e7_event_outcome(spark, d):
    return rounded(outcomes(spark, d).select("asset", "any_alarm", "hit", "false_before", "lead_hours", "alarm_rate"))


@query(f"WITH {OUT} SELECT asset % 3 AS method, sum(is_fault::INT)::BIGINT AS fault_events, sum((is_fault AND hit)::INT)::BIGINT AS detected, round(quantile_cont(CASE WHEN is_fault THEN lead_hours END, 0.5), 6) AS median_lead_hours, sum((is_fault AND false_before)::INT)::BIGINT AS early_alarms, sum((NOT is_fault AND any_alarm)::INT)::BIGINT AS false_alarms, round(avg(alarm_rate), 6) AS mean_alarm_rate FROM ol GROUP BY 1")
def e8_event_summary(spark, d):
    return rounded(evaluation.event_summary(outcomes(spark, d).withColumn("method", F.col("asset") % 3), "method", "is_fault"))


@query(f"WITH {OUT} SELECT asset, CASE WHEN greatest(c1, 0) >= greatest(c2, 0) THEN 'z_value' ELSE 'z_k' END AS top FROM scored JOIN evs USING (asset) WHERE alarm AND rn BETWEEN start_id AND end_id QUALIFY row_number() OVER (PARTITION BY asset ORDER BY rn) = 1")
def e9_root_cause(spark, d):
    s = scored(spark, d)
    return evaluation.root_cause(s, events_of(s), "asset", "rn", "alarm", "top_sensors").select("asset", F.map_keys("root_cause")[0].alias("top"))


@query(f"WITH {METHODS}, t AS (SELECT *, CASE asset % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'normal_wear' ELSE 'degraded' END AS tier FROM lo) SELECT method, " + ", ".join(f"round(avg(CASE WHEN tier = '{t}' THEN alarm::INT END), 6) AS {t}" for t in ("critical", "normal_wear", "degraded")) + " FROM t GROUP BY 1")
def e10_critical_detection(spark, d):
    t = F.when(F.col("asset") % 3 == 0, "critical").when(F.col("asset") % 3 == 1, "normal_wear").otherwise("degraded")
    return rounded(evaluation.critical_detection(methods_of(spark, d).withColumn("tier", t), "tier", NAMES))


@query(f"WITH {SCORED} SELECT regime, event_id FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY regime) AS n FROM scored WHERE alarm) WHERE i = n // 2")
def e11_example_alert(spark, d):
    return evaluation.example_alert(scored(spark, d), "alarm", "regime", "value", ["event_id"]).select("regime", "event_id")


@query(f"WITH {SCORED} SELECT round(avg(alarm_confirmed::INT), 6) AS alarm_rate FROM scored")
def e12_alarm_rate(spark, d):
    return rounded(evaluation.alarm_rate(scored(spark, d), "alarm_confirmed"))


# --- metrics ---

CM = "c AS (SELECT l_returnflag AS y, CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END AS p FROM lineitem)"
LABELS = ["A", "N", "R"]


def guesses(spark, d):
    p = F.when(F.col("l_discount") > 0.05, "R").when(F.col("l_tax") > 0.04, "A").otherwise("N")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), p.alias("p"))


@query(f"WITH {CM}, f AS (SELECT l, 2.0 * sum((y = l AND p = l)::INT) / (sum((y = l)::INT) + sum((p = l)::INT)) AS f1 FROM c, (SELECT unnest(['A', 'N', 'R']) AS l) GROUP BY l) SELECT (SELECT round(avg((y = p)::INT), 6) FROM c) AS accuracy, round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM f")
def x1_classification_scores(spark, d):
    return rounded(metrics.classification_scores(guesses(spark, d), "y", "p"))


@query(f"WITH {CM} SELECT y, " + ", ".join(f"sum((p = '{x}')::INT)::BIGINT AS {x}" for x in LABELS) + " FROM c GROUP BY y")
def x2_confusion_matrix(spark, d):
    return metrics.confusion_matrix(guesses(spark, d), "y", "p", LABELS)


@query(f"WITH {CM} SELECT y, round(avg((y = p)::INT), 6) AS recall, count(*) AS rows FROM c GROUP BY y")
def x3_recall_by(spark, d):
    return rounded(metrics.recall_by(guesses(spark, d), "y", "p"))


PR = "c AS (SELECT p_size::DOUBLE AS y, p_size * 0.8 + p_partkey % 9 AS p FROM part)"


def lives(spark, d):
    return table(spark, d, "part").select(F.col("p_size").cast("double").alias("y"), (F.col("p_size") * F.lit(0.8) + F.col("p_partkey") % 9).alias("p"))


@query(f"""WITH {PR}, e AS (SELECT *, p - y AS e, least(p, 40) - least(y, 40) AS ec FROM c) SELECT round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (count(*) * var_pop(y)), 6) AS r2, round(100 * avg(abs(e)) / (max(y) - min(y)), 6) AS mae_pct_range,
round(sqrt(avg(ec * ec)), 6) AS rmse_capped, round(stddev_pop(y), 6) AS rmse_constant, round(sqrt(avg(CASE WHEN y <= 10 THEN e * e END)), 6) AS rmse_near FROM e""")
def x4_regression_scores(spark, d):
    return rounded(metrics.regression_scores(lives(spark, d), "y", "p", 40.0, 10.0))


@query(f"WITH {PR} SELECT round(sum(CASE WHEN p < y THEN exp(-(p - y) / 13) - 1 ELSE exp((p - y) / 10) - 1 END), 5) AS nasa_score FROM c")
def x5_nasa_score(spark, d):
    return rounded(metrics.nasa_score(lives(spark, d), "y", "p"), 5)


# --- views ---


@query(f"""WITH {SCORED}, l AS (SELECT asset, alarm_confirmed, rn % 17 AS rul FROM scored QUALIFY row_number() OVER (PARTITION BY asset ORDER BY t DESC) = 1)
SELECT asset, rul, CASE WHEN asset % 5 = 0 THEN asset % 7 END AS service_day, CASE WHEN alarm_confirmed THEN 'alarm' WHEN asset % 5 = 0 THEN 'due' ELSE 'ok' END AS status FROM l""")
def w1_fleet_view(spark, d):
    s = scored(spark, d).select("asset", "t", "alarm_confirmed", (F.col("rn") % 17).cast("long").alias("rul"))
    plan = s.select("asset").distinct().filter("asset % 5 = 0").withColumn("service_day", F.col("asset") % 7)
    return views.fleet_view(s, plan, "asset", "t", "rul").select("asset", "rul", "service_day", "status")


@query(f"WITH {SCORED} SELECT asset, date_trunc('day', ts) AS day, event_id, round(health_score, 6) AS health_score FROM scored QUALIFY row_number() OVER (PARTITION BY asset, date_trunc('day', ts) ORDER BY health_score DESC, ts DESC) = 1")
def w2_worst_sample_per_day(spark, d):
    s = scored(spark, d)
    w = views.worst_sample_per_day(s.select("asset", "ts", "health_score"), "asset", "ts")
    j = w.join(s.select("asset", "ts", "event_id"), ["asset", "ts"])
    return rounded(j.select("asset", F.col("day").cast("timestamp_ntz").alias("day"), "event_id", "health_score"))


@query(f"WITH {SCORED} SELECT asset, round(avg(alarm::INT), 6) AS alarm_share, round((epoch_us(max(ts)) - epoch_us(min(CASE WHEN alarm THEN ts END))) / 8.64e10, 6) AS lead_days FROM scored GROUP BY 1")
def w3_alarm_share_and_lead(spark, d):
    return rounded(views.alarm_share_and_lead(scored(spark, d), "asset", "ts", "alarm"))


@query(f"WITH {CM}, t AS (SELECT *, CASE WHEN y = 'R' THEN 'critical' ELSE 'other' END AS tier FROM c) SELECT tier, count(*) AS rows, round(avg((y = p)::INT), 6) AS agreement FROM t GROUP BY 1")
def w4_agreement(spark, d):
    return rounded(views.agreement(guesses(spark, d).withColumn("tier", F.when(F.col("y") == "R", "critical").otherwise("other")), "y", "p", "tier"))


@query("SELECT p_partkey, unnest(['pred', 'actual']) AS kind, unnest([p_size * 0.8, p_size::DOUBLE]) AS value FROM part")
def w5_melt_pred_actual(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") * F.lit(0.8)).alias("pred"), F.col("p_size").cast("double").alias("actual"))
    return views.melt_pred_actual(x, ["p_partkey"], "pred", "actual")


