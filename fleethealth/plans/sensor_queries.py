"""Quality gate, labels, residuals and trends over the sensor table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleethealth.operators import labels, quality, regime, vibration
from fleethealth.plans.registry import EV, HEALTHY, REGIME, SENSORS, Z, query, r6, ranked, rounded, sensors, table, z_table

RANGES = {"value": (0.0, 250.0), "k": (0.0, 99.0)}


def seconds(spark, d):
    return sensors(spark, d).withColumn("s", F.floor("t").cast("long"))


@query(f"""WITH {EV}, e AS (SELECT *, floor(t)::BIGINT AS s FROM ev),
dup AS (SELECT count(*) AS n FROM (SELECT 1 FROM e GROUP BY asset, s HAVING count(*) > 1)),
st AS (SELECT asset, max((cv >= 5 AND sv = 0)::INT) AS v, max((ck >= 5 AND sk = 0)::INT) AS k FROM (SELECT asset, count(value) OVER w AS cv, stddev_samp(value) OVER w AS sv, count(k) OVER w AS ck, stddev_samp(k) OVER w AS sk FROM e WINDOW w AS (PARTITION BY asset ORDER BY s, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) GROUP BY asset),
sd AS (SELECT concat_ws(',', CASE WHEN sum(k) > 0 THEN 'k=' || sum(k)::BIGINT END, CASE WHEN sum(v) > 0 THEN 'value=' || sum(v)::BIGINT END) AS d FROM st),
fr AS (SELECT max(l) - min(l) AS d FROM (SELECT max(s) AS l FROM e GROUP BY asset)),
rg AS (SELECT sum((value < 0 OR value > 250)::INT) AS v, sum((k < 0 OR k > 99)::INT) AS k FROM e)
SELECT 'schema' AS "check", true AS passed, false AS warning, '' AS detail
UNION ALL SELECT 'nulls', true, false, ''
UNION ALL SELECT 'range', v + k = 0, false, concat_ws(',', CASE WHEN v > 0 THEN 'value=' || v::BIGINT END, CASE WHEN k > 0 THEN 'k=' || k::BIGINT END) FROM rg
UNION ALL SELECT 'duplicates', n = 0, false, n::VARCHAR FROM dup
UNION ALL SELECT 'stuck', true, d <> '', d FROM sd
UNION ALL SELECT 'freshness', true, d <> 0, d::VARCHAR FROM fr""")
def q0_quality_report(spark, d):
    rows = seconds(spark, d).withColumn("s2", F.struct("s", "event_id"))
    report = quality.quality_report(rows, SENSORS, "asset", "s", RANGES, 5)
    stuck = quality.stuck_sensors(rows, SENSORS, "asset", "s2", 5).filter("machines > 0").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "sensor", F.col("machines").cast("string")))), ",").alias("detail")).select(F.lit("stuck").alias("check"), F.lit(True).alias("passed"), (F.col("detail") != "").alias("warning"), "detail")
    return report.filter("check <> 'stuck'").unionByName(stuck)  # ties within a second are ordered by id


@query("SELECT 'quality, k' AS missing, count(*) AS rows FROM events")
def q1_schema_check(spark, d):
    x = sensors(spark, d).drop("k")
    return x.agg(F.lit(", ".join(quality.missing_columns(x, ["asset", "quality", "k"]))).alias("missing"), F.count("*").alias("rows"))


@query("SELECT 'l_discount' AS sensor, round(avg((nullif(l_discount, 0) IS NULL)::INT), 4) AS null_share FROM lineitem UNION ALL SELECT 'l_tax', round(avg((nullif(l_tax, 0) IS NULL)::INT), 4) FROM lineitem")
def q2_null_share(spark, d):
    x = table(spark, d, "lineitem").select(*(F.when(F.col(c) == 0, float("nan")).otherwise(F.col(c)).alias(c) for c in ("l_discount", "l_tax")))
    clean = quality.normalise_nan(x, ["l_discount", "l_tax"])
    return clean.unpivot([], ["l_discount", "l_tax"], "sensor", "v").groupBy("sensor").agg(F.round(F.avg(F.col("v").isNull().cast("int")), 4).alias("null_share"))


@query("SELECT count(*) AS duplicate_keys FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def q3_duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {EV} SELECT 'value' AS sensor, sum((value < 1 OR value > 250)::INT)::BIGINT AS outside FROM ev UNION ALL SELECT 'k', sum((k < 5 OR k > 90)::INT)::BIGINT FROM ev")
def q4_physical_range(spark, d):
    limits = {"value": (1.0, 250.0), "k": (5.0, 90.0)}
    x = sensors(spark, d)
    g = x.agg(*(F.sum((~F.col(s).between(lo, hi)).cast("int")).alias(s) for s, (lo, hi) in limits.items()))
    return g.unpivot([], list(limits), "sensor", "outside")


@query("""SELECT c AS sensor, round(lo - 0.25 * (hi - lo), 6) AS low, round(hi + 0.25 * (hi - lo), 6) AS high FROM (
SELECT 'l_quantity' AS c, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem)""")
def q5_default_ranges(spark, d):
    return rounded(quality.default_ranges(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query(f"""WITH {EV}, w AS (SELECT asset, floor(k / 40) AS c, count(k) OVER x AS n, stddev_samp(floor(k / 40)) OVER x AS s FROM ev WINDOW x AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT 'coarse' AS sensor, sum(m)::BIGINT AS machines FROM (SELECT asset, max((n >= 4 AND s = 0)::INT) AS m FROM w GROUP BY asset)""")
def q6_stuck_sensors(spark, d):
    x = sensors(spark, d).withColumn("coarse", F.floor(F.col("k") / 40).cast("double"))
    return quality.stuck_sensors(x, ["coarse"], "asset", "t", 4)


@query(f"WITH {EV} SELECT round(max(l) - min(l), 3) AS spread FROM (SELECT max(t) AS l FROM ev GROUP BY asset)")
def q7_freshness(spark, d):
    return rounded(quality.freshness(sensors(spark, d), "asset", "t"), 3)


@query(f"WITH {EV} SELECT CASE WHEN value BETWEEN 1 AND 250 AND k BETWEEN 5 AND 90 THEN 'good' ELSE 'quarantined' END AS part, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1")
def q8_quarantine(spark, d):
    good, bad = quality.quarantine(sensors(spark, d), SENSORS, {"value": (1.0, 250.0), "k": (5.0, 90.0)})
    both = good.withColumn("part", F.lit("good")).unionByName(bad.withColumn("part", F.lit("quarantined")))
    return both.groupBy("part").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))


# --- labels ---


@query(f"WITH {EV} SELECT event_id, max(rn) OVER (PARTITION BY asset) AS life, least(max(rn) OVER (PARTITION BY asset) - rn, 40) AS rul FROM ev")
def l1_rul_label(spark, d):
    return labels.rul_label(ranked(spark, d), "asset", "rn", 40).select("event_id", F.col("life").cast("long").alias("life"), F.col("rul").cast("long").alias("rul"))


@query(f"WITH {EV} SELECT least(max_rn - rn, 25) AS rul, count(*) AS n FROM (SELECT rn, max(rn) OVER (PARTITION BY asset) AS max_rn FROM ev) GROUP BY 1")
def l3_rul_cap(spark, d):
    """How many rows each capped remaining life has."""
    return labels.rul_label(ranked(spark, d), "asset", "rn", 25).groupBy(F.col("rul").cast("long").alias("rul")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, (asset % 7) + max(rn) OVER (PARTITION BY asset) - rn AS rul FROM ev")
def l2_true_rul_truncated(spark, d):
    x = ranked(spark, d)
    truth = x.select("asset").distinct().withColumn("rul_at_end", F.col("asset") % 7)
    return labels.true_rul_truncated(x, truth, "asset", "rn").select("event_id", F.col("rul").cast("long").alias("rul"))


@query("SELECT l_returnflag, l_linestatus, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS state_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def l4_state_id(spark, d):
    return labels.state_id(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag", "l_linestatus", F.col("state_id").cast("long").alias("state_id")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS power_1h FROM ev")
def l5_trailing_mean(spark, d):
    return rounded(labels.trailing_mean(sensors(spark, d), "value", "asset", "t", 6, "power_1h").select("event_id", "power_1h"))


@query(f"WITH {EV} SELECT regime, count(*) AS n FROM ev WHERE regime IN ('view', 'click') GROUP BY 1")
def l6_status_whitelist(spark, d):
    return labels.status_whitelist(sensors(spark, d), "regime", ["view", "click"]).groupBy("regime").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, c AS (SELECT *, CASE WHEN rn > 1 AND lag(regime) OVER w IS DISTINCT FROM regime THEN 1 ELSE 0 END AS step FROM ev WINDOW w AS (PARTITION BY asset ORDER BY t))
SELECT event_id, sum(step) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c""")
def l7_segment_id(spark, d):
    return labels.segment_id(sensors(spark, d), ["regime"], "t", ["asset"]).select("event_id", F.col("segment").cast("long").alias("segment"))


@query(f"WITH {EV} SELECT (asset % 3 > 0 AND rn >= 30) AS faulty, count(*) AS n FROM ev GROUP BY 1")
def l8_onset_flag(spark, d):
    return labels.onset_flag(ranked(spark, d).withColumn("fault", F.col("asset") % 3), "fault", "rn", 30).groupBy("faulty").agg(F.count("*").alias("n"))


LABELLED = """lab AS (SELECT *, least(greatest((0 - l_discount) / (0 - 0.1), 0), 1) AS sd, least(greatest((0 - l_tax) / (0 - 0.08), 0), 1) AS st FROM lineitem),
lc AS (SELECT *, greatest(sd, st) AS severity, greatest(sd, st) >= 0.3 AS faulty, CASE WHEN greatest(sd, st) < 0.2 THEN 'healthy' WHEN sd >= 0.3 AND st >= 0.3 THEN 'combined' WHEN sd = greatest(sd, st) THEN 'l_discount' ELSE 'l_tax' END AS condition FROM lab)"""


def labelled(spark, d):
    return labels.label_states(table(spark, d, "lineitem"), {"l_discount": (0.0, 0.1), "l_tax": (0.0, 0.08)}, 0.3, 0.2)


@query(f"WITH {LABELLED} SELECT condition, faulty, count(*) AS n, round(avg(severity), 6) AS severity FROM lc GROUP BY 1, 2")
def l9_label_states(spark, d):
    return labelled(spark, d).groupBy("condition", "faulty").agg(F.count("*").alias("n"), r6(F.avg("severity")).alias("severity"))


@query("""SELECT CASE WHEN l_returnflag = 'R' OR l_linestatus = 'X' THEN 'critical' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'normal_wear' ELSE 'degraded' END AS tier, count(*) AS n FROM lineitem GROUP BY 1""")
def l10_tier(spark, d):
    t = labels.tier(["l_returnflag", "l_linestatus"], {"l_returnflag": ["R"], "l_linestatus": ["X"]}, {"l_returnflag": ["N"], "l_linestatus": ["O"]})
    return table(spark, d, "lineitem").groupBy(t.alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN x < 0.2 THEN NULL WHEN x < 0.4 THEN '0.2-0.4' WHEN x < 0.6 THEN '0.4-0.6' WHEN x < 0.8 THEN '0.6-0.8' WHEN x < 1.0001 THEN '0.8-1.0' END AS bin, count(*) AS n FROM (SELECT l_quantity / 50 AS x FROM lineitem) GROUP BY 1""")
def l11_severity_bins(spark, d):
    return table(spark, d, "lineitem").groupBy(labels.severity_bin(F.col("l_quantity") / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_discount > 0.05 THEN l_returnflag ELSE 'healthy' END AS fault, count(*) AS n FROM lineitem GROUP BY 1")
def l12_fault_class(spark, d):
    return table(spark, d, "lineitem").groupBy(labels.fault_class(F.col("l_discount") > 0.05, F.col("l_returnflag")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT asset, count(*) AS n, round(sum(value), 6) AS total FROM ev WHERE rn <= 20 GROUP BY 1")
def l13_healthy_window(spark, d):
    return labels.healthy_window(sensors(spark, d), "asset", "t", HEALTHY).groupBy("asset").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_tax <> 0 AND l_discount <> 0")
def l14_drop_incomplete(spark, d):
    x = table(spark, d, "lineitem").select(*(F.nullif(c, F.lit(0.0)).alias(c) for c in ("l_tax", "l_discount")))
    return labels.drop_incomplete(x, ["l_tax", "l_discount"]).agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT asset, event_id, regime, value FROM ev QUALIFY row_number() OVER (PARTITION BY asset ORDER BY t DESC) = 1")
def l15_latest_per_machine(spark, d):
    return labels.latest_per_machine(sensors(spark, d).select("asset", "t", "event_id", "regime", "value"), "asset", "t").drop("t")


@query("SELECT regime, least(count(*), 50) AS n FROM (SELECT event_type AS regime FROM events) GROUP BY 1")
def l16_stratified_sample(spark, d):
    return labels.stratified_sample(sensors(spark, d), "regime", ["event_id"], 50).groupBy("regime").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, x AS (SELECT *, asset % 4 AS size, asset % 4 = 0 AS ok FROM ev), n AS (SELECT *, count(*) OVER (PARTITION BY ok) AS c, row_number() OVER (PARTITION BY ok ORDER BY event_id) AS i FROM x)
SELECT CASE WHEN (ok AND i > c - round_even(c * 0.25, 0)) OR (NOT ok AND size = 3) THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM n GROUP BY 1""")
def l17_split_held_out(spark, d):
    x = sensors(spark, d).withColumn("size", F.col("asset") % 4)
    return labels.split_held_out(x, "size", 3, F.col("size") == 0, "event_id", 0.25).groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# --- regime residuals and trends ---


@query("SELECT 'discrete' AS mode, 'continuous' AS wide, 'none' AS bare, count(*) AS rows FROM events")
def f2_regime_mode(spark, d):
    x = sensors(spark, d)
    modes = regime.regime_mode(x, ["regime"]), regime.regime_mode(x, ["value"]), regime.regime_mode(x, [])
    return x.agg(*(F.lit(m).alias(n) for m, n in zip(modes, ("mode", "wide", "bare"), strict=True)), F.count("*").alias("rows"))


@query(f"""WITH {Z} SELECT rm.regime, round(m1, 6) AS mean_value, round(m2, 6) AS mean_k, round(s1, 6) AS std_value, round(s2, 6) AS std_k, round(gs.g1, 6) AS gstd_value FROM rm JOIN rs USING (regime), gs""")
def f3_regime_parameters(spark, d):
    means, spreads = regime.fit_regime(labels.healthy_window(sensors(spark, d), "asset", "t", HEALTHY), SENSORS, REGIME, "asset", "t", HEALTHY)
    return rounded(means.join(spreads, "regime").select("regime", "mean_value", "mean_k", "std_value", "std_k", "gstd_value"))


@query(f"WITH {Z} SELECT event_id, round(z1, 6) AS z_value, round(z2, 6) AS z_k FROM z")
def f8_residual_z(spark, d):
    return rounded(z_table(spark, d).select("event_id", "z_value", "z_k"))


@query(f"WITH {Z} SELECT event_id, round(value - r1, 6) AS value, round(k - r2, 6) AS k FROM r")
def f5_expected(spark, d):
    """What a row's regime leads to expect of each sensor."""
    x = ranked(spark, d)
    r = regime.residuals(x, regime.regime_means(x.filter(F.col("rn") <= HEALTHY), SENSORS, REGIME), SENSORS, REGIME)
    return rounded(r.select("event_id", *((F.col(s) - F.col(f"r_{s}")).alias(s) for s in SENSORS)))


@query(f"WITH {Z} SELECT event_id, round(coalesce(s1, g1), 6) AS value, round(coalesce(s2, g2), 6) AS k FROM rb LEFT JOIN rs ON rs.regime = rb.regime, gs")
def f6_spread(spark, d):
    """The deviation of each sensor in a row's regime."""
    x = ranked(spark, d)
    _, spreads = regime.fit_regime(x.filter(F.col("rn") <= HEALTHY), SENSORS, REGIME, "asset", "t", HEALTHY)
    ones = x.select("event_id", *REGIME, *(F.lit(1.0).alias(f"r_{s}") for s in SENSORS))
    return rounded(regime.residual_z(ones, spreads, SENSORS, REGIME).select("event_id", *((1 / F.col(f"z_{s}")).alias(s) for s in SENSORS)))


@query(f"WITH {EV} SELECT event_id, round(value - avg(CASE WHEN rn <= 20 THEN value END) OVER (PARTITION BY asset), 6) AS value FROM ev")
def f7_asset_baseline(spark, d):
    return rounded(regime.asset_baseline(sensors(spark, d), ["value"], "asset", "t", HEALTHY).select("event_id", "value"))


@query(f"WITH {Z} SELECT event_id, round(avg(z1) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS z_value FROM z")
def f9_smoothed_z(spark, d):
    return rounded(regime.smooth(z_table(spark, d), ["z_value"], "asset", "t", 5).select("event_id", "z_value"))


@query(f"WITH {EV}, s AS (SELECT *, avg(value) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM ev) SELECT event_id, round(m, 6) AS value FROM s WHERE rn > 20")
def f10_warm_start(spark, d):
    x = ranked(spark, d)
    return rounded(regime.warm_start(x.filter("rn <= 20"), x.filter("rn > 20"), ["value"], "asset", "t", 5).select("event_id", "value"))


@query(f"""WITH {EV}, s AS (SELECT event_id, count(value) OVER w AS n, regr_slope(value, rn) OVER w AS b FROM ev WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n >= 3 THEN coalesce(b, 0) ELSE 0 END, 5) AS slope_value FROM s""")
def f11_trend_slope(spark, d):
    return rounded(regime.trend_slope(ranked(spark, d), ["value"], "asset", "rn", 10).select("event_id", "slope_value"), 5)


@query(f"""WITH {EV}, a AS (SELECT *, (value - 50) / 41.7 AS z FROM ev), b AS (SELECT *, z - avg(CASE WHEN rn <= 20 THEN z END) OVER (PARTITION BY asset) AS y FROM a),
c AS (SELECT *, avg(y) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM b), e AS (SELECT event_id, s, count(s) OVER w AS n, regr_slope(s, rn) OVER w AS g FROM c WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT event_id, round(s, 4) AS z_value, round(CASE WHEN n >= 3 THEN coalesce(g, 0) ELSE 0 END, 4) AS slope_z_value FROM e""")
def f12_residual_features(spark, d):
    return rounded(regime.residual_features(ranked(spark, d), ["value"], {"value": 50.0}, {"value": 41.7}, "asset", "rn", True, HEALTHY, 3, 12).select("event_id", "z_value", "slope_z_value"), 4)


@query(f"WITH {EV} SELECT event_id, round(ln(1 + value), 6) AS log_health, rn::DOUBLE AS time_feature FROM ev")
def f13_rul_features(spark, d):
    return rounded(regime.rul_features(ranked(spark, d).withColumn("health_score", F.col("value")), SENSORS, "rn").select("event_id", "log_health", "time_feature"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), n AS (SELECT *, len(v) AS n, list_avg(v) AS m FROM x)
SELECT vec_id, round(m, 6) AS mean, round(list_stddev_pop(v), 6) AS std, round(list_min(v), 6) AS min, round(list_max(v), 6) AS max,
round(list_sum(list_transform(v, lambda y, i: (y - m) * ((i - 1) / (n - 1) - 0.5))) / list_sum(list_transform(v, lambda y, i: ((i - 1) / (n - 1) - 0.5) ** 2)), 6) AS slope,
round(list_avg(v[1:6]), 6) AS first, round(list_avg(v[n - 5:n]), 6) AS last FROM n""")
def f14_cycle_features(spark, d):
    x = table(spark, d, "embeddings").withColumn("c", vibration.cycle_features(F.transform("embedding", lambda v: v.cast("double"))))
    return rounded(x.select("vec_id", "c.*"))


@query(f"""WITH {EV}, g AS (SELECT asset, floor((rn - 1) / 16)::BIGINT AS w, count(*) AS n, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, avg(value) AS m FROM ev GROUP BY 1, 2),
c AS (SELECT g.*, avg((e.value - m) ** 2) AS v2, avg((e.value - m) ** 3) AS v3, avg((e.value - m) ** 4) AS v4 FROM g JOIN ev e ON e.asset = g.asset AND floor((e.rn - 1) / 16)::BIGINT = g.w WHERE n = 16 GROUP BY ALL)
SELECT asset, w AS "window", round(ln(rms), 6) AS log_rms, round(ln(peak / rms), 6) AS log_crest, round(ln(v4 / v2 ** 2), 6) AS log_kurtosis, round(v3 / v2 ** 1.5, 6) AS skew FROM c""")
def f15_vibration_time_features(spark, d):
    x = ranked(spark, d).withColumn("i", F.col("rn") - 1)
    return rounded(vibration.vibration_time_features(x, "asset", "i", "value", 16))


#: Windows of 32 samples, their means, and a discrete Fourier transform written out.
WINDOWS = f"""{EV}, sm AS (SELECT asset, (rn - 1) // 32 AS wn, (rn - 1) % 32 AS j, value AS x FROM ev QUALIFY count(*) OVER (PARTITION BY asset, (rn - 1) // 32) = 32),
ce AS (SELECT asset, wn, j, x - avg(x) OVER (PARTITION BY asset, wn) AS x FROM sm)"""
WIDTHS = [(0, 0), (0, 2), (2, 5), (5, 10), (10, 17)]


@query(f"""WITH {WINDOWS}, hn AS (SELECT asset, wn, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 31)) AS x FROM ce), pw AS (SELECT asset, wn, f, sum(x * cos(2 * pi() * f * j / 32)) ** 2 + sum(x * sin(2 * pi() * f * j / 32)) ** 2 AS p FROM hn, generate_series(0, 16) AS t(f) GROUP BY ALL)
SELECT asset, wn AS "window", {", ".join(f"round(ln(coalesce(sum(CASE WHEN f >= {a} AND f < {b} THEN p END), 0) / coalesce(nullif(sum(p), 0), 1) + 1e-12), 6) AS band{k}" for k, (a, b) in enumerate(WIDTHS))} FROM pw GROUP BY 1, 2""")
def f16_band_energy(spark, d):
    w = vibration.windows_of(ranked(spark, d).withColumn("i", F.col("rn") - 1), "asset", "i", "value", 32)
    w = w.select("asset", "window", vibration.band_energy("signal").alias("bands"))
    return rounded(w.select("asset", "window", *(F.col("bands")[k].alias(f"band{k}") for k in range(5))))


def _peak_sql(hz: float) -> str:
    near = ", ".join(f"coalesce(max(CASE WHEN abs(f * 31.25 - {k * hz}) <= 62.5 THEN l END), 0)" for k in (1, 2))
    return f"ln(greatest({near}) / (median(CASE WHEN f * 31.25 BETWEEN 10 AND 500 THEN l END) + 1e-12) + 1e-12)"


@query(f"""WITH {WINDOWS}, sp AS (SELECT asset, wn, f, sum(x * cos(2 * pi() * f * j / 32)) AS re, -sum(x * sin(2 * pi() * f * j / 32)) AS im FROM ce, generate_series(4, 12) AS t(f) GROUP BY ALL),
en AS (SELECT asset, wn, j, sqrt(sum(re * cos(2 * pi() * f * j / 32) - im * sin(2 * pi() * f * j / 32)) ** 2 + sum(re * sin(2 * pi() * f * j / 32) + im * cos(2 * pi() * f * j / 32)) ** 2) / 16 AS e FROM sp, generate_series(0, 31) AS t(j) GROUP BY ALL),
ec AS (SELECT asset, wn, j, e - avg(e) OVER (PARTITION BY asset, wn) AS e FROM en), li AS (SELECT asset, wn, f, sqrt(sum(e * cos(2 * pi() * f * j / 32)) ** 2 + sum(e * sin(2 * pi() * f * j / 32)) ** 2) AS l FROM ec, generate_series(0, 16) AS t(f) GROUP BY ALL)
SELECT asset, wn AS "window", round({_peak_sql(108.0)}, 5) AS outer_race, round({_peak_sql(162.0)}, 5) AS inner_race FROM li GROUP BY 1, 2""")
def f17_envelope_peaks(spark, d):
    w = vibration.windows_of(ranked(spark, d).withColumn("i", F.col("rn") - 1), "asset", "i", "value", 32)
    p = vibration.envelope_peaks(w, "signal", 1000.0, 30.0, [3.6, 5.4], (100.0, 400.0))
    return rounded(p.select("asset", "window", F.col("peaks")[0].alias("outer_race"), F.col("peaks")[1].alias("inner_race")), 5)


@query()
def f4_continuous_regime(spark, d):
    x = sensors(spark, d)
    models = regime.fit_continuous(labels.healthy_window(x, "asset", "t", HEALTHY), ["value"], ["k"])
    return rounded(regime.continuous_residuals(x, models, ["value"]).select("event_id", "r_value"))


@query(f"WITH {EV} SELECT regime, asset, count(*) AS n FROM ev WHERE rn <= 20 GROUP BY regime, asset QUALIFY row_number() OVER (PARTITION BY regime ORDER BY count(*) DESC, asset) <= 3")
def f1_regime_key_counts(spark, d):
    g = labels.healthy_window(sensors(spark, d), "asset", "t", HEALTHY).groupBy("regime", "asset").agg(F.count("*").alias("n"))
    return g.withColumn("_rn", F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("n"), "asset"))).filter("_rn <= 3").drop("_rn")
