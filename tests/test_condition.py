"""Facts about residuals, scores, alarms and the quality gate, on generated machines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleethealth.operators import alarms, detector, evaluation, labels, quality, regime


@pytest.fixture(scope="module")
def plant(spark):
    rng = np.random.default_rng(0)
    load = rng.choice([0.3, 0.6, 1.0], 3000)
    return spark.createDataFrame(pd.DataFrame({"m": 1, "t": range(3000), "load": load, "a": 100 * load + rng.normal(size=3000), "b": 50 * load + rng.normal(size=3000)}))


def test_residuals_are_standard(plant):
    means, spreads = regime.fit_regime(plant, ["a", "b"], ["load"])
    z = regime.transform_regime(plant, means, spreads, ["a", "b"], ["load"])
    r = z.agg(F.avg("z_a").alias("m"), F.stddev("z_a").alias("s")).first()
    assert abs(r.m) < 0.1 and abs(r.s - 1) < 0.1


def test_unseen_regime_falls_back_to_global(plant):
    means, spreads = regime.fit_regime(plant.filter("load < 1"), ["a"], ["load"])
    z = regime.transform_regime(plant.filter("load = 1"), means, spreads, ["a"], ["load"])
    assert z.filter("z_a is null").count() == 0


def test_fault_is_found_and_blamed(plant):
    means, spreads = regime.fit_regime(plant, ["a", "b"], ["load"])
    z = regime.transform_regime(plant, means, spreads, ["a", "b"], ["load"])
    d = detector.calibrate_random(z, ["z_a", "z_b"], ["t"])
    ill = regime.transform_regime(plant.withColumn("b", F.col("b") + 5), means, spreads, ["a", "b"], ["load"])
    rate = lambda x: x.agg(F.avg((detector.health_score(d) > d.threshold).cast("int"))).first()[0]
    assert rate(z) < 0.03 and rate(ill) > 0.9
    top = ill.select(F.map_keys(detector.top_sensors(d, 1))[0].alias("k")).groupBy("k").count().orderBy(F.desc("count")).first().k
    assert top == "z_b"
    gap = ill.select(F.abs(detector.health_score(d) - F.aggregate(detector.contributions(d), F.lit(0.0), lambda a, c: a + c)).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-9


def test_moment_fit_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]]) + 1000
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    d = detector.fit_detector(df, list("abc"))
    c = x - x.mean(0)
    s = c.T @ c / 400
    mu = np.trace(s) / 3
    delta = ((s - mu * np.eye(3)) ** 2).sum() / 3
    beta = ((((c**2).sum(1)) ** 2).mean() - (s**2).sum()) / (3 * 400)
    rho = min(beta, delta) / delta
    assert np.allclose(d.precision, np.linalg.inv((1 - rho) * s + rho * mu * np.eye(3)), rtol=1e-6)


def test_blocked_calibration_is_stricter_on_slow_series(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(4400, 8))
    x = np.zeros_like(e)
    for k in range(1, len(x)):
        x[k] = 0.97 * x[k - 1] + e[k]
    pdf = pd.DataFrame(x, columns=[f"s{k}" for k in range(8)]).assign(t=range(4400))
    train, new = spark.createDataFrame(pdf[:400]), spark.createDataFrame(pdf[400:])
    cols = [f"s{k}" for k in range(8)]
    rate = lambda d: new.agg(F.avg((detector.health_score(d) > d.threshold).cast("int"))).first()[0]
    assert rate(detector.calibrate_blocked(train, cols, "t")) < rate(detector.calibrate_random(train, cols, ["t"]))


def test_many_sensors_use_arrays(spark):
    rng = np.random.default_rng(3)
    cols = [f"s{k}" for k in range(35)]
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 35)), columns=cols))
    d = detector.fit_detector(df, cols)
    x = df.limit(5).toPandas().to_numpy() - np.array(d.mean)
    want = np.einsum("ij,jk,ik->i", x, np.array(d.precision), x)
    assert np.allclose(df.limit(5).select(detector.health_score(d).alias("h")).toPandas()["h"], want)


def test_confirmation_and_first_alarm(spark):
    flags = [True, False, True, True, False, True, True, True, True]
    df = spark.createDataFrame([(1, t, f) for t, f in enumerate(flags)] + [(2, t, False) for t in range(5)], "m int, t int, alarm boolean")
    for k, want in ((1, 0), (3, 7)):
        first = {r.m: r.alarm_at for r in detector.first_alarm(detector.confirm_alarm(df, "alarm", "m", "t", k), "alarm_confirmed", "m", "t").collect()}
        assert first == {1: want, 2: None}


def test_joint_limits_keep_the_budget(spark):
    rng = np.random.default_rng(4)
    cols = [f"s{k}" for k in range(10)]
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(5000, 10)), columns=cols))
    lim = {r.sensor: (r.low, r.high) for r in alarms.univariate_limits(df, cols, 0.05).collect()}
    x = df.toPandas()
    rate = np.mean(np.any([(x[c] < lim[c][0]) | (x[c] > lim[c][1]) for c in cols], axis=0))
    assert 0.03 < rate <= 0.05


def test_gate_reports_planted_faults(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame([(u, c, *rng.normal(10, 1, 3)) for u in range(6) for c in range(80)], columns=["u", "c", "a", "b", "k"])
    pdf.loc[:40, "a"] = np.nan
    pdf.loc[100:130, "k"] = 30.0
    pdf = pd.concat([pdf, pdf[:1]])
    report = quality.quality_report(spark.createDataFrame(pdf), ["a", "b", "k"], "u", "c", {"b": (0.0, 11.0)})
    got = {r.check: r for r in report.collect()}
    assert not got["nulls"].passed and not got["duplicates"].passed and not got["range"].passed
    assert got["stuck"].passed and got["stuck"].warning and got["stuck"].detail == "k=1"
    with pytest.raises(quality.QualityError):
        quality.gate(report)
    assert quality.quality_report(spark.createDataFrame(pdf), ["zz"], "u", "c").first().detail == "zz"


def test_slopes_match_numpy(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=30)
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(y)], "m int, t int, z double")
    got = regime.trend_slope(df, ["z"], "m", "t", 10).orderBy("t").toPandas()["slope_z"].to_numpy()
    want = [0, 0] + [np.polyfit(range(max(0, t - 9), t + 1), y[max(0, t - 9) : t + 1], 1)[0] for t in range(2, 30)]
    assert np.allclose(got, want)


def test_residual_features_match_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame([(u, c, rng.normal(u, 1)) for u in range(6) for c in range(80)], columns=["u", "c", "b"])
    got = regime.residual_features(spark.createDataFrame(pdf), ["b"], {"b": 1.0}, {"b": 2.0}, "u", "c", True, 30, 5, 20).orderBy("u", "c").toPandas()
    z = (pdf["b"] - 1) / 2
    z = z - z.groupby(pdf["u"]).transform(lambda s: s[:30].mean())
    z = z.groupby(pdf["u"]).transform(lambda s: s.rolling(5, min_periods=1).mean())
    assert np.allclose(got["z_b"], z, rtol=1e-6)


def test_alarm_table_and_delay(spark):
    df = spark.createDataFrame([(m, t, m == 1 and t >= 8) for m in (1, 2) for t in range(1, 11)], "m int, t int, on boolean")
    rows = {r.m: r for r in evaluation.alarm_table(df, "on", "m", "t").collect()}
    assert rows[1].lead == 2 and not rows[1].false_early and rows[2].missed
    d = evaluation.detection_delay(df.withColumn("bad", F.col("t") >= 5), "m", "t", "bad", "on", 2)
    assert {r.m: r.delay for r in d.collect()} == {1: 4, 2: None}


def test_latest_and_samples(spark):
    df = spark.createDataFrame([(m, t, m * t) for m in range(5) for t in range(10)], "m int, t int, v int")
    assert {(r.m, r.t) for r in labels.latest_per_machine(df, "m", "t").collect()} == {(m, 9) for m in range(5)}
    assert labels.stratified_sample(df, "m", ["t"], 3).groupBy("m").count().filter("count <> 3").count() == 0


def test_isolation_forest_sets_outliers_apart(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(600, 2)), columns=["a", "b"]).assign(i=range(600))
    df = spark.createDataFrame(pdf)
    trees = detector.fit_isolation_forest(df, ["a", "b"], ["i"], trees=30)
    far = spark.createDataFrame([(8.0, 8.0, 0), (0.0, 0.0, 1)], "a double, b double, i int")
    s = {r.i: r.isolation_score for r in detector.score_isolation_forest(far, ["a", "b"], trees).collect()}
    assert s[0] > 0.6 > s[1]
