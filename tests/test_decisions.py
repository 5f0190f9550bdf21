"""Facts about risk, plans, drift, monitoring and statistics."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleethealth.functions.columns import normal_cdf, normal_quantile, t_two_sided
from fleethealth.operators import drift, learn, monitor, planning, risk, stats


def one(df):
    return df.first()


def test_k_out_of_n(spark):
    r = one(spark.range(1).select(risk.k_out_of_n_failure(F.array(*(F.lit(0.5),) * 4), 2).alias("a"), risk.k_out_of_n_failure(F.array(F.lit(0.1)), 2).alias("b")))
    assert r.a == pytest.approx(5 / 16) and r.b == 1.0


def test_risk_classes(spark):
    rows = [(0.6, 4), (0.6, 2), (0.05, 4), (0.005, 4), (0.0005, 4)]
    df = spark.createDataFrame(rows, "p double, s int")
    assert [r.c for r in df.select(risk.risk_class(F.col("p"), F.col("s")).alias("c")).collect()] == ["high", "medium", "high", "medium", "low"]


def test_register_order_and_wildcard(spark):
    scored = spark.createDataFrame([("GT1", 3.0, True), ("GT2", 80.0, False), ("GT3", 25.0, True)], "machine string, rul double, alarm boolean")
    effects = spark.createDataFrame([("*", "loss", 4, "")], "failure_mode string, effect string, severity int, note string")
    got = risk.risk_register(risk.unit_likelihoods(scored, "machine", 30, 5.0, rul="rul"), effects, "machine").collect()
    assert got[0].machine == "GT1" and got[0].risk == "high" and got[-1].machine == "GT2" and got[-1].risk == "low"


def test_healthy_diagnosis_stays_out(spark):
    s = spark.createDataFrame([("a", "turbine", 0.8, True), ("b", "healthy", 0.9, False)], "m string, d string, c double, on boolean")
    got = risk.unit_likelihoods(s, "m", 30, diagnosis="d", confidence="c", confirmed="on").collect()
    assert [(r.failure_mode, r.p_fail) for r in got] == [("turbine", 0.8)]


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        c = rng.random((4, 6))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(6), 4))
        assert sum(c[i, j] for i, j in enumerate(planning.assign(c))) == pytest.approx(best)


def test_plan_serves_urgent_machines_first(spark):
    df = spark.createDataFrame([("g", 1, 3.0), ("g", 2, 4.0), ("g", 3, 25.0), ("g", 4, 200.0)], "g string, a int, rul double")
    m = planning.service_cost_matrix(df, "rul", 30, 2.0, keep=["g", "a"])
    plan = {r.a: r.service_day for r in planning.plan_service(m, "g", "a", 30, 1).collect()}
    assert plan[1] <= 3 and plan[2] <= 4 and plan[3] > max(plan[1], plan[2]) and 4 not in plan
    assert len(set(plan.values())) == 3


def test_itinerary_keeps_to_ports(spark):
    df = spark.createDataFrame([("s", "G1", 6.0), ("s", "G2", 9.0), ("s", "G3", 60.0), ("s", "G4", 80.0)], "g string, a string, rul double")
    days = spark.createDataFrame([("s", d, d in (1, 3, 4, 6), 4) for d in range(1, 15)], "g string, day int, port boolean, required int")
    slots = planning.service_slots(days, 1, 4)
    m = planning.service_cost_matrix(df, "rul", 14, 2.0, keep=["g", "a"])
    plan = {r.a: (r.service_day, r.at_sea) for r in planning.plan_service_itinerary(m, slots, "g", "a").collect()}
    assert plan["G1"][0] in (1, 3, 4, 6) and plan["G2"][0] in (1, 3, 4, 6) and plan["G1"][0] != plan["G2"][0]
    assert not any(sea for _, sea in plan.values())


def test_normal_functions(spark):
    r = one(spark.range(1).select(normal_cdf(F.lit(1.96)).alias("a"), normal_cdf(F.lit(-3.0)).alias("b"), normal_quantile(F.lit(0.975)).alias("c"), normal_quantile(F.lit(0.001)).alias("d")))
    assert r.a == pytest.approx(0.9750021, abs=1e-6) and r.b == pytest.approx(0.0013499, abs=1e-6) and r.c == pytest.approx(1.959964, abs=1e-6) and r.d == pytest.approx(-3.090232, abs=1e-5)


def test_mcnemar_and_permutation(spark):
    df = spark.createDataFrame([(i < 30, i < 10) for i in range(35)], "a boolean, b boolean")
    r = one(stats.mcnemar_exact(df, "a", "b"))
    assert (r.a_only, r.b_only) == (20, 0) and r.p == pytest.approx(2 / 2**20)
    up = spark.createDataFrame([(i, 0.3) for i in range(20)], "k int, d double")
    flat = spark.createDataFrame([(i, 1.0 if i < 10 else -1.0) for i in range(20)], "k int, d double")
    assert one(stats.paired_permutation(up, "d", "k", 2000)).p < 0.001 * 2 and one(stats.paired_permutation(flat, "d", "k", 500)).p > 0.5


def test_cluster_interval_is_wider(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(m, i, mu + rng.normal() * 0.1) for m, mu in enumerate(rng.normal(size=20)) for i in range(50)], columns=["m", "i", "x"])
    df = spark.createDataFrame(pdf).withColumn("row", F.col("m") * 50 + F.col("i"))
    a, b = one(stats.bootstrap_ci(df, "m", "x", 400)), one(stats.bootstrap_ci(df, "row", "x", 400))
    assert a.high - a.low > 3 * (b.high - b.low)


def test_draws_are_spread_over_tasks_and_follow_digests(spark, monkeypatch):
    from hashlib import md5

    monkeypatch.setattr(stats, "PICKS", 100)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"m": np.arange(90) % 30, "x": rng.normal(size=90)})
    df = spark.createDataFrame(pdf)
    at = {d: [int(int(md5(f"7|{d}|{k}".encode()).hexdigest()[:13], 16) / 2.0**52 * 30) for k in range(30)] for d in range(1, 41)}
    picks = stats._picks(spark.range(30).select(F.col("id").alias("_at")).coalesce(1), 30, 40, 7)
    assert picks.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, picks.collect())) == sorted((d, k) for d, ks in at.items() for k in ks)
    sums = pdf.groupby("m")["x"].agg(["sum", "count"]).to_numpy()
    means = [sums[ks, 0].sum() / sums[ks, 1].sum() for ks in at.values()]
    got = one(stats.bootstrap_ci(df, "m", "x", 40, seed=7))
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_split_draws_are_whole_and_like_drawn_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(stats, "SPLIT", 16)
    counts = np.concatenate([stats._block_draws(150, b, 16, 3000, 4) for b in range(10)], axis=1)
    assert counts.shape == (3000, 150) and (counts.sum(axis=1) == 150).all()
    # means, variances and covariances of a multinomial distribution
    assert counts.mean(axis=0) == pytest.approx(np.ones(150), abs=0.1) and counts.var(axis=0) == pytest.approx(np.full(150, 149 / 150), abs=0.2)
    between = np.cov(counts.T)[np.triu_indices(150, 1)]
    assert between.mean() == pytest.approx(-1 / 150, abs=1e-3) and abs(between).max() < 0.1

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"m": rng.integers(0, 150, 4000), "x": rng.gamma(2.0, 3.0, 4000)})
    pdf["x"] += pdf["m"] % 7
    pdf.loc[:20, "x"] = None
    df = spark.createDataFrame(pdf)
    got = one(stats.bootstrap_split(df, "m", "x", 1500, seed=4))
    used = pdf.dropna().groupby("m")["x"].agg(["sum", "count"])
    counts = np.concatenate([stats._block_draws(150, b, 16, 1500, 4) for b in range(10)], axis=1)
    means = counts @ used["sum"].to_numpy() / (counts @ used["count"].to_numpy())
    assert (got.estimate, got.clusters) == (pytest.approx(used["sum"].sum() / used["count"].sum()), 150)
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert tuple(one(stats.bootstrap_split(df.repartition(7), "m", "x", 1500, seed=4))) == pytest.approx(tuple(got))
    other = one(stats.bootstrap_ci(df, "m", "x", 1500))
    assert other.high - other.low == pytest.approx(got.high - got.low, rel=0.15)
    none = one(stats.bootstrap_split(df.filter("m < 0"), "m", "x", 50))
    assert tuple(none) == (None, 0, None, None)


def test_students_t_and_arms_of_few_units(spark):
    # tabulated points of Student's t: 5 % and 1 % two-sided; with one degree of freedom a closed form; with many, normal
    known = [(2.228139, 10.0, 0.05), (12.706205, 1.0, 0.05), (-3.169273, 10.0, 0.01), (4.302653, 2.0, 0.05), (0.0, 3.0, 1.0), (1.5, 1.0, float(1 - 2 / np.pi * np.arctan(1.5))), (1.959964, 1e9, 0.05)]
    got = spark.createDataFrame(known, "t double, v double, p double").select("p", t_two_sided(F.col("t"), F.col("v")).alias("q")).collect()
    assert [r.q for r in got] == pytest.approx([r.p for r in got], abs=2e-7)
    assert one(spark.range(1).select(t_two_sided(F.lit(None).cast("double"), F.lit(3.0)).alias("q"))).q is None
    # no unit's earlier mean varies with the later one, so adjustment is zero: Welch's test of 1, 2, 3, 4 and 5, 7, 9, 11
    y = {0: [1.0, 2.0, 3.0, 4.0], 1: [5.0, 7.0, 9.0, 11.0]}
    pre = [1.0, -1.0, -1.0, 1.0]
    rows = [(10 * a + i, bool(a), v, p) for a in y for i in range(4) for v, p in ((pre[i], False), (y[a][i], True))]
    r = one(stats.parallel_ab(spark.createDataFrame(rows, "u int, arm boolean, y double, post boolean"), "u", "arm", "y", "post"))
    assert (r.difference, r.z) == (pytest.approx(5.5), pytest.approx(5.5 / np.sqrt(5 / 12 + 5 / 3)))
    dof = (5 / 12 + 5 / 3) ** 2 / ((5 / 12) ** 2 / 3 + (5 / 3) ** 2 / 3)
    angle = np.linspace(0, np.pi / 2, 400_001)
    density = np.cos(angle) ** (dof - 1)
    assert r.p == pytest.approx(density[angle >= np.arctan(r.z / np.sqrt(dof))].sum() / density.sum(), rel=1e-4)
    lone = one(stats.parallel_ab(spark.createDataFrame([x for x in rows if x[0] in (0, 10, 11)], "u int, arm boolean, y double, post boolean"), "u", "arm", "y", "post"))
    assert lone.p is None


def test_designs_and_cuped(spark):
    r = one(stats.n_per_arm_proportions(spark.createDataFrame([(0.10, 0.05)], "a double, b double"), "a", "b"))
    assert 400 < r.n_per_arm < 500
    rng = np.random.default_rng(2)
    pre = rng.normal(size=500) * 3
    df = spark.createDataFrame(pd.DataFrame({"pre": pre, "y": pre + rng.normal(size=500)}))
    v = one(stats.cuped(df, "y", "pre").agg(F.var_samp("y_adjusted").alias("a"), F.var_samp("y").alias("b"), F.avg("y_adjusted").alias("m"), F.avg("y").alias("n")))
    assert v.a / v.b < 0.2 and v.m == pytest.approx(v.n)


def test_two_way_effect_is_recovered(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(u, t, int(t >= 4 + 2 * (u % 4)), u * 0.5 + t * 0.3 - 2 * (t >= 4 + 2 * (u % 4)) + rng.normal() * 0.5, 4 + 2 * (u % 4)) for u in range(24) for t in range(15)], columns=["u", "t", "d", "y", "s"])
    df = spark.createDataFrame(pdf)
    r = one(stats.did_twfe(df, "y", "d", "u", "t"))
    assert r.ci_low < -2 < r.ci_high and r.p < 1e-6
    ri = one(stats.randomization_inference(df, "u", "t", "y", "s", 40))
    assert ri.effect == pytest.approx(r.effect) and ri.p < 0.1


def test_drift_flags_a_shift(spark):
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame(pd.DataFrame({"b": rng.normal(size=2000), "load": rng.uniform(size=2000)}))
    moved = spark.createDataFrame(pd.DataFrame({"b": rng.normal(size=500) + 1.5, "load": np.full(500, 1.4)}))
    r = {(x.kind, x.column): x for x in drift.drift_report(moved, drift.drift_reference(ref, ["b"], ["load"]), ["b"], ["load"]).collect()}
    assert r["psi", "b"].flagged and r["envelope", "load"].value == 1.0
    assert one(drift.retrain_flag(drift.drift_report(moved, drift.drift_reference(ref, ["b"], ["load"]), ["b"], ["load"]))).retrain_recommended


def test_monitoring_policies(spark):
    alerts = spark.createDataFrame([(str(i), 0.0, "x" if i < 15 else "y") for i in range(30)], "alert_id string, ts double, slice string")
    acks = spark.createDataFrame([(str(i), 3600.0, "inspected") for i in range(5)] + [("zz", 1.0, "inspected")], "alert_id string, ts double, action string")
    labels = spark.createDataFrame([(str(i), 1.0, "no_fault_found" if i < 12 else "fault_confirmed") for i in range(30)], "alert_id string, ts double, outcome string")
    acked = monitor.apply_acks(alerts, acks)
    assert one(monitor.adoption(acked)).ack_rate == pytest.approx(5 / 30) and monitor.unknown_acks(alerts, acks).count() == 1
    d = monitor.disparity(monitor.slice_false_alarms(alerts, labels))
    assert one(d).disparity_flag and one(d).worst_slice == "x"
    calm = spark.createDataFrame([(False, "")], "retrain_recommended boolean, reasons string")
    got = {r.action for r in monitor.retrain_policy(calm, monitor.alert_precision(labels), monitor.adoption(acked), d).collect()}
    assert got == {"process_review", "investigate_slice"}


def test_parity_flags_the_weak_slice(spark):
    rows = [("high", True, i % 2 == 0) for i in range(400)] + [("low", True, i % 20 > 0) for i in range(400)] + [(s, False, False) for s in ("high", "low") for _ in range(50)]
    got = {r.regime: r.flag for r in monitor.slice_parity(spark.createDataFrame(rows, "regime string, fault boolean, alarm boolean"), "regime", "alarm", "fault").collect()}
    assert got == {"high": True, "low": False}


def test_string_classifier(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] > 0.5, "compressor", np.where(x[:, 1] > 0.5, "turbine", "healthy"))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y, g=np.arange(600) // 20))
    folds = learn.group_kfold(df, "g", 3)
    oof = learn.out_of_fold(folds, list("abcd"), "y", "forest")
    assert oof.agg(F.avg((F.col("oof") == F.col("y")).cast("int"))).first()[0] > 0.85


def best_saving(saving, slots):
    """Largest total saving of serving machines on days with slots, by trying everything."""
    def go(i, left):
        if i == len(saving):
            return 0.0
        most = go(i + 1, left)
        for day, gain in saving[i].items():
            if left.get(day, 0):
                most = max(most, gain + go(i + 1, left | {day: left[day] - 1}))
        return most

    return go(0, dict(slots))


@pytest.mark.parametrize("seed", range(3))
def test_plans_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows, days = [], {"g": {1: 1, 2: 0, 3: 1}, "h": {1: 1, 2: 1, 3: 0}, "none": {1: 0, 2: 0, 3: 0}}
    for g in days:
        for a in range(7):
            skip = float(rng.integers(20, 200))
            rows += [(g, a, day, float(rng.integers(1, 160)), skip, float(rng.random()), float(rng.random())) for day in (1, 2, 3)]
    m = spark.createDataFrame(rows, "g string, a int, day int, cost double, skip_cost double, p_day double, p_end double")
    slots = spark.createDataFrame([(g, day, n, day == 1) for g, x in days.items() for day, n in x.items()], "g string, day int, slots int, port boolean")
    cost = {r[:3]: r[3] for r in rows}
    skip = {r[:2]: r[4] for r in rows}
    for plan, places in ((planning.plan_service_itinerary(m, slots, "g", "a"), days), (planning.plan_service(m, "g", "a", 3, 1), {g: {1: 1, 2: 1, 3: 1} for g in days})):
        got = plan.collect()
        assert sorted((r.g, r.a) for r in got) == sorted(skip)
        for g in days:
            served = [r for r in got if r.g == g and r.service_day]
            assert all(sum(r.service_day == d for r in served) <= places[g][d] for d in (1, 2, 3))
            saving = [{d: skip[g, a] - cost[g, a, d] for d in (1, 2, 3)} for a in range(7)]
            assert sum(skip[g, r.a] - cost[g, r.a, r.service_day] for r in served) == pytest.approx(best_saving(saving, places[g]))
    risky = planning.plan_service_itinerary(m, slots, "g", "a", 0.5).collect()
    assert len(risky) == 21 and all(r.service_day is None for r in risky if r.g == "none")


def test_quantiles_of_both_ways_agree(spark, monkeypatch):
    from fleethealth.functions import quantiles

    df = spark.range(40_000).select(F.pow(F.col("id") % 9973, F.lit(1.3)).alias("a"), F.when(F.col("id") % 7 > 0, F.rand(3)).alias("b"), F.lit(None).cast("double").alias("c"))
    shares = [0.0, 0.001, 0.37, 0.5, 0.99, 1.0]
    few = quantiles.exact_quantiles(df, ["a", "b", "c"], shares)
    monkeypatch.setattr(quantiles, "DIRECT", 100)
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    many = quantiles.exact_quantiles(df, ["a", "b", "c"], shares)
    x = df.select("a", "b").toPandas()
    for c in "ab":
        assert few[c] == pytest.approx(many[c]) and few[c] == pytest.approx(np.nanquantile(x[c], shares))
    assert few["c"] == many["c"] == [None] * 6


def test_quantiles_by_selection_list_no_more_as_rows_grow(spark, monkeypatch):
    from fleethealth.functions import quantiles

    monkeypatch.setattr(quantiles, "DIRECT", 100)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "LISTED", 60)
    listed = quantiles._listed
    largest = {}
    for rows in (5_000, 50_000):
        sizes = []
        monkeypatch.setattr(quantiles, "_listed", lambda df, x, gaps: sizes.extend(g.size for g in gaps) or listed(df, x, gaps))
        # half of the column is one value, a tenth is infinite or no number, the rest differs
        v = F.when(F.col("id") % 2 == 0, 7.0).when(F.col("id") % 10 == 1, F.lit(float("inf"))).when(F.col("id") % 10 == 3, F.lit(float("nan"))).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 2.0**36)
        df = spark.range(rows).select(v.alias("odd name.x"), F.lit(3.0).alias("flat"))
        shares = [0.0, 0.1, 0.25, 0.5, 0.73, 0.86, 0.95, 1.0]
        got = quantiles.exact_quantiles(df, ["odd name.x", "flat"], shares)
        x = np.sort([r[0] for r in df.collect() if r[0] == r[0]])
        at = [q * (len(x) - 1) for q in shares]
        assert got["odd name.x"] == pytest.approx([x[int(p)] if x[int(p)] == x[int(np.ceil(p))] else x[int(p)] + (x[int(np.ceil(p))] - x[int(p)]) * (p % 1) for p in at])
        assert got["flat"] == [3.0] * 8
        largest[rows] = max(sizes)
    assert max(largest.values()) <= 60


def test_quantiles_of_an_empty_table(spark):
    from fleethealth.functions import quantiles

    assert quantiles.exact_quantiles(spark.createDataFrame([], "a double"), ["a"], [0.5]) == {"a": [None]}


def test_running_sums_need_no_single_task(spark):
    df = spark.range(5000).select(((F.col("id") * 37) % 1009).alias("v"), "id").repartition(7)
    got = {r.id: r._before for r in stats.running(df, ["v", "id"], F.col("v")).collect()}
    total = 0
    for v, i in sorted((r.v, r.id) for r in df.collect()):
        assert got[i] == total
        total += v


def test_degenerate_counts_have_no_ratio(spark):
    flat = spark.createDataFrame([(u, t, 0, 1) for u in range(4) for t in range(4)], "u int, t int, d int, y int")
    assert one(stats.poisson_twfe(flat, "y", "d", "u", "t")).p == 1.0 and one(stats.poisson_twfe(flat.withColumn("y", F.lit(0)), "y", "d", "u", "t")).rate_ratio is None


def test_importance_over_all_rows_and_boosted_classes(spark, monkeypatch):
    monkeypatch.setattr(learn, "BUCKET", 100)
    df = spark.range(600).select("id", (F.rand(1)).alias("a"), F.rand(2).alias("b")).withColumn("y", F.when(F.col("a") > 0.6, "pump").when(F.col("b") > 0.5, "valve").otherwise("healthy")).withColumn("r", 3 * F.col("a"))
    df = spark.createDataFrame(df.toPandas())
    model = learn.fit_regressor(df, ["a", "b"], "r", "ridge")
    found = {r.feature: r.importance for r in learn.permutation_importance(df, model.transform, ["a", "b"], ["id"], F.abs(F.col("predicted") - F.col("r"))).collect()}
    assert found["a"] > 0.5 and abs(found["b"]) < 0.05
    out = learn.diagnose(df, learn.fit_classifier(df, ["a", "b"], "y", "boosted"))
    assert out.filter("diagnosis = y").count() > 570 and out.filter("diagnosis_confidence > 1 or diagnosis_confidence < 0.33").count() == 0


def test_boosted_trees_on_cells_are_those_on_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    few = lambda kind: lambda **x: kind(**(x | {"maxIter": 3}))
    monkeypatch.setattr(learn, "GBTRegressor", few(GBTRegressor))
    monkeypatch.setattr(learn, "GBTClassifier", few(GBTClassifier))
    sizes = []
    monkeypatch.setattr(learn, "written", lambda df, name: sizes.append(df.count()) or df)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 4000), "b": rng.integers(0, 5, 4000) / 4, "c": rng.normal(size=4000)})
    pdf["r"], pdf["y"] = pdf["a"] * 2.0 + (pdf["b"] > 0.4) * 5 + rng.normal(size=4000), np.where(pdf["a"] > 5, "pump", "healthy")
    df = spark.createDataFrame(pdf).coalesce(1).cache()
    got = learn.fit_regressor(df, ["a", "b"], "r").transform(df).select("a", "b", "predicted").distinct().collect()
    trees = GBTRegressor(featuresCol="_x", labelCol="r", predictionCol="predicted", maxIter=3, maxDepth=4, stepSize=0.1, seed=0)
    rows = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="_x"), trees]).fit(df).transform(df).select("a", "b", "predicted").distinct().collect()
    want = {(r.a, r.b): r.predicted for r in rows}
    assert len(got) == 45 and all(r.predicted == pytest.approx(want[r.a, r.b], abs=1e-9) for r in got)
    out = learn.diagnose(df, learn.fit_classifier(df, ["a", "b"], "y", "boosted"))
    assert out.filter("diagnosis <> y").count() == 0 and not [c for c in out.columns if c.startswith("_")]
    assert sizes == [45, 45]  # a fit saw cells, not rows
    # quantiles cut a continuous feature into bins of like size; a constant one, a missing and an infinite value do no harm
    odd = df.withColumn("k", F.lit(3)).unionByName(spark.createDataFrame([(1, 0.5, c, 1.0, "pump", 3) for c in (None, float("nan"), float("inf"))], "a long, b double, c double, r double, y string, k int"))
    model = learn.fit_regressor(odd, ["c", "k"], "r")
    per = model.stages[0].transform(odd).groupBy("_bin_0").count().toPandas()["count"]
    assert len(per) == learn.BINS and per.min() > 100 and per.max() < 150
    assert learn.predict_rul(odd, model, 60.0).count() == 4001
    with pytest.raises(Exception, match="(?i)null|nan"):
        learn.fit_regressor(df.withColumn("r", F.when(F.col("a") > 0, F.col("r"))), ["a", "b"], "r")


def test_rows_of_a_forest_come_in_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(learn, "TASK_ROWS", 100)
    df = spark.range(0, 1000, 1, 1).select("id", (F.col("id") % 7).alias("a"), F.lit("x").alias("y"))
    dealt = learn._dealt(df, ["a", "y"])
    assert dealt.columns == ["a", "y"] and dealt.rdd.glom().map(len).collect() == [100] * 10
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, df.select("a", "y").collect()))
    seen = []
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()))
    learn.fit_classifier(df, ["a"], "y", "forest")
    assert seen == [10]


def dense_twfe(pdf, y, d, weights=None):
    """Least squares with dummies: effect and error clustered by unit."""
    u, t = pd.get_dummies(pdf["u"]).to_numpy(float), pd.get_dummies(pdf["t"]).to_numpy(float)[:, 1:]
    x, w = np.column_stack([pdf[d], u, t]), np.ones(len(pdf)) if weights is None else weights
    bread = np.linalg.pinv(x.T @ (w[:, None] * x))
    beta = bread @ x.T @ (w * pdf[y])
    return x, bread, beta


def test_two_way_effect_on_a_panel_with_holes(spark):
    rng = np.random.default_rng(8)
    rows = [(u, t, int(t >= 3 + u % 5), u * 0.4 - t * 0.2 - 2 * (t >= 3 + u % 5) + rng.normal() * 0.3) for u in range(12) for t in range(10) if rng.random() > 0.3]
    pdf = pd.DataFrame([*rows, rows[0], rows[5]], columns=["u", "t", "d", "y"])
    x, bread, beta = dense_twfe(pdf, "y", "d")
    score = x * (pdf["y"] - x @ beta).to_numpy()[:, None]
    by_unit = pd.DataFrame(score).groupby(pdf["u"].to_numpy()).sum().to_numpy()
    var = (bread @ by_unit.T @ by_unit @ bread)[0, 0] * 12 / 11
    holed = pd.concat([pdf, pd.DataFrame({"u": [0, 1], "t": [0, 1], "d": [np.nan, 1], "y": [1.0, np.nan]})])
    df = spark.createDataFrame(holed, "u int, t int, d double, y double").na.replace(float("nan"), None)
    r = one(stats.did_twfe(df, "y", "d", "u", "t"))
    assert (r.effect, r.se, r.units) == (pytest.approx(beta[0], abs=1e-8), pytest.approx(np.sqrt(var), abs=1e-8), 12)
    full = one(stats.did_twfe(df, "y", "d", "u", "t", dof=True))
    n, k = len(pdf), 1 + 12 + 9
    assert full.se == pytest.approx(np.sqrt(var * (n - 1) / (n - k)))
    same = one(stats.did_twfe(df.withColumn("d", F.lit(1)), "y", "d", "u", "t"))
    assert same.effect is None and same.p is None


def test_poisson_effect_equals_dense_fit(spark):
    rng = np.random.default_rng(9)
    rows = [(u, t, int(t >= 3 + u % 5), int(rng.poisson(np.exp(0.1 * u + 0.05 * t - 0.5 * (t >= 3 + u % 5))))) for u in range(12) for t in range(10) if rng.random() > 0.2]
    rows += [(90, t, 0, 0) for t in range(10)]
    pdf = pd.DataFrame([r for r in rows if r[0] != 90], columns=["u", "t", "d", "y"])
    mu = pdf["y"].to_numpy() + 0.5
    for _ in range(60):
        pdf["z"] = np.log(mu) + (pdf["y"] - mu) / mu
        x, bread, beta = dense_twfe(pdf, "z", "d", mu)
        mu = np.exp(x @ beta)
    by_unit = pd.DataFrame(x * (pdf["y"] - mu).to_numpy()[:, None]).groupby(pdf["u"].to_numpy()).sum().to_numpy()
    se = np.sqrt((bread @ by_unit.T @ by_unit @ bread)[0, 0])
    df = spark.createDataFrame(rows, "u int, t int, d int, y int")
    r = one(stats.poisson_twfe(df, "y", "d", "u", "t"))
    assert r.rate_ratio == pytest.approx(np.exp(beta[0]), rel=1e-7)
    assert np.log(r.ci_high / r.ci_low) / (2 * 1.959964) == pytest.approx(se, rel=1e-6)
    split = df.withColumn("y", F.when(F.col("d") == 1, 0).otherwise(F.col("y")))
    assert one(stats.poisson_twfe(split, "y", "d", "u", "t")).p == 1.0  # no bound


def test_poisson_effect_over_very_many_units(spark):
    panel = spark.range(30_000).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("t")).withColumn("d", ((F.col("t") >= 2) & (F.col("u") % 2 == 0)).cast("int"))
    panel = panel.withColumn("y", (1 + F.pmod(F.xxhash64("u", "t"), F.lit(4)) * F.when(F.col("d") == 1, 1).otherwise(2)).cast("int"))
    r = one(stats.poisson_twfe(panel, "y", "d", "u", "t"))
    assert r.ci_low < 2.5 / 4 < r.ci_high and r.ci_high / r.ci_low < 1.05


def test_exposure_follows_the_log_ratio(spark):
    r = one(stats.exposure_poisson(spark.createDataFrame([(2.0, 1.0)], "a double, b double"), "a", "b"))
    assert r.exposure == pytest.approx((1.959964 + 0.841621) ** 2 * 1.5 / np.log(2) ** 2, rel=1e-5)


def test_forest_samples_are_the_least_hashes(spark):
    from fleethealth.operators import detector

    df = spark.range(20_000).select("id", (F.col("id") % 97).cast("double").alias("x")).repartition(5)
    got = detector.forest_samples(df, ["x"], ["id"], 12, 64)
    assert "Generate" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() < 12 * 400
    hashed = df.select(F.xxhash64("id", F.lit(0)).alias("h")).toPandas()["h"].tolist()
    sample = got.toPandas()
    for tree in (0, 7):
        want = spark.createDataFrame([(h, tree) for h in hashed], "h long, t int").select(F.xxhash64("h", "t").alias("x")).toPandas()["x"].nsmallest(64)
        assert sorted(sample[sample["tree"] == tree]["_h"].nsmallest(64)) == sorted(want)
    few = detector.forest_samples(df.limit(10), ["x"], ["id"], 3, 64)
    assert few.count() == 30


def test_plans_keep_the_best_machines_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(planning, "HELD_ROWS", 50)
    rows = [(f"g{i % 3}" if i % 3 else None, i, d, float(i * 7 % 11), 2) for i in range(120) for d in (1, 2)]
    options = spark.createDataFrame(rows, "g string, a int, day int, saving double, slots int").coalesce(1)
    got = planning._leading(options, "g", "a", 4)
    best = lambda rows: sorted((str(g), d, -s, a) for g, a, d, s, _ in rows)
    want = [x for k in {(str(r[0]), r[2]) for r in rows} for x in [x for x in best(rows) if x[:2] == k][:4]]
    assert best(got.collect()) == sorted(want)
    few = spark.createDataFrame([(f"g{i}", i, 1, 1.0, 2) for i in range(200)], options.schema).coalesce(1)
    assert planning._leading(few, "g", "a", 4).count() == 200


def test_folds_are_dealt_once_for_all_steps_of_a_fit(spark):
    from fleethealth.operators import learn

    x = learn.group_kfold(spark.range(200).select((F.col("id") % 20).alias("m"), F.rand(1).alias("f"), (F.col("id") % 7).cast("double").alias("y")), "m", 2)
    out = learn.out_of_fold(x, ["f"], "y", "ridge", classify=False)
    assert out.count() == 200 and "Join" not in out._jdf.queryExecution().executedPlan().toString()
