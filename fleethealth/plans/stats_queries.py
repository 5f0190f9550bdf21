"""Statistics of proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleethealth.functions.columns import normal_cdf_sql, t_two_sided_sql, wilson_sql
from fleethealth.operators import stats
from fleethealth.plans.registry import query, rounded, table

PANEL = """pn AS (SELECT c_nationkey AS unit, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS period, sum(o_totalprice) / 1e6 AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < '2001-01-01' GROUP BY 1, 2),
gr AS (SELECT u.unit, p.period, coalesce(y, 0) AS y, coalesce(n, 0) AS n, 6 + 4 * (u.unit % 3) AS start FROM (SELECT DISTINCT unit FROM pn) u CROSS JOIN (SELECT DISTINCT period FROM pn) p LEFT JOIN pn USING (unit, period)),
tr AS (SELECT *, (period >= start)::INT AS d FROM gr)"""


def panel(spark, d):
    j = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz'2001-01-01 00:00:00'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    period = (F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1
    g = j.groupBy(F.col("c_nationkey").alias("unit"), period.alias("period")).agg((F.sum("o_totalprice") / 1e6).alias("y"), F.count("*").alias("n"))
    cells = g.select("unit").distinct().join(g.groupBy().agg(F.explode(F.collect_set("period")).alias("period")))  # quarters: a fixed calendar
    return cells.join(g, ["unit", "period"], "left").na.fill({"y": 0.0, "n": 0}).withColumn("start", 6 + 4 * (F.col("unit") % 3)).withColumn("d", (F.col("period") >= F.col("start")).cast("int"))


def outcomes(spark, d):
    return table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"), (F.col("doc_id") % 37).alias("m"))


def boot_sql(p: str, rows: str, draws: int) -> str:
    """Cluster bootstrap of a table (c, v): {p} has estimate, clusters, low, high."""
    return f"""{p}s AS (SELECT c, sum(v)::DOUBLE AS s, count(*) AS n FROM {rows} WHERE v IS NOT NULL GROUP BY 1), {p}i AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS pos, count(*) OVER () AS g FROM {p}s),
{p}p AS (SELECT draw, floor(('0x' || substr(md5('0|' || draw || '|' || pos), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE * g)::BIGINT AS pos, count(*) AS k FROM {p}i, generate_series(1, {draws}) AS t(draw) GROUP BY ALL),
{p}r AS (SELECT draw, sum(k * s) / sum(k * n) AS m FROM {p}p JOIN {p}i USING (pos) GROUP BY 1),
{p} AS (SELECT (SELECT sum(s) / sum(n) FROM {p}s) AS estimate, (SELECT count(*) FROM {p}s) AS clusters, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM {p}r)"""


def sign_sql(p: str, rows: str, draws: int) -> str:
    """Sign-flip test of a table (k, x): {p} has mean and p."""
    bit = "(('0x' || substr(md5('0|' || k || '|' || (draw // 128)), 8 * (draw % 128 // 32) + 1, 8))::BIGINT >> (draw % 32)) & 1"
    return f"""{p}m AS (SELECT avg(x) AS mean FROM {rows} WHERE x IS NOT NULL), {p}d AS (SELECT draw, sum(CASE WHEN {bit} = 1 THEN x ELSE -x END) / count(*) AS m FROM {rows}, generate_series(0, {draws - 1}) AS t(draw) WHERE x IS NOT NULL GROUP BY 1),
{p} AS (SELECT mean, (1 + sum((abs(m) >= abs(mean) - 1e-12)::INT)) / {draws + 1} AS p FROM {p}d, {p}m GROUP BY 1)"""


OUTCOMES = "oc AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b, doc_id % 37 AS m FROM labels)"


@query(f"WITH {OUTCOMES}, av AS (SELECT m AS c, a::INT AS v FROM oc), {boot_sql('bt', 'av', 2000)} SELECT round(estimate, 6) AS estimate, clusters, round(low, 6) AS low, round(high, 6) AS high FROM bt")
def t1_bootstrap_ci(spark, d):
    return rounded(stats.bootstrap_ci(outcomes(spark, d).withColumn("v", F.col("a").cast("double")), "m", "v"))


@query()
def t1_bootstrap_split(spark, d):
    """Mean order value, resampling customers."""
    return rounded(stats.bootstrap_split(table(spark, d, "orders"), "o_custkey", "o_totalprice"))


WL, WH = wilson_sql("k", "n")


@query(f"WITH g AS (SELECT doc_id % 11 AS slice, sum(toxic) AS k, count(*) AS n FROM labels GROUP BY 1) SELECT slice, k::BIGINT AS k, n, round({WL}, 6) AS ci_low, round({WH}, 6) AS ci_high FROM g")
def t2_wilson_ci(spark, d):
    g = table(spark, d, "labels").groupBy((F.col("doc_id") % 11).alias("slice")).agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    return rounded(stats.wilson_ci(g, "k", "n"))


@query("""WITH g AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS a, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS b FROM labels),
s AS (SELECT a, b, sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) AS p FROM (SELECT a, b, unnest(generate_series(0, least(a, b))) AS i FROM g) GROUP BY 1, 2)
SELECT a AS a_only, b AS b_only, round(least(1, 2 * p), 6) AS p FROM s""")
def t3_mcnemar_exact(spark, d):
    return rounded(stats.mcnemar_exact(outcomes(spark, d), "a", "b"))


@query(f"WITH {OUTCOMES}, df AS (SELECT m AS k, avg(a::INT - b::INT) AS x FROM oc GROUP BY 1), {sign_sql('sg', 'df', 1000)} SELECT round(mean, 6) AS mean, round(p, 6) AS p FROM sg")
def t4_paired_permutation(spark, d):
    x = outcomes(spark, d).groupBy("m").agg(F.avg(F.col("a").cast("double") - F.col("b").cast("double")).alias("diff"))
    return rounded(stats.paired_permutation(x, "diff", "m", 1000))


Z2 = normal_cdf_sql("abs(z)")


@query(f"""WITH d AS (SELECT o_custkey AS c, round(avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END), 0) - round(avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END), 0) AS diff FROM orders GROUP BY 1), a AS (SELECT abs(diff) AS a, sign(diff) AS s FROM d WHERE diff IS NOT NULL),
r AS (SELECT a, count(*) AS t, sum(CASE WHEN s > 0 THEN 1.0 WHEN s = 0 THEN 0.5 ELSE 0 END) AS plus FROM a GROUP BY 1), k AS (SELECT *, coalesce(sum(t) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM r),
g AS (SELECT sum(t)::DOUBLE AS n, sum(plus * rk) AS w, sum(CASE WHEN a = 0 THEN t ELSE 0 END)::DOUBLE AS z0, sum(CASE WHEN a <> 0 THEN t ** 3 - t ELSE 0 END)::DOUBLE AS ties FROM k),
z AS (SELECT n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - z0 * (z0 + 1) * (2 * z0 + 1) / 24 - ties / 48) AS z FROM g)
SELECT n::BIGINT AS n, round(w, 3) AS w_plus, round(z, 5) AS z, round(least(1, 2 * (1 - {Z2})), 5) AS p FROM z""")
def t5_wilcoxon_paired(spark, d):
    side = lambda k: F.round(F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice"))), 0)
    x = table(spark, d, "orders").groupBy("o_custkey").agg((side(0) - side(1)).alias("diff"))
    return stats.wilcoxon_paired(x, "diff").select("n", F.round("w_plus", 3).alias("w_plus"), F.round("z", 5).alias("z"), F.round("p", 5).alias("p"))


@query(f"""WITH d AS (SELECT o_orderstatus = 'F' AS g, round(o_totalprice, -3) AS v FROM orders), r AS (SELECT v, count(*) AS t, sum(g::INT)::DOUBLE AS x FROM d GROUP BY 1), k AS (SELECT *, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM r),
g AS (SELECT sum(x) AS nx, sum(t - x) AS ny, sum(x * rk) AS rs, sum(t ** 3 - t)::DOUBLE AS ties FROM k), u AS (SELECT *, rs - nx * (nx + 1) / 2 AS u, nx + ny AS n FROM g),
z AS (SELECT *, (u - nx * ny / 2) / sqrt(nx * ny / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
SELECT nx AS n_x, ny AS n_y, round(u / (nx * ny), 6) AS auc, round(z, 5) AS z, round(least(1, 2 * (1 - {Z2})), 5) AS p FROM z""")
def t6_mann_whitney_auc(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("g"), F.round("o_totalprice", -3).alias("v"))
    return stats.mann_whitney_auc(x, "g", "v").select("n_x", "n_y", F.round("auc", 6).alias("auc"), F.round("z", 5).alias("z"), F.round("p", 5).alias("p"))


POWER_SQL = "(1.959963984540054 * sqrt(2 * m * (1 - m)) + 0.8416212335729143 * sqrt(a * (1 - a) + b * (1 - b)))"


@query(f"WITH s AS (SELECT p_partkey, p_size / 100.0 AS a, (p_size + 20) / 100.0 AS b, (p_size + 10) / 100.0 AS m FROM part) SELECT p_partkey, ceil({POWER_SQL} ** 2 / (a - b) ** 2)::BIGINT AS n_per_arm FROM s")
def t7_n_per_arm(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 100).alias("a"), ((F.col("p_size") + 20) / 100).alias("b"))
    return stats.n_per_arm_proportions(x, "a", "b").select("p_partkey", "n_per_arm")


@query("WITH s AS (SELECT p_partkey, p_size / 10.0 AS a, p_size / 20.0 AS b FROM part) SELECT p_partkey, round((1.959963984540054 + 0.8416212335729143) ** 2 * (1 / a + 1 / b) / ln(b / a) ** 2, 4) AS exposure FROM s")
def t7_exposure_poisson(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("a"), (F.col("p_size") / 20).alias("b"))
    return rounded(stats.exposure_poisson(x, "a", "b").select("p_partkey", "exposure"), 4)


@query("WITH s AS (SELECT covar_samp(l_extendedprice, l_quantity) / var_samp(l_quantity) AS th, avg(l_quantity) AS m FROM lineitem) SELECT l_returnflag, round(avg(l_extendedprice - th * (l_quantity - m)), 4) AS y FROM lineitem, s GROUP BY 1")
def t8_cuped(spark, d):
    x = stats.cuped(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(x.groupBy("l_returnflag").agg(F.avg("y_adjusted").alias("y")), 4)


PT = normal_cdf_sql("abs(effect / se)")


@query(f"""WITH {PANEL}, dm AS (SELECT unit, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY period) + avg(y) OVER () AS y, d - avg(d) OVER (PARTITION BY unit) - avg(d) OVER (PARTITION BY period) + avg(d) OVER () AS d FROM tr),
b AS (SELECT sum(y * d) / sum(d * d) AS effect, sum(d * d) AS dd FROM dm), sc AS (SELECT unit, sum(d * (y - effect * d)) AS g FROM dm, b GROUP BY 1), mt AS (SELECT sum(g * g) AS m, count(*) AS u FROM sc), r AS (SELECT effect, sqrt(m * u / (u - 1)) / dd AS se, u FROM b, mt)
SELECT round(effect, 6) AS effect, round(se, 6) AS se, round(effect - 1.959964 * se, 6) AS ci_low, round(effect + 1.959964 * se, 6) AS ci_high, round(2 * (1 - {PT}), 6) AS p, u AS units FROM r""")
def t9_did_twfe(spark, d):
    return rounded(stats.did_twfe(panel(spark, d), "y", "d", "unit", "period"))


#: A panel with holes: every third cell or so is missing.
HOLES = "ho AS (SELECT * FROM tr WHERE (unit * 7 + period * 11 + unit * period) % 10 < 7)"


def with_holes(spark, d):
    return panel(spark, d).filter((F.col("unit") * 7 + F.col("period") * 11 + F.col("unit") * F.col("period")) % 10 < 7)


def out_of_means(name: str, rows: str, columns: list[str], group: str = "", weight: str = "1", rounds: int = 400) -> str:
    """SQL: ``columns`` of ``rows`` less unit and period effects, by so many rounds of weighted means."""
    g = f"{group}, " if group else ""
    mean = lambda key, table: ", ".join(f"{c} - sum({weight} * {c}) OVER (PARTITION BY {g}{key}) / sum({weight}) OVER (PARTITION BY {g}{key}) AS {c}" for c in columns)
    return f"""{name}_i AS (SELECT 0 AS round, * FROM {rows} UNION ALL SELECT * REPLACE (round + 1 AS round, {mean("period", "b")}) FROM (SELECT * REPLACE ({mean("unit", "a")}) FROM {name}_i WHERE round < {rounds})),
{name} AS (SELECT * FROM {name}_i WHERE round = {rounds})"""


DID_SQL = f"""b AS (SELECT sum(y * d) / sum(d * d) AS effect, sum(d * d) AS dd FROM dm), sc AS (SELECT unit, sum(d * (y - effect * d)) AS g FROM dm, b GROUP BY 1), mt AS (SELECT sum(g * g) AS m, count(*) AS u FROM sc), r AS (SELECT effect, sqrt(m * u / (u - 1)) / dd AS se, u FROM b, mt)
SELECT round(effect, 6) AS effect, round(se, 6) AS se, round(effect - 1.959964 * se, 6) AS ci_low, round(effect + 1.959964 * se, 6) AS ci_high, round(2 * (1 - {PT}), 6) AS p, u AS units FROM r"""


@query(f"WITH RECURSIVE {PANEL}, {HOLES}, hd AS (SELECT unit, period, y::DOUBLE AS y, d::DOUBLE AS d FROM ho), {out_of_means('dm', 'hd', ['y', 'd'], rounds=60)}, {DID_SQL}")
def t9_did_twfe_holes(spark, d):
    return rounded(stats.did_twfe(with_holes(spark, d), "y", "d", "unit", "period"))


def _poisson_sql(rows: str) -> str:
    """Expected counts by iterative proportional fitting: to the units', the periods' and the treated cells' events in turn."""
    return f"""lv AS (SELECT unit, period, n::DOUBLE AS y, d::DOUBLE AS d FROM {rows} WHERE unit IN (SELECT unit FROM {rows} GROUP BY 1 HAVING sum(n) > 0)),
lw AS (SELECT * FROM lv WHERE period IN (SELECT period FROM lv GROUP BY 1 HAVING sum(y) > 0)),
fi AS (SELECT 0 AS round, *, 1.0::DOUBLE AS mu, 0.0::DOUBLE AS beta FROM lw UNION ALL
  SELECT * EXCLUDE (f) REPLACE (round + 1 AS round, CASE WHEN d = 1 THEN mu * f ELSE mu END AS mu, beta + ln(f) AS beta) FROM (SELECT *, sum(y * d) OVER () / sum(mu * d) OVER () AS f FROM (
    SELECT * REPLACE (mu * sum(y) OVER (PARTITION BY period) / sum(mu) OVER (PARTITION BY period) AS mu) FROM (
      SELECT * REPLACE (mu * sum(y) OVER (PARTITION BY unit) / sum(mu) OVER (PARTITION BY unit) AS mu) FROM fi WHERE round < 400)))),
fd AS (SELECT unit, period, y, d, d AS x, mu, beta FROM fi WHERE round = 400), {out_of_means("pr", "fd", ["x"], weight="mu", rounds=100)},
sc AS (SELECT unit, sum(x * (y - mu)) AS g, sum(mu * x * x) AS b FROM pr GROUP BY 1), z AS (SELECT (SELECT any_value(beta) FROM fd) AS beta, sqrt(sum(g * g)) / sum(b) AS se FROM sc)
SELECT round(exp(beta), 6) AS rate_ratio, round(exp(beta - 1.959964 * se), 6) AS ci_low, round(exp(beta + 1.959964 * se), 6) AS ci_high, round(2 * (1 - {normal_cdf_sql("abs(beta / se)")}), 6) AS p FROM z"""


@query(f"WITH RECURSIVE {PANEL}, {_poisson_sql('tr')}")
def t10_poisson_twfe(spark, d):
    return rounded(stats.poisson_twfe(panel(spark, d), "n", "d", "unit", "period"))


@query(f"WITH RECURSIVE {PANEL}, {HOLES}, {_poisson_sql('ho')}")
def t10_poisson_twfe_holes(spark, d):
    return rounded(stats.poisson_twfe(with_holes(spark, d), "n", "d", "unit", "period"))


PW = t_two_sided_sql("z", "dof")


@query(f"""WITH {PANEL}, m AS (SELECT unit, unit % 2 = 0 AS arm, avg(CASE WHEN period >= 12 THEN y END) AS y, avg(CASE WHEN period < 12 THEN y END) AS pre FROM tr GROUP BY 1, 2), s AS (SELECT covar_samp(y, pre) / var_samp(pre) AS th, avg(pre) AS mp FROM m),
a AS (SELECT arm, y - th * (pre - mp) AS v FROM m, s), g AS (SELECT avg(CASE WHEN arm THEN v END) AS m1, avg(CASE WHEN NOT arm THEN v END) AS m0, var_samp(CASE WHEN arm THEN v END) AS v1, var_samp(CASE WHEN NOT arm THEN v END) AS v0, sum(arm::INT) AS n1, sum((NOT arm)::INT) AS n0 FROM a),
z AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS z, (v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)) AS dof FROM g) SELECT round(m1 - m0, 6) AS difference, round(m1 / m0, 6) AS ratio, round(z, 6) AS z, round({PW}, 6) AS p FROM z""")
def t11_parallel_ab(spark, d):
    x = panel(spark, d).withColumn("arm", F.col("unit") % 2 == 0).withColumn("post", F.col("period") >= 12)
    return rounded(stats.parallel_ab(x, "unit", "arm", "y", "post"))


@query(f"""WITH {PANEL}, su AS (SELECT unit, start, row_number() OVER (ORDER BY unit) AS slot FROM (SELECT DISTINCT unit, start FROM gr)),
dl AS (SELECT unit, draw, row_number() OVER (PARTITION BY draw ORDER BY md5('0|' || unit || '|' || draw), unit) AS slot FROM su, generate_series(1, 100) AS t(draw)),
dn AS (SELECT draw, gr.unit, period, y, (period >= su.start)::INT AS d FROM gr JOIN dl USING (unit) JOIN su USING (slot) UNION ALL SELECT 0, unit, period, y, d FROM tr),
dm AS (SELECT draw, y - avg(y) OVER (PARTITION BY draw, unit) - avg(y) OVER (PARTITION BY draw, period) + avg(y) OVER (PARTITION BY draw) AS y, d - avg(d) OVER (PARTITION BY draw, unit) - avg(d) OVER (PARTITION BY draw, period) + avg(d) OVER (PARTITION BY draw) AS d FROM dn),
be AS (SELECT draw, sum(y * d) / sum(d * d) AS beta FROM dm GROUP BY 1), e AS (SELECT beta AS effect FROM be WHERE draw = 0) SELECT round(effect, 6) AS effect, round((1 + sum((abs(beta) >= abs(effect))::INT)) / 101, 6) AS p FROM be, e WHERE draw > 0 GROUP BY effect""")
def t12_randomization_inference(spark, d):
    return rounded(stats.randomization_inference(panel(spark, d), "unit", "period", "y", "start", 100))


@query(f"""WITH RECURSIVE {PANEL}, {HOLES}, su AS (SELECT unit, start, row_number() OVER (ORDER BY unit) AS slot FROM (SELECT DISTINCT unit, start FROM ho)),
dl AS (SELECT unit, draw, row_number() OVER (PARTITION BY draw ORDER BY md5('0|' || unit || '|' || draw), unit) AS slot FROM su, generate_series(1, 20) AS t(draw)),
dn AS (SELECT draw, ho.unit, period, y::DOUBLE AS y, (period >= su.start)::INT::DOUBLE AS d FROM ho JOIN dl USING (unit) JOIN su USING (slot) UNION ALL SELECT 0, unit, period, y, d FROM ho), {out_of_means('dm', 'dn', ['y', 'd'], 'draw', rounds=60)},
be AS (SELECT draw, sum(y * d) / sum(d * d) AS beta FROM dm GROUP BY 1), e AS (SELECT beta AS effect FROM be WHERE draw = 0) SELECT round(effect, 6) AS effect, round((1 + sum((abs(beta) >= abs(effect))::INT)) / 21, 6) AS p FROM be, e WHERE draw > 0 GROUP BY effect""")
def t12_randomization_holes(spark, d):
    return rounded(stats.randomization_inference(with_holes(spark, d), "unit", "period", "y", "start", 20))


@query("SELECT 0 AS wave, 3 AS start, count(*) // 3 + (count(*) % 3 > 0)::INT AS n FROM supplier UNION ALL SELECT 1, 6, count(*) // 3 + (count(*) % 3 > 1)::INT FROM supplier UNION ALL SELECT 2, 9, count(*) // 3 FROM supplier")
def t13_wave_assignment(spark, d):
    return stats.wave_assignment(table(spark, d, "supplier"), "s_suppkey", 3, 3, 9).groupBy("wave", "start").agg(F.count("*").alias("n"))


def _compare_sql() -> str:
    parts, rows = ["li AS (SELECT l_suppkey AS m, l_returnflag = 'R' AS fault, l_discount > 0.05 AS x, l_tax > 0.05 AS y FROM lineitem)"], []
    for k in "xy":
        parts += [f"f{k} AS (SELECT m AS c, {k}::INT AS v FROM li WHERE fault)", f"h{k} AS (SELECT m AS c, {k}::INT AS v FROM li WHERE NOT fault)", f"w{k} AS (SELECT m AS k, avg({k}::INT - x::INT) AS x FROM li WHERE fault GROUP BY 1)"]
        parts += [boot_sql(f"bf{k}", f"f{k}", 200), boot_sql(f"bh{k}", f"h{k}", 200), sign_sql(f"sg{k}", f"w{k}", 200)]
        rows.append(f"SELECT '{k}' AS method, " + ", ".join(f"round({a}.{c}, 6) AS {n}" for a, c, n in ((f"bf{k}", "estimate", "detection"), (f"bf{k}", "low", "detection_low"), (f"bf{k}", "high", "detection_high"), (f"bh{k}", "estimate", "false_alarm"), (f"bh{k}", "low", "false_alarm_low"), (f"bh{k}", "high", "false_alarm_high"), (f"sg{k}", "p", "p"))) + f" FROM bf{k}, bh{k}, sg{k}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


@query(_compare_sql())
def t14_compare_alarms(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("m"), (F.col("l_returnflag") == "R").alias("fault"), (F.col("l_discount") > 0.05).alias("x"), (F.col("l_tax") > 0.05).alias("y"))
    return rounded(stats.compare_alarms(x, ["x", "y"], "x", "fault", "m", 200))


@query(f"""WITH pt AS (SELECT p_partkey AS c, (p_size > 10)::INT AS v, p_size > 10 AS wa, p_size > 25 AS wb, p_size - (p_size - p_partkey % 9) AS diff FROM part), {boot_sql('bt', 'pt', 200)},
mc AS (SELECT sum((wa AND NOT wb)::INT)::BIGINT AS a, sum((NOT wa AND wb)::INT)::BIGINT AS b FROM pt), ms AS (SELECT sum(exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))) AS p FROM (SELECT a, b, unnest(generate_series(0, least(a, b))) AS i FROM mc)),
ra AS (SELECT abs(diff) AS a, count(*) AS t, sum(CASE WHEN diff > 0 THEN 1.0 WHEN diff = 0 THEN 0.5 ELSE 0 END) AS plus FROM pt GROUP BY 1), rk AS (SELECT *, coalesce(sum(t) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM ra),
rg AS (SELECT sum(t)::DOUBLE AS n, sum(plus * rk) AS w, sum(CASE WHEN a = 0 THEN t ELSE 0 END)::DOUBLE AS z0, sum(CASE WHEN a <> 0 THEN t ** 3 - t ELSE 0 END)::DOUBLE AS ties FROM rk),
rz AS (SELECT (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - z0 * (z0 + 1) * (2 * z0 + 1) / 24 - ties / 48) AS z FROM rg)
SELECT round(estimate, 6) AS warned, round(low, 6) AS low, round(high, 6) AS high, round(least(1, 2 * ms.p), 6) AS p_warned, round(least(1, 2 * (1 - {Z2})), 6) AS p_lead FROM bt, ms, rz""")
def t15_warning_uncertainty(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 10).alias("wa"), (F.col("p_size") > 25).alias("wb"), F.col("p_size").alias("la"), (F.col("p_size") - F.col("p_partkey") % 9).alias("lb"))
    return rounded(stats.warning_uncertainty(x, "p_partkey", "wa", "wb", "la", "lb", 200))


@query(f"WITH {PANEL} SELECT round(avg(CASE WHEN period >= 12 THEN y END) / avg(CASE WHEN period < 12 THEN y END), 6) AS ratio FROM tr")
def t16_before_after_ratio(spark, d):
    return rounded(stats.before_after_ratio(panel(spark, d).withColumn("post", F.col("period") >= 12), "y", "post"))


@query(f"WITH {PANEL} SELECT d, round(sum(n) / count(*), 6) AS rate FROM tr GROUP BY 1")
def t16_rate_ratio(spark, d):
    return rounded(stats.rate_ratio(panel(spark, d).withColumn("e", F.lit(1.0)), "n", "e", "d"))


@query("""WITH p AS (SELECT p_brand AS outcome, p_size AS ships, 3 * (1 + p_partkey % 4) AS months, 0.5 + (p_partkey % 50) / 100.0 AS power, p_partkey FROM part), q AS (SELECT outcome, ships, months, max(power) AS power FROM p GROUP BY ALL)
SELECT outcome, ships, months, round(power, 6) AS power FROM q WHERE power >= 0.8 QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY ships * months, months) = 1""")
def t17_smallest_design(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("outcome"), F.col("p_size").alias("ships"), (3 * (1 + F.col("p_partkey") % 4)).alias("months")).agg(F.max(0.5 + (F.col("p_partkey") % 50) / 100).alias("power"))
    return rounded(stats.smallest_design(p, ["outcome"]))
