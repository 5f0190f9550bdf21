"""Where queries and their SQL are kept, and the tables and SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SENSORS = ["value", "k"]
REGIME = ["regime"]
HEALTHY, PERSISTENCE = 20, 2


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sensors(spark: SparkSession, d: str) -> DataFrame:
    """Events as a sensor table: asset, t (seconds), ts, day, regime, value, k."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("asset"), t.alias("t"), "ts", F.col("event_type").alias("regime"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return sensors(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("t", "event_id")))


def r6(c, n: int = 6):
    return F.round(c, n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*(F.round(F.col(f"`{c}`"), n).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


#: Shared SQL: the sensor table, healthy rows, residuals, scores, confirmed alarms.
EV = """ev AS (SELECT event_id, user_id AS asset, epoch_us(ts) / 1e6 AS t, ts, event_type AS regime, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""
Z = (
    EV
    + """, h AS (SELECT * FROM ev WHERE rn <= 20), gm AS (SELECT avg(value) AS g1, avg(k) AS g2 FROM h), rm AS (SELECT regime, avg(value) AS m1, avg(k) AS m2 FROM h GROUP BY regime),
r AS (SELECT ev.*, value - coalesce(m1, g1) AS r1, k - coalesce(m2, g2) AS r2 FROM ev LEFT JOIN rm USING (regime), gm),
rb AS (SELECT *, r1 - avg(CASE WHEN rn <= 20 THEN r1 END) OVER (PARTITION BY asset) AS b1, r2 - avg(CASE WHEN rn <= 20 THEN r2 END) OVER (PARTITION BY asset) AS b2 FROM r),
gs AS (SELECT stddev_samp(b1) AS g1, stddev_samp(b2) AS g2 FROM rb WHERE rn <= 20), rs AS (SELECT regime, nullif(stddev_samp(b1), 0) AS s1, nullif(stddev_samp(b2), 0) AS s2 FROM rb WHERE rn <= 20 GROUP BY regime),
z AS (SELECT event_id, asset, t, ts, rb.regime, value, k, rn, b1 / coalesce(s1, g1) AS z1, b2 / coalesce(s2, g2) AS z2 FROM rb LEFT JOIN rs ON rs.regime = rb.regime, gs)"""
)


def fit_sql(rows: str, name: str) -> str:
    """Two-sensor Ledoit-Wolf fit over a table with z1, z2: mean and precision entries."""
    return f"""{name}_c AS (SELECT avg(z1) AS m1, avg(z2) AS m2 FROM {rows}),
{name}_q AS (SELECT m1, m2, count(*) AS n, avg((z1 - m1) * (z1 - m1)) AS s11, avg((z2 - m2) * (z2 - m2)) AS s22, avg((z1 - m1) * (z2 - m2)) AS s12, avg(((z1 - m1) ** 2 + (z2 - m2) ** 2) ** 2) AS f4 FROM {rows}, {name}_c GROUP BY m1, m2),
{name}_l AS (SELECT *, (s11 + s22) / 2 AS mu, (((s11 - s22) / 2) ** 2 * 2 + 2 * s12 * s12) / 2 AS delta, (f4 - (s11 ** 2 + s22 ** 2 + 2 * s12 ** 2)) / (2 * n) AS beta FROM {name}_q),
{name}_r AS (SELECT *, least(greatest(beta, 0), delta) / delta AS rho FROM {name}_l),
{name}_v AS (SELECT m1, m2, (1 - rho) * s11 + rho * mu AS a, (1 - rho) * s12 AS b, (1 - rho) * s22 + rho * mu AS d FROM {name}_r),
{name} AS (SELECT m1, m2, d / (a * d - b * b) AS p11, -b / (a * d - b * b) AS p12, a / (a * d - b * b) AS p22 FROM {name}_v)"""


SCORED = (
    Z
    + ", hz AS (SELECT * FROM z WHERE rn <= 20), "
    + fit_sql("hz", "fit")
    + """, s0 AS (SELECT z.*, (z1 - m1) * ((z1 - m1) * p11 + (z2 - m2) * p12) AS c1, (z2 - m2) * ((z1 - m1) * p12 + (z2 - m2) * p22) AS c2 FROM z, fit),
th AS (SELECT quantile_cont(c1 + c2, 0.99) AS threshold FROM s0 WHERE rn <= 20),
s1 AS (SELECT s0.*, c1 + c2 AS health_score, threshold, c1 + c2 > threshold AS alarm FROM s0, th),
scored AS (SELECT *, min(alarm::INT) OVER w = 1 AND count(*) OVER w = 2 AS alarm_confirmed FROM s1 WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"""
)


def z_table(spark: SparkSession, d: str) -> DataFrame:
    """z_value and z_k of every row, by regime and against each machine's first rows.

    A table in the shared folder: fits and scores read it several times. The regime parameters are tables too, of a
    row per regime, so that they aren't fitted again for each use."""
    from fleethealth.operators.regime import fit_regime, transform_regime
    from fleethealth.sources.scratch import written

    rows = written(ranked(spark, d), "ranked")
    means, spreads = fit_regime(rows.filter(F.col("rn") <= HEALTHY), SENSORS, REGIME, "asset", "t", HEALTHY)
    return written(transform_regime(rows, means, written(spreads, "spreads"), SENSORS, REGIME, "asset", "t", HEALTHY), "residuals")


def fitted(z: DataFrame):
    """A detector on healthy rows with the 99 % quantile of their own scores as its threshold."""
    from dataclasses import replace

    from fleethealth.operators import detector

    healthy = z.filter(F.col("rn") <= HEALTHY)
    d = detector.fit_detector(healthy, [f"z_{s}" for s in SENSORS])
    return replace(d, threshold=detector.quantile_threshold(healthy.select(detector.health_score(d).alias("health_score")), 0.99))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The scored table: health_score, threshold, alarm, top_sensors, alarm_confirmed."""
    from fleethealth.operators import detector

    z = z_table(spark, d)
    return detector.score(z, fitted(z), "asset", "t", PERSISTENCE, 2)
