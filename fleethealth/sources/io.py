"""Sources and sinks of sensor tables, reports, parameters and passages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleethealth.operators.detector import Detector


def read_whitespace(spark: SparkSession, path: str, names: list[str], decimals: dict[str, int] | None = None) -> DataFrame:
    """Headerless numbers between white space, with given names; some columns rounded half-even."""
    parts = F.split(F.trim("value"), r"\s+")
    row = spark.read.text(path).filter(F.trim("value") != "")
    out = row.select(*(F.get(parts, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))
    return out.withColumns({c: F.bround(c, d) for c, d in (decimals or {}).items()})


def read_scada(spark: SparkSession, path: str, rename: dict[str, str], time: str, order: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Latin-1 CSV with semicolons, one file per event: chosen columns under new names, and ``event_id``."""
    raw = spark.read.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    event = F.regexp_extract(F.col("_metadata.file_name"), r"([^/.]+)\.", 1)
    out = raw.select(event.alias("event_id"), *(F.col(f"`{a}`").alias(b) for a, b in rename.items()))
    numeric = {c: F.expr(f"try_cast(`{c}` as double)") for c in rename.values() if c not in (time, order)}
    return out.withColumns(numeric).withColumn(time, F.try_to_timestamp(time, F.lit(fmt))).withColumn(order, F.col(order).cast("long"))


def read_cycle_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, line, signal: one cycle per line of tab-separated numbers, one file per sensor."""
    values = F.transform(F.split(F.trim("value"), r"\t"), lambda v: v.cast("double"))
    return spark.read.text(path).filter(F.trim("value") != "").select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/.]+)\.", 1).alias("sensor"), F.monotonically_increasing_id().alias("line"), values.alias("signal"))


def read_runs(spark: SparkSession, paths: list[str], schema: str, split: Column | None = None) -> DataFrame:
    """Many run files as one table: ``run`` and ``fault`` from names like d07_te, ``split``."""
    rows = spark.read.schema(schema).option("header", True).csv(paths)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/.]+)\.", 1)
    is_test = F.when(name.endswith("_te"), "test").otherwise("train") if split is None else split
    return rows.select("*", name.alias("run"), F.regexp_extract(name, r"(\d+)", 1).cast("int").alias("fault"), is_test.alias("split"))


def concat_parts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def ingest_append(spark: SparkSession, csv_path: str, table_path: str) -> DataFrame:
    """Appends CSV rows with ``_ingested_at``; the table is read with merged schemas."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(csv_path).withColumn("_ingested_at", F.current_timestamp())
    rows.write.mode("append").parquet(table_path)
    return spark.read.option("mergeSchema", True).parquet(table_path)


def write_table(df: DataFrame, path: str, asset: Column, run_date: Column, mode: str = "overwrite") -> None:
    """Parquet by asset and run date; overwriting replaces only the partitions that are written."""
    out = df.withColumn("asset_name", asset).withColumn("run_date", run_date)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("asset_name", "run_date").parquet(path)


def write_features_scores(features: DataFrame, scores: DataFrame, path: str, asset: Column, run_date: Column) -> None:
    write_table(features, f"{path}/features", asset, run_date)
    write_table(scores, f"{path}/scores", asset, run_date)


def write_report(df: DataFrame, path: str, fmt: str = "csv", compress: bool = True) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").format(fmt).save(path)


def write_chunks(chunks: DataFrame, manifest: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").option("compression", "gzip").json(f"{path}/chunks")
    manifest.write.mode("overwrite").option("header", True).csv(f"{path}/manifest")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest), with empty strings for nulls."""
    chunks = spark.read.schema("doc_id string, section string, text string, chunk_id string").json(f"{path}/chunks")
    manifest = spark.read.option("header", True).csv(f"{path}/manifest")
    return chunks.na.fill(""), manifest.na.fill("")


def overlay_policy(register: DataFrame, policy: DataFrame, mode: str = "failure_mode") -> DataFrame:
    """Effects and severities of today's policy table over those that were stored with the scores."""
    own = [c for c in policy.columns if c != mode and c in register.columns]
    return register.drop(*own).join(policy, mode, "left")


def flatten_metrics(df: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """run, key, value: numeric columns under dotted, cleaned keys."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "boolean") and c not in (run, *keys)]
    long = df.select(run, *keys, *(F.col(c).cast("double").alias(c) for c in numbers)).unpivot([run, *keys], numbers, "_m", "value")
    key = F.substring(F.regexp_replace(F.concat_ws(".", *(F.col(k).cast("string") for k in keys), "_m"), r"[^\w\-./ ]", "_"), 1, 250)
    return long.select(run, key.alias("key"), "value").filter("value is not null")


def save_params(detector: Detector, spark: SparkSession, path: str, asset: str, version: int) -> None:
    """Fitted parameters as a table keyed by asset and version."""
    rows = [(asset, version, k, c, float(m), [float(v) for v in p], float(detector.threshold)) for k, (c, m, p) in enumerate(zip(detector.columns, detector.mean, detector.precision, strict=True))]
    df = spark.createDataFrame(rows, "asset string, version int, position int, column string, mean double, precision array<double>, threshold double")
    df.write.mode("append").parquet(path)


def load_params(spark: SparkSession, path: str, asset: str, version: int | None = None) -> Detector:
    """The asset's newest version, or the given one."""
    rows = spark.read.parquet(path).filter(F.col("asset") == asset)
    version = rows.agg(F.max("version").alias("v")).first().v if version is None else version
    got = rows.filter(F.col("version") == version).orderBy("position").collect()  # a row per sensor
    if not got:
        raise KeyError(f"no parameters of {asset}, version {version}")
    return Detector(tuple(r["column"] for r in got), tuple(r["mean"] for r in got), tuple(tuple(r["precision"]) for r in got), got[0]["threshold"])


def save_model(model: PipelineModel, path: str, asset: str, version: int) -> None:
    model.write().overwrite().save(f"{path}/{asset}/{version}")


def load_model(path: str, asset: str, version: int) -> PipelineModel:
    return PipelineModel.load(f"{path}/{asset}/{version}")
