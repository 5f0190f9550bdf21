"""Supervised models, tables in and out, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleethealth.operators import learn
from fleethealth.plans.registry import PERSISTENCE, SCORED, query, rounded, scored, sensors, table, z_table
from fleethealth.sources import io
from fleethealth.sources.scratch import folder, written
from fleethealth.streaming import streams

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def labelled(spark, d):
    """Supplier days with a class that follows from discount and tax."""
    c = F.when(F.col("l_discount") > 0.05, "pump").when(F.col("l_tax") > 0.04, "valve").otherwise("healthy")
    return table(spark, d, "lineitem").withColumn("y", c).withColumn("rul", 100 - F.col("l_quantity") * 1.5 - 100 * F.col("l_tax"))


@query()
def m1_fit_classifier(spark, d):
    x = labelled(spark, d)
    out = learn.diagnose(x, learn.fit_classifier(x, FEATURES, "y", "forest"))
    return out.groupBy("y", "diagnosis").agg(F.count("*").alias("n"))


@query()
def m1_boosted_classifier(spark, d):
    """The same classes by boosted trees, one against the rest."""
    x = labelled(spark, d)
    return learn.diagnose(x, learn.fit_classifier(x, FEATURES, "y", "boosted")).groupBy("y", "diagnosis").agg(F.count("*").alias("n"))


@query()
def m11_diagnose(spark, d):
    """Each row's diagnosis and how sure it is, where the true class isn't given."""
    x = labelled(spark, d)
    return learn.diagnose(x.select("l_orderkey", "l_linenumber", "l_partkey", *FEATURES), learn.fit_classifier(x, FEATURES, "y", "logistic")).select("l_orderkey", "l_linenumber", "l_partkey", "diagnosis", "diagnosis_confidence")


@query()
def m14_predict_rul(spark, d):
    """Each row's remaining life by boosted trees, capped."""
    x = labelled(spark, d)
    return learn.predict_rul(x, learn.fit_regressor(x, FEATURES, "rul", "boosted"), 60.0).select("l_orderkey", "l_linenumber", "l_partkey", "rul", "rul_pred")


LABELLED = "lb AS (SELECT l_suppkey, l_quantity::DOUBLE AS x1, l_extendedprice::DOUBLE AS x2, l_discount::DOUBLE AS x3, l_tax::DOUBLE AS x4, 100 - l_quantity::DOUBLE * 1.5 - 100 * l_tax::DOUBLE AS y FROM lineitem)"


def ridge_sql(p: str, rows: str) -> str:
    """Ridge regression of y on x1 to x4 by group g of a table, penalty 0.01 in units of standard deviations: {p} has means, deviations and coefficients b1 to b4.

    The normal equations are solved by elimination, one step a common table."""
    at = range(1, 5)
    scaled = lambda i: f"stddev_samp(x{i})"
    cells = [f"covar_pop(x{i}, x{j}) / ({scaled(i)} * {scaled(j)}){' + 0.01 / stddev_samp(y)' if i == j else ''} AS m{i}{j}" for i in at for j in at]
    cells += [f"covar_pop(x{i}, y) / {scaled(i)} AS m{i}5" for i in at] + [f"avg(x{i}) AS a{i}, {scaled(i)} AS s{i}" for i in at]
    steps = [f"{p}0 AS (SELECT g, avg(y) AS ay, {', '.join(cells)} FROM {rows} GROUP BY g)"]
    for k in at:
        less = [f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} AS m{i}{j}" for i in at for j in range(1, 6) if i != k]
        steps.append(f"{p}{k} AS (SELECT * REPLACE ({', '.join(less)}) FROM {p}{k - 1})")
    return ", ".join(steps) + f", {p} AS (SELECT *, {', '.join(f'm{i}5 / m{i}{i} AS b{i}' for i in at)} FROM {p}4)"


PREDICTED = "ay + " + " + ".join(f"b{i} * (x{i} - a{i}) / s{i}" for i in range(1, 5))


@query(f"WITH {LABELLED}, al AS (SELECT 0 AS g, * FROM lb), {ridge_sql('rg', 'al')} SELECT round(avg(abs(round_even(least(greatest({PREDICTED}, 0), 120), 1) - y)), 3) AS mae FROM lb, rg")
def m2_fit_regressor(spark, d):
    x = labelled(spark, d)
    p = learn.predict_rul(x, learn.fit_regressor(x, FEATURES, "rul", "ridge"), 120.0)
    return rounded(p.agg(F.avg(F.abs(F.col("rul_pred") - F.col("rul"))).alias("mae")), 3)


@query("WITH c AS (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1) SELECT y, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def m3_balanced_weights(spark, d):
    x = learn.balanced_weights(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y")), "y")
    return rounded(x.groupBy("y").agg(F.max("weight").alias("weight")))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('0|' || l_suppkey), l_suppkey) - 1 AS rn FROM g)
SELECT (CASE WHEN rn // 5 % 2 = 0 THEN rn % 5 ELSE 4 - rn % 5 END)::INTEGER AS fold, count(*) AS suppliers, sum(n)::BIGINT AS rows FROM r GROUP BY 1""")
def m4_group_kfold(spark, d):
    x = learn.group_kfold(table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey", 5)
    return x.groupBy("fold").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("rows"))


@query("WITH g AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) SELECT 'test' AS split, ceil(n * 0.3)::BIGINT AS suppliers FROM g UNION ALL SELECT 'train', n - ceil(n * 0.3)::BIGINT FROM g")
def m5_group_shuffle_split(spark, d):
    x = learn.group_shuffle_split(table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey", 0.3)
    return x.groupBy("split").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events), m AS (SELECT user_id, floor(i * 4 / (max(i) OVER (PARTITION BY user_id) + 1))::BIGINT AS b FROM e) SELECT user_id || '_' || b AS \"group\", count(*) AS n FROM m GROUP BY 1")
def m6_time_block_groups(spark, d):
    from pyspark.sql import Window

    x = sensors(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("t")) - 1)
    return learn.time_block_groups(x, "asset", "i", 4).groupBy("group").agg(F.count("*").alias("n"))


@query()
def m7_compare_models(spark, d):
    x = learn.group_kfold(labelled(spark, d).select("l_suppkey", *FEATURES, "y"), "l_suppkey", 2)
    return rounded(learn.compare_models(x, FEATURES, "y", ["forest", "logistic"]), 3)


@query(f"""WITH {LABELLED}, gr AS (SELECT l_suppkey, count(*) AS n FROM lb GROUP BY 1), nb AS (SELECT l_suppkey, row_number() OVER (ORDER BY n DESC, md5('0|' || l_suppkey), l_suppkey) - 1 AS rn FROM gr),
fd AS (SELECT lb.*, (CASE WHEN rn // 2 % 2 = 0 THEN rn % 2 ELSE 1 - rn % 2 END)::INTEGER AS fold FROM lb JOIN nb USING (l_suppkey)), al AS (SELECT 1 - fold AS g, * FROM fd), {ridge_sql('rg', 'al')}
SELECT fold, round(sqrt(avg(({PREDICTED} - y) ** 2)), 3) AS rmse, count(*) AS n FROM fd JOIN rg ON g = fold GROUP BY 1""")
def m9_out_of_fold(spark, d):
    x = learn.group_kfold(labelled(spark, d).select("l_suppkey", *FEATURES, "rul"), "l_suppkey", 2)
    o = learn.out_of_fold(x, FEATURES, "rul", "ridge", classify=False)
    return rounded(o.groupBy("fold").agg(F.sqrt(F.avg((F.col("oof") - F.col("rul")) ** 2)).alias("rmse"), F.count("*").alias("n")), 3)


@query()
def m10_leakage_probe(spark, d):
    x = labelled(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", *FEATURES, "y")
    rows = learn.random_folds(x, ["l_orderkey", "l_linenumber"], 2)
    return learn.out_of_fold(rows, FEATURES, "y", "logistic").agg(F.round(F.avg((F.col("oof") == F.col("y")).cast("int")), 3).alias("accuracy"))


@query(f"WITH {LABELLED}, al AS (SELECT 0 AS g, * FROM lb), {ridge_sql('rg', 'al')} SELECT round(avg(abs({PREDICTED} - y)), 3) AS mae FROM lb, rg")
def m12_severity_regressors(spark, d):
    x = labelled(spark, d)
    models = learn.severity_regressors(x, FEATURES, ["rul"])
    return models["rul"].transform(x).agg(F.round(F.avg(F.abs(F.col("predicted") - F.col("rul"))), 3).alias("mae"))


@query()
def m13_grade_components(spark, d):
    x = labelled(spark, d)
    out = learn.grade_components(x, {"pump": learn.fit_classifier(x, FEATURES, "y", "logistic")}, {"pump": ["pump", "valve"]})
    return out.groupBy("y", "condition_pump").agg(F.count("*").alias("n"), F.round(F.avg("p_critical_pump"), 3).alias("p"))


@query()
def m15_feature_importance(spark, d):
    x = labelled(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *FEATURES, "rul")
    model = learn.fit_regressor(x, FEATURES, "rul", "ridge")
    lin = learn.linear_attribution(x, model, FEATURES).withColumn("kind", F.lit("linear"))
    perm = learn.permutation_importance(x, model.transform, FEATURES, ["l_orderkey", "l_linenumber", "l_partkey"], F.abs(F.col("predicted") - F.col("rul"))).withColumn("kind", F.lit("permutation"))
    return rounded(lin.unionByName(perm), 3)


# --- tables in and out ---


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2")
def s6_write_table(spark, d):
    path = folder(spark, "table")
    io.write_table(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path, F.col("l_returnflag"), F.lit("2024-01-01"))
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s8_write_report(spark, d):
    path = folder(spark, "report")
    io.write_report(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), path)
    x = spark.read.option("header", True).schema("o_orderpriority string, o_totalprice double").csv(path)
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS bal FROM supplier GROUP BY 1")
def s1_read_whitespace(spark, d):
    path = folder(spark, "plain")
    table(spark, d, "supplier").select(F.concat_ws("  ", F.lit(" ").cast("string"), "s_suppkey", "s_nationkey", "s_acctbal").alias("value")).write.text(path)
    x = io.read_whitespace(spark, path, ["s_suppkey", "s_nationkey", "s_acctbal"], {"s_acctbal": 2})
    return x.groupBy(F.col("s_nationkey").cast("int").alias("s_nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("bal"))


@query("SELECT count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE))), 3) AS total FROM embeddings")
def s3_read_cycle_matrix(spark, d):
    path = folder(spark, "cycles")
    line = F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), "\t")
    table(spark, d, "embeddings").select(line.alias("value")).write.text(path)
    x = io.read_cycle_matrix(spark, path)
    return x.agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v)), 3).alias("total"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def s9_chunks_round_trip(spark, d):
    path = folder(spark, "chunks")
    docs = table(spark, d, "documents")
    io.write_chunks(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("Summary").alias("section"), "text", F.concat(F.col("doc_id").cast("string"), F.lit("#000")).alias("chunk_id")), docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang"), path)
    chunks, manifest = io.read_chunks(spark, path)
    return chunks.join(manifest, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_brand || '.' || p_type || '.' || m AS key, v AS value FROM (SELECT p_brand, p_type, unnest(['n', 'size']) AS m, unnest([count(*)::DOUBLE, sum(p_size)::DOUBLE]) AS v FROM part GROUP BY 1, 2)")
def s11_flatten_metrics(spark, d):
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size")).withColumn("run", F.lit("r"))
    return io.flatten_metrics(g, "run", ["p_brand", "p_type"]).select(F.regexp_replace("key", "_", "#").alias("key"), "value")


@query("SELECT count(*) AS n, 0.0::DOUBLE AS gap FROM events")
def s12_params_store(spark, d):
    from fleethealth.operators.detector import health_score
    from fleethealth.plans.registry import fitted

    z = z_table(spark, d)
    f, path = fitted(z), folder(spark, "params")
    io.save_params(f, spark, path, "fleet", 1)
    back = io.load_params(spark, path, "fleet")
    return z.agg(F.count("*").alias("n"), F.max(F.abs(health_score(f) - health_score(back))).alias("gap"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders GROUP BY 1")
def s2_read_scada(spark, d):
    path = folder(spark, "scada")
    x = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time_stamp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("wind (m/s)"), F.col("o_orderpriority").alias("état"))
    x.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    got = io.read_scada(spark, path, {"time_stamp": "ts", "id": "id", "wind (m/s)": "wind"}, "ts", "id")
    j = got.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")), "id")
    return j.groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("wind"), 2).alias("total"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last"))


@query("SELECT n_regionkey, count(*) AS n, 'train' AS split FROM nation GROUP BY 1")
def s4_read_runs(spark, d):
    path = folder(spark, "runs")
    table(spark, d, "nation").select("n_nationkey", "n_regionkey").write.option("header", True).csv(path)
    x = io.read_runs(spark, [path], "n_nationkey int, n_regionkey int", F.lit("train"))
    return x.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("split").alias("split"))


@query("SELECT c_mktsegment, 2 * count(*) AS n, count(*) AS with_balance FROM customer GROUP BY 1")
def s5_ingest_append(spark, d):
    path, first, second = (folder(spark, k) for k in ("ingested", "first", "second"))
    c = table(spark, d, "customer")
    c.select("c_custkey", "c_mktsegment").write.option("header", True).csv(first)
    c.select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).csv(second)
    io.ingest_append(spark, first, path)
    return io.ingest_append(spark, second, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_balance"))


@query("SELECT l_returnflag, count(*) AS features, count(*) AS scores FROM lineitem GROUP BY 1")
def s7_write_features_scores(spark, d):
    path = folder(spark, "run")
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    io.write_features_scores(x.drop("l_tax"), x.drop("l_quantity"), path, F.col("l_returnflag"), F.lit("2024-01-01"))
    f, s = (spark.read.parquet(f"{path}/{k}").groupBy("l_returnflag").agg(F.count("*").alias(k)) for k in ("features", "scores"))
    return f.join(s, "l_returnflag")


@query("SELECT p_type AS failure_mode, CASE WHEN p_type = 'ECONOMY' THEN 5 ELSE NULL END AS severity, count(*) AS n FROM part GROUP BY 1, 2")
def s10_overlay_policy(spark, d):
    stored = table(spark, d, "part").select(F.col("p_type").alias("failure_mode"), F.col("p_size").alias("severity"))
    policy = table(spark, d, "part").filter("p_type = 'ECONOMY'").select(F.col("p_type").alias("failure_mode")).distinct().withColumn("severity", F.lit(5))
    return io.overlay_policy(stored, policy).groupBy("failure_mode", "severity").agg(F.count("*").alias("n"))


# --- streams, over files, run to their end and compared with the batch form ---


def streamed(spark, df, stream, mode: str = "append", files: int = 4):
    """Rows that a streaming query gives for a table read as a stream of files."""
    src, out, mark = (folder(spark, k) for k in ("source", "sink", "marks"))
    df.repartition(files).write.parquet(src)
    s = stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(out)


def streamed_in_order(spark, df, stream, time: str, slices: int = 4, arrival=None):
    """The same with the rows arriving in time order, or in that of ``arrival``: a slice of time after the other, each a batch of many files.

    State and watermark pass from batch to batch by the checkpoint. Rows are written first, so that slices don't work them out again."""
    src, out, mark = (folder(spark, k) for k in ("source", "sink", "marks"))
    df = written(df, "arrivals")
    when = F.unix_micros(time) if arrival is None else arrival
    at = F.coalesce(when, F.lit(-(1 << 63)))
    cuts = df.agg(F.percentile_approx(when, [k / slices for k in range(1, slices)]).alias("c")).first().c or []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if lo is None else df.filter(at > lo)
        (part if hi is None else part.filter(at <= hi)).write.mode("append").parquet(src)
        s = stream(spark.readStream.schema(df.schema).parquet(src))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(out)


@query(f"WITH {SCORED} SELECT event_id, round(health_score, 6) AS health_score, alarm FROM scored")
def st1_stream_score(spark, d):
    from fleethealth.plans.registry import fitted

    z = z_table(spark, d).select("event_id", "z_value", "z_k", "rn")
    f = fitted(z)
    return rounded(streamed(spark, z.drop("rn"), lambda s: streams.stream_score(s, f).select("event_id", "health_score", "alarm")))


@query(f"WITH {SCORED} SELECT asset, sum(alarm_confirmed::INT)::BIGINT AS confirmed FROM scored GROUP BY 1")
def st2_stream_confirm(spark, d):
    x = scored(spark, d).select("asset", F.col("ts").cast("timestamp").alias("ts"), "alarm")
    return streamed_in_order(spark, x, lambda s: streams.stream_confirm(s, "asset", "ts", PERSISTENCE), "ts").groupBy("asset").agg(F.sum(F.col("alarm_confirmed").cast("int")).alias("confirmed"))


@query(f"""WITH {SCORED}, hr AS (SELECT *, date_trunc('hour', ts) AS h FROM scored),
cf AS (SELECT asset, h, min(alarm::INT) OVER w = 1 AND count(*) OVER w = {PERSISTENCE} AS confirmed FROM hr WINDOW w AS (PARTITION BY asset ORDER BY h, event_id ROWS BETWEEN {PERSISTENCE - 1} PRECEDING AND CURRENT ROW))
SELECT asset, count(*) AS n, sum(confirmed::INT)::BIGINT AS confirmed FROM cf WHERE h <= (SELECT max(h) - INTERVAL 2 DAY FROM cf) GROUP BY 1""")
def st2_stream_confirm_ordered(spark, d):
    """Times are cut to hours, so many tie, and rows arrive up to a day late; what the watermark has passed equals the batch form."""
    x = scored(spark, d).select("asset", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "event_id", "alarm")
    late = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000))
    before = spark.conf.get(streams.STATE_STORE, None)
    spark.conf.set(streams.STATE_STORE, streams.ROCKS_DB)
    try:
        out = streamed_in_order(spark, x, lambda s: streams.stream_confirm_ordered(s, "asset", "ts", "event_id", PERSISTENCE, "2 days"), "ts", arrival=late)
    finally:
        spark.conf.unset(streams.STATE_STORE) if before is None else spark.conf.set(streams.STATE_STORE, before)
    return out.groupBy("asset").agg(F.count("*").alias("n"), F.sum(F.col("alarm_confirmed").cast("int")).alias("confirmed"))


@query("SELECT event_type AS slice, count(*) AS n FROM events WHERE value > 200 GROUP BY 1")
def st3_stream_alert_log(spark, d):
    a = sensors(spark, d).filter("value > 200").select(F.col("event_id").cast("string").alias("alert_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("regime").alias("slice"))
    twice = a.unionByName(a)
    return streamed(spark, twice, lambda s: streams.stream_alert_log(s, delay="60 days")).groupBy("slice").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT event_type AS endpoint, date_trunc('day', ts) + INTERVAL 1 DAY AS e, max(ts) OVER () - INTERVAL 10 MINUTE AS mark FROM events) SELECT endpoint, count(*) AS calls FROM w WHERE e <= mark GROUP BY 1""")
def st4_stream_service_health(spark, d):
    x = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("cost_usd"))
    return rounded(streamed_in_order(spark, x, lambda s: streams.stream_service_health(s, "1 day"), "ts").groupBy("endpoint").agg(F.sum("calls").alias("calls")))
