"""Supervised models on MLlib: diagnosis, grades, remaining life."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.operators.metrics import classification_scores
from fleethealth.sources.scratch import written

CLASSIFIERS = ("forest", "boosted", "logistic")
REGRESSORS = ("boosted", "ridge")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """weight: n over classes times the class's n."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    w = n.withColumn("weight", F.sum("_n").over(Window.partitionBy(F.lit(0))) / (F.count("*").over(Window.partitionBy(F.lit(0))) * F.col("_n")))  # a row per class
    return df.join(F.broadcast(w.select(label, "weight")), label)


#: Bins of a feature in boosted trees (MLlib's maxBins), steps of the quantiles between which they are cut, names of binned columns.
BINS, ACCURACY, BIN = 32, 10_000, "_bin_"


def _bins(df: DataFrame, features: list[str]) -> Bucketizer:
    """Bins of each feature: its values, cut half way, if there are at most BINS of them, else ranges between quantiles of all rows."""
    x = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features}
    shares = [k / BINS for k in range(1, BINS)]
    seen = df.agg(*(f for i, v in enumerate(x.values()) for f in (F.approx_count_distinct(v).alias(f"n{i}"), F.percentile_approx(v, shares, ACCURACY).alias(f"q{i}")))).first()
    few = [i for i in range(len(features)) if seen[f"n{i}"] <= 2 * BINS]
    sets = df.agg(*(F.sort_array(F.collect_set(x[features[i]])).alias(f"v{i}") for i in few)).first() if few else None  # about 2 * BINS values each
    cuts = []
    for i in range(len(features)):
        if i in few and len(sets[f"v{i}"]) <= BINS:
            v = sets[f"v{i}"]
            at = {a / 2 + b / 2 for a, b in zip(v, v[1:], strict=False)}
        else:
            at = {float(np.nextafter(q, np.inf)) for q in seen[f"q{i}"]}  # the quantile itself goes to the lower bin
        at = sorted(a for a in at if np.isfinite(a)) or [0.0]
        cuts.append([-float("inf"), *at, float("inf")])
    return Bucketizer(inputCols=features, outputCols=[f"{BIN}{i}" for i in range(len(features))], splitsArray=cuts, handleInvalid="skip")


def _numeric(df: DataFrame, features: list[str]) -> bool:
    kinds = dict(df.dtypes)
    return all(kinds[f].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) for f in features)


def boosted_classifier(df: DataFrame, features: list[str], label: str, weight: str, stages: list) -> PipelineModel:
    """A pipeline of ``stages`` (an indexer of the label, an assembler, boosted trees) fitted on cells of rows that trees can't tell apart.

    Boosted trees only ever see bins, and rows of the same bins and label have the same margins and gradients in every round, so a cell
    with the rows' weight stands for them exactly. A fit reads its rows hundreds of times; cells are at most as many as combinations of bins."""
    bins = _bins(df, features)
    cells = bins.transform(df).groupBy(*bins.getOutputCols(), label).agg(F.sum(weight).alias(weight))
    return _on_cells(cells, bins, stages, 1)


def boosted_regressor(df: DataFrame, features: list[str], target: str, assembler: VectorAssembler, trees: GBTRegressor) -> PipelineModel:
    """The same for a number: squared errors differ between splits only by cells' means and counts."""
    if not _numeric(df, features):
        return Pipeline(stages=[assembler, trees]).fit(df)
    bins = _bins(df, features)
    mean = F.when(F.count(F.col(target)) == F.count("*"), F.avg(F.col(target).cast("double")))  # a missing target is refused, as in a fit on rows
    cells = bins.transform(df).groupBy(*bins.getOutputCols()).agg(mean.alias(target), F.count("*").cast("double").alias("_n"))
    return _on_cells(cells, bins, [assembler, trees.setWeightCol("_n")], 0)


def _on_cells(cells: DataFrame, bins: Bucketizer, stages: list, at: int) -> PipelineModel:
    """Bins go in as plain numbers: the bucketizer marks them as categories, which trees would split in any order."""
    codes = bins.getOutputCols()
    stages[at].setInputCols(codes)
    fitted = Pipeline(stages=stages).fit(written(cells.withColumns({c: F.col(c).cast("int") for c in codes}), "cells")).stages
    return PipelineModel(fitted[:at] + [bins] + fitted[at:])


def without_bins(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(BIN)))


#: Rows of a forest's task: each is held with a count per tree.
TASK_ROWS = 250_000


def _dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows in partitions of about TASK_ROWS rows: a forest keeps its rows in the partitions that they come in, however large."""
    rows = df.select(*columns)
    n = rows.count()
    return rows if n <= TASK_ROWS else rows.repartition(-(-n // TASK_ROWS))


def fit_classifier(df: DataFrame, features: list[str], label: str, kind: str = "forest", seed: int = 0) -> PipelineModel:
    """String labels, balanced classes; gives ``predicted`` index, probabilities and label names.

    Boosted trees are binary, so each class is held against the rest; the margins become probabilities by softmax."""
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")]
    common = {"labelCol": "_label", "weightCol": "weight", "predictionCol": "_predicted", "probabilityCol": "_probability", "rawPredictionCol": "_raw"}
    if kind == "logistic":
        stages += [StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", regParam=0.003, maxIter=100, **common)]
    elif kind == "boosted":
        tree = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=20, maxDepth=4, stepSize=0.2, seed=seed).setRawPredictionCol("_raw")
        stages.append(OneVsRest(classifier=tree, featuresCol="_x", labelCol="_label", weightCol="weight", predictionCol="_predicted", rawPredictionCol="_raw", parallelism=2))
        if _numeric(df, features):
            return boosted_classifier(balanced_weights(df, label), features, label, "weight", stages)
    else:
        stages.append(RandomForestClassifier(featuresCol="_x", numTrees=60, maxDepth=8, seed=seed, **common))
        return Pipeline(stages=stages).fit(_dealt(balanced_weights(df, label), [*features, label, "weight"]))
    return Pipeline(stages=stages).fit(balanced_weights(df, label))


def fit_regressor(df: DataFrame, features: list[str], target: str, kind: str = "boosted", seed: int = 0) -> PipelineModel:
    stages = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip")]
    if kind == "ridge":
        stages += [StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True), LinearRegression(featuresCol="_scaled", labelCol=target, predictionCol="predicted", regParam=0.01, elasticNetParam=0.0)]
    else:
        return boosted_regressor(df, features, target, stages[0], GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="predicted", maxIter=40, maxDepth=4, stepSize=0.1, seed=seed))
    return Pipeline(stages=stages).fit(df)


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def diagnose(df: DataFrame, model: PipelineModel) -> DataFrame:
    """diagnosis and diagnosis_confidence (three decimals)."""
    names = F.array(*(F.lit(x) for x in labels_of(model)))
    out = without_bins(model.transform(_with_label(df, model)))
    p = _probabilities(out)
    return out.withColumn("diagnosis", F.element_at(names, F.col("_predicted").cast("int") + 1)).withColumn("diagnosis_confidence", F.bround(F.array_max(p), 3)).drop("_label", "_x", "_scaled", "_raw", "_probability", "_predicted")


def _probabilities(out: DataFrame) -> Column:
    """The model's own, or the softmax of its margins."""
    if "_probability" in out.columns:
        return vector_to_array("_probability")
    weights = F.transform(vector_to_array("_raw"), lambda m: F.exp(2 * m))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, v: a + v))


def _with_label(df: DataFrame, model: PipelineModel) -> DataFrame:
    name = model.stages[0].getInputCol()
    if name not in df.columns:
        df = df.withColumn(name, F.lit(labels_of(model)[0]))
    model.stages[0].setHandleInvalid("keep")
    return df


def grade_components(df: DataFrame, models: dict[str, PipelineModel], critical: dict[str, list[str]]) -> DataFrame:
    """condition_<c> and p_critical_<c> of each component."""
    out = df
    for c, model in models.items():
        names = labels_of(model)
        out = without_bins(model.transform(_with_label(out, model)))
        p = _probabilities(out)
        worst = sum((p[k] for k, n in enumerate(names) if n in critical[c]), F.lit(0.0))
        out = out.withColumn(f"condition_{c}", F.element_at(F.array(*(F.lit(n) for n in names)), F.col("_predicted").cast("int") + 1)).withColumn(f"p_critical_{c}", F.bround(worst, 3)).drop("_label", "_x", "_scaled", "_raw", "_probability", "_predicted")
    return out


def predict_rul(df: DataFrame, model: PipelineModel, cap: float) -> DataFrame:
    """rul_pred within [0, cap], one decimal."""
    return without_bins(model.transform(df)).withColumn("rul_pred", F.bround(F.least(F.greatest(F.col("predicted"), F.lit(0.0)), F.lit(cap)), 1)).drop("_x", "_scaled", "predicted")


def severity_regressors(df: DataFrame, features: list[str], targets: list[str], faulty: str | None = None, kind: str = "ridge") -> dict[str, PipelineModel]:
    rows = df.filter(F.col(faulty)) if faulty else df
    return {t: fit_regressor(rows, features, t, kind) for t in targets}


def group_kfold(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """fold: whole groups, dealt by falling size in a snake, so folds have balanced sizes."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    rn = F.row_number().over(Window.orderBy(F.desc("_n"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"))), group)) - 1  # a row per group
    lap = F.floor(rn / folds)
    fold = F.when(lap % 2 == 0, rn % folds).otherwise(folds - 1 - rn % folds)
    return df.join(sizes.select(group, fold.cast("int").alias("fold")), group)


def group_shuffle_split(df: DataFrame, group: str, test_fraction: float, seed: int = 0) -> DataFrame:
    """split: the given share of groups, rounded up, is test."""
    groups = df.select(group).distinct()
    rn = F.row_number().over(Window.orderBy(F.xxhash64(group, F.lit(seed)), group))  # a row per group
    marked = groups.withColumn("_rn", rn).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return df.join(marked.select(group, F.when(F.col("_rn") <= F.ceil(F.col("_n") * test_fraction), "test").otherwise("train").alias("split")), group)


def time_block_groups(df: DataFrame, run: str, sample: str, blocks: int) -> DataFrame:
    """group: run and block of consecutive samples."""
    top = F.max(sample).over(Window.partitionBy(run)) + 1
    return df.withColumn("group", F.concat_ws("_", F.col(run).cast("string"), F.floor(F.col(sample) * blocks / top).cast("string")))


def out_of_fold(df: DataFrame, features: list[str], target: str, kind: str, fold: str = "fold", classify: bool = True) -> DataFrame:
    """Predictions of rows by models that never saw their fold.

    Rows are written with their folds first: a fit reads them once for each step, and would repeat the join that deals the folds."""
    return _out_of_fold(written(df, "folds"), features, target, kind, fold, classify)


def _out_of_fold(df: DataFrame, features: list[str], target: str, kind: str, fold: str, classify: bool) -> DataFrame:
    out = None
    for (k,) in df.select(fold).distinct().orderBy(fold).collect():  # a row per fold
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        if classify:
            part = diagnose(test, fit_classifier(train, features, target, kind)).withColumnRenamed("diagnosis", "oof")
        else:
            part = without_bins(fit_regressor(train, features, target, kind).transform(test)).withColumnRenamed("predicted", "oof").drop("_x", "_scaled")
        out = part if out is None else out.unionByName(part)
    return out


def random_folds(df: DataFrame, keys: list[str], folds: int, seed: int = 0) -> DataFrame:
    """fold by row: the leaky split, for contrast with folds by group."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int"))


def compare_models(df: DataFrame, features: list[str], target: str, kinds: list[str], classify: bool = True) -> DataFrame:
    """kind, mean, std over folds of macro F1 or RMSE, best first; reports only, the configured model stays."""
    df = written(df, "folds")
    out = None
    for kind in kinds:
        oof = _out_of_fold(df, features, target, kind, "fold", classify)
        if classify:
            per = None
            for (k,) in df.select("fold").distinct().orderBy("fold").collect():
                one = classification_scores(oof.filter(F.col("fold") == k), target, "oof").select(F.col("macro_f1").alias("score"))
                per = one if per is None else per.unionByName(one)
        else:
            d = F.col("oof") - F.col(target)
            per = oof.groupBy("fold").agg(F.sqrt(F.avg(d * d)).alias("score"))
        row = per.agg(F.lit(kind).alias("kind"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("mean") if classify else F.asc("mean"))


def linear_attribution(df: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """feature, importance: mean absolute contribution to a linear model's prediction."""
    scaler, linear = model.stages[-2], model.stages[-1]
    beta = [float(b) / (float(s) or 1.0) for b, s in zip(linear.coefficients, scaler.std, strict=True)]
    means = df.agg(*(F.avg(f).alias(f) for f in features)).first()
    wide = df.agg(*(F.avg(F.abs(b * (F.col(f) - means[f]))).alias(f) for f, b in zip(features, beta, strict=True)))
    return wide.unpivot([], features, "feature", "importance").orderBy(F.desc("importance"), "feature")


#: Rows of a bucket within which values are dealt to other rows.
BUCKET = 10_000


def permutation_importance(df: DataFrame, predict, features: list[str], keys: list[str], error: Column, seed: int = 0) -> DataFrame:
    """feature, importance: how much the mean error grows when a column is dealt to other rows, over all rows.

    Values change places within hash buckets of about BUCKET rows, so no task ranks all rows."""
    buckets = max(1, df.count() // BUCKET)
    bucket = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(buckets))
    place = lambda f: F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(*keys, F.lit(f), F.lit(seed)), *keys))
    rows = written(df.withColumn("_b", bucket).withColumn("_rn", place("")), "rows")
    base = predict(rows).agg(F.avg(error).alias("e")).first().e
    out = None
    for f in features:
        other = rows.select("_b", F.col(f).alias("_other"), place(f).alias("_rn"))
        moved = rows.drop(f).join(other, ["_b", "_rn"]).withColumnRenamed("_other", f)
        row = predict(moved).agg(F.lit(f).alias("feature"), (F.avg(error) - base).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("importance"), "feature")
