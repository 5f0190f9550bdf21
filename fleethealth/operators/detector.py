"""Multivariate health score: fit, calibration, contributions, alarms."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.columns import trailing
from fleethealth.functions.quantiles import exact_quantiles
from fleethealth.sources.scratch import written

#: From this many sensors on the score is an array expression: a generated sum would be too long a method.
GENERATED_MOST = 30


@dataclass(frozen=True)
class Detector:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    precision: tuple[tuple[float, ...], ...]
    threshold: float = float("inf")


def moments(df: DataFrame, columns: list[str], centre: list[float], by: Column | None = None) -> list:
    """Additive raw moments of centred columns, one row for each value of ``by``."""
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, centre, strict=True)]
    norm = sum(v * v for v in x)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"), F.sum(norm * norm).alias("qq")]
    aggs += [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    aggs += [F.sum(norm * v).alias(f"qs{i}") for i, v in enumerate(x)]
    aggs += [F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
    complete = df.dropna(subset=columns)
    return (complete.groupBy(by.alias("block")) if by is not None else complete.groupBy()).agg(*aggs).collect()  # a row per block


def _arrays(row, p: int) -> dict:
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            cross[i, j] = cross[j, i] = row[f"c{i}_{j}"] or 0.0
    vec = lambda k: np.array([row[f"{k}{i}"] or 0.0 for i in range(p)])
    return {"n": float(row["n"]), "q": row["q"] or 0.0, "qq": row["qq"] or 0.0, "s": vec("s"), "qs": vec("qs"), "c": cross}


def shrunk_fit(m: dict, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and precision by Ledoit-Wolf shrinkage from raw moments (p numbers square, on the driver)."""
    n, mean = m["n"], m["s"] / m["n"]
    cov = m["c"] / n - np.outer(mean, mean)
    cov = (cov + cov.T) / 2
    mm = mean @ mean
    fourth = m["qq"] + 4 * mean @ m["c"] @ mean + n * mm * mm - 4 * mean @ m["qs"] + 2 * mm * m["q"] - 4 * mm * mean @ m["s"]
    mu = np.trace(cov) / p
    delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
    beta = (fourth / n - (cov**2).sum()) / (p * n)
    rho = min(max(beta, 0.0), delta) / delta if delta > 0 else 0.0
    return mean, np.linalg.inv((1 - rho) * cov + rho * mu * np.eye(p))


def _centre(df: DataFrame, columns: list[str]) -> list[float]:
    return [v or 0.0 for v in df.dropna(subset=columns).agg(*(F.avg(c) for c in columns)).first()]


def fit_detector(healthy: DataFrame, columns: list[str]) -> Detector:
    """Mean and precision in two passes: means first, then centred moments."""
    centre = _centre(healthy, columns)
    mean, precision = shrunk_fit(_arrays(moments(healthy, columns, centre)[0], len(columns)), len(columns))
    return Detector(tuple(columns), tuple(mean + centre), tuple(map(tuple, precision)))


def _deviation(d: Detector) -> list[Column]:
    return [F.col(c) - F.lit(float(m)) for c, m in zip(d.columns, d.mean, strict=True)]


def health_score(d: Detector) -> Column:
    """d' P d, as one generated expression or, with many sensors, over arrays."""
    x = _deviation(d)
    p = len(x)
    if p <= GENERATED_MOST:
        return sum(F.lit(float(d.precision[i][j]) * (1 if i == j else 2)) * x[i] * x[j] for i in range(p) for j in range(i, p))
    return F.aggregate(contributions(d), F.lit(0.0), lambda a, c: a + c)


def contributions(d: Detector) -> Column:
    """d_i (P d)_i for each sensor, in order; they add up to the score."""
    x = F.array(*_deviation(d))
    row = lambda i: F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in d.precision[i])), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    return F.array(*(x[i] * row(i) for i in range(len(d.columns))))


def top_sensors(d: Detector, n: int = 3, parts: Column | None = None) -> Column:
    """Map of the n largest shares of the score, three decimals; earlier sensors win ties."""
    parts = contributions(d) if parts is None else parts
    clipped = F.transform(parts, lambda c: F.greatest(c, F.lit(0.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, c: a + c)
    names = F.array(*(F.lit(c) for c in d.columns))
    ranked = F.array_sort(F.transform(clipped, lambda c, i: F.struct((-F.coalesce(F.try_divide(c, total), F.lit(0.0))).alias("share"), i.alias("i"))))
    return F.map_from_entries(F.transform(F.slice(ranked, 1, n), lambda r: F.struct(F.element_at(names, r["i"] + 1), F.bround(-r["share"], 3))))


def quantile_threshold(scored: DataFrame, quantile: float, column: str = "health_score") -> float:
    return exact_quantiles(scored, [column], [quantile])[column][0]


def calibrate_random(healthy: DataFrame, columns: list[str], keys: list[str], quantile: float = 0.99, share: float = 0.3, seed: int = 0) -> Detector:
    """Fit on rows whose hash falls outside the held-out share, threshold from those inside."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    held = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1000)) < int(share * 1000)
    healthy = written(healthy.select(*columns, held.alias("_held")), "healthy")
    held = F.col("_held")
    d = fit_detector(healthy.filter(~held), columns)
    return replace(d, threshold=quantile_threshold(healthy.filter(held).select(health_score(d).alias("health_score")), quantile))


def calibrate_blocked(healthy: DataFrame, columns: list[str], time: str, quantile: float = 0.99, blocks: int = 5) -> Detector:
    """Threshold over contiguous time blocks, each scored by the fit of all others.

    Moments add up over blocks, so the leave-one-out fits come from one pass. Blocks are cut at
    quantiles of time, which needs no global sort of all rows."""
    t = F.col(time).cast("double")
    healthy = written(healthy.select(time, *columns), "healthy")  # read for edges, centres, moments and scores
    edges = exact_quantiles(healthy, [time], [k / blocks for k in range(1, blocks)])[time]
    block = sum((t > e).cast("int") for e in edges)
    centre, p = _centre(healthy, columns), len(columns)
    rows = {r["block"]: _arrays(r, p) for r in moments(healthy, columns, centre, block)}
    total = {k: sum(m[k] for m in rows.values()) for k in next(iter(rows.values()))}
    score = F.lit(None).cast("double")
    for b, m in rows.items():
        rest = {k: total[k] - m[k] for k in total}
        if rest["n"] > p:
            mean, precision = shrunk_fit(rest, p)
            score = F.when(F.col("_block") == b, health_score(Detector(tuple(columns), tuple(mean + centre), tuple(map(tuple, precision))))).otherwise(score)
    threshold = quantile_threshold(healthy.withColumn("_block", block).select(score.alias("health_score")), quantile)
    mean, precision = shrunk_fit(total, p)
    return Detector(tuple(columns), tuple(mean + centre), tuple(map(tuple, precision)), threshold)


def confirm_alarm(df: DataFrame, alarm: str, asset: str, time: str, persistence: int, name: str = "alarm_confirmed") -> DataFrame:
    """True where the alarm has been on for so many consecutive rows of the machine."""
    w = trailing([asset], [time], persistence)
    on = F.min(F.coalesce(F.col(alarm), F.lit(False)).cast("int")).over(w) == 1
    return df.withColumn(name, on & (F.count(F.lit(1)).over(w) == persistence))


def first_alarm(df: DataFrame, confirmed: str, asset: str, time: str) -> DataFrame:
    """alarm_at of each machine: the time at which the alarm is first confirmed, or null."""
    return df.groupBy(asset).agg(F.min(F.when(F.col(confirmed), F.col(time))).alias("alarm_at"))


def score(df: DataFrame, d: Detector, asset: str, time: str, persistence: int = 3, n_top: int = 3) -> DataFrame:
    """health_score, threshold, alarm, top_sensors, alarm_confirmed for every row."""
    out = df.withColumn("health_score", health_score(d)).withColumn("threshold", F.lit(d.threshold))
    out = out.withColumn("alarm", F.col("health_score") > F.col("threshold")).withColumn("top_sensors", top_sensors(d, n_top))
    return confirm_alarm(out, "alarm", asset, time, persistence)


def score_grouped(df: DataFrame, asset: str, fit_score, schema: str) -> DataFrame:
    """Any fitted Python model over each machine's history; only for models without a native form."""
    return df.groupBy(asset).applyInPandas(fit_score, schema)


# --- isolation forest: trees on hash subsamples, fitted in parallel and scored by broadcast ---


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list:
    if depth == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return [len(x)]
    c = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    at = rng.uniform(x[:, c].min(), x[:, c].max())
    left = x[:, c] < at
    return [int(c), float(at), _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1)]


def _mean_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _depths(tree: list, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] = depth + _mean_path(np.array(tree[0]))
        return
    left = x[at, tree[0]] < tree[1]
    _depths(tree[2], x, at[left], depth + 1, out)
    _depths(tree[3], x, at[~left], depth + 1, out)


def forest_samples(complete: DataFrame, columns: list[str], keys: list[str], trees: int, rows: int, seed: int = 0) -> DataFrame:
    """columns, tree, _h: for each tree the rows with the least hashes, about twice ``rows`` of them, so that the least ``rows`` are among them.

    A row is repeated only for the trees that it enters, so what leaves the scan is bounded by trees times rows, however many rows there are."""
    total = max(1, complete.count())
    share = min(1.0, (2.0 * rows + 100) / total)
    most = F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))
    hashed = complete.select(*columns, F.xxhash64(*keys, F.lit(seed)).alias("_h"))
    entered = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64("_h", t) <= most)
    return hashed.select(*columns, "_h", F.explode(entered).alias("tree")).withColumn("_h", F.xxhash64("_h", "tree"))


def fit_isolation_forest(healthy: DataFrame, columns: list[str], keys: list[str], trees: int = 300, rows: int = 256, seed: int = 0) -> list:
    """Trees as nested lists; each is grown by its own task on a hash subsample of ``rows`` rows."""
    import json

    picks = forest_samples(healthy.dropna(subset=columns), columns, keys, trees, rows, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_h").head(rows)[columns].to_numpy(float)
        number = int(pdf["tree"].iloc[0])
        return pd.DataFrame({"tree": [number], "body": [json.dumps(_tree(x, np.random.default_rng([seed, number]), int(np.ceil(np.log2(max(2, len(x)))))))]})

    return [json.loads(r.body) for r in picks.groupBy("tree").applyInPandas(grow, "tree int, body string").orderBy("tree").collect()]  # at most `trees` rows


def score_isolation_forest(df: DataFrame, columns: list[str], trees: list, rows: int = 256) -> DataFrame:
    """``isolation_score``: near 1 for rows that few cuts set apart."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def isolation(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        total, out = np.zeros(len(x)), np.zeros(len(x))
        for t in shared.value:
            _depths(t, x, np.arange(len(x)), 0, out)
            total += out
        return pd.Series(2.0 ** (-total / len(shared.value) / float(_mean_path(np.array(rows)))))

    return df.withColumn("isolation_score", isolation(*(F.col(c).cast("double") for c in columns)))
