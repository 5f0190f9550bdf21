"""Did the alarms and programmes work? Intervals, tests, designs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.functions.columns import Z95, binomial_two_sided, normal_cdf, normal_quantile, t_two_sided, wilson
from fleethealth.sources.scratch import written

DRAWS = 2000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash, the same in every run."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


# --- resampling ---


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


#: Draws that a task works out.
PICKS = 1 << 20


def _picks(numbered: DataFrame, total: int, draws: int, seed: int) -> DataFrame:
    """draw, _at: the cluster that each replicate draws in each of its ``total`` slots, by the first 52 bits of a digest.

    Slots are dealt to tasks by the number of draws: a table of clusters is small, and would be read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [b"%d" % x for x in batch.column(0).to_pylist()]
            for draw in range(1, draws + 1):
                start = f"{seed}|{draw}|".encode()
                bits = np.frombuffer(b"".join([md5(start + x).digest() for x in slots]), ">u8")[::2] >> 12
                at = np.floor(bits.astype(float) / float(1 << 52) * total).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), draw, np.int32)), pa.array(at)], names=["draw", "_at"])

    return numbered.select(F.col("_at").cast("long")).repartition(max(1, -(-total * draws // PICKS))).mapInArrow(run, "draw int, _at long")


def bootstrap_ci(df: DataFrame, cluster: str, value: str, draws: int = DRAWS, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """estimate, clusters, low, high of a mean, resampling whole clusters with replacement.

    Clusters are reduced to sums and counts first. A replicate draws as many clusters as there are, each by a hash
    of the replicate and the draw. Draws are dealt once, to the clusters' sums, and added up by replicate there: nearly every pair of
    replicate and cluster is drawn once or not at all, so counting them first would only shuffle them twice."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = clean.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    numbered = written(running(sums, [cluster], F.lit(1)).withColumn("_at", F.col("_before")).drop("_before"), "clusters")
    point = numbered.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("estimate"), F.count("*").alias("clusters"))
    total = numbered.count()
    rep = _picks(numbered, total, draws, seed).join(numbered.hint("shuffle_hash"), "_at").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))  # draws are streamed, not sorted
    ci = rep.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))  # a row per draw
    return point.join(F.broadcast(ci))  # one row each


#: Clusters whose draws are counted at once.
SPLIT = 1024


def _block_draws(total: int, block: int, split: int, draws: int, seed: int) -> np.ndarray:
    """draws x clusters of a block: how often each is drawn when ``total`` clusters are drawn with replacement from all.

    The number of draws that fall on a range of blocks is split between its halves by binomials, each from a generator
    of the range's own, down to the block, and dealt out evenly there: a task works out its own blocks and no others."""
    low, high = 0, -(-total // split)
    end = lambda b: min(b * split, total)
    count = np.full(draws, total)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([seed, 0, low, high]).binomial(count, (end(mid) - end(low)) / (end(high) - end(low)))
        low, high, count = (low, mid, left) if block < mid else (mid, high, count - left)
    size = end(high) - end(low)
    at = np.random.default_rng([seed, 1, block]).integers(0, size, count.sum())
    return np.bincount(np.repeat(np.arange(draws) * size, count) + at, minlength=draws * size).reshape(draws, size)


def bootstrap_split(df: DataFrame, cluster: str, value: str, draws: int = DRAWS, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """As ``bootstrap_ci``, for very many clusters: no row per cluster and draw is ever made.

    Clusters are numbered. A task counts the draws of its clusters block by block (``_block_draws``) and gives two sums
    a draw, so that tasks x draws numbers are shuffled. Counts depend on the seed and a cluster's number alone, not on
    how rows are dealt to tasks. Without clusters the estimate and its limits are null."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = clean.groupBy(F.col(cluster).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    numbered = written(running(sums, ["c"], F.lit(1)).select(F.col("_before").cast("long").alias("at"), "s", F.col("n").cast("double").alias("n")), "clusters")
    point = numbered.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("estimate"), F.count("*").alias("clusters"))
    total, split = numbered.count(), SPLIT

    def part(batches):
        out, known, counts = np.zeros((2, draws)), None, None
        for pdf in batches:
            for block, rows in pdf.groupby(pdf["at"] // split):
                if block != known:
                    known, counts = block, _block_draws(total, int(block), split, draws, seed)
                out += (counts[:, (rows["at"] - block * split).to_numpy()] @ rows[["s", "n"]].to_numpy()).T
        if known is not None:
            yield pd.DataFrame({"draw": np.arange(1, draws + 1), "s": out[0], "n": out[1]})

    rep = numbered.mapInPandas(part, "draw long, s double, n double").groupBy("draw").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    ci = rep.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))  # a row per draw
    return point.join(F.broadcast(ci))  # one row each


#: Draws that one digest gives signs for: its bits.
SIGNS = 128


def paired_permutation(diffs: DataFrame, diff: str, key: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """mean, p: sign-flip test of paired differences, (1 + extreme) / (draws + 1).

    A digest of the key and a block number gives the signs of 128 draws, which are summed side by side: a row is
    repeated once a block, not once a draw."""
    d = diffs.filter(F.col(diff).isNotNull()).select(F.col(diff).cast("double").alias("x"), F.col(key).alias("k"))
    blocks = -(-draws // SIGNS)
    flips = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    flips = flips.withColumn("h", _digest(F.lit(seed), F.col("k"), F.col("block")))
    words = [F.conv(F.substring("h", 8 * w + 1, 8), 16, 10).cast("long") for w in range(4)]
    flips = flips.select("x", "block", *(w.alias(f"w{i}") for i, w in enumerate(words)))
    sums = flips.groupBy("block").agg(F.count("*").alias("n"), *(F.sum(F.when(F.shiftright(F.col(f"w{b // 32}"), b % 32).bitwiseAND(1) == 1, F.col("x")).otherwise(-F.col("x"))).alias(f"s{b}") for b in range(SIGNS)))
    means = sums.select("block", F.posexplode(F.array(*(F.col(f"s{b}") / F.col("n") for b in range(SIGNS)))).alias("b", "m")).filter(F.col("block") * SIGNS + F.col("b") < draws)
    seen = d.agg(F.avg("x").alias("mean"))
    j = means.join(F.broadcast(seen))  # one row
    return j.groupBy("mean").agg(((1 + F.sum((F.abs("m") >= F.abs("mean") - 1e-12).cast("int"))) / (draws + 1)).alias("p"))


def randomization_inference(panel: DataFrame, unit: str, period: str, outcome: str, start: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """effect, p: the two-way effect under start periods dealt to units anew.

    A draw permutes starts over units by hash order, so each draw keeps the waves' sizes. Panels may have holes; a draw in
    which the treatment doesn't vary beside the effects counts as not extreme."""
    starts = panel.select(unit, start).distinct()
    slots = starts.withColumn("_slot", F.row_number().over(Window.orderBy(unit))).select("_slot", F.col(start).alias("_start"))  # a row per unit
    dealt = starts.select(unit).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    dealt = dealt.withColumn("_slot", F.row_number().over(Window.partitionBy("draw").orderBy(_digest(F.lit(seed), F.col(unit), F.col("draw")), unit)))
    dealt = dealt.join(slots, "_slot").drop("_slot")
    drawn = panel.select(unit, period, outcome).join(dealt, unit).withColumn("_d", F.coalesce(F.col(period) >= F.col("_start"), F.lit(False)).cast("double"))
    both = drawn.unionByName(panel.select(unit, period, outcome, F.lit(0).alias("draw"), F.col(start).alias("_start"), F.coalesce(F.col(period) >= F.col(start), F.lit(False)).cast("double").alias("_d")))
    cells, keys = _cells(both, unit, period, {"y": F.col(outcome), "d": F.col("_d")}, ["draw"])
    slopes = written(_twfe_slopes(cells, len(keys), ["draw"]), "slopes")
    null, own = slopes.filter("draw > 0"), slopes.filter("draw = 0").select(F.col("beta").alias("effect"))
    j = null.join(F.broadcast(own))
    return j.groupBy("effect").agg(((1 + F.sum((F.abs("beta") >= F.abs("effect")).cast("int"))) / (draws + 1)).alias("p"))


# --- closed form ---


def wilson_ci(df: DataFrame, hits: str, total: str) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(total))
    return df.withColumn("ci_low", low).withColumn("ci_high", high)


def mcnemar_exact(df: DataFrame, a: str, b: str) -> DataFrame:
    """a_only, b_only, p of paired yes/no outcomes."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    g = df.agg(F.coalesce(F.sum((x & ~y).cast("int")), F.lit(0)).alias("a_only"), F.coalesce(F.sum((~x & y).cast("int")), F.lit(0)).alias("b_only"))
    return g.withColumn("p", binomial_two_sided(F.col("a_only"), F.col("a_only") + F.col("b_only")))


def running(df: DataFrame, order: list[str], amount: Column) -> DataFrame:
    """``df`` with ``_before``: the sum of ``amount`` over all rows that come earlier in the order.

    Rows are dealt out by ranges of the order; a window runs within each range, and the ranges' totals, one number a
    task, are added up before it. No task sees all rows."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_amount", amount), "ranges")
    totals = ranged.groupBy("_range").agg(F.sum("_amount").alias("_t"))
    first = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_base")  # a row per task
    inner = F.sum("_amount").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(first), "_range").withColumn("_before", F.col("_base") + F.coalesce(inner, F.lit(0))).drop("_range", "_base", "_amount")


def _mid_ranks(df: DataFrame, value: str, weights: dict[str, Column]) -> DataFrame:
    """A row per distinct value: its mid-rank, its count and the named sums."""
    g = df.groupBy(value).agg(F.count("*").alias("t"), *(F.sum(c).alias(k) for k, c in weights.items()))
    return running(g, [value], F.col("t")).withColumn("rank", F.col("_before") + (F.col("t") + 1) / 2)


def wilcoxon_paired(df: DataFrame, diff: str) -> DataFrame:
    """n, w_plus, z, p: signed ranks, zeros split evenly, normal approximation with ties."""
    d = df.filter(F.col(diff).isNotNull()).select(F.abs(diff).alias("a"), F.signum(diff).alias("s"))
    r = _mid_ranks(d, "a", {"plus": F.when(F.col("s") > 0, 1.0).when(F.col("s") == 0, 0.5).otherwise(0.0)})
    z0 = F.sum(F.when(F.col("a") == 0, F.col("t")).otherwise(0))
    ties = F.sum(F.when(F.col("a") != 0, F.col("t") * F.col("t") * F.col("t") - F.col("t")).otherwise(0)).cast("double")
    g = r.agg(F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), z0.alias("z0"), ties.alias("ties"))
    n, k = F.col("n").cast("double"), F.col("z0").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.col("w_plus") - mean, F.sqrt(F.greatest(var, F.lit(0.0))))
    return g.select("n", "w_plus", z.alias("z"), F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


def mann_whitney_auc(df: DataFrame, group: str, value: str) -> DataFrame:
    """n_x, n_y, auc, z, p: how often a value of the true group exceeds one of the other."""
    d = df.filter(F.col(value).isNotNull())
    g = F.col(group).cast("boolean")
    r = _mid_ranks(d, value, {"x": F.when(g, 1.0).otherwise(0.0)})
    s = r.agg(F.sum("x").alias("n_x"), F.sum(F.col("t") - F.col("x")).alias("n_y"), F.sum(F.col("x") * F.col("rank")).alias("rs"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    nx, ny = F.col("n_x"), F.col("n_y")
    n = nx + ny
    u = F.col("rs") - nx * (nx + 1) / 2
    var = nx * ny / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(u - nx * ny / 2, F.sqrt(F.greatest(var, F.lit(0.0))))
    return s.select("n_x", "n_y", F.try_divide(u, nx * ny).alias("auc"), z.alias("z"), F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


def n_per_arm_proportions(df: DataFrame, p1: str, p2: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """n_per_arm to tell two shares apart."""
    a, b = F.col(p1), F.col(p2)
    m = (a + b) / 2
    za, zb = normal_quantile(F.lit(1 - alpha / 2)), normal_quantile(F.lit(power))
    root = za * F.sqrt(2 * m * (1 - m)) + zb * F.sqrt(a * (1 - a) + b * (1 - b))
    return df.withColumn("n_per_arm", F.ceil(F.try_divide(root * root, (a - b) * (a - b))))


def exposure_poisson(df: DataFrame, rate1: str, rate2: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """exposure per arm to tell two event rates apart, by a Wald test of the logarithm of their ratio."""
    a, b = F.col(rate1), F.col(rate2)
    z = normal_quantile(F.lit(1 - alpha / 2)) + normal_quantile(F.lit(power))
    gap = F.ln(F.try_divide(b, a))
    return df.withColumn("exposure", F.try_divide(z * z * (F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)), gap * gap))


def cuped(df: DataFrame, y: str, pre: str, by: list[str] = ()) -> DataFrame:
    """y_adjusted: y less what its pre-period value explains."""
    stats = df.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_samp(y, pre), F.var_samp(pre)), F.lit(0.0)).alias("_theta"), F.avg(pre).alias("_mean"))
    j = df.join(stats, list(by)) if by else df.join(F.broadcast(stats))
    return j.withColumn("y_adjusted", F.col(y) - F.col("_theta") * (F.col(pre) - F.col("_mean"))).drop("_theta", "_mean")


#: Rounds of a fit of effects, at most; one that hasn't settled by then is an error.
MOST_ROUNDS = 400
#: Periods of a panel, at most: a fit keeps a number or two for each on the driver.
MOST_PERIODS = 100_000


class NotSettledError(ArithmeticError):
    """Effects that still move after MOST_ROUNDS rounds, or run away."""


def _settled(step, start: np.ndarray, tolerance: float = 1e-11, memory: int = 8) -> np.ndarray:
    """The fixed point of ``step``, with the last few moves mixed so that the next is least (Anderson's scheme)."""
    x, held = start, []
    for _ in range(MOST_ROUNDS):
        to = step(x)
        move = to - x
        if not np.isfinite(to).all() or np.abs(to).max(initial=0) > 1e12:
            raise NotSettledError("the effects run away")
        if np.abs(move).max(initial=0) <= tolerance * max(1.0, np.abs(to).max(initial=0)):
            return to
        held = [*held, (to, move)][-memory:]
        if len(held) > 1:
            tos, moves = (np.stack([h[k] for h in held]) for k in (0, 1))
            mix = np.linalg.lstsq(np.diff(moves, axis=0).T, move, rcond=1e-12)[0]
            to = to - np.diff(tos, axis=0).T @ mix
        x = to
    raise NotSettledError(f"the effects still move after {MOST_ROUNDS} rounds")


def _cells(df: DataFrame, unit: str, period: str, columns: dict[str, Column], by: list[str] = ()) -> tuple[DataFrame, list]:
    """(by, u, p, columns) as a written table, without rows that lack a value; and the (by, period) that each p numbers."""
    rows = df.select(*by, F.col(unit).alias("u"), F.col(period).alias("_t"), *(c.cast("double").alias(k) for k, c in columns.items())).dropna(subset=["u", "_t", *columns])
    keys = sorted(map(tuple, rows.select(*by, "_t").distinct().limit(MOST_PERIODS + 1).collect()))
    if len(keys) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    kinds = dict(rows.dtypes)
    numbers = df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, "_t")), "p int"]))
    return written(rows.join(F.broadcast(numbers), [*by, "_t"]).drop("_t"), "panel"), keys  # a row per period


def _by_period(cells: DataFrame, values: np.ndarray, names: list[str]) -> DataFrame:
    """``cells`` with named values of their periods."""
    numbers = cells.sparkSession.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ", ".join(["p int", *(f"{n} double" for n in names)]))
    return cells.join(F.broadcast(numbers), "p")  # a row per period


def _of_units(rows: DataFrame, unit: list[str], aggregates: list[Column]) -> DataFrame:
    """``rows`` with aggregates of their unit. The aggregates are written first, so that a unit with very many rows can be split."""
    return rows.join(written(rows.groupBy(*unit).agg(*aggregates), "units"), unit)


def _projected(cells: DataFrame, columns: list[str], periods: int, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """``cells`` with ``_c`` for each column c: what is left of it when unit and period effects are taken out, by weighted least squares.

    Period effects are the fixed point of taking out unit means, then period means; a round is two pre-aggregated sums, and only
    a number per period and column comes to the driver. Exact for panels with holes and repeated cells."""
    w = F.lit(1.0) if weight is None else weight
    unit, held = [*by, "u"], [f"_p_{c}" for c in columns]
    scale = cells.agg(*(F.sqrt(F.avg(F.col(c) * F.col(c))) for c in columns)).first()
    scale = np.array([s or 1.0 for s in scale])

    def without_units(values: np.ndarray) -> DataFrame:
        rows = _by_period(cells, values.reshape(periods, -1) * scale, held)
        return _of_units(rows, unit, [(F.sum(w * (F.col(c) - F.col(h))) / F.sum(w)).alias(f"_u_{c}") for c, h in zip(columns, held, strict=True)])

    def step(values: np.ndarray) -> np.ndarray:
        sums = without_units(values).groupBy("p").agg(*(F.sum(w * (F.col(c) - F.col(f"_u_{c}"))) / F.sum(w) for c in columns)).collect()  # a row per period
        out = np.zeros((periods, len(columns)))
        for r in sums:
            out[r[0]] = np.array(r[1:], float) / scale
        return out.ravel()

    rows = without_units(_settled(step, np.zeros(periods * len(columns))))
    return rows.select(*cells.columns, *((F.col(c) - F.col(h) - F.col(f"_u_{c}")).alias(f"_{c}") for c, h in zip(columns, held, strict=True)))


def _twfe_slopes(cells: DataFrame, periods: int, by: list[str]) -> DataFrame:
    """by, beta: least squares of y on d with unit and period effects, for each ``by`` group."""
    sums = _projected(cells, ["y", "d"], periods, by).groupBy(*by).agg(F.sum(F.col("_y") * F.col("_d")).alias("top"), F.sum(F.col("_d") * F.col("_d")).alias("low"))
    return sums.select(*by, F.when(F.col("low") > 1e-9, F.col("top") / F.col("low")).alias("beta"))


def did_twfe(panel: DataFrame, outcome: str, treated: str, unit: str, period: str, dof: bool = False) -> DataFrame:
    """effect, se, ci_low, ci_high, p, units: two-way fixed effects, errors clustered by unit.

    Panels may have holes: effects are projected out by rounds until they settle, which equals least squares with a dummy
    for each unit and period. Rows without an outcome or treatment are left out. Small-sample factor G / (G - 1), with
    ``dof`` also (n - 1) / (n - k) for k effects; reference distribution normal. Null where the treatment doesn't vary beside the effects."""
    cells, keys = _cells(panel, unit, period, {"y": F.col(outcome), "d": F.col(treated)})
    d = written(_projected(cells, ["y", "d"], len(keys)), "demeaned")
    beta = d.agg(F.sum(F.col("_d") * F.col("_d")).alias("dd"), F.sum(F.col("_y") * F.col("_d")).alias("yd"), F.count("*").alias("n")).filter("dd > 1e-9").select((F.col("yd") / F.col("dd")).alias("effect"), "dd", "n")
    scores = d.join(F.broadcast(beta)).groupBy("u").agg(F.sum(F.col("_d") * (F.col("_y") - F.col("effect") * F.col("_d"))).alias("g"))  # one row
    meat = scores.agg(F.sum(F.col("g") * F.col("g")).alias("meat"), F.count("*").alias("units"))
    j = meat.join(F.broadcast(beta), how="left")
    factor = F.col("units") / (F.col("units") - 1) * (((F.col("n") - 1) / (F.col("n") - F.col("units") - len(keys))) if dof else 1)
    out = j.select("effect", (F.sqrt(F.col("meat") * factor) / F.col("dd")).alias("se"), "units")
    return out.select("effect", "se", (F.col("effect") - Z95 * F.col("se")).alias("ci_low"), (F.col("effect") + Z95 * F.col("se")).alias("ci_high"), (2 * (1 - normal_cdf(F.abs(F.try_divide(F.col("effect"), F.col("se")))))).alias("p"), "units")


def poisson_twfe(panel: DataFrame, outcome: str, treated: str, unit: str, period: str, dof: bool = False) -> DataFrame:
    """rate_ratio, ci_low, ci_high, p of event counts with unit and period effects, errors clustered by unit.

    Unit effects are concentrated out of the likelihood: given period effects and the treatment's, a unit's is its events over
    its expected ones. Period effects follow from the periods' events in the same way, and the treatment's from its score; rounds
    go on until all stand still, each of two pre-aggregated sums, so units may be any number. The error comes from the
    treatment less its projection on the effects, weighted by expected counts, which takes rounds of its own. Units and periods
    without events tell nothing and are left out. Null with p = 1 if no unit has events, if the treatment doesn't vary beside the effects, or if
    its effect has no bound (all events on one side)."""
    spark = panel.sparkSession
    none = spark.createDataFrame([(None, None, None, 1.0)], "rate_ratio double, ci_low double, ci_high double, p double")
    rows = panel.select(F.col(unit).alias("u"), F.col(period).alias("t"), F.col(outcome).cast("double").alias("y"), F.col(treated).cast("double").alias("d")).dropna()
    for key in ("u", "t"):
        rows = rows.join(written(rows.groupBy(key).agg(F.sum("y").alias("_s")).filter("_s > 0").select(key), "live"), key, "left_semi")
    cells, keys = _cells(rows, "u", "t", {"y": F.col("y"), "d": F.col("d")})
    if not keys or (_projected(cells, ["d"], len(keys)).agg(F.sum(F.col("_d") * F.col("_d"))).first()[0] or 0) < 1e-9:
        return none
    events = {r.p: r.y for r in cells.groupBy("p").agg(F.sum("y").alias("y")).collect()}  # a row per period
    events = np.array([events[i] for i in range(len(keys))])

    def expected(x: np.ndarray) -> DataFrame:
        """Cells with their expected counts ``mu``, and the mean of d in their unit, ``_du``."""
        m = F.exp(F.col("_b") + F.lit(float(x[-1])) * F.col("d"))
        each = _by_period(cells, x[:-1, None], ["_b"]).withColumn("_m", m)
        known = _of_units(each, ["u"], [F.sum("_m").alias("_s"), F.sum("y").alias("_y"), (F.sum(F.col("_m") * F.col("d")) / F.sum("_m")).alias("_du")])
        return known.withColumn("mu", F.col("_m") * F.col("_y") / F.col("_s"))

    def step(x: np.ndarray) -> np.ndarray:
        if abs(x[-1]) > 25:
            raise NotSettledError("the treatment's effect has no bound")
        d, mu = F.col("d"), F.col("mu")
        sums = expected(x).groupBy("p").agg(F.sum(mu), F.sum(d * (F.col("y") - mu)), F.sum(mu * d * (d - F.col("_du")))).collect()  # a row per period
        got = np.array([r[1:] for r in sorted(sums)], float)
        b = x[:-1] + np.log(events / got[:, 0])
        return np.append(b - b.mean(), x[-1] + np.clip(got[:, 1].sum() / max(got[:, 2].sum(), 1e-12), -1, 1))

    try:
        x = _settled(step, np.zeros(len(keys) + 1), 1e-10)
    except NotSettledError:
        return none
    fitted = written(expected(x).select("u", "p", "y", "d", "mu"), "fitted")
    part = _projected(fitted, ["d"], len(keys), weight=F.col("mu"))
    by_unit = part.groupBy("u").agg(F.sum(F.col("_d") * (F.col("y") - F.col("mu"))).alias("g"), F.sum(F.col("mu") * F.col("_d") * F.col("_d")).alias("b"), F.count("*").alias("n"))
    sums = by_unit.agg(F.sum("b").alias("bread"), F.sum(F.col("g") * F.col("g")).alias("meat"), F.count("*").alias("units"), F.sum("n").alias("n")).first()
    if not sums.bread or not sums.meat:
        return none
    factor = sums.units / (sums.units - 1) * (sums.n - 1) / (sums.n - sums.units - len(keys)) if dof else 1.0
    b, se = F.col("b"), F.col("se")
    one = spark.createDataFrame([(float(x[-1]), math.sqrt(sums.meat * factor) / sums.bread)], "b double, se double")
    return one.select(F.exp(b).alias("rate_ratio"), F.exp(b - Z95 * se).alias("ci_low"), F.exp(b + Z95 * se).alias("ci_high"), (2 * (1 - normal_cdf(F.abs(b / se)))).alias("p"))


def parallel_ab(panel: DataFrame, unit: str, arm: str, outcome: str, post: str) -> DataFrame:
    """difference, ratio, z, p: unit means after the start, adjusted by those before, compared by Welch's test.

    The reference is Student's t with Welch's degrees of freedom, so few units are right too; p is null where an arm
    has less than two units or neither arm varies."""
    means = panel.groupBy(unit, arm).agg(F.avg(F.when(F.col(post), F.col(outcome))).alias("y"), F.avg(F.when(~F.col(post), F.col(outcome))).alias("pre"))
    adj = cuped(means.dropna(subset=["y", "pre"]), "y", "pre")
    on = F.col(arm).cast("boolean")
    v = F.col("y_adjusted")
    pick = lambda f, c: f(F.when(c, v))
    g = adj.agg(pick(F.avg, on).alias("m1"), pick(F.avg, ~on).alias("m0"), pick(F.var_samp, on).alias("v1"), pick(F.var_samp, ~on).alias("v0"), F.sum(on.cast("int")).alias("n1"), F.sum((~on).cast("int")).alias("n0"))
    z = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(F.try_divide("v1", "n1") + F.try_divide("v0", "n0")))
    e1, e0 = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    dof = F.try_divide((e1 + e0) * (e1 + e0), F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e0 * e0, F.col("n0") - 1))
    g = g.select("*", z.alias("z"), dof.alias("dof"))
    return g.select((F.col("m1") - F.col("m0")).alias("difference"), F.try_divide(F.col("m1"), F.col("m0")).alias("ratio"), "z", t_two_sided(F.col("z"), F.col("dof")).alias("p"))


def wave_assignment(units: DataFrame, unit: str, waves: int, first: int, last: int, seed: int = 0) -> DataFrame:
    """wave (from 0) and start of each unit: equal waves in hash order, starts evenly spaced."""
    rn = F.row_number().over(Window.orderBy(F.xxhash64(unit, F.lit(seed)), unit)) - 1  # a row per unit
    step = (last - first) / max(1, waves - 1)
    return units.withColumn("wave", rn % waves).withColumn("start", F.bround(first + F.col("wave") * step).cast("int"))


def compare_alarms(df: DataFrame, methods: list[str], reference: str, positive: str, cluster: str, draws: int = 500, seed: int = 0, resample=bootstrap_ci) -> DataFrame:
    """method, detection, false alarms with cluster intervals, and p of the paired test with the reference.

    ``resample`` is ``bootstrap_split`` where clusters are very many."""
    out = None
    for m in methods:
        hit = df.withColumn("_v", F.col(m).cast("double"))
        det = resample(hit.filter(F.col(positive)), cluster, "_v", draws, seed=seed).select(F.col("estimate").alias("detection"), F.col("low").alias("detection_low"), F.col("high").alias("detection_high"))
        fa = resample(hit.filter(~F.col(positive)), cluster, "_v", draws, seed=seed).select(F.col("estimate").alias("false_alarm"), F.col("low").alias("false_alarm_low"), F.col("high").alias("false_alarm_high"))
        diffs = df.filter(F.col(positive)).groupBy(cluster).agg(F.avg(F.col(m).cast("double") - F.col(reference).cast("double")).alias("_d"))
        p = paired_permutation(diffs, "_d", cluster, draws, seed).select("p")
        row = det.join(fa).join(p).select(F.lit(m).alias("method"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def warning_uncertainty(table: DataFrame, asset: str, warned_a: str, warned_b: str, lead_a: str, lead_b: str, draws: int = 500, resample=bootstrap_ci) -> DataFrame:
    """warned share with interval, and p of McNemar's and Wilcoxon's tests against another method."""
    ci = resample(table.withColumn("_v", F.col(warned_a).cast("double")), asset, "_v", draws).select(F.col("estimate").alias("warned"), "low", "high")
    mc = mcnemar_exact(table, warned_a, warned_b).select(F.col("p").alias("p_warned"))
    wx = wilcoxon_paired(table.withColumn("_d", F.coalesce(F.col(lead_a).cast("double"), F.lit(0.0)) - F.coalesce(F.col(lead_b).cast("double"), F.lit(0.0))), "_d").select(F.col("p").alias("p_lead"))
    return ci.join(mc).join(wx)  # one row each


def before_after_ratio(df: DataFrame, outcome: str, post: str) -> DataFrame:
    """ratio of means after and before."""
    return df.agg(F.try_divide(F.avg(F.when(F.col(post), F.col(outcome))), F.avg(F.when(~F.col(post), F.col(outcome)))).alias("ratio"))


def rate_ratio(df: DataFrame, events: str, exposure: str, by: str) -> DataFrame:
    """Events per unit of exposure by group."""
    return df.groupBy(by).agg(F.try_divide(F.sum(F.col(events).cast("double")), F.sum(exposure)).alias("rate"))


def smallest_design(power: DataFrame, by: list[str], least: float = 0.8) -> DataFrame:
    """The smallest number of ships times months that reaches the power, per outcome and design."""
    w = Window.partitionBy(*by).orderBy(F.col("ships") * F.col("months"), "months")
    return power.filter(F.col("power") >= least).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
