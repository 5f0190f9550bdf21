"""Mixing sources to target weights by Poisson replication.

Method. A source's repetition rate is its target share over its present share. A document's
count of copies is a Poisson number with that mean, found by inverting the distribution at a
uniform number that a hash of the document and a seed gives, so a rerun repeats it. Documents
are exploded by their counts, and the copies are shuffled by a hash of document and copy number.

Defined results: a null source is a source of its own; rows that share id, source and text get
the same count; a source with target weight 0 is left out; very long texts are passed on whole; an empty table
gives no rows; all other columns are passed on, whatever their names, but for input columns named n_copies, copy
or shuffle_key, which the operator's own replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import own_columns, written

#: Target shares follow the present shares to this power, unless weights are given.
TEMPERATURE = 0.7
SEED = 20
#: Sources whose rates are sent to every task, at most.
SENT = 10_000
#: Largest mean that one inversion takes; larger rates are sums of several.
MEAN = 16


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in every engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def poisson(mean: Column, u: Column) -> Column:
    """Smallest k whose cumulative probability is at least u, for means up to MEAN."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda a, i: F.when(a["c"] >= u, a).otherwise(F.struct((a["p"] * mean / i).alias("p"), (a["c"] + a["p"] * mean / i).alias("c"), (a["k"] + 1).alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 16).cast("int")), start, step)["k"]


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source_key, rate: the mean number of copies, so that shares meet the targets at the same total."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        wanted = sizes.withColumn("w", F.round(F.pow("n", F.lit(temperature)), 6))
    else:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.lit(None).cast("map<string,double>")
        wanted = sizes.withColumn("w", F.coalesce(F.try_element_at(given, F.col("source_key")), F.lit(0.0)))
    total = wanted.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))  # one row
    return wanted.join(F.broadcast(total)).select("source_key", F.coalesce(F.try_divide(F.col("w") * F.col("sum_n"), F.col("sum_w") * F.col("n")), F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The copies: all columns of ``docs``, n_copies, copy (from 0) and shuffle_key, in shuffled order."""
    key = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rates = written(repetition_rates(docs, weights, temperature), "rates")
    if rates.count() <= SENT:
        rates = F.broadcast(rates)  # a few thousand pairs, counted; beyond that an equi-join whose hot keys are split
    # the documents' own columns travel in one struct, so that no name can clash
    passed = [x for c, x in zip(docs.columns, own_columns(docs), strict=True) if c not in ("n_copies", "copy", "shuffle_key")]
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*passed).alias("row"), key.alias("source_key"), who.alias("who")).join(rates, "source_key")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN).cast("int"))
    of_part = lambda i: poisson(F.col("rate") / parts, uniform(F.lit(str(seed)), F.col("who"), i.cast("string")))
    rows = rows.withColumn("n_copies", F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + of_part(i))).otherwise(0))
    copies = rows.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    copies = copies.select("row", "n_copies", "copy", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), "who", "copy")).alias("shuffle_key"))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", "n_copies", "copy", "shuffle_key")


SQL = f"""
WITH sizes AS (SELECT coalesce(source, '') AS k, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
wanted AS (SELECT k, n, round(pow(n, {TEMPERATURE}), 6) AS w FROM sizes),
rates AS (SELECT k, w * sum(n) OVER () / (sum(w) OVER () * n) AS rate FROM wanted),
numbers AS (SELECT d.*, rate, (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), '1')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
            FROM documents d JOIN rates r ON coalesce(d.source, '') = r.k),
steps AS (SELECT k, rate, i, sum(CASE WHEN i = 0 THEN exp(-rate) ELSE exp(-rate + i * ln(rate) - lgamma(i + 1)) END) OVER (PARTITION BY k ORDER BY i) AS c
          FROM rates, generate_series(0, 90) AS g(i)),
counted AS (SELECT n.*, (SELECT min(i) FROM steps s WHERE s.k = coalesce(n.source, '') AND s.c >= u) AS n_copies FROM numbers n)
SELECT doc_id, text, lang, source, n_chars, n_copies::INTEGER AS n_copies, c::INTEGER AS copy, md5(concat_ws('|', '{SEED}s', coalesce(doc_id::VARCHAR, ''), c::VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(generate_series(0, n_copies - 1)) AS c FROM counted WHERE n_copies > 0)
"""
