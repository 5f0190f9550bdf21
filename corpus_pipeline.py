"""A corpus clean-up in five stages, each written as Parquet and read again by the next.

Order: quality rules and toxicity drop documents, the similarity join keeps one document of each
group of near copies, mixing replicates documents towards target source shares, packing places
them in training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleethealth.llm import mixing, ngram_join, packing, quality_rules, toxicity
from fleethealth.llm.common import own_columns, table, written
from fleethealth.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule stay; null and empty texts go, repeated rows fare alike, very long texts are read whole."""
    return quality_rules.kept_rows(docs).select(own_columns(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents stay, by a model fitted on labelled rows of the documents that are left. Null texts are clean;
    without labels of both kinds all stay; repeated rows fare alike."""
    return toxicity.clean_rows(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))).select(own_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, and of several rows with that id the least by text, then by its JSON form.

    Rows without an id stay; a document without words is linked with no other id."""
    found = ngram_join.ngram_jaccard_components(docs, width=5, percent=80)
    others = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(others, "doc_id", "left_anti").select(own_columns(docs))
    several = written(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids")
    if several.isEmpty():
        return kept
    row = F.struct(*own_columns(docs))
    least = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")
    return kept.join(several, "doc_id", "left_anti").select(own_columns(docs)).unionByName(least)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their sources' rates; a null source is a source of its own."""
    return mixing.poisson_mix(docs).select(own_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's token pieces with their places; null texts give their end token alone. Workers outlive the stage, so they don't keep its words."""
    return packing.pack_documents(docs, tokenizer_path(), keep_words=False)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("ngram_jaccard_join", near_copies), ("source_mixing", mix), ("best_fit_packing", pack)]
#: Model fitting, similarity groups and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
