"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleethealth.llm import byte_language, chat_format, filter_audit, html_wrappers, license_scan, matroska, mixing, ngram_join, packing, quality_rules, ranked_search, toxicity, warc
from fleethealth.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.format_preferences(chat_format.swapped_answers(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: chat_format.span_text(c) for c in ("chosen_spans", "rejected_spans")})


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_column(matroska.encode_column(table(spark, sf_dir, "documents")))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(warc.decide(table(spark, sf_dir, "pages"))), with_payload=False)
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to_id").alias("refers_to"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES[-1])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "sole_rule", "policy")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of op9: documents that fail it, and documents that the newest policy would keep without it."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES[-1])


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.with_labels(filter_audit.failure_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def op12_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_language.predict_language(docs, byte_language.fit_language(docs))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_chat_formatting, op2_best_fit_packing, op3_toxicity, op4_media_columns, op5_license_scans, op6_warc, op7_source_mixing, op8_ngram_jaccard_join, op9_quality_rules, rule_ablations, op10_html_extraction, op11_filter_audit, op12_byte_language, op13_ranked_search)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 7], chr(1)) AS g, len(words) AS n FROM d, unnest(generate_series(1, len(words) - 7)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, generate_series(0, 7) AS o(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_marks
  FROM d LEFT JOIN v ON v.doc_id = d.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_marks > 60 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed,
  CASE WHEN bit_count(failed) = 1 THEN failed ELSE 0 END::BIGINT AS sole_rule, 2 AS policy
FROM f
"""


_RULES = ", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(quality_rules.RULES))
ABLATIONS_SQL = f"""WITH f AS ({OP9_SQL}), r(rule, bit) AS (VALUES {_RULES})
SELECT rule, sum((failed & bit <> 0)::INT)::BIGINT AS failed, sum((failed & (127 - bit) = 0)::INT)::BIGINT AS kept_without, bit_or(failed)::BIGINT AS seen_bits FROM f, r GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    return {"rule_ablations": ABLATIONS_SQL, "op1_chat_formatting": chat_format.SQL, "op6_warc": OP6_SQL, "op7_source_mixing": mixing.SQL, "op9_quality_rules": OP9_SQL, "op11_filter_audit": filter_audit.SQL, "op13_ranked_search": ranked_search.SQL}
