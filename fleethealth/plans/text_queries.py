"""Reports, retrieval, answers and triage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleethealth.operators import retrieval, text
from fleethealth.plans.registry import query, rounded, table
from fleethealth.sources.scratch import written

TAG_SQL = text.TAG.replace("\\w.\\-", "a-zA-Z0-9_.-").replace("\\d", "[0-9]")
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '{text.TOKEN}'), lambda w: NOT list_contains({STOP}, w) AND length(w) > 1)"


def passages(spark, d):
    """Documents as one passage each, with a tag as its id."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"), F.lit("#000")).alias("chunk_id"), "text", "source", "lang")


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


@query("SELECT doc_id, md5(replace(replace(replace(translate(text, '’–—', '''--'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')) AS digest FROM documents")
def g1_normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalise_text(F.col("text"))).alias("digest"))


@query(r"""WITH h AS (SELECT doc_id, 'Accident Type ' || lang || '/' || source || ' No. 7' || chr(10) || 'On March ' || (1 + doc_id % 28) || ', 2021 the ship' AS t FROM documents)
SELECT doc_id, regexp_extract(t, 'Type ([a-z/]+)', 1) AS casualty_type, '2021-03-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') AS date FROM (SELECT doc_id, regexp_replace(t, '[0-9]+ No', ' No') AS t FROM h)""")
def g2_extract_metadata(spark, d):
    h = F.concat(F.lit("Accident Type "), F.col("lang"), F.lit("/"), F.regexp_replace("source", "[0-9]", ""), F.lit(" No. 7\nOn March "), (1 + F.col("doc_id") % 28).cast("string"), F.lit(", 2021 the ship"))
    return table(spark, d, "documents").select("doc_id", text.extract_metadata(h).alias("m")).select("doc_id", "m.casualty_type", "m.date")


@query(f"""WITH e AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' blackout blackout loss of steering' WHEN doc_id % 3 = 1 THEN ' blackout' ELSE '' END AS t, CASE WHEN doc_id % 7 = 0 THEN 'Fire' ELSE '' END AS c, CASE WHEN doc_id % 2 = 0 THEN 'engine trouble' ELSE 'dinner' END AS title FROM documents)
SELECT doc_id, regexp_matches(c, '{text.MACHINERY_TYPES}') OR len(regexp_extract_all(t, '{text.STRONG_TERMS}')) >= 3 OR (regexp_matches(title, '{text.MACHINERY_TITLE}') AND len(regexp_extract_all(t, '{text.STRONG_TERMS}')) >= 1) AS machinery FROM e""")
def g3_is_machinery(spark, d):
    m3 = F.col("doc_id") % 3
    body = F.concat("text", F.when(m3 == 0, " blackout blackout loss of steering").when(m3 == 1, " blackout").otherwise(""))
    kind = F.when(F.col("doc_id") % 7 == 0, "Fire").otherwise("")
    title = F.when(F.col("doc_id") % 2 == 0, "engine trouble").otherwise("dinner")
    return table(spark, d, "documents").select("doc_id", text.is_machinery(kind, title, body).alias("machinery"))


@query()
def g4_chunk_documents(spark, d):
    return text.chunk_documents(table(spark, d, "documents")).select("doc_id", "chunk_id", "section", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query(f"SELECT doc_id, len({tokens_sql('text')})::INTEGER AS n, md5(coalesce(array_to_string({tokens_sql('text')}, ' '), '')) AS digest FROM documents")
def g5_tokenize(spark, d):
    t = text.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


BM = f"""tk AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents), sz AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tk), po AS (SELECT doc_id, len(w) AS l, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM tk) GROUP BY doc_id, len(w), term),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM po, sz GROUP BY term, n), mn AS (SELECT avg(idf) AS m FROM df), wt AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM df, mn),
qt AS (SELECT item_id AS q, unnest({tokens_sql('text')}) AS term FROM benchmark),
bm AS (SELECT q, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))) AS score FROM qt JOIN po USING (term) JOIN wt USING (term), sz GROUP BY 1, 2),
bk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)"""


def bm25(spark, d, k, by=None):
    """Scores of passages that may be among the ``k`` best of a question, or of a question and a value of ``by``."""
    s = retrieval.bm25_search(questions(spark, d), "q", "question", passages(spark, d), "doc_id", F.col("text"), k, by)
    return s.withColumn("score", F.round("score", 6))


def best_by_blocks(spark, d, choose, k):
    """What ``choose`` picks, from an index of the questions' terms in blocks."""
    asked = questions(spark, d)
    index = retrieval.block_index(passages(spark, d), "doc_id", F.col("text"), asked.select(F.explode(text.tokenize(F.col("question"))).alias("term")))
    return retrieval.BlockSearch(index, asked, "q", "question", choose, k, 6).best


@query(f"WITH {BM} SELECT q, doc_id, round(score, 6) AS score FROM bk WHERE rank <= 10")
def g6_bm25_search(spark, d):
    return retrieval.top_k(bm25(spark, d, 10), "q", "doc_id", "score", 10)


@query(f"WITH {BM} SELECT q, doc_id, round(score, 6) AS score FROM bk WHERE rank <= 10")
def g6_block_search(spark, d):
    return best_by_blocks(spark, d, lambda s: retrieval.top_k(s, "q", "doc_id", "score", 10), 10)


@query()
def g7_lsa_embed(spark, d):
    e, model = retrieval.lsa_embed(passages(spark, d).select("doc_id", "text"), "text", keep=["doc_id"])
    asked = written(model.embed(questions(spark, d), "question").select("q", F.col("lsa").alias("qv")), "asked")
    near = retrieval.dense_search(asked, "q", "qv", e, "doc_id", "lsa", 10)
    return near.select("q", "doc_id", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")).alias("rank"), F.round("score", 6).alias("score"))


UNIT = "list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
DENSE = f"u AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings), dn AS (SELECT a.vec_id AS q, b.vec_id, round(list_sum(list_transform(a.v, lambda x, i: x * b.v[i])), 6) AS score FROM u a, u b WHERE a.vec_id % 50 = 0), dr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM dn)"


def dense(spark, d, k=10):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))  # the stated query set
    return retrieval.dense_search(q, "q", "qv", e, "vec_id", "embedding", k, 6)


@query(f"WITH {DENSE} SELECT q, vec_id, score FROM dr WHERE rank <= 10")
def g8_dense_search(spark, d):
    return dense(spark, d)


LEX = "lx AS (SELECT d.q, d.vec_id, row_number() OVER (PARTITION BY d.q ORDER BY (d.vec_id % 13), d.vec_id) AS rank FROM dr d WHERE d.rank <= 10)"


@query(f"WITH {DENSE}, {LEX} SELECT q, vec_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT q, vec_id, rank FROM dr WHERE rank <= 10 UNION ALL SELECT q, vec_id, rank FROM lx) GROUP BY 1, 2")
def g9_rrf_fuse(spark, d):
    a = dense(spark, d)
    b = a.select("q", "vec_id", (-(F.col("vec_id") % 13)).cast("double").alias("score"))
    return rounded(retrieval.rrf_fuse([retrieval.ranks(a, "q", "vec_id"), retrieval.ranks(b, "q", "vec_id")], "q", "vec_id"))


@query(f"""WITH {BM}, j AS (SELECT bm.q, doc_id, round(score, 6) AS score, source, lang FROM bm JOIN documents USING (doc_id) WHERE NOT (bm.q % 5 = 0 AND source = 'src0')), p AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY q, source ORDER BY score DESC, doc_id) <= 2)
SELECT q, doc_id, source, lang, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 8""")
def g10_search(spark, d):
    exclude = questions(spark, d).filter("q % 5 = 0").select("q", F.lit("src0").alias("source"))
    meta = table(spark, d, "documents").select("doc_id", "source", "lang")
    return retrieval.search(bm25(spark, d, 2, "source"), meta, "q", "doc_id", "source", 8, 2, exclude).select("q", "doc_id", "source", "lang", "rank")


@query(f"""WITH {BM}, j AS (SELECT bm.q, doc_id, round(score, 6) AS score, source, lang FROM bm JOIN documents USING (doc_id) WHERE NOT (bm.q % 5 = 0 AND source = 'src0')), p AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY q, source ORDER BY score DESC, doc_id) <= 2)
SELECT q, doc_id, source, lang, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 8""")
def g10_block_search(spark, d):
    exclude = questions(spark, d).filter("q % 5 = 0").select("q", F.lit("src0").alias("source"))
    meta = table(spark, d, "documents").select("doc_id", "source", "lang")
    return best_by_blocks(spark, d, lambda s: retrieval.search(s, meta, "q", "doc_id", "source", 8, 2, exclude), 8).select("q", "doc_id", "source", "lang", "rank")


@query(f"""WITH {BM}, j AS (SELECT bm.q, doc_id, round(score, 6) AS score, source FROM bm JOIN documents USING (doc_id)), p AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY q, source ORDER BY score DESC, doc_id) <= 1)
SELECT q, source, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10""")
def g11_top_docs(spark, d):
    return retrieval.top_docs(bm25(spark, d, 1, "source"), table(spark, d, "documents").select("doc_id", "source"), "q", "doc_id", "source")


@query(r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text || ' call +1 305 555 0100 or ops' || turn || '@ship.com', '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.]+', '[email]', 'g'), '\+?[0-9][0-9\s().-]{8,}[0-9]', '[phone]', 'g')) AS digest FROM conversations")
def g12_scrub(spark, d):
    c = F.concat("text", F.lit(" call +1 305 555 0100 or ops"), F.col("turn").cast("string"), F.lit("@ship.com"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.scrub(c)).alias("digest"))


STEMS = "^(" + "|".join(text.DOMAIN_STEMS) + ")"


@query(f"SELECT conv_id, turn, len(list_filter({tokens_sql('text')}, lambda t: regexp_matches(t, '{STEMS}'))) > 0 AS in_scope FROM conversations")
def g13_scope_gate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.scope_gate(F.col("text")).alias("in_scope"))


@query(f"""WITH {BM}, b AS (SELECT item_id AS q, list_distinct({tokens_sql('text')}) AS w FROM benchmark), o AS (SELECT q, max(len(list_intersect(b.w, tk.w))) AS overlap FROM bk JOIN b USING (q) JOIN tk USING (doc_id) WHERE rank <= 5 GROUP BY 1) SELECT q, overlap::INTEGER AS overlap, overlap >= 2 AS enough FROM o""")
def g14_evidence_gate(spark, d):
    hits = retrieval.top_k(bm25(spark, d, 5), "q", "doc_id", "score", 5).join(passages(spark, d).select("doc_id", "text"), "doc_id").join(questions(spark, d), "q")
    return text.evidence_gate(hits, "q", "question", "text")


@query("SELECT p_partkey, p_brand || ': ' || concat_ws('; ', CASE WHEN p_partkey % 3 > 0 THEN replace(p_name, '_', ' ') || ' fault suspected' END, 'abnormal shaft speed, oil temp', CASE WHEN p_partkey % 2 = 0 THEN 'risk of ' || lower(p_type) END) || '. What caused similar failures, what should be checked, and which barriers failed?' AS question FROM part")
def g15_alert_to_question(spark, d):
    sensors = F.create_map(F.lit("s1"), F.lit(0.6), F.lit("oil_temp"), F.lit(0.4))
    terms = F.create_map(F.lit("s1"), F.lit("shaft speed"))
    q = text.alert_to_question(F.col("p_brand"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")), sensors, F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.lit(""), terms)
    return table(spark, d, "part").select("p_partkey", q.alias("question"))


def answers(spark, d, best=None):
    best = retrieval.top_k(bm25(spark, d, 5), "q", "doc_id", "score", 5) if best is None else best
    hits = best.join(passages(spark, d), "doc_id").join(questions(spark, d), "q")
    return text.extractive_answer(hits, "q", "question", "chunk_id", "text")


def words4_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z]{{4,}}'))"


ANSWERS = rf"""{BM}, ht AS (SELECT bk.q, 'DOC-' || d.doc_id || '#000' AS tag, d.text, b.text AS question FROM bk JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = bk.q WHERE rank <= 5),
sp AS (SELECT q, tag, question, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM ht), se AS (SELECT q, tag, question, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM sp),
sc AS (SELECT *, len(list_intersect({words4_sql('question')}, {words4_sql('s')})) AS score FROM se WHERE length(s) > 60 AND length(s) < 400),
be AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q, tag ORDER BY score DESC, pos) = 1), to4 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, tag) AS rk FROM be),
an AS (SELECT q, string_agg('- ' || trim(s, ' ') || ' [' || tag || ']', chr(10) ORDER BY rk) AS answer FROM to4 WHERE rk <= 4 GROUP BY 1)"""


@query(f"WITH {ANSWERS} SELECT q, answer FROM an")
def g16_extractive_answer(spark, d):
    return answers(spark, d)


@query("SELECT conv_id, turn, array_to_string(CASE WHEN turn % 2 = 0 THEN ['DOC-1#000'] ELSE [] END, ',') AS cited, 'DOC-9#001' AS invalid FROM conversations")
def g17_validate_citations(spark, d):
    a = F.concat(F.lit("see [DOC-9#001] "), F.when(F.col("turn") % 2 == 0, "and [DOC-1#000], [DOC-1#000]").otherwise(""))
    v = text.validate_citations(a, F.array(F.lit("DOC-1#000"), F.lit("DOC-2#000")))
    return table(spark, d, "conversations").select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", F.array_join("v.cited", ",").alias("cited"), F.array_join("v.invalid", ",").alias("invalid"))


@query(rf"""WITH {ANSWERS}, rt AS (SELECT q, list('DOC-' || doc_id || '#000') AS tags FROM bk WHERE rank <= 3 GROUP BY 1), ca AS (SELECT q, list_distinct(regexp_extract_all(answer, '{TAG_SQL}', 1)) AS used FROM an)
SELECT q, array_to_string(list_sort(list_filter(used, lambda t: list_contains(tags, t))), ',') AS cited, array_to_string(list_sort(list_filter(used, lambda t: NOT list_contains(tags, t))), ',') AS invalid FROM ca JOIN rt USING (q)""")
def g17_answer_citations(spark, d):
    """Which citations of the extractive answers are among the best three passages, and which aren't."""
    five = written(retrieval.top_k(bm25(spark, d, 5), "q", "doc_id", "score", 5), "best")
    best = retrieval.top_k(five, "q", "doc_id", "score", 3).groupBy("q").agg(F.collect_list(F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"), F.lit("#000"))).alias("tags"))
    v = answers(spark, d, five.drop("_rn")).join(best, "q").select("q", text.validate_citations(F.col("answer"), F.col("tags")).alias("v"))
    return v.select("q", F.array_join(F.array_sort("v.cited"), ",").alias("cited"), F.array_join(F.array_sort("v.invalid"), ",").alias("invalid"))


CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(c), '{p}') THEN '{n}'" for n, p in text.EVENT_CLASSES) + " ELSE 'other' END"
KINDS = ["Fire/Explosion", "Machinery Damage", "Hull failure", "Stranding", "Allision", "Capsizing", "Personnel"]


@query("WITH k AS (SELECT p_partkey, list_extract(['" + "', '".join(KINDS) + f"'], (1 + p_partkey % 7)::INT) AS c FROM part) SELECT {CLASS_SQL} AS event, count(*) AS n FROM k GROUP BY 1")
def g18_event_class(spark, d):
    c = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (1 + F.col("p_partkey") % 7).cast("int"))
    return table(spark, d, "part").groupBy(text.event_class(c).alias("event")).agg(F.count("*").alias("n"))


@query(f"""WITH {DENSE}, pr AS (SELECT label, count(*) / sum(count(*)) OVER () AS s FROM embeddings GROUP BY 1), nb AS (SELECT d.q, e.label, row_number() OVER (PARTITION BY d.q ORDER BY d.rank) AS rn FROM dr d JOIN embeddings e USING (vec_id) WHERE d.rank <= 10 AND d.vec_id <> d.q),
vt AS (SELECT q, label, sum(1.0 / rn / s) AS v FROM nb JOIN pr USING (label) WHERE rn <= 7 GROUP BY 1, 2) SELECT q, label AS predicted FROM vt QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(v, 9) DESC, label) = 1""")
def g19_knn_triage(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = dense(spark, d).filter("vec_id <> q").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return retrieval.knn_triage(hits, "q", "vec_id", labels)


GOLD = "gd AS (SELECT item_id AS q, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, d):
    """Reports that hold a question's passage, among all reports."""
    return retrieval.anchored(questions(spark, d), "q", "question", passages(spark, d), "doc_id", "text")


@query(f"""WITH {BM}, {GOLD}, r AS (SELECT gd.q, min(rank) AS rank FROM gd LEFT JOIN (SELECT * FROM bk WHERE rank <= 10) k ON k.q = gd.q AND k.doc_id = gd.doc_id GROUP BY 1)
SELECT count(*) AS questions, {", ".join(f"round(avg(coalesce(rank <= {k}, false)::INT), 6) AS hit_at_{k}" for k in (1, 3, 5))}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr_at_10 FROM r""")
def g20_retrieval_metrics(spark, d):
    top = retrieval.ranks(retrieval.top_k(bm25(spark, d, 10), "q", "doc_id", "score", 10), "q", "doc_id")
    return rounded(retrieval.retrieval_metrics(top, gold(spark, d), "q", "doc_id"))


@query(rf"""WITH {ANSWERS}, cl AS (SELECT q, string_split(regexp_replace(regexp_replace(answer, '\]\s+([A-Z0-9-])', ']' || chr(1) || '\1', 'g'), '\n', chr(1), 'g'), chr(1)) AS cs FROM an), ce AS (SELECT q, unnest(cs) AS s, generate_subscripts(cs, 1) AS pos FROM cl),
ct AS (SELECT q, pos, s, regexp_extract_all(s, '{TAG_SQL}', 1) AS tags FROM ce WHERE length(s) > 30), ck AS (SELECT *, list_distinct({tokens_sql(f"regexp_replace(s, '{TAG_SQL}', '', 'g')")}) AS terms FROM ct WHERE len(tags) > 0 OR len(regexp_split_to_array(s, '\s+')) >= 8),
cx AS (SELECT q, pos, terms, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS tag FROM ck), cb AS (SELECT q, pos, max(coalesce(len(list_intersect(terms, tk.w)) / nullif(len(terms), 0), 0)) AS best FROM cx LEFT JOIN tk ON 'DOC-' || tk.doc_id || '#000' = cx.tag GROUP BY 1, 2)
SELECT q, count(*) AS claims, round(avg((best >= 0.6)::INT), 6) AS supported FROM cb GROUP BY 1""")
def g21_faithfulness(spark, d):
    """Claims of each extractive answer, and the share that its cited passage supports."""
    return rounded(text.faithfulness(answers(spark, d), passages(spark, d).select(F.col("chunk_id").alias("tag"), "text"), "q", "answer"))


@query(f"WITH {BM}, gd AS (SELECT item_id AS q, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), r AS (SELECT gd.q, min(rank) AS rank FROM gd LEFT JOIN (SELECT * FROM bk WHERE rank <= 10) k ON k.q = gd.q AND k.doc_id = gd.doc_id GROUP BY 1) SELECT count(*) AS questions, round(avg(coalesce(rank <= 5, false)::INT), 6) AS hit_at_5 FROM r")
def g24_quality_bar(spark, d):
    top = retrieval.ranks(retrieval.top_k(bm25(spark, d, 10), "q", "doc_id", "score", 10), "q", "doc_id")
    return rounded(retrieval.quality_bar(retrieval.retrieval_metrics(top, gold(spark, d), "q", "doc_id"), 0.5).select("questions", "hit_at_5"))


@query("""WITH a AS (SELECT o_orderkey % 4 > 0 AS answerable, o_orderkey % 7 = 0 AS refused, o_orderkey % 3 AS citations, (o_orderkey % 11 = 0)::INT AS invalid, o_orderkey % 2 = 0 AS gold_cited, o_totalprice / 1000 AS latency_s FROM orders)
SELECT round(avg(CASE WHEN answerable AND NOT refused THEN (invalid = 0)::INT END), 6) AS citation_validity, round(avg(CASE WHEN answerable AND NOT refused THEN (citations > 0)::INT END), 6) AS answers_with_citations, round(avg(CASE WHEN answerable AND NOT refused THEN gold_cited::INT END), 6) AS gold_report_cited,
round(avg(CASE WHEN answerable THEN refused::INT END), 6) AS false_refusal_rate, round(avg(CASE WHEN NOT answerable THEN refused::INT END), 6) AS off_topic_refusal_rate, round(quantile_cont(latency_s, 0.5), 6) AS latency_s_p50, round(quantile_cont(latency_s, 0.95), 6) AS latency_s_p95 FROM a""")
def g22_answer_metrics(spark, d):
    k = F.col("o_orderkey")
    a = table(spark, d, "orders").select((k % 4 > 0).alias("answerable"), (k % 7 == 0).alias("refused"), (k % 3).alias("citations"), (k % 11 == 0).cast("int").alias("invalid_citations"), (k % 2 == 0).alias("gold_cited"), (F.col("o_totalprice") / 1000).alias("latency_s"))
    return rounded(retrieval.answer_metrics(a))


@query("""WITH c AS (SELECT o_orderpriority AS y, CASE WHEN o_totalprice > 250000 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders), l AS (SELECT DISTINCT y AS l FROM c), f AS (SELECT l, coalesce(2.0 * sum((y = l AND p = l)::INT) / nullif(sum((y = l)::INT) + sum((p = l)::INT), 0), 0) AS f1 FROM c, l GROUP BY 1), m AS (SELECT y, count(*) AS n FROM c GROUP BY 1)
SELECT (SELECT round(avg((y = p)::INT), 6) FROM c) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, (SELECT count(*) FROM f) AS classes, (SELECT y FROM m ORDER BY n DESC, y LIMIT 1) AS majority_class, (SELECT round(max(n) / sum(n), 6) FROM m) AS majority_accuracy""")
def g23_triage_metrics(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("y"), F.when(F.col("o_totalprice") > 250000, "1-URGENT").otherwise(F.col("o_orderpriority")).alias("p"))
    return rounded(retrieval.triage_metrics(x, "y", "p"))
