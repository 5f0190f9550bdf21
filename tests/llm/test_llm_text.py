"""Chat formatting, packing, toxicity, license scans, mixing, quality rules: small cases and brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleethealth.llm import chat_format, license_scan, mixing, packing, quality_rules, toxicity
from fleethealth.llm.queries import OP9_SQL, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to river stone light over under house green walk seven north paper glass".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty texts, one very long text, ties, repeated rows, columns with clashing names."""
    rng = random.Random(0)
    rows = [(i, sentence(rng, rng.randint(1, 300)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n", "en", "s1", 0), (None, "a b c", "en", None, 0), (103, sentence(rng, 30_000), "en", "s0", 0)]
    rows += [rows[3], rows[3], (104, "same line here\nsame line here\n" * 30, "en", "s0", 0), (105, "é ß 日本 \x1c x", "fr", "s2", 0)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("words", "lines", "failed", "row", "kept", "n_copies", "copy", "length", "toxic", "sig", "media", "host", "a", "b", "key", "u", "source_key", "rate", "shuffle_key", "digest")})


# --- chat formatting ---

TURNS = "conv_id long, turn long, role string, text string"


def test_prefix_is_rendered_once(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    kind = "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = [
        (1, t(("user", "q"), ("assistant", "good")), t(("user", "q"), ("assistant", "bad"))),
        (2, t(("user", "q")), t(("user", "q"))),
        (3, None, t(("user", "q"))),
        (4, t(("user", "q"), ("assistant", "x")), t(("user", "q"))),
        (5, t(("user", "a")), t(("user", "b"))),
    ]
    got = {r.pair_id: r for r in chat_format.format_preferences(spark.createDataFrame(rows, kind)).collect()}
    assert got[1].n_prompt_turns == 1 and got[1].prompt == "<|user|>\nq<|end|>\n"
    s = got[1].chosen_spans[0]
    assert got[1].chosen[s.start : s.start + s.length] == "good<|end|>\n"
    assert got[2].n_prompt_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].n_prompt_turns == 0 and got[3].chosen == "" and got[3].rejected == "<|user|>\nq<|end|>\n" and not got[3].rejected_spans
    assert got[4].n_prompt_turns == 1 and got[4].rejected == "" and got[5].n_prompt_turns == 0


def test_swapped_answers(spark):
    rows = [(0, 1, "assistant", "a0"), (0, 0, "user", "q0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "more"), (2, 0, "user", None), (3, 0, None, "x"), (4, 0, "user", "q4"), (4, 1, "assistant", "a4"), (None, 0, "user", "u")]
    got = {r.pair_id: r for r in chat_format.swapped_answers(spark.createDataFrame(rows, TURNS)).collect()}
    texts = lambda x: [t.text for t in x]
    assert texts(got[0].chosen) == ["q0", "a0"] and texts(got[0].rejected) == ["q0", "a1"]
    assert texts(got[1].rejected) == ["q1", "a0"] and texts(got[4].rejected) == ["q4"] and texts(got[2].rejected) == []
    assert len(got) == 6 and chat_format.swapped_answers(spark.createDataFrame([], TURNS)).count() == 0


# --- packing ---


@pytest.mark.parametrize("open_bins", [1, 3, 64])
def test_bins_against_brute_force(open_bins):
    rng = random.Random(open_bins)
    items, bins, slow, opened = [rng.randint(1, 50) for _ in range(400)], packing.OpenBins(50, open_bins), {}, 0
    for n in items:
        number, offset = bins.place(n)
        fit = [f for f in slow.values() if f >= n]
        if fit:
            assert slow[number] == min(fit) and offset == 50 - min(fit)
            slow[number] -= n
        else:
            assert number == opened and offset == 0
            opened += 1
            slow[number] = 50 - n
        slow = {k: f for k, f in slow.items() if f}
        if len(slow) > open_bins:  # the fullest closes; which of equals doesn't matter
            low = min(slow.values())
            gone = next(k for k, f in slow.items() if f == low and k not in {b for s in bins.by_free for b in s})
            del slow[gone]
    assert bins.count == len(slow)


def test_packing_is_whole_and_tight(spark, docs):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs, tokenizer_path(), 256).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d in docs.collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[d.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.03 * math.ceil(sum(r.length for r in rows) / 256) + 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    some = docs.filter("doc_id < 20").dropDuplicates(["doc_id"])
    pieces = packing.token_pieces(some, tokenizer_path(), 128)
    placed = packing.best_fit(pieces.drop("ids"), ["doc_id", "piece"], 128)
    seqs = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces, placed).collect()}
    for r in placed.collect():
        assert zlib.crc32(seqs[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_run_wise_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    texts = ["", "\n", "ΣΑΣ Σ. İstanbul éa É", "<|endoftext|> Hello<|startoftext|>WORLD.", "don't I'LL 's ''", "1234 a1b2 12.5,", "日本語 ﬁ", "..., . ,", "tab\tx\r\ny\x1cz\x85w", "A.B. c.,", "😀😀.", "ß ẞ µ ª"]
    tok = Tokenizer.from_file(tokenizer_path())
    small = packing.WordTokenizer(tokenizer_path(), keep=3)
    assert [small.ids([t])[0] for t in texts * 2] == packing.WordTokenizer(tokenizer_path()).ids(texts * 2) and len(small.older) > 0
    got = packing.WordTokenizer(tokenizer_path()).ids(texts)
    assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# --- toxicity ---


def test_thresholds_are_ordered_and_held_out_rows_are_found(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(rng.randint(30, 120))]
        if bad:
            for _ in range(max(2, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "foulness", "foulmouth"])
        rows.append((i, " ".join(w), "en", "s", 0))
        if i < 600:
            labels.append((i, 1, int(bad)))
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "river stone", "en", "s", 0), rows[0]]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (7777, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(df, lab)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    got = toxicity.score_toxicity(df.withColumns({"toxic": F.lit(1), "severity": F.lit("x")}), model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and 600 <= r.doc_id < 900]
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.severity <= 3 for r in got) and not any(r.toxic for r in got if r.doc_id in (9000, 9001, None))
    assert toxicity.clean_rows(df, model).count() == sum(not r.toxic for r in got)
    assert toxicity.fit_toxicity(df, lab).weights == model.weights


def brute_scores(texts, model):
    """Severity and probability from the model's weights, by plain loops over prefixes and words."""
    out = []
    for t in texts:
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        x = 0.0
        for f, weight in zip(model.features, model.weights, strict=True):
            n = sum(f == y or f[0] == "^" and 4 <= len(f) - 1 <= 9 and len(y) >= len(f) - 1 and y.startswith(f[1:]) for y in w)
            x += weight * np.log1p(200 * n / (len(w) + 10))
        above = [1 - 1 / (1 + np.exp(-(b - x))) for b in model.thresholds]
        out.append((sum(above), above[0]))
    return out


def test_scores_against_brute_force_and_repeats_fit_once(spark, docs):
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit_toxicity(docs, lab)
    assert toxicity.fit_toxicity(docs.unionByName(docs), lab.unionByName(lab)) == model
    rows = docs.select("doc_id", "text").limit(60).collect()
    rows = spark.createDataFrame([*rows, (-1, "x " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.severity, r.p_toxic) for r in toxicity.score_toxicity(rows, model).collect()}
    for r, (severity, p) in zip(rows.collect(), brute_scores([r.text for r in rows.collect()], model), strict=True):
        assert abs(got[r.doc_id][0] - severity) < 1e-6 and abs(got[r.doc_id][1] - p) < 1e-6


def test_no_labels_means_no_severity(spark, docs):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, lab)
    assert {r.severity for r in toxicity.score_toxicity(docs, model).collect()} == {0.0} and toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_gradient_fits_an_ordinal_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    latent = 2 * x + rng.logistic(size=3000)
    grades = (latent[:, None] > np.array([-1, 1, 3])).sum(1)
    w, theta = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, int), x, grades, 1, l2=0)
    assert abs(w[0] - 2) < 0.2 and np.allclose(theta, [-1, 1, 3], atol=0.3)


# --- license scans ---


def brute_places(text, phrases):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for p, label in phrases.items():
        q = p.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(q)] == q]
    return len(w), out


def test_base_places_against_brute_force(spark, docs):
    extra = [(1, "CC BY cc-by cc_by. All rights reserved, all RIGHTS reserved"), (2, "GNU General Public License; general\npublic license"), (3, "all rights all rights reserved"), (4, None), (5, "ÉCC by é cc by")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(df).collect())))
    want = []
    for r in df.collect():
        n, places = brute_places(r.text, license_scan.BASE_PHRASES)
        at = [i for i, _ in places]
        want.append((r.doc_id, n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    assert got == sorted(map(str, want))


def test_regions_of_templates():
    a = license_scan.compile_template("licensed under [[the]] mit license [[version <<2>>]] end", "x")
    ok = lambda t: a.match(t.encode().split(), 0)
    assert ok("licensed under mit license end") == 5 and ok("licensed under the mit license version 1 2 end") == 9
    assert ok("licensed under mit licence end") == -1 and ok("licensed under mit license version 1 2 3 end") == -1 and ok("licensed under the the mit license end") == -1
    with pytest.raises(ValueError):
        license_scan.compile_template("[[all]]", "x")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_texts_match_and_altered_ones_are_refused():
    scanner = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.TEMPLATES)
    labels = lambda t: {x[2] for x in scanner.scan(t)[1]}
    assert labels("Copyright 2020 X\n" + MIT) == {"mit-text"} and labels(MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME, INC.")) == {"mit-text"}
    assert not labels(MIT.replace("subject to the following conditions", "provided you pay a fee")) and not labels(MIT[:-20])
    bsd2, bsd3 = (next(t for t, x in license_scan.LICENSES.items() if x == f"bsd-{k}-clause-text") for k in (2, 3))
    fill = lambda t: re.sub(r"<<\d+>>", "the regents", re.sub(r"\[\[.*?\]\]", "", t))
    assert labels(fill(bsd2)) == {"bsd-2-clause-text"} and labels(fill(bsd3)) == {"bsd-3-clause-text"}
    for template, label in license_scan.LICENSES.items():
        w = fill(template).split()
        assert label in labels(" ".join(w)) and label not in labels(" ".join([*w[:9], "not", *w[9:]])) and label not in labels(" ".join(w[:-1]))


def read_out(parts, most=4):
    """All token patterns of a template given as parts: a word, ("?", parts) or ("*", n)."""
    if not parts:
        return {()}
    head, rest = parts[0], read_out(parts[1:], most)
    if isinstance(head, str):
        first = {(head,)}
    elif head[0] == "?":
        first = {(), *read_out(head[1], most)}
    else:
        first = {(None,) * k for k in range(head[1] + 1)}
    return {a + b for a in first for b in rest}


def marked_up(parts):
    return " ".join(p if isinstance(p, str) else f"[[ {marked_up(p[1])} ]]" if p[0] == "?" else f"<<{p[1]}>>" for p in parts)


TEMPLATE = st.lists(st.one_of(st.sampled_from("abc"), st.tuples(st.just("*"), st.integers(1, 2)), st.tuples(st.just("?"), st.lists(st.one_of(st.sampled_from("abc"), st.tuples(st.just("*"), st.integers(1, 2))), min_size=1, max_size=3))), max_size=5)


@given(TEMPLATE, st.lists(st.sampled_from("abcd"), max_size=9))
@settings(max_examples=400, deadline=None)
def test_automata_against_brute_force(parts, tokens):
    parts = ["a", *parts]
    patterns, tokens = read_out(parts), ["a", *tokens]
    fits = [len(p) for p in patterns if len(p) <= len(tokens) and all(x is None or x == t for x, t in zip(p, tokens, strict=False))]
    got = license_scan.compile_template(marked_up(parts), "x").match([t.encode() for t in tokens], 0)
    assert got == max(fits, default=-1)


def test_method_adds_labels(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under CC BY-NC 4.0."), (4, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert got[1].labels == "mit" and got[2].labels == "apache-2.0" and got[3].labels == "cc-by,cc-by-nc" and got[4].labels == "gpl,gpl-notice"
    assert all(0 < r.score <= 1 for r in got.values()) and license_scan.license_places(df).count() == 6 and license_scan.scan_licenses(df.limit(0)).count() == 0


# --- mixing ---


def test_mean_copies_follow_the_rates(spark):
    df = spark.createDataFrame([(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(6000)], DOCS)
    out = mixing.poisson_mix(df, {"big": 1.0, "small": 1.0})
    share = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["small"] / share["big"] - 1) < 0.1 and abs(sum(share.values()) / 6000 - 1) < 0.1
    k = out.filter("source = 'small'").groupBy("doc_id").count().collect()
    assert max(r["count"] for r in k) > 5 and out.select("doc_id", "copy").distinct().count() == out.count()


def test_large_rates_are_sums(spark):
    df = spark.createDataFrame([(i, "t", "en", "a" if i else "b", 1) for i in range(400)], DOCS)
    n = mixing.poisson_mix(df, {"a": 1.0, "b": 1.0}).filter("source = 'b'").count()
    assert 130 < n < 270


def test_mixing_edge_cases(spark, docs):
    out = mixing.poisson_mix(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() > 0
    assert mixing.poisson_mix(docs.limit(0)).count() == 0 and mixing.poisson_mix(docs, {}).count() == 0
    again = mixing.poisson_mix(docs)
    assert sorted(map(str, again.select("doc_id", "copy").collect())) == sorted(map(str, out.select("doc_id", "copy").collect()))


def test_inversion_is_exact(spark):
    r = spark.range(1).select(*(mixing.poisson(F.lit(3.0), F.lit(u)).alias(f"k{i}") for i, u in enumerate((0.01, 0.2, 0.6, 0.999)))).first()
    cdf = np.cumsum([math.exp(-3) * 3**k / math.factorial(k) for k in range(40)])
    assert list(r) == [int(np.searchsorted(cdf, u)) for u in (0.01, 0.2, 0.6, 0.999)]


# --- quality rules ---


def test_ledger_equals_sql(spark, docs):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.POLICIES[-1])
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "sole_rule", "policy"]
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in rows.filter("doc_id is not null and doc_id <> 3").collect())))
    con = duckdb.connect()
    con.register("documents", docs.filter("doc_id is not null and doc_id <> 3").select("doc_id", "text").toPandas())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({OP9_SQL})").fetchall()
    assert got == sorted(map(str, want))
    assert rows.filter("doc_id = 3").count() == 3 and rows.filter("doc_id is null").count() == 1


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({i + k for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for k in range(8)})


def test_repeats_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        part = sentence(rng, rng.randint(6, 12))
        texts.append(" ".join(part if rng.random() < 0.4 else sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 12))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(df).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_ablations_equal_recounts(spark, docs):
    led = quality_rules.ledger(docs).cache()
    policy = quality_rules.POLICIES[-1]
    bits = [r.failed for r in led.collect()]
    for r in quality_rules.ablations(led, policy).collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        assert r.failed == sum(b & bit > 0 for b in bits) and r.kept_without == sum(b & (policy.rules | quality_rules.BASE) & ~bit == 0 for b in bits)
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(b & (policy.rules | 3) == 0 for b in bits)
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_texts_are_tokenized_in_bounded_lots(monkeypatch):
    import pyarrow as pa

    seen = []

    class Recorder:
        def ids(self, texts):
            seen.append(sum(map(len, texts)))
            return [b"\1\0\0\0" * len(t) for t in texts]

    monkeypatch.setattr(packing, "tokenizer", lambda path: Recorder())
    monkeypatch.setattr(packing, "HELD_CHARS", 1000)
    texts = ["x" * n for n in [10] * 300 + [5000, 0, 700, 700, 1]]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = pa.Table.from_batches(packing._cut("", 2048, False)(iter([rows])))
    assert max(x for x in seen if x < 5000) < 1700 and max(seen) <= 6000
    assert sum(got.column("length").to_pylist()) == sum(map(len, texts)) + len(texts)


def test_features_let_other_operators_memory_go():
    from fleethealth.llm import common, toxicity

    common.remembered("another operator", dict)
    list(toxicity._feature_rows(iter([])))
    assert list(common._remembered) == ["features of words"]


def test_packing_of_the_pipeline_keeps_no_words():
    import pyarrow as pa

    from fleethealth.llm import packing
    from fleethealth.llm.queries import tokenizer_path

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words to cut"]})
    kept = [b.to_pydict() for b in packing._cut(tokenizer_path(), 2048, False)(iter([batch]))]
    assert packing.tokenizer(tokenizer_path()).known
    assert [b.to_pydict() for b in packing._cut(tokenizer_path(), 2048, False, False)(iter([batch]))] == kept
    words = packing.tokenizer(tokenizer_path())
    assert not words.known and not words.older
