"""Ranked search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleethealth.llm import ranked_search as rs

DOCS = "doc_id long, text string, item_id int, rank int, score int, n int, terms int, tf int, item int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    found = [(i, words(t)) for i, t in docs]
    total = [len(w) for _, w in found if w]
    df = Counter(t for _, w in found for t in set(w))
    out = {}
    for item, text in items:
        scored = []
        for i, w in found:
            tf, score = Counter(w), 0
            for t, c in Counter(words(text)).items():
                if tf[t]:
                    m = 25 + 75 * len(w) * len(total) // sum(total)
                    score += c * math.floor(1000 * math.log((2 * len(total) + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return {k: v for k, v in out.items() if v}


def as_found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    common, rare = [f"w{i}" for i in range(12)], [f"Rare{i}é" for i in range(60)]
    text = lambda n: rng.choice(" ,\n;").join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(900)]
    docs += [(2000 + i, docs[7][1] + " rare3é") for i in range(500)]  # ties
    docs += [(5000, None), (5001, " .,; \n"), (5002, ""), (None, docs[3][1]), (None, docs[3][1]), docs[11], docs[11], (5003, text(30_000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(50, None), (51, "nothing-known"), (52, docs[7][1] + " RARE3é"), (None, docs[3][1]), (53, "w1 " * 40), (54, "w1 w2"), (54, "w2 w3")]
    return docs, items


@pytest.mark.parametrize("block_bytes,per_task", [(1 << 22, 500_000), (300, 1500)])
def test_search_equals_brute_force(spark, tables, block_bytes, per_task):
    docs, items = tables
    d = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, 1) for r in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1, 1) for i, t in items], "item_id long, text string, doc_id int, block int")
    want = brute(docs, [(i, t) for i, t in items if (i, t) != (54, "w2 w3")])
    assert as_found(rs.search(d, q, block_bytes=block_bytes, per_task=per_task).collect()) == want


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one_d, one_q = spark.createDataFrame([(1, "a b")], d.schema), spark.createDataFrame([(1, "a")], q.schema)
    assert [rs.search(x, y).count() for x, y in ((d, q), (d, one_q), (one_d, q))] == [0, 0, 0]


def test_maxima_and_pruning():
    rng = np.random.default_rng(0)
    n = 20_000
    term = np.concatenate([np.zeros(n, int), np.ones(300, int), np.full(5, 3)])
    doc = np.concatenate([np.arange(n), np.sort(rng.choice(n, 300, False)), [3, 700, 9000, 9001, 19_999]])
    impact = np.concatenate([rng.integers(1, 50, n), rng.integers(900, 1000, 300), [5000] * 5])
    p = rs.Postings(n, term, doc, impact)
    for _ in range(300):
        a, b = sorted(rng.choice(n + 1, 2, False))
        assert p.impact[p._maxima(np.array([a]), np.array([b]))[0]] == impact[a:b].max()
    scores = np.zeros(n, int)
    np.add.at(scores, doc, impact * np.array([2, 1, 0, 1])[term])
    want = sorted(range(n), key=lambda d: (-scores[d], d))[:10]
    assert p.best({0: 2, 1: 1, 2: 5, 3: 1}, np.arange(n), 10) == [(d, scores[d]) for d in want]
    assert p.scored < n / 2  # most intervals are never looked into


def test_copies_of_the_best_document_are_not_all_scored():
    n = 50_000
    p = rs.Postings(n, np.repeat([0, 1], n), np.tile(np.arange(n), 2), np.full(2 * n, 7))
    assert p.best({0: 1, 1: 1}, np.arange(n), 10) == [(d, 14) for d in range(10)]
    assert p.scored < 1000
