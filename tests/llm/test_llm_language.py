"""The byte network: gradients by finite differences, whole texts, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from fleethealth.llm import byte_language as bl

DOCS = "doc_id long, text string, lang string, held_out int, lang_pred string, score int, segment int"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = bl.Network.fresh(3, units=4, kind="f8")
    ids, lengths, target = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([7, 3, 7, 1, 5]), np.array([0, 1, 2, 1, 0])
    loss, gradients = bl.loss_and_gradients(net, ids, lengths, target)
    assert loss > 0
    for part, g in zip(net.parts(), gradients, strict=True):
        places = np.argwhere(np.abs(g) > 0)
        for at in map(tuple, places[rng.choice(len(places), min(12, len(places)), replace=False)]):
            was, both = part[at], []
            for step in (1e-5, -1e-5):
                part[at] = was + step
                both.append(bl.loss_and_gradients(net, ids, lengths, target)[0])
            part[at] = was
            assert g[at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-4, abs=1e-8)


def plain(net, text):
    """Mean probabilities of one text, a byte and a segment at a time."""
    total = np.zeros(len(net.bias))
    h = net.states.shape[-1]
    ratio = lambda v: v / (1 + abs(v))
    for a in range(0, len(text), bl.SEGMENT):
        part, states = text[a : a + bl.SEGMENT], [{}, {}]
        for k in (0, 1):
            state = np.zeros(h)
            for t in range(len(part)) if k == 0 else reversed(range(len(part))):
                x, back = net.inputs[:, k, part[t]], [state @ net.states[g, k] for g in range(3)]
                update, reset = 0.5 + 0.5 * ratio(x[0] + back[0]), 0.5 + 0.5 * ratio(x[1] + back[1])
                candidate = ratio(x[2] + reset * back[2])
                state = candidate + update * (state - candidate)
                states[k][t] = state
        for t in range(len(part)):
            e = np.exp(states[0][t] @ net.outputs[0] + states[1][t] @ net.outputs[1] + net.bias)
            total += e / e.sum()
    return total / len(text)


def test_pooled_probabilities_are_those_of_all_positions():
    rng = random.Random(0)
    model = bl.LanguageModel(["a", "b", "c"], bl.Network.fresh(3, units=5))
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 5, bl.SEGMENT, bl.SEGMENT + 1, 1000, 7)]
    got = model.probabilities(texts)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx(plain(model.network, t), abs=1e-5)
    assert model.probabilities([texts[4]])[0] == pytest.approx(got[4], abs=1e-6)  # whatever else is read beside it


def documents():
    rng = random.Random(3)
    syllables = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["é", "eau", "oi", "qu"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(3, 200)), lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], [8, 1, 1], k=400))]
    return rows, text


def test_held_out_rows_and_odd_ones(spark):
    rows, text = documents()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ²! _", "bb"), (None, text("bb", 50), "aa"), (1003, text("cc", 30_000), None), (1004, text("bb", 9), None), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, 1, "x", 1, 1) for r in rows + odd], DOCS)
    model = bl.fit_language(docs, per_language=60, steps=60)
    assert model.languages == ["aa", "bb", "cc"]
    got = bl.predict_language(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    held = [(r, lang) for i, _, lang in rows if (r := by_id[i]).held_out]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert len(held) > 60 and sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003].lang_pred == "cc" and by_id[1004].lang_pred == "bb" and by_id[None].lang_pred == "bb" and not by_id[None].held_out
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == rows[5][0]}) == 1


def test_sample_is_bounded_and_leaves_held_out_rows(spark):
    rows, _ = documents()
    docs = spark.createDataFrame([(i, f"{i:06d}" + t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    got = bl.training_segments(docs, 20).collect()
    assert {r.lang for r in got} == {"aa", "bb", "cc"}
    assert all(sum(r.lang == k for r in got) <= 20 * bl.PIECES for k in ("aa", "bb", "cc")) and max(len(r.segment) for r in got) <= bl.SEGMENT
    learned = {int(bytes(r.segment)[:6]) for r in got if bytes(r.segment)[:6].isdigit()}
    assert learned and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in learned)


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = bl.fit_language(docs)
    assert {(r.lang_pred, r.score) for r in bl.predict_language(docs, model).collect()} == {("und", 0.0)}
    assert bl.predict_language(docs.limit(0), model).count() == 0
