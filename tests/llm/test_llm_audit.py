"""The filter audit against a plain walk through all orders."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fleethealth.llm import filter_audit

DOCS = "doc_id long, text string, lang string, words string, mask string, part int, good int, digest int"
WEIGHT = st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9))


def brute(rows, n):
    """{(order, step): ...} by applying each order to every row; rows are (mask, good, toxic)."""
    out, shapley = {}, [0] * n
    for order in itertools.permutations(range(n)):
        left = list(rows)
        for step, k in enumerate(order, 1):
            gone = [r for r in left if r[0] >> k & 1]
            left = [r for r in left if not r[0] >> k & 1]
            shapley[k] += len(gone)
            fails = sum(r[0] >> k & 1 for r in rows)
            out[order, step] = len(left), len(gone), fails - len(gone), sum(r[0] == 1 << k for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)
    return {key: (*v, shapley[key[0][key[1] - 1]]) for key, v in out.items()}


def test_orders_are_all_and_neighbours():
    got = [o for o, _ in filter_audit.orders(5)]
    assert sorted(got) == sorted(itertools.permutations(range(5)))
    for (a, _), (b, at) in itertools.pairwise(filter_audit.orders(5)):
        assert [*a[:at], a[at + 1], a[at], *a[at + 2 :]] == list(b)
    assert [o for o, _ in filter_audit.orders(1)] == [(0,)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 15), WEIGHT, max_size=16))
def test_diagram_steps_equal_brute_force(counts):
    rows = [(m, int(i < g), int(i < t)) for m, (n, g, t) in counts.items() for i in range(n) if True]
    counts = {m: (n, min(n, g), min(n, t)) for m, (n, g, t) in counts.items()} or {0: (0, 0, 0)}
    want = brute(rows, 4)
    got = {(tuple("ABCD".index(c) for c in name), step): tuple(rest) for name, step, *rest in filter_audit.audit_counts(counts, "ABCD")}
    assert got == want


def test_equal_remainders_are_one_node():
    d = filter_audit.Diagram(5, {0: (1,), 31: (1,)})
    assert len(d.levels[0]) == 1 and sum(map(len, d.levels)) == 1 + 2 + 3 + 3 + 3
    for _, at in filter_audit.orders(5):
        if at is not None:
            d.swap(at)
            assert [len(x) for x in d.levels] == [1, 2, 3, 3, 3]


def documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(80):
        text = " ".join(word() for _ in range(rng.choice((20, 120)))) + rng.choice(("", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 8)) + rng.choice(("", " same" * 90))
        rows.append((i, text, rng.choice(("en", "de", None))))
    rows += [(200 + i, rows[i % 3][1], "en") for i in range(40)] + [(300, None, "en"), (301, "", None), (302, " \t\n", "fr"), (None, rows[0][1], "en"), (303, "x " * 50_000, "fr"), rows[5], rows[5]]
    return rows


def own_mask(text, doc_id, least):
    text = text or ""
    words = [w for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    bits = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), any(c in "#$%&*|" for c in text), doc_id is not None and doc_id > least[text]]
    return sum(1 << k for k, b in enumerate(bits) if b)


def test_audit_of_documents(spark):
    rows = documents(spark)
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (5, 1, 1), (999, 1, 1)]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = {}
    for i, t, lang in rows:
        parts.setdefault(lang or "", []).append((own_mask(t, i, least), int(i is not None and i in good), int(i is not None and i in toxic)))
    docs = spark.createDataFrame([(i, t, lang, "x", "y", 1, 1, 1) for i, t, lang in rows], DOCS)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.with_labels(filter_audit.failure_masks(docs), table)).collect()
    assert len(got) == 600 * len(parts)
    for part, members in parts.items():
        want = brute(members, 5)
        for r in (r for r in got if r.part == part):
            key = tuple("ABCDE".index(c) for c in r.filter_order), r.step
            assert want[key] == (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.with_labels(filter_audit.failure_masks(docs), labels)).count() == 0
