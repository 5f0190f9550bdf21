"""Media columns, archives, similarity join, page extraction and the pipeline."""

import hashlib
import io
import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleethealth.llm import html_wrappers, matroska, ngram_join, warc
from fleethealth.llm.common import connected_components
from fleethealth.llm.queries import op6_warc, op10_html_extraction

# --- media ---


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 8 + 1, 576 * 64, 576 * 64 + 1, 576 * 200 + 5])
def test_media_round_trip(n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    size, payload = matroska.padded(text)
    data = matroska.write_pcm(payload)
    m = matroska.read(data)
    assert size == n and len(payload) % 576 == 0 and len(payload) > 0 and b"".join(data[p.start : p.start + p.length] for p in m.packets) == payload
    assert [p.timestamp_ns for p in m.packets] == [k * 12_000_000 for k in range(len(m.packets))]
    assert len(m.cues) == len(m.clusters) and all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in m.cues)
    assert m.tracks == {1: {"codec": "A_PCM/INT/LIT", "default_ns": 12_000_000}}


@pytest.mark.parametrize("kind", [1, 3])
def test_uneven_lacing(kind):
    frames = [bytes([k]) * n for k, n in enumerate((1, 700, 255, 0, 254, 3))]
    block = matroska.vint(1) + b"\0\0" + bytes([kind << 1]) + matroska.lace(frames, kind)
    data = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.unsigned(matroska.TIMESTAMP, 5) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))))
    assert [data[p.start : p.start + p.length] for p in matroska.read(data).packets] == frames


def test_unknown_sizes_and_damage():
    inner = matroska.unsigned(matroska.TIMESTAMP, 0) + matroska.element(matroska.SIMPLE_BLOCK, matroska.vint(1) + b"\0\0\x80abc")
    cluster = b"\x1f\x43\xb6\x75\xff" + inner
    data = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    assert len(matroska.read(data).packets) == 2
    with pytest.raises(ValueError):
        matroska.read(matroska.write_pcm(b"x" * 576)[:-700])


def test_media_columns(spark):
    rows = [(1, "héllo", 1), (2, None, 1), (3, "", 1), (4, "héllo", 2), (5, "x" * 300_000, 1), (None, "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    media = matroska.encode_column(df)
    got = {r.doc_id: r for r in matroska.read_column(media).collect()}
    want = "héllo".encode() + b"\xff" * (576 - 6)
    assert got[1].payload_sha256 == hashlib.sha256(want).hexdigest() and got[1].n_bytes == 6
    assert got[1][1:] == got[4][1:] and got[2][1:] == got[3][1:] and got[2].payload_bytes == 576 and got[5].payload_bytes == 300_096
    t = matroska.packet_table(media)
    assert t.filter("doc_id = 5").count() == 521 and t.filter("cue_ns is null").count() == 0 and matroska.read_column(media.limit(0)).count() == 0


# --- archives ---


def test_ranges_own_what_starts_inside():
    rng = random.Random(0)
    parts = [warc.member(warc.record(i, "http://x/\r\n" if i == 3 else "u", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) + warc.MAGIC * 5, 7 if i % 5 == 0 else None)) for i in range(40)]
    data = b"".join(parts)
    for step in (1, 17, 400, 5000, len(data), len(data) + 9):
        got = [f["warc-record-id"] for a in range(0, len(data), step) for f, _ in warc.read_range(io.BytesIO(data), a, min(len(data), a + step))]
        assert got == [f"<urn:page:{i}>" for i in range(40)], step


def test_fake_magic_and_other_members_are_passed_by():
    import gzip

    data = warc.MAGIC + b"junk" + gzip.compress(b"not a record") + warc.member(warc.record(1, "u", b"p", None)) + warc.MAGIC
    assert len(list(warc.read_range(io.BytesIO(data), 0, len(data)))) == 1


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/1", long), (2, "http://a/2", long), (9, "http://b/1", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 500), (7, "u", "é" * 500), (9, "http://b/1", long), (None, "u", long)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "keeper", "host", "wrapper", "pages", "text")})


def test_archives(spark, pages, tmp_path):
    pages.coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    got = defaultdict(list)
    for r in op6_warc(spark, str(tmp_path)).collect():
        got[r.page_id].append((r.record_type, r.refers_to, r.payload_bytes))
    assert got[9] == [("response", None, 1207)] * 2 and got[1] == got[2] == got[None] == [("revisit", 9, 1207)]
    assert got[3] == got[4] == [("response", None, 5)] and got[5] == [("response", None, 0)] and got[6] == [("revisit", 7, 1000)]
    recs = warc.read_archives(warc.write_archives(warc.decide(pages)), split_bytes=100).collect()
    assert len(recs) == 10 and {bytes(r.payload).decode() for r in recs if r.record_type == "response"} == {pages.first().html, "short", "", "é" * 500}
    assert warc.read_archives(warc.write_archives(warc.decide(pages.limit(0)))).count() == 0


# --- similarity join ---


def brute_components(rows, width, percent):
    sets = {i: set(ngram_join.shingle_set(t, width).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 8, 12, 20, 60, 200]))] + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 1, 3, 8])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 70)])
def test_components_against_brute_force(spark, width, percent):
    rows = near_copies(width, 250)
    rows += [(len(rows), ""), (len(rows) + 1, " \t"), (len(rows) + 2, "One two"), (len(rows) + 3, "one\ntwo"), (len(rows) + 4, rows[0][1].upper())]
    df = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("sig", "component", "b", "g", "tile")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df, width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    rows = near_copies(9, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()}
    assert got == brute_components(rows, 3, 80)


def chained_groups(seed):
    """Clusters of near copies of all sizes, joined to each other by a passage that makes them candidates but not links."""
    rng = random.Random(seed)
    passage, rows = [f"p{k}" for k in range(30)], []
    for c in range(6):
        base = [f"c{c}w{k}" for k in range(rng.choice([4, 6, 9, 12]))]
        for _ in range(rng.choice([1, 2, 15, 30])):
            w = passage + base + [f"t{rng.randrange(50)}" for _ in range(rng.randrange(4))]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_over_many_blocks_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 6)
    rows = chained_groups(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    want = brute_components(rows, 2, 80)
    assert got == want and len({c for _, c in want.values()}) > 3


def test_documents_with_several_texts_link_them(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (3, b), (9, c), (9, c), (None, a), (12, "a" * 3_000_000 + " " + c)]
    got = sorted((str(r.doc_id), r.component_id) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == sorted([("1", 1), ("5", 1), ("5", 1), ("3", 1), ("9", 9), ("9", 9), ("None", None), ("12", 9)])


def test_different_words_have_different_hashes():
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    x = ngram_join.word_hashes(f"{a} {b} Word word\x0bw\u00a0x É é")
    assert x[0] != x[1] and x[2] == x[3] and len(x) == 7 and x[5] != x[6]


def test_join_of_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df, 3, 90).collect()} == {(None, 1, None), (1, 0, 1)}
    assert ngram_join.ngram_jaccard_components(df.limit(0), 3, 90).count() == 0


def test_parts_never_miss_a_link():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 300, 1000):
            for _ in range(20):
                s = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                drop = rng.integers(0, n * (100 - percent) // 100 + 1)
                t = np.sort(np.concatenate([s[drop:], rng.integers(0, 1 << 63, rng.integers(0, 3), dtype=np.uint64)]))
                o = n - drop
                if len(t) and 100 * o >= percent * (len(s) + len(t) - o):
                    assert np.intersect1d(ngram_join.part_signatures(s, percent), ngram_join.part_signatures(t, percent)).size


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}


def test_no_block_outgrows_a_task(spark):
    n = ngram_join.BLOCK_DOCS + 500
    met, star = ngram_join.signature_blocks(spark.createDataFrame([(1, i) for i in range(n)] + [(2, 3), (2, 9), (3, 7)], "sig long, doc_id long"))
    assert sorted(map(tuple, met.collect())) == [(2, 3), (2, 9)]
    assert {(r.a, r.b) for r in star.collect()} == {(i, 0) for i in range(1, n)}


def test_large_groups_of_near_copies_are_complete(spark):
    n = ngram_join.BLOCK_DOCS + 200
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(n)] + [(n + i, " ".join(f"x{i}y{k}" for k in range(60))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < n else i for i in range(n + 20)}


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy</div><header>Site</header><article><h1>{h}</h1><p><b>One &amp; two&nbsp;<i>th</i>ree<br>four
 five<p>Last &lt;p&gt; &#233;<form>Name <input></form><aside>Aside</aside><div class="comments"><p>First!</p></div></article><section class="sidebar">Side</section><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_wrappers.main_text(PAGE.format(h="Head"), None) == "Head\nOne & two three four five\nLast <p> é"
    assert html_wrappers.main_text("", None) == "" and html_wrappers.main_text("plain &amp; simple", None) == "plain & simple"
    assert html_wrappers.main_text("<p>a<p>b</div><li>c<li>d", None) == "a\nb\nc\nd" and html_wrappers.main_text("<p>a < b <", None) == "a < b <"


def test_wrappers_resolve_mismatches():
    items = lambda html: json.loads(next(iter(html_wrappers.Page(html).streams[html_wrappers.ROOT])))
    a, b = items("<h1>A</h1><p>x</p><p>y</p><p>z</p><ul><li>same</li></ul>"), items("<h1>B</h1><p>q</p><blockquote>new</blockquote><ul><li>same</li></ul>")
    w = html_wrappers.align(a, b)
    assert html_wrappers.expression(a) == "h1 (p)+ ul~+" and html_wrappers.expression(w) == "h1 (p)+ blockquote? ul~+"
    assert html_wrappers.align(w, w) == w and html_wrappers.align(w, a) == w
    crossed = html_wrappers.align(items("<h1>A</h1><p>x</p><ul></ul><h2>c</h2>"), items("<h1>A</h1><ul></ul><p>x</p><h2>c</h2>"))
    assert html_wrappers.expression(crossed) in ("h1 ul? p ul? h2", "h1 p? ul p? h2")
    apart = html_wrappers.align(items("<div>ad</div><div><p>x</p></div><div>foot</div>"), items("<div><p>y</p></div><div>foot</div>"))
    assert html_wrappers.expression(apart) == "div~#? div~+ div~#"  # like elements have places of their own
    assert html_wrappers.expression(items("<h1>A</h1>" + "<p>x</p><h2>b</h2>" * 4 + "<p>z</p><ul></ul>")) == "h1 (h2? p?)+ ul"


def accepted(items, tokens):
    """By a plain regular expression that is written out from the wrapper's expression."""
    out = "".join(f"(?:{'|'.join(re.escape(t) + ';' for t in names)})" + ("*" if optional and repeated else "?" if optional else "+" if repeated else "") for names, optional, repeated in items)
    return re.fullmatch(out, "".join(f"{t};" for t in tokens)) is not None


@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=8), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_a_wrapper_accepts_every_stream_it_was_aligned_with(streams):
    items = html_wrappers.fold(streams[0])[0]
    for s in streams[1:]:
        items = html_wrappers.align(items, html_wrappers.fold(s)[0])
    assert all(accepted(items, s) for s in streams)
    places = Counter(t for names, _, _ in items for t in names)
    grouped = {t for names, _, _ in items if len(names) > 1 for t in names}
    assert all(n <= (1 if t in grouped else html_wrappers.PLACES) for t, n in places.items())
    for s in streams:
        folded, spans = html_wrappers.fold(s)
        assert [k for low, high in spans for k in range(low, high + 1)] == list(range(len(s)))
        assert all(set(s[low : high + 1]) == set(x[0]) for x, (low, high) in zip(folded, spans, strict=True))
        met = html_wrappers.matches(items, folded)
        assert all(x < y and v < w for (x, v), (y, w) in zip(met, met[1:])) and all(set(items[x][0]) & set(folded[v][0]) for x, v in met)


def host_pages(n, seed=0):
    """Pages without any telling tag or class, and their articles: only what recurs on the host tells them apart."""
    rng = random.Random(seed)
    text = lambda k: " ".join(f"w{rng.randrange(400)}" for _ in range(k))
    rows = []
    for i in range(n):
        body = [text(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
        links = "".join(f"<div><a href='/{k}'>Go {text(2)}</a></div>" for k in range(5))
        html = f"<div><div>Our site</div>{links}</div><section><div>Seen {rng.randrange(900)} times</div></section><center><h1>T {i}</h1>" + "".join(f"<div>{p}</div>" + (f"<h2>H{k}</h2>" if k == i % 3 else "") for k, p in enumerate(body)) + "</center><section><div>Imprint and terms of our site</div></section>"
        rows.append((i, f"http://plain/{i}", html, "\n".join([f"T {i}", *(x for k, p in enumerate(body) for x in ([p, f"H{k}"] if k == i % 3 else [p]))])))
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_only_the_wrapper_can_tell(spark, partitions):
    rows = host_pages(30)
    got = extracted(spark, [r[:3] for r in rows] + [(100, *rows[3][1:3])], partitions)
    assert got == {r[0]: r[3] for r in rows} | {100: rows[3][3]}


def plain_pages(n, host="boxes"):
    """Nothing but plain ``div`` elements: menu, an advert on some pages, the article, a box of the same kind, a footer."""
    rng = random.Random(n)
    text = lambda k: " ".join(f"w{rng.randrange(400)}" for _ in range(k))
    rows = []
    for i in range(n):
        body = [text(rng.randint(20, 60)) for _ in range(rng.randint(3, 6))] if i else [text(8), text(8)]
        beside = [text(5)] if i else [text(60), text(60)]  # the first page has more beside its article than in it
        menu = "".join(f"<div><a href='/{k}'>{text(2)}</a></div>" for k in range(4))
        div = lambda parts: "<div>" + "".join(f"<div>{x}</div>" for x in parts) + "</div>"
        html = f"<div>{menu}</div>" + f"<div>{text(6)}</div>" * (i % 2) + div(body) + f"<div>{text(4)}</div>" + div([*beside, text(3)]) + "<div>End</div>"
        rows.append((i, f"http://{host}/{i}", html, "\n".join(body)))
    return rows


def test_places_of_the_wrapper_tell_like_elements_apart(spark):
    rows = plain_pages(20)
    assert extracted(spark, [r[:3] for r in rows], 3) == {r[0]: r[3] for r in rows}


def test_order_groups_and_optional_items_decide(spark):
    rows = plain_pages(20)
    cards = [(i, "", f"<div><a href='/'>Top {i}</a></div>" + "".join(f"<div><div>Card {i} {k} {'x ' * 20}</div><div>more {k} {i}</div></div>" for k in range(1 + i % 3)), None) for i in range(9)]
    pages = spark.createDataFrame([r[:3] for r in rows] + [(100 + i, f"http://cards/{i}", html) for i, _, html, _ in cards], "page_id long, url string, html string")
    models = {r.host: json.loads(r.model) for r in html_wrappers.infer_wrappers(pages).collect()}

    def texts(found, model, change):
        changed = html_wrappers.Model([r | {"items": json.dumps(change(json.loads(r["items"])))} for r in model])
        return [html_wrappers.main_blocks(html_wrappers.Page(r[2]), changed)[1] for r in found]

    same = lambda items: items
    assert texts(rows, models["boxes"], same) == [r[3].split("\n") for r in rows]
    assert texts(rows, models["boxes"], lambda items: items[::-1]) != texts(rows, models["boxes"], same)
    assert texts(rows, models["boxes"], lambda items: [x for x in items if not x[1]]) != texts(rows, models["boxes"], same)
    flat = texts(cards, models["cards"], lambda items: [[t, o, False] for t, o, _ in items])
    assert flat != texts(cards, models["cards"], same) and flat[0] == [f"Card 0 0 {'x ' * 20}".strip(), "more 0 0"]  # a page of one card is still a page of cards


def test_a_title_beside_its_text_is_no_furniture():
    assert html_wrappers.main_text("<div><div>Title</div><div><div>" + "text " * 50 + "</div><div>more</div></div></div>").startswith("Title\n")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_hosts_of_any_size_have_regions(spark, n):
    rows = plain_pages(n + 1, f"few{n}")[1:]
    assert extracted(spark, [r[:3] for r in rows]) == {r[0]: r[3] for r in rows}


def test_marked_enclosure_of_the_article_is_kept(spark):
    rows = [(i, f"http://m/{i}", f"<div class='header-top'>Top</div><div class='has-sidebar'><p>Article {i} {'text ' * 30}</p><div class='sidebar'>Side {i}</div></div><div>Foot</div>") for i in range(5)]
    assert extracted(spark, rows, 2) == {i: f"Article {i} " + " ".join(["text"] * 30) for i in range(5)}


def brute_model(rows):
    """Weights, counts and constants of one host's paths, in one loop over its distinct pages."""
    pages = {}
    for html in rows:
        p = html_wrappers.Page(html)
        pages.setdefault(tuple((a, t) for a, _, t in p.texts), p)
    n, chars, links, met, held = (Counter() for _ in range(5))
    for p in pages.values():
        n.update(p.nodes.keys())
        for path, link, t in p.texts:
            chars[path] += len(t)
            links[path] += link
            held[path, t] += len(t)
        met.update({(path, t) for path, _, t in p.texts})
    fixed = {k for k, m in met.items() if m > 1 and 2 * m > len(pages)}
    again = Counter()
    for (path, t), m in met.items():
        again[path] += held[path, t] - held[path, t] // m
    weight = {k: max(0, 10 * chars[k] - 9 * links[k] - 10 * again[k]) for k in n}
    return n, weight, {(k, html_wrappers.text_hash(t)) for k, t in fixed}, pages.values()


@pytest.mark.parametrize("partitions", [1, 5])
def test_models_against_brute_force(spark, partitions):
    rows = [r[:3] for r in host_pages(12, 3)] + [(50 + i, f"http://long/{i}", varied_page(i)) for i in range(6)]
    rows += [(90 + i, *rows[i][1:]) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions, "page_id")
    models = {r.host: json.loads(r.model) for r in html_wrappers.infer_wrappers(pages).collect()}
    for host in ("plain", "long"):
        n, weight, fixed, distinct = brute_model([r[2] for r in rows if f"//{host}/" in r[1]])
        got = models[host]
        assert {r["path"]: r["n"] for r in got} == dict(n) and all(r["weight"] == weight[r["path"]] for r in got)
        assert {(r["path"], t) for r in got for t in r["fixed"]} == fixed
        for _, url, html in rows:
            if f"//{host}/" in url:
                for path, found in html_wrappers.Page(html).streams.items():
                    items = json.loads(next(r["items"] for r in got if r["path"] == path))
                    assert all({t for x in json.loads(f) for t in x[0]} <= {t for x in items for t in x[0]} for f in found)
        sums = Counter()
        for p in distinct:
            for e, children in enumerate(p.children):
                if children == [-1] or not children:
                    continue
                items = json.loads(next(r["items"] for r in got if r["path"] == p.paths[e]))
                folded, spans = html_wrappers.fold(p.tokens_in(e))
                for place, k in html_wrappers.matches(items, folded):
                    for c in children[spans[k][0] : spans[k][1] + 1]:
                        if c >= 0:
                            sums[p.paths[e], place, p.paths[c]] += p.weights[c]
        assert {(r["path"], x["place"], x["child"]): x["weight"] for r in got for x in r["places"] if x["child"]} == dict(sums)


def test_sent_and_joined_models_agree(spark, monkeypatch):
    rows = [r[:3] for r in host_pages(8, 1)]
    sent = extracted(spark, rows)
    monkeypatch.setattr(html_wrappers, "SENT_BYTES", -1)
    assert extracted(spark, rows) == sent


def test_very_long_pages_take_linear_time():
    page = lambda n: "".join(f"<div class='c{k % 7}'><p>Text {k}</p></div></b></i>" for k in range(n)) + "<div>" * n
    took = []
    for n in (4000, 32000):
        began = time.process_time()
        assert html_wrappers.main_text(page(n)).count("\n") == n - 1
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]  # 8 times as long


def test_constants_outside_articles_are_boilerplate(spark, tmp_path):
    rows = [(i, f"http://Host.example/{i}", f"<div>Welcome to us</div><p>Body number {i}</p>") for i in range(6)] + [(50, None, None), (51, "bad url", "<p>t</p>"), (52, "http://other/", "<div>Welcome to us</div>")]
    spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumn("host", F.lit("x")).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.text, r.n_chars) for r in op10_html_extraction(spark, str(tmp_path)).collect()}
    assert got[3] == ("Body number 3", 13) and got[50] == ("", 0) and got[51] == ("t", 1) and got[52][0] == "Welcome to us"


def extracted(spark, rows, partitions=1):
    """The text of each page, with the rows dealt over so many tasks."""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions, "page_id")
    return {r.page_id: r.text for r in html_wrappers.extract_main_text(pages).collect()}


def test_copies_of_a_page_count_once_over_all_tasks(spark):
    page = "<div>Only page</div><p>Its text</p>"
    scripts = [f"<script>track({i})</script>" for i in range(12)]
    got = extracted(spark, [(i, f"http://copies/{i}", s + page) for i, s in enumerate(scripts)], 6)
    assert set(got.values()) == {"Only page\nIts text"} and len(got) == 12


def test_text_of_one_page_is_no_constant(spark):
    rows = [(i, f"http://one/{i}", f"<div>Welcome</div><p>Body {i}</p>" + ("<blockquote>A quote</blockquote>" if i == 2 else "")) for i in range(5)]
    rows += [(9, "http://one/9", "<div>Welcome</div><p>Body 9</p>")]
    got = extracted(spark, rows, 2)
    assert got[2] == "Body 2\nA quote" and got[1] == "Body 1"


def varied_page(i: int) -> str:
    """A page of parts of its own, with a notice at the end."""
    names = ["div", "section", "blockquote", "center", "details", "fieldset", "figure", "dl", "pre"]
    paths = [(a, b, c) for a in names for b in names for c in names]
    part = lambda k, p: "".join(f"<{n}>" for n in p) + f"Part {i} {k}" + "".join(f"</{n}>" for n in reversed(p))
    return "".join(part(k, p) for k, p in enumerate(paths) if random.Random(k * 100 + i).random() < 0.2) + "<p>All rights reserved</p>"


def test_constants_of_long_hosts(spark):
    got = extracted(spark, [(i, f"http://long/{i}", varied_page(i)) for i in range(12)])
    assert all("rights" not in t and t.count("Part") > 50 for t in got.values())


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(120):
        t = text(80)
        if i % 6 == 0:
            t += " vile rotten vile foul" * 3
        rows.append((i, t, "en", f"s{i % 2}", len(t)))
    rows += [(500, rows[1][1], "en", "s0", 1), (501, rows[2][1] + " tail", "en", "s0", 1), (502, "too short", "en", "s0", 1), (503, None, "en", "s0", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        kept.append({r.doc_id for r in docs.collect()})
    every = set(range(120)) | {500, 501}
    assert kept[0] == every and kept[1] == {i for i in every if i >= 120 or i % 6} and kept[2] == kept[1] - {500, 501}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and {r.doc_id for r in out.collect()} <= kept[2]


def test_stages_with_nulls_repeats_and_other_columns(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"word{k} lake" for k in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (1, long + " more", "b"), (2, long, None), (None, long, "a"), (None, None, None), (3, None, "a"), (4, "", "a"), (4, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("rate", "row", "who", "component", "copy")})
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(tmp_path))
            got = out.collect()
            assert name == "best_fit_packing" or out.columns == docs.columns
            if name == "ngram_jaccard_join" and df is docs:
                assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(map(str, [(1, long), (None, long), (None, None), (3, None), (4, "")]))
            if name == "quality_rules" and df is docs:
                assert len(got) == 5


def test_hot_payloads_are_split(spark):
    """Half of all rows share a payload: with the keeper table written first, the join's skewed side is one that adaptive execution can deal out."""
    pages = spark.createDataFrame([(i, None, "x" * 2000 if i % 2 else f"{i} " * 600) for i in range(400)], "page_id long, url string, html string")
    plan = warc.decide(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and plan.count("Join") == 1
    assert {r.refers_to for r in warc.decide(pages).collect() if r.page_id % 2} == {399, None}


@pytest.mark.parametrize("split", [1 << 16, 1 << 22])
def test_long_payloads_come_back(spark, split):
    rng = random.Random(4)
    rows = [(i, "u", "".join(chr(rng.randrange(32, 500)) for _ in range(n))) for i, n in enumerate([3_000_000, 10, 1_200_000])]
    made = warc.write_archives(warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)))
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read_archives(made, split).collect()}
    assert got == {f"<urn:page:{i}>": html for i, _, html in rows}


def test_batches_are_bounded_by_bytes():
    from fleethealth.llm.common import batched

    schema = pa.schema([("a", pa.int64()), ("b", pa.binary())])
    got = list(batched(((i, b"x" * 400) for i in range(100)), schema, 50, 8000))
    assert sum(b.num_rows for b in got) == 100 and max(b.num_rows for b in got) <= 8


def test_both_forms_of_the_bound_agree():
    for seed in range(6):
        rows = [r for r in near_copies(seed, 200) if 8 <= len(r[1].split()) <= 14][:12]
        sets = [ngram_join.shingle_set(t, 2) for _, t in rows]
        few = [(i, len(s), ngram_join.bitmap(s)) for (i, _), s in zip(rows, sets, strict=True)]
        ids, sizes, maps = zip(*few, strict=True)
        groups = []
        for edges in (ngram_join.few_stars(few, 80), ngram_join.bounded_stars(np.array(ids), np.array(sizes), ngram_join._folded(maps), 80)):
            root = {i: i for i in ids}
            for a, b in edges:
                root = {k: root[b] if v == root[a] else v for k, v in root.items()}
            groups.append({frozenset(k for k in ids if root[k] == r) for r in root.values()})
        assert groups[0] == groups[1] and len(groups[0]) > 1


def test_damage_is_an_error():
    members = [warc.member(warc.record(i, "u", f"payload {i} ".encode() * 200, None)) for i in range(5)]
    data = b"".join(members)
    read = lambda d: list(warc.read_range(io.BytesIO(d), 0, len(d)))
    assert len(read(data)) == 5 and len(read(data + data)) == 10
    ends = [sum(map(len, members[: k + 1])) for k in range(5)]
    for cut in range(ends[3] + 40, len(data)):
        with pytest.raises(warc.DamagedArchive):
            read(data[:cut])
    for at in [ends[1], ends[1] + 1, *range(ends[1] + 60, ends[2], 7), *range(ends[2] - 8, ends[2])]:
        with pytest.raises(warc.DamagedArchive):
            read(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    short = warc.member(warc.record(1, "u", b"p", None)[:-20])
    with pytest.raises(warc.DamagedArchive):
        read(short)


def test_stages_with_odd_names_and_maps(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"word{k} lake" for k in range(60))
    docs = spark.createDataFrame([(1, long, "a", {"k": "1"}), (1, long, "a", {"k": "2"}), (2, long + " more", "b", None)], "doc_id long, text string, source string, `a``b` map<string,string>")
    docs = docs.withColumn("meta.lang", F.lit("x")).withColumn("meta", F.struct(F.lit(1).alias("lang")))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        if name == "ngram_jaccard_join":
            assert [(r.doc_id, r["a`b"]) for r in got] == [(1, {"k": "1"})]
    assert stage_rows(corpus_pipeline.pack(spark, docs, str(tmp_path))) == 3


def stage_rows(df):
    return len({(r.doc_id, r.sequence_id, r.offset) for r in df.collect()})


@pytest.mark.parametrize("step", [150, 700])
def test_damage_is_an_error_wherever_ranges_end(step):
    members = [warc.member(warc.record(i, "u", f"payload {i} ".encode() * 200, None)) for i in range(5)]
    data, a, b = b"".join(members), len(members[0]), len(members[0] + members[1])
    for at in range(a + 10, b):
        bad = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        with pytest.raises(warc.DamagedArchive):
            [list(warc.read_range(io.BytesIO(bad), k, min(len(bad), k + step))) for k in range(0, len(bad), step)]
