"""Main text of web pages by wrappers inferred from pages of the same host.

Method. A page is a tree of block elements and texts. A token is an element's name, its plain class words, and, for
plain containers, what it holds: links (``~a``), only text (``~#``) or other blocks (``~+``). A host's wrapper is a
union-free regular expression over token streams, written element by element: every element path has the sequence of
what stands in it, with optional items, repeated items ``(x)+``, repeated groups ``(x? y?)+`` and text slots ``#``.
Streams are folded first: neighbours that are alike become a repeated item, and a token that stands in more than three
places binds all from its first to its last place into a repeated group. Then the streams of a path are aligned one after
the other with the wrapper: common ends, then tokens that both sides have once, then the gaps between them. What one side
lacks becomes optional; what then stands in more places becomes a group. So a token has at most three places in an
expression, or stands in one group: expressions never outgrow the different tokens that were met there.

Every child of an element so has a place in the wrapper: the third of four like ``div`` elements is another item than
the first. Places have weights, the mean characters that they hold over the host's distinct pages: link characters count
a tenth, and a text that several pages share counts once among them. Extraction aligns the page with the wrapper. From
the root, the region goes down to the item that holds the greater part of the weight, but never into a place that the
wrapper repeats, and only where something that is left out shows to be furniture: marked, mostly links, or mostly text
that pages share. Element names and class words are hints: they weigh an item down (navigation, adverts, forms, ...) or
let <article> and <main> pass at a smaller part, and within the region marked items are left out. Constants, texts on
most pages of the host and on two at least, are left out of the region too where all of an element that isn't a paragraph
or heading is constant; where no element is the region, all constants are. A host of one page is its own wrapper.

Scale. Distinct streams, texts and weights are sums of pre-aggregated groups over (host, path), so that a host with very
many pages meets no single task, and the streams of one path are aligned in rounds of 200 that a hash deals out: the
wrapper does not depend on how rows are partitioned. Models of a measured size are sent to the tasks; beyond it they are
joined by host.

Defined results: null html is empty; a page without text gives an empty text; unclosed and stray
tags are tolerated; a null or malformed url makes a host of its own, the empty one; repeated rows are
extracted each time and count once in a wrapper; of equal weights the first in page order is the region; very
long pages are parsed, aligned and returned whole; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, rows_of, written

#: Elements whose content isn't text, that never hold the article, that end a block, that hold prose.
DROPPED = frozenset("script style noscript template svg math iframe object select textarea button head title".split())
RAW = frozenset("script style noscript iframe textarea title template svg".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()) - {"html", "body"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption legend option summary address".split())
INLINE = frozenset("span a b i em strong small label".split())
CONTENT = frozenset(["article", "main"])
#: Words of class and id names that mark what isn't the article.
MARKED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar side widget comment comments reply replies respond disqus share sharing social related recommended pagination pager login search toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}[\s>/]", re.I) for name in RAW}
#: What a marked item weighs beside others; part of the weight that makes an item the region, and the part that an
#: <article> or <main> needs.
MARKED_WEIGHT = 0.1
REGION, CONTENT_REGION = 2 / 3, 1 / 4
#: Places of a token in an expression, at most, before it becomes a repeated group with all between them.
PLACES = 3
#: Streams of a path that one alignment round takes together.
ROUND = 200
#: Bytes of models that are sent to every task, at most.
SENT_BYTES = 16 << 20


def stream(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page: kinds are open, close and text. Raw elements are skipped whole."""
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            yield "text", "", html[at:]
            return
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.start() if end else size


def _attribute_words(rest: str) -> tuple[set[str], list[str]]:
    """Marking words, and the plain lower-case words of class, id and role names: generated names have digits or capitals."""
    marks, plain = set(), set()
    for groups in _MARK.findall(rest):
        for name in groups:
            marks.update(re.split(r"[^a-z]+", name.lower()))
            plain.update(w for w in re.split(r"[\s_-]+", name) if w.isascii() and w.isalpha() and w.islower() and len(w) <= 20)
    return marks & MARKED, sorted(plain)


def path_id(parent: int, token: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{token}".encode("utf-8", "surrogatepass")) - (1 << 63)


ROOT = path_id(0, "")


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def weight_of(chars: int, links: int) -> int:
    """Tenths of a character: a character in a link counts a tenth."""
    return 10 * chars - 9 * links


class Page:
    """Elements of a page, their texts and streams.

    Elements are numbers, parents first; 0 is the root. ``children``: elements within each element in page order, -1 for
    a text. ``paths``, ``weights`` (with all that is within), ``names`` and ``marks``: of each element. ``nodes``: path ->
    (parent path, token, marked), parents first. ``texts``: (path, characters in links, text) in page order, ``within``:
    their elements. ``streams``: path -> folded streams of its elements, as JSON, each with
    (item, child path) -> [weight, streams]."""

    def __init__(self, html: str, with_streams: bool = True):
        self.parents, self.names, self.tokens, self.marks = [0], [""], [""], [False]
        self.children: list[list[int]] = [[]]
        self.within: list[int] = []
        found = self._parse(html)
        self._place(found)
        self.texts = [(self.paths[e], link, text) for e, (link, text) in zip(self.within, found, strict=True)]
        self.streams: dict[int, dict[str, dict[tuple[int, int], list[int]]]] = {}
        if with_streams:
            self._fold_all()

    def _parse(self, html: str) -> list[tuple[int, str]]:
        held: list[str] = []
        found: list[tuple[int, str]] = []
        linked = 0
        #: name, nearest block element, inside an article, inside a link, dropped
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        open_names: dict[str, int] = {}
        tags: dict[tuple[str, str], tuple[str, bool, bool]] = {}  # name and attributes -> token, marked, hidden

        def flush():
            nonlocal linked
            text = " ".join(entities.unescape("".join(held)).split()) if held else ""
            held.clear()
            if text:
                element = stack[-1][1]
                found.append((min(linked, len(text)), text))
                self.within.append(element)
                self.children[element].append(-1)
            linked = 0

        def leave(down_to: int):
            for name, *_ in stack[down_to:]:
                open_names[name] -= 1
            del stack[down_to:]

        def close(name: str, until) -> None:
            if open_names.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        leave(k)
                        return
                    if stack[k][0] in until:
                        return

        for kind, name, rest in stream(html):
            if kind == "text":
                if not stack[-1][4]:
                    held.append(rest)
                    if stack[-1][3]:
                        linked += len(rest)
                continue
            if name == "br":
                held.append(" ")
            block = name in BLOCKS
            if block or name in DROPPED:
                flush()
            if kind == "close":
                close(name, () if block else BLOCKS)
                continue
            if name == "body" or block:
                close("head", BLOCKS)
            if name in VOID or rest.endswith("/") and not block:
                continue
            if block:  # a block ends an open paragraph
                close("p", BLOCKS - {"p"})
            if name in ("li", "tr", "td", "th", "dt", "dd", "option"):
                close(name, ("ul", "ol", "table", "dl", "select"))
            _, element, inside, link, dropped = stack[-1]
            if (name, rest) not in tags:
                marks, plain = _attribute_words(rest) if rest else (set(), [])
                tags[name, rest] = ".".join([name, *sorted(marks.union(plain))]), bool(marks), bool(rest and _HIDDEN.search(rest))
            token, marked, hidden = tags[name, rest]
            if block:
                self.children[element].append(len(self.parents))
                element, parent = len(self.parents), element
                self.parents.append(parent)
                self.names.append(name)
                self.tokens.append(token)
                self.marks.append(name not in CONTENT and (marked or name in BOILERPLATE or name == "header" and not inside))
                self.children.append([])
            stack.append((name, element, inside or name in CONTENT, link or name == "a", dropped or hidden or name in DROPPED or marked and name in INLINE))
            open_names[name] = open_names.get(name, 0) + 1
        flush()
        return found

    def _place(self, found: list[tuple[int, str]]) -> None:
        """Weights and what containers hold, from the leaves up; then paths, from the root down."""
        size = len(self.parents)
        chars, links, boxes = [0] * size, [0] * size, [False] * size
        for e, (link, text) in zip(self.within, found, strict=True):
            chars[e] += len(text)
            links[e] += link
        for e in range(size - 1, 0, -1):
            if chars[e]:
                above = self.parents[e]
                chars[above] += chars[e]
                links[above] += links[e]
                boxes[above] = True
        self.weights = [weight_of(c, k) for c, k in zip(chars, links, strict=True)]
        self.paths = [ROOT]
        self.nodes: dict[int, tuple[int, str, bool]] = {ROOT: (0, "", False)}
        known: dict[tuple[int, str], int] = {}
        for e in range(1, size):
            if chars[e] and self.names[e] not in CONTENT and self.names[e] not in PROSE:
                self.tokens[e] += "~a" if 2 * links[e] >= chars[e] else "~+" if boxes[e] else "~#"
            above = self.paths[self.parents[e]]
            path = known.get((above, self.tokens[e]))
            if path is None:
                path = known[above, self.tokens[e]] = path_id(above, self.tokens[e])
                self.nodes[path] = above, self.tokens[e], self.marks[e]
            self.paths.append(path)

    def tokens_in(self, element: int) -> list[str]:
        return ["#" if c < 0 else self.tokens[c] for c in self.children[element]]

    def _fold_all(self) -> None:
        own: dict[int, int] = {}
        for e, (_, link, text) in zip(self.within, self.texts, strict=True):
            own[e] = own.get(e, 0) + weight_of(len(text), link)
        for e, children in enumerate(self.children):
            at = self.streams.setdefault(self.paths[e], {})
            if children == [-1] or not children:
                at.setdefault(_ONE_TEXT if children else "[]", {})
                continue
            items, spans = fold(self.tokens_in(e))
            held = at.setdefault(json.dumps(items), {})
            texts = sum(c < 0 for c in children)
            here: dict[tuple[int, int], int] = {}
            for k, (first, last) in enumerate(spans):
                for c in children[first : last + 1]:  # an element's texts share its own weight evenly
                    key, w = (k, 0) if c < 0 else (k, self.paths[c]), own[e] // texts if c < 0 else self.weights[c]
                    here[key] = here.get(key, 0) + w
            for key, w in here.items():
                sums = held.setdefault(key, [0, 0])
                sums[0] += w
                sums[1] += 1

    def digest(self) -> bytes:
        d = xxhash.xxh3_128()
        for path, _, text in self.texts:
            d.update(f"{path} {len(text)} {text}".encode("utf-8", "surrogatepass"))
        return d.digest()


# --- expressions: lists of items [tokens, optional, repeated]; several tokens in an item are a repeated group ---


def _bound(items: list[list]) -> list[tuple[int, int]]:
    """Stretches (first, last) of items that become one: a token in more than PLACES places, or in a group and elsewhere, binds
    all from its first to its last place, and so does every token within. All other items stand alone."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    places: dict[str, int] = {}
    grouped = set()
    for k, (tokens, _, _) in enumerate(items):
        for t in tokens:
            first.setdefault(t, k)
            last[t] = k
            places[t] = places.get(t, 0) + 1
        if len(tokens) > 1:
            grouped.update(tokens)
    closed: list[tuple[int, int]] = []
    for t in first:  # by first place
        if places[t] < 2 or places[t] <= PLACES and t not in grouped or closed and closed[-1][1] >= first[t]:
            continue
        low, high, start, end = first[t], last[t], first[t], first[t] - 1
        while start > low or end < high:
            if end < high:
                end += 1
                k = end
            else:
                start -= 1
                k = start
                if closed and closed[-1][1] == k:  # a stretch that is closed already goes in whole
                    start = closed.pop()[0]
                    low = min(low, start)
                    continue
            low = min(low, min(first[x] for x in items[k][0]))
            high = max(high, max(last[x] for x in items[k][0]))
        closed.append((low, high))
    out, k = [], 0
    for low, high in [*closed, (len(items), len(items) - 1)]:
        out += [(j, j) for j in range(k, low)]
        if low <= high:
            out.append((low, high))
        k = high + 1
    return out


def _settled(items: list[list], spans: list[tuple[int, int]]) -> tuple[list[list], list[tuple[int, int]]]:
    """Neighbours that are alike become one repeated item, and bound stretches a group; spans follow their items."""
    runs: list[list] = []
    at: list[tuple[int, int]] = []
    for (tokens, optional, repeated), (low, high) in zip(items, spans, strict=True):
        if runs and runs[-1][0] == tokens:
            runs[-1] = [tokens, runs[-1][1] and optional, True]
            at[-1] = at[-1][0], high
        else:
            runs.append([tokens, optional, repeated])
            at.append((low, high))
    out, where = [], []
    for low, high in _bound(runs):
        part = runs[low : high + 1]
        out.append(part[0] if low == high else [sorted({t for x in part for t in x[0]}), all(x[1] for x in part), True])
        where.append((at[low][0], at[high][1]))
    return out, where


def fold(tokens: list[str]) -> tuple[list[list], list[tuple[int, int]]]:
    """The expression of one stream, and the stretch (first, last) of the stream that each item stands for."""
    return _settled([[[t], False, False] for t in tokens], [(k, k) for k in range(len(tokens))])


_ONE_TEXT = json.dumps([[["#"], False, False]])


def _rising(values: list[int]) -> set[int]:
    """Positions of a longest strictly rising subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        j = bisect_left(tails, v)
        before[k] = at[j - 1] if j else -1
        tails[j : j + 1], at[j : j + 1] = [v], [k]
    out, k = set(), at[-1] if at else -1
    while k >= 0:
        out.add(k)
        k = before[k]
    return out


def matches(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of both expressions that stand for each other, in order: items that share a token. Common ends match first,
    then tokens that both sides have in one place, longest rising sequence, then the gaps between those likewise."""
    out = []
    gaps = [(0, len(a), 0, len(b))]
    like = lambda i, j: a[i][0] == b[j][0] or not set(a[i][0]).isdisjoint(b[j][0])
    while gaps:
        i, k, j, m = gaps.pop()
        while i < k and j < m and like(i, j):
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and like(k - 1, m - 1):
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        sides = []
        for items, low, high in ((a, i, k), (b, j, m)):
            place: dict[str, int] = {}
            for x in range(low, high):
                for t in items[x][0]:
                    place[t] = -1 if t in place else x
            sides.append(place)
        pairs = sorted({(x, sides[1][t]) for t, x in sides[0].items() if x >= 0 and sides[1].get(t, -1) >= 0}, key=lambda p: (p[0], -p[1]))
        kept = _rising([y for _, y in pairs])
        anchors = [p for n, p in enumerate(pairs) if n in kept]
        out += anchors
        for x, y in anchors:
            gaps.append((i, x, j, y))
            i, j = x + 1, y + 1
        if anchors:
            gaps.append((i, k, j, m))
    return sorted(out)


def align(a: list[list], b: list[list]) -> list[list]:
    """The expression that two expressions resolve into: it accepts what either accepts."""
    if a == b:
        return a
    out: list[list] = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        out += [[t, True, r] for t, _, r in [*a[i:x], *b[j:y]]]
        if x < len(a):
            tokens = a[x][0] if a[x][0] == b[y][0] else sorted({*a[x][0], *b[y][0]})
            out.append([tokens, a[x][1] or b[y][1], a[x][2] or b[y][2] or len(tokens) > 1])
        i, j = x + 1, y + 1
    return _settled(out, [(0, 0)] * len(out))[0]


def expression(items: list[list]) -> str:
    """A path's expression as text."""
    inner = lambda tokens: tokens[0] if len(tokens) == 1 else " ".join(f"{t}?" for t in tokens)
    return " ".join((f"({inner(tokens)})" + "*+"[not optional] if repeated else tokens[0] + "?" * optional) for tokens, optional, repeated in items)


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_LISTS = dict.fromkeys(["n_path", "n_parent", "n_chars", "n_links", "t_path", "t_text", "t_chars", "i_path", "i_stream", "i_item", "i_child", "i_weight", "i_n"], pa.int64())
_PARTS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("items", pa.string()), ("page", pa.binary()), *((k, pa.list_(t)) for k, t in _LISTS.items())])
_PARTS_SQL = "host string, path long, items string, page binary, " + ", ".join(f"{k} array<bigint>" for k in _LISTS)


def _page_lists(page: Page) -> tuple[list[int], ...]:
    chars, links, texts = dict.fromkeys(page.nodes, 0), dict.fromkeys(page.nodes, 0), {}
    for path, link, text in page.texts:
        chars[path] += len(text)
        links[path] += link
        key = path, text_hash(text)
        texts[key] = texts.get(key, 0) + len(text)
    placed = [(path, stream_id, item, child, w, n) for path, found in page.streams.items() for items, held in found.items() if held for stream_id in [text_hash(items)] for (item, child), (w, n) in held.items()]
    places = [list(x) for x in zip(*placed, strict=True)] if placed else [[] for _ in range(6)]
    return list(page.nodes), [p for p, _, _ in page.nodes.values()], list(chars.values()), list(links.values()), [p for p, _ in texts], [t for _, t in texts], list(texts.values()), *places


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams that a task meets first, and counts of the pages that it meets first."""

    def each():
        seen: set[tuple] = set()
        none = (None,) * len(_LISTS)
        for host, html in rows_of(batches):
            page = Page(html)
            digest = page.digest()
            if (host, digest) not in seen:
                seen.add((host, digest))
                yield host, None, None, digest, *_page_lists(page)
            for path, found in page.streams.items():
                for items in found:
                    if (host, path, items) not in seen:
                        seen.add((host, path, items))
                        yield host, path, items, None, *none
            if len(seen) > 500_000:
                seen.clear()

    yield from batched(each(), _PARTS, 1000)


_WRAPPERS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("items", pa.string())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each():
        key, items = None, []
        for host, path, part, text in rows_of(batches):
            if (host, path, part) == key:
                items = align(items, json.loads(text))
            else:
                if key is not None:
                    yield *key[:2], json.dumps(items)
                key, items = (host, path, part), json.loads(text)
        if key is not None:
            yield *key[:2], json.dumps(items)

    yield from batched(each(), _WRAPPERS, 1000)


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"))


def aligned(streams: DataFrame) -> DataFrame:
    """host, path, items: the streams of each path aligned into one expression, ROUND at a time, in an order that a hash fixes."""
    while True:
        streams = written(streams.distinct(), "streams")
        counts = written(streams.groupBy("host", "path").agg(F.count("*").alias("n")), "stream-counts")
        most = counts.agg(F.max("n").alias("n")).first().n or 1
        if most == 1:
            return streams
        order = F.xxhash64("items")
        parts = streams.join(counts, ["host", "path"]).withColumn("part", F.pmod(order, F.ceil(F.col("n") / ROUND))).withColumn("order", order)
        dealt = parts.repartition("host", "path", "part").sortWithinPartitions("host", "path", "part", "order", "items")
        streams = dealt.select("host", "path", "part", "items").mapInArrow(_merge, "host string, path long, items string")


_PLACES = pa.schema([("host", pa.string()), ("path", pa.int64()), ("stream", pa.int64()), ("item", pa.int64()), ("place", pa.int64())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper's place of every item of every distinct stream."""

    def each():
        for host, path, stream_items, items in rows_of(batches):
            for place, item in matches(json.loads(items), json.loads(stream_items)):
                yield host, path, text_hash(stream_items), item, place

    yield from batched(each(), _PLACES, 10_000)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, model (JSON): every host's wrapper from all its pages; copies of a page count once.

    A model is a list of wrapper paths, each with its expression, the distinct pages that have it, its own texts'
    weight in full (raw) and with shared texts counted once (weight), the hashes of its constant texts, and the
    weights of the expression's places, by the path of what stands there (0: text)."""
    parts = written(_pages(pages).select("host", "html").mapInArrow(_partial, _PARTS_SQL), "page-parts")
    streams = parts.filter("items is not null").select("host", "path", "items")
    wrappers = written(aligned(streams), "wrapper-items")
    distinct = written(parts.filter("page is not null").dropDuplicates(["host", "page"]), "distinct-pages")
    node = lambda x: F.struct(x["n_path"].alias("path"), F.lit(None).cast("long").alias("text"), x["n_parent"].alias("parent"), x["n_chars"].alias("chars"), x["n_links"].alias("links"))
    text = lambda x: F.struct(x["t_path"].alias("path"), x["t_text"].alias("text"), F.lit(0).cast("long").alias("parent"), x["t_chars"].alias("chars"), F.lit(0).cast("long").alias("links"))
    met = distinct.select("host", F.explode(F.concat(F.transform(F.arrays_zip("n_path", "n_parent", "n_chars", "n_links"), node), F.transform(F.arrays_zip("t_path", "t_text", "t_chars"), text))).alias("x")).select("host", "x.*")
    sums = met.groupBy("host", "path", "text").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = written(sums.filter("text is null or n > 1"), "path-counts")
    nodes, texts = sums.filter("text is null").drop("text"), sums.filter("text is not null")
    size = nodes.filter(F.col("path") == ROOT).select("host", F.col("n").alias("pages"))
    most = F.col("n") * 2 > F.col("pages")
    shared = texts.join(size, "host").groupBy("host", "path").agg(
        F.sum(F.expr("chars - chars div n")).alias("again"),
        F.sum(F.when(most, F.col("chars"))).alias("fixed_chars"),
        F.array_sort(F.collect_list(F.when(most, F.col("text")))).alias("fixed"),
    )
    placed = distinct.select("host", F.explode(F.arrays_zip("i_path", "i_stream", "i_item", "i_child", "i_weight", "i_n")).alias("x")).groupBy("host", F.col("x.i_path").alias("path"), F.col("x.i_stream").alias("stream"), F.col("x.i_item").alias("item"), F.col("x.i_child").alias("child"))
    placed = written(placed.agg(F.sum("x.i_weight").alias("weight"), F.sum("x.i_n").alias("n")), "item-weights")
    found = streams.distinct().join(wrappers.withColumnRenamed("items", "wrapper"), ["host", "path"]).select("host", "path", "items", "wrapper").mapInArrow(_places, "host string, path long, stream long, item long, place long")
    places = placed.join(found, ["host", "path", "stream", "item"]).groupBy("host", "path", "place", "child").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    places = places.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("place", "child", "weight", "n"))).alias("places"))
    raw = 10 * F.col("chars") - 9 * F.col("links")
    weight = F.greatest(F.lit(0), raw - 10 * F.coalesce("again", F.lit(0)))
    full = nodes.join(wrappers, ["host", "path"], "left").join(shared, ["host", "path"], "left").join(places, ["host", "path"], "left")
    row = F.struct("path", "parent", "n", raw.alias("raw"), weight.alias("weight"), (F.col("chars") == F.coalesce("fixed_chars", F.lit(-1))).alias("constant"), F.coalesce("items", F.lit("[]")).alias("items"), F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"), F.coalesce("places", F.array().cast("array<struct<place:bigint,child:bigint,weight:bigint,n:bigint>>")).alias("places"))
    return full.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("model"))


class Model:
    """A host's wrapper as extraction needs it. Without pages of a host, a page is its own wrapper."""

    def __init__(self, rows: list[dict]):
        self.constant = {r["path"] for r in rows if r["constant"]}
        self.fixed = {(r["path"], t) for r in rows for t in r["fixed"]}
        self.items = {r["path"]: json.loads(r["items"]) for r in rows}
        #: path, place, child path -> mean weight, less what pages share
        self.mean: dict[tuple[int, int, int], float] = {}
        raw, weight, below = {r["path"]: r["raw"] for r in rows}, {r["path"]: r["weight"] for r in rows}, {}
        own = {path: weight[path] / raw[path] for path in raw if raw[path]}
        for r in rows:
            below.setdefault(r["parent"], []).append(r["path"])
        order, k = [ROOT] if ROOT in raw else [], 0
        while k < len(order):  # parents first
            order += below.get(order[k], [])
            k += 1
        parent = {r["path"]: r["parent"] for r in rows}
        for path in reversed(order[1:]):
            raw[parent[path]] += raw[path]
            weight[parent[path]] += weight[path]
        #: paths whose greater part several pages share
        self.shared = {path for path in order if raw[path] > 2 * weight[path]}
        for r in rows:
            for p in r["places"]:
                child = p["child"]
                part = own.get(r["path"], 0.0) if not child else weight[child] / raw[child] if raw.get(child) else 0.0
                self.mean[r["path"], p["place"], child] = part * p["weight"] / p["n"]

    @classmethod
    def of_page(cls, page: Page) -> Model:
        paths, parents, chars, links, *_ = _page_lists(page)
        rows = []
        for p, q, c, k in zip(paths, parents, chars, links, strict=True):
            items = None
            for text in sorted(page.streams[p]):
                items = align(items, json.loads(text)) if items is not None else json.loads(text)
            sums: dict[tuple[int, int], list[int]] = {}
            for text, held in page.streams[p].items():
                place = {b: a for a, b in matches(items, json.loads(text))}
                for (item, child), (w, n) in held.items():
                    if item in place:
                        s = sums.setdefault((place[item], child), [0, 0])
                        s[0], s[1] = s[0] + w, s[1] + n
            rows.append({"path": p, "parent": q, "raw": weight_of(c, k), "weight": weight_of(c, k), "constant": False, "items": json.dumps(items), "fixed": [], "places": [{"place": a, "child": b, "weight": w, "n": n} for (a, b), (w, n) in sums.items()]})
        return cls(rows)


def region(page: Page, model: Model) -> list[int]:
    """The elements that hold the greater part of what fills slots: one, or several that are all <article> or <main>."""
    at = [0]
    while len(at) == 1 and any(c >= 0 for c in page.children[at[0]]):
        path, children = page.paths[at[0]], page.children[at[0]]
        folded, spans = fold(page.tokens_in(at[0]))
        wrapper = model.items.get(path, [])
        place = {b: a for a, b in matches(wrapper, folded)}
        total, plain, content, furniture = 0.0, [], [], 0
        for k, (first, last) in enumerate(spans):
            like: dict[int, list[int]] = {}  # children of this item by path
            for c in children[first : last + 1]:
                like.setdefault(page.paths[c] if c >= 0 else 0, []).append(c)
            for child, elements in like.items():
                weight = model.mean.get((path, place.get(k, -1), child), 0.0)
                e = elements[0]
                if e >= 0 and page.marks[e]:
                    weight *= MARKED_WEIGHT
                total += weight
                sign = e >= 0 and (page.marks[e] or page.tokens[e].endswith("~a") or child in model.shared)
                furniture += sign
                if e < 0 or weight <= 0:
                    continue
                if page.names[e] in CONTENT:
                    content.append((weight, elements))
                elif first == last and page.names[e] not in PROSE and not (k in place and wrapper[place[k]][2]):
                    plain.append((weight, elements, sign))
        best = max(content, key=lambda x: x[0], default=(0.0, []))
        if not best[1] or best[0] < CONTENT_REGION * total:
            best = max(plain, key=lambda x: x[0], default=(0.0, [], False))
            if not best[1] or best[0] < REGION * total or furniture <= best[2]:
                return at
        at = best[1]
    return at


def region_name(page: Page, element: int) -> str:
    names = []
    while element:
        names.append(page.tokens[element])
        element = page.parents[element]
    return "/".join(reversed(names))


def main_blocks(page: Page, model: Model | None = None) -> tuple[str, list[str]]:
    """The region's path, and the texts that are kept, in page order."""
    model = model or Model.of_page(page)
    main = region(page, model)
    top = set(main)
    inside = [0 in top]
    for e in range(1, len(page.parents)):
        inside.append(e in top or inside[page.parents[e]] and not page.marks[e])
    found = [(e, path, text) for e, (path, _, text) in zip(page.within, page.texts, strict=True) if inside[e]]
    if main == [0]:
        kept = [text for _, path, text in found if not model.fixed or (path, text_hash(text)) not in model.fixed]
    else:
        kept = [text for e, path, text in found if path not in model.constant or e in top or page.names[e] in PROSE]
    return region_name(page, main[0]), kept or [text for *_, text in found]


def main_text(html: str, model: Model | None = None) -> str:
    """Blocks of the article, joined by newlines."""
    return "\n".join(main_blocks(Page(html), model)[1])


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("region", pa.string())])


def _extract(models):
    """Extraction with sent models, or with a model in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            cached: dict[str, Model] = {}
            for page_id, url, html, host, text in rows_of(batches):
                if host not in cached:
                    if len(cached) > 5000:
                        cached.clear()
                    text = text or models.value[host]
                    cached[host] = Model(json.loads(text))
                name, kept = main_blocks(Page(html, False), cached[host])
                yield page_id, url, "\n".join(kept), name

        yield from batched(each(), _TEXTS, 1000)

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, region, n_chars of every page; region is the element path that the wrapper chose, empty for the whole page."""
    models = written(infer_wrappers(pages), "wrappers")
    size = models.agg(F.sum(F.length("model") + F.length("host") + 100).alias("s")).first().s
    if (size or 0) <= SENT_BYTES:  # of a measured size
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.model for r in models.collect()})
        joined = _pages(pages).withColumn("model", F.lit(None).cast("string"))
    else:
        sent, joined = None, _pages(pages).join(models, "host")  # an equi-join; adaptive execution splits its hot hosts
    out = joined.select("page_id", "url", "html", "host", "model").mapInArrow(_extract(sent), "page_id long, url string, text string, region string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
