"""N-gram Jaccard join: exact similarity self-join on word shingle sets.

Method. Equal sets are one set from the start. Sets are laid out in size bands; two of them can only link
inside a band or across neighbouring ones, so each band gives one tile of the join. Inside a tile sets are
blocked by part signatures: the shingle universe is cut into more parts than linked sets can differ in, so at
least one non-empty part of two linked sets is equal (no link is lost). Among sets that meet in a block,
hashed bitmap signatures bound the overlap from above by bit counts; a block too large for one task is a star
around its least document, which holds all its candidates. Sets that pass, directly or over others, form
candidate groups; a group's texts are read again, wider bitmaps bound the overlap, and only pairs that pass
get the exact intersection of sorted arrays.

A group too large for one task is cut into size-banded blocks, and a few documents of every band are added to
each block of their group. First each block is compared within itself; only documents that are still in different
components are then compared block against block, where bitmaps say beforehand which texts are needed. So a cluster of true near copies, whatever its size, takes work in proportion to its documents, and no link
between documents of different components goes unlooked.

Defined results: null text and text without words give an empty set, linked with nothing; a
text with fewer words than the shingle width is one shingle; very long texts are read whole; equal sets link;
rows that share a doc_id are linked through it, repeated rows too; rows with a null doc_id take no part and
keep a null component; an empty table gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, connected_components, remembered, rows_of, written

_MULT = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT, _ONE = np.uint64(32), np.uint64(1)
#: Size bands of a tile: each is this much wider than its lower edge.
BAND_RATIO = 1.5
#: Documents and shingles that one comparison block may hold.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Documents of a block that are compared as integers, at most.
FEW = 12
#: Documents of each band of a large group that all its blocks share.
SHARED = 16


class _WordHashes(dict):
    """Hash of each word met, worked out once; forgets all when it has met very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word's bytes, lower-cased in ASCII; words are split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(remembered("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MULT
    return x ^ (x >> _SHIFT)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    w = min(width, len(h))
    n = len(h) - w + 1
    x = np.full(n, w, np.uint64) * _STEP
    for i in range(w):
        x = _mix(x + h[i : i + n]) + _STEP
    x = np.sort(_mix(x))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class Bands:
    """Tiles, part counts and differences allowed at a similarity of ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 31:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * BAND_RATIO)))
        self.tiles = [self._tile(lo, hi) for lo, hi in zip(self.edges, self.edges[1:], strict=False)]

    def differ(self, a: int, b: int) -> int:
        """Most elements in the symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def largest(self, a: int) -> int:
        return a * 100 // self.percent

    def _tile(self, lo: int, hi: int) -> tuple[int, int]:
        """Parts in all, and how many of a set's parts may be empty before empty ones count too."""
        need, spare = self.differ(hi - 1, self.largest(hi - 1)) + 1, 0
        for _ in range(8 if need > 1 else 0):
            empty = (need + spare) * math.exp(-lo / (need + spare))
            spare = min(need, max(1, math.ceil(empty + 3 * math.sqrt(empty))))
        return need + spare, spare

    def of(self, size: int) -> list[tuple[int, int, int, int]]:
        """(tile, parts, parts to emit, spare) of the tiles in which a set of this size has partners."""
        j = int(np.searchsorted(self.edges, size, "right")) - 1
        out = []
        for t in range(j, -1, -1):
            top = self.edges[t + 1] - 1
            if t < j and self.largest(top) < size:
                break
            parts, spare = self.tiles[t]
            d = self.differ(size, self.largest(size)) if t == j else self.differ(top, size)
            out.append((t, parts, min(parts, d + 1 + spare), spare))
        return out


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def part_signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """64-bit block keys; two sets that link have at least one in common."""
    out, mixed = [], _mix(s + _STEP)
    for tile, parts, emit, spare in bands(percent).of(len(s)):
        part = (mixed % np.uint64(parts)).astype(np.int64)
        counts = np.bincount(part, minlength=parts)[:emit]
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, s * _MULT)
        key = _mix(_mix(sums[:emit] + np.arange(emit, dtype=np.uint64) * _STEP) + np.uint64(tile * 0x2545F4914F6CDD1D % (1 << 64)))
        out.append(key if (counts == 0).sum() > spare else key[counts > 0])
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """A small bitmap signature: about as many bits as elements, set by half of the elements."""
    bits = 1 << max(6, int(len(s) - 1).bit_length()) if len(s) else 64
    out = np.zeros(bits // 64, np.uint64)
    at = s[(s >> np.uint64(40)) & _ONE == 0] & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), _ONE << (at & np.uint64(63)))
    return out.tobytes()


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows, folded to the shortest of them."""
    words = min(len(m) for m in maps) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, words), axis=0) for m in maps])


def few_stars(rows: list, percent: int) -> Iterator[tuple[int, int]]:
    """The same as bounded_stars for a few (id, size, bitmap): whole bitmaps as integers."""
    words = min(len(m) for _, _, m in rows)
    maps, root = [], list(range(len(rows)))
    for _, _, m in rows:
        whole = 0
        for at in range(0, len(m), words):
            whole |= int.from_bytes(m[at : at + words], "little")
        maps.append(whole)
    for i in range(1, len(rows)):
        a, n, _ = rows[i]
        for j in range(i):
            if root[j] != root[i]:
                b, k, _ = rows[j]
                need = -(-percent * (n + k) // (100 + percent))
                if (maps[i] & ~maps[j]).bit_count() <= n - need and (maps[j] & ~maps[i]).bit_count() <= k - need:
                    yield a, b
                    gone = root[j]
                    root = [root[i] if r == gone else r for r in root]


def bounded_stars(ids: np.ndarray, sizes: np.ndarray, maps: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Edges that span the groups of documents whose bitmaps don't rule a link out."""
    root = np.arange(len(ids))
    for i in range(1, len(ids)):
        near = np.flatnonzero(root[:i] != root[i])
        need = -(-percent * (sizes[near] + sizes[i]) // (100 + percent))  # overlap that a link needs
        fits = (np.bitwise_count(maps[i] & ~maps[near]).sum(1) <= sizes[i] - need) & (np.bitwise_count(maps[near] & ~maps[i]).sum(1) <= sizes[near] - need)
        for r in set(root[near[fits]].tolist()):
            yield int(ids[i]), int(ids[r])
            root[root == r] = i
        root[root == root[i]] = i


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bitmap", pa.binary()), ("sigs", pa.list_(pa.int64()))])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _doc_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for doc_id, text in rows_of(batches):
                s = shingle_set(text, width)
                yield doc_id, len(s), set_key(s), bitmap(s), part_signatures(s, percent).tolist() if len(s) and doc_id is not None else None

        yield from batched(each(), _DOCS, 2000, 8 << 20)

    return run


def compare(ids: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None, roots: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Links that span the components of these documents.

    With ``sides`` (0 or 1 for each), only pairs across the two sides are looked at; with ``roots``, only pairs
    of different components."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    side = np.array([sides[i] for i in order]) if sides else None
    sizes = np.array([len(s) for s in sets])
    bits = 1 << min(14, max(8, int(sizes.max() * 2).bit_length()))
    maps = np.zeros((len(ids), bits // 64), np.uint64)
    for row, s in zip(maps, sets, strict=True):
        at = s & np.uint64(bits - 1)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    root = np.unique([roots[i] for i in order], return_inverse=True)[1] if roots else np.arange(len(ids))
    for i in range(1, len(ids)):
        lo = int(np.searchsorted(sizes, -(-sizes[i] * percent // 100)))
        near = np.arange(lo, i)
        near = near[root[near] != root[i]]
        if side is not None:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        least = -(-percent * (sizes[near] + sizes[i]) // (100 + percent))  # overlap that a link needs
        mine, theirs = maps[i], maps[near]
        most = np.minimum(sizes[i] - np.bitwise_count(mine & ~theirs).sum(1), sizes[near] - np.bitwise_count(theirs & ~mine).sum(1))
        for j, need in zip(near[most >= least], least[most >= least], strict=True):
            if root[j] == root[i]:
                continue
            small, big = sets[j], sets[i]
            at = np.searchsorted(big, small)
            same = int((big[np.minimum(at, len(big) - 1)] == small).sum())
            if same >= need:
                yield ids[i], ids[int(j)]
                root[root == root[j]] = root[i]


def passing(rows: list[tuple], percent: int) -> set[int]:
    """Positions of the rows (side, size, root, bitmap) whose bitmaps don't rule out a link across sides and components."""
    sides, sizes, roots = (np.array([r[k] for r in rows]) for k in range(3))
    maps, out = _folded([r[3] for r in rows]), set()
    for i in np.flatnonzero(sides == sides.max()):
        near = np.flatnonzero(((sides != sides[i]) if sides.max() else np.arange(len(rows)) < i) & (roots != roots[i]))
        need = -(-percent * (sizes[near] + sizes[i]) // (100 + percent))
        fits = near[(np.bitwise_count(maps[i] & ~maps[near]).sum(1) <= sizes[i] - need) & (np.bitwise_count(maps[near] & ~maps[i]).sum(1) <= sizes[near] - need)]
        if len(fits):
            out.update(fits.tolist(), (int(i),))
    return out


def _block_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            key, held = None, []
            for sig, *row in rows_of(batches):
                if sig != key and held:
                    yield from block(held)
                    held = []
                key = sig
                held.append(row)
            if held:
                yield from block(held)

        def block(rows):
            if 1 < len(rows) <= FEW:
                yield from few_stars(rows, percent)
            elif len(rows) > FEW:
                ids, sizes, maps = zip(*rows, strict=True)
                yield from bounded_stars(np.array(ids), np.array(sizes), _folded(maps), percent)

        yield from batched(each(), _EDGES, 10_000)

    return run


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each tile, which come together and name it first."""
    held: list[tuple] = []
    for row in rows_of(batches):
        if held and held[0][0] != row[0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _tile_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for rows in _by_tile(batches):
                _, sides, roots, ids, texts = zip(*rows, strict=True)
                yield from compare(list(ids), [shingle_set(t, width) for t in texts], percent, list(sides) if any(sides) else None, list(roots))

        yield from batched(each(), _EDGES, 10_000)

    return run


_NEEDED = pa.schema([("tile", pa.string()), ("side", pa.int32()), ("root", pa.int64()), ("doc_id", pa.int64())])


def _passing_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for rows in _by_tile(batches):
                for k in sorted(passing([(side, size, root, maps) for _, side, root, _, size, maps in rows], percent)):
                    yield rows[k][:4]

        yield from batched(each(), _NEEDED, 10_000)

    return run


def _blocks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with the blocks (column ``subs``) that the documents of the same keys are cut into."""
    sizes = docs.groupBy(*keys).agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    subs = F.ceil(F.greatest(F.col("c") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES, F.lit(1)))
    return docs.join(written(sizes.select(*keys, subs.alias("subs")), "block-counts"), keys)  # written: hot keys can be split


def _band(percent: int):
    return F.floor(F.log(F.col("n_shingles").cast("double") + 0.5) / math.log(100 / percent))


def _cross_tiles(docs: DataFrame, percent: int) -> DataFrame:
    """tile, side, root, doc_id, n_shingles, bitmap: where documents in different roots of a component meet.

    A root with many documents of a band has blocks of its own, the others of the band share blocks. Blocks meet
    those of their own and the neighbouring bands, but never others of the same root."""
    docs = docs.withColumn("band", _band(percent))
    of_root = docs.groupBy("component", "band", "root").agg(F.count("*").alias("of_root"))
    docs = docs.join(written(of_root, "root-counts"), ["component", "band", "root"])
    docs = docs.withColumn("kind", F.when(F.col("of_root") > BLOCK_DOCS, F.col("root").cast("string")).otherwise(""))
    keys = ["component", "band", "kind"]
    placed = written(_blocks(docs, keys).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("subs"))).select(*keys, "sub", "root", "doc_id", "n_shingles", "bitmap"), "placed")
    kinds = placed.select(*keys).distinct()
    side = lambda df, x: df.select("component", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "component"))
    met = side(kinds, "a").join(side(kinds, "b"), "component").filter("abs(band_a - band_b) <= 1 and (kind_a <> kind_b or kind_a = '')")
    met = met.filter(F.struct("band_a", "kind_a") <= F.struct("band_b", "kind_b"))
    blocks = placed.select(*keys, "sub").distinct()
    pairs = met.join(side(blocks, "a"), ["component", "band_a", "kind_a"]).join(side(blocks, "b"), ["component", "band_b", "kind_b"])
    pairs = pairs.filter("(band_a, kind_a) <> (band_b, kind_b) or sub_a <= sub_b")
    own = F.expr("(band_a, kind_a, sub_a) = (band_b, kind_b, sub_b)")
    pairs = written(pairs.withColumn("tile", F.concat_ws("/", "component", "band_a", "kind_a", "sub_a", "band_b", "kind_b", "sub_b")).withColumn("own", own), "block-pairs")
    first, second = (pairs.select("component", *(F.col(f"{c}_{x}").alias(c) for c in ("band", "kind", "sub")), "tile", F.when(F.col("own"), 0).otherwise(k).alias("side")) for k, x in ((1, "a"), (2, "b")))
    ends = first.unionByName(second.filter("side = 2"))
    return placed.join(ends, [*keys, "sub"]).select("tile", "side", "root", "doc_id", "n_shingles", "bitmap")


def signature_blocks(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, doc_id) of blocks that are compared, and edges (a, b) that span the larger ones.

    Blocks are counted by a pre-aggregated group and an equi-join that adaptive execution can split."""
    blocks = written(sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).filter("n > 1"), "blocks")
    met = sigs.join(blocks, "sig")
    star = met.filter(F.col("n") > BLOCK_DOCS).select(F.col("doc_id").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return met.filter(F.col("n") <= BLOCK_DOCS).select("sig", "doc_id"), star


def _rooted(docs: DataFrame, links: DataFrame) -> DataFrame:
    """``docs`` with the roots that the links give, of components that still have several."""
    found = written(connected_components(links).select(F.col("node").alias("root"), F.col("component").alias("to")), "found")
    docs = docs.join(found, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
    docs = written(docs, "rooted")
    open_ones = docs.groupBy("component").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("component")
    return docs.join(written(open_ones, "open"), "component")


def group_links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components of documents within candidate groups (doc_id, component)."""
    docs = groups.join(nodes.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    docs = written(docs.withColumn("root", F.col("doc_id")), "grouped")
    sizes = docs.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    docs = docs.join(written(sizes, "group-sizes"), "component")
    is_small = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= BLOCK_SHINGLES)

    def links(tiles: DataFrame) -> DataFrame:
        placed = tiles.select("tile", "side", "root", "doc_id").join(texts, "doc_id").select("tile", "side", "root", "doc_id", "text")
        return placed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_rows(width, percent), "a long, b long")

    found = links(docs.filter(is_small).select(F.col("component").cast("string").alias("tile"), F.lit(0).alias("side"), "root", "doc_id"))
    large = docs.filter(~is_small).select("component", "root", "doc_id", "n_shingles")
    if large.isEmpty():
        return found
    placed = _blocks(large.withColumn("band", _band(percent)), ["component", "band"])
    placed = written(placed.withColumn("tile", F.concat_ws("/", "component", "band", F.pmod(F.xxhash64("doc_id"), F.col("subs")))), "placed")
    # the same few documents in all blocks of a group: near copies in different blocks meet through them
    order = F.row_number().over(Window.partitionBy("component", "band").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    shared = placed.withColumn("_rn", order).filter(F.col("_rn") <= SHARED).select("component", "root", "doc_id")
    tiles = placed.select("tile", "root", "doc_id").unionByName(placed.select("component", "tile").distinct().join(written(shared, "shared"), "component").select("tile", "root", "doc_id")).distinct()
    within = written(links(tiles.withColumn("side", F.lit(0))), "links")
    apart = written(_rooted(large, within), "apart")
    if apart.isEmpty():
        return found.unionByName(within)
    maps = nodes.groupBy("doc_id").agg(F.max_by("bitmap", "n_shingles").alias("bitmap"))
    met = _cross_tiles(apart.join(maps, "doc_id"), percent)
    needed = met.repartition("tile").sortWithinPartitions("tile").select("tile", "side", "root", "doc_id", "n_shingles", "bitmap").mapInArrow(_passing_rows(percent), "tile string, side int, root long, doc_id long")
    return found.unionByName(within).unionByName(links(written(needed, "needed")))


def ngram_jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text).

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(texts.mapInArrow(_doc_rows(width, percent), "doc_id long, n_shingles long, set_hash binary, bitmap binary, sigs array<bigint>"), "shingle-sets")
    known = every.filter("doc_id is not null and n_shingles > 0")
    # of equal sets, the least document goes on; all else depends on the set alone
    nodes = written(known.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "bitmap", "sigs"))), "sets")
    met, star = signature_blocks(nodes.select(F.explode("sigs").alias("sig"), "doc_id"))
    placed = met.join(nodes.select("doc_id", "n_shingles", "bitmap"), "doc_id").select("sig", "doc_id", "n_shingles", "bitmap")
    candidates = placed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_block_rows(percent), "a long, b long").unionByName(star)
    groups = connected_components(candidates).withColumnRenamed("node", "doc_id")
    links = group_links(groups, nodes, texts, width, percent)
    # a document with several texts links their sets
    several = known.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("lo <> hi").select("doc_id")
    shared = known.select("doc_id", "set_hash").join(written(several, "several"), "doc_id").join(nodes.select("set_hash", F.col("doc_id").alias("b")), "set_hash").select(F.col("doc_id").alias("a"), "b")
    linked = connected_components(links.unionByName(shared)).withColumnRenamed("node", "doc_id")
    least = nodes.select("set_hash", "doc_id").join(linked, "doc_id", "left").select("set_hash", F.coalesce("component", "doc_id").alias("least"))
    out = every.select("doc_id", "n_shingles", "set_hash").join(written(least, "least"), "set_hash", "left")  # written: a hot set can be split
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))
