"""Ranked lexical search: the highest-scoring documents of each query item, exactly.

Method. A task holds a share of the documents, numbered by ascending id, and a posting list per term: document
numbers and impacts (what the term adds to a document's score). Over each list lies a sparse table for range maxima, so the greatest
impact of a term in any interval of documents takes two look-ups. An item is answered best first: the sum of its terms' maxima
bounds every document of an interval; the interval with the greatest bound is split at the document of its greatest single
impact, which is scored exactly; intervals of at most LEAF documents are scored whole; and no interval is looked at
whose bound can't reach the last of the best ``k`` found so far. Every task returns its ``k`` best of each item, and Spark keeps the best of those.

A first pass over the documents counts the items' terms in them, which gives document frequencies, lengths and the number of documents; it
writes a row per document. Items come in blocks of about BLOCK_BYTES, each with its own pass, so what is sent to tasks is bounded.

Defined results: null text has no terms; a document without terms isn't counted; items without terms, or whose terms
no document holds, have no rows; terms of weight 0 add nothing, and documents of score 0 aren't returned; rows of one item id
are one item, by the least of their texts; a null item id is an item; every document row counts, repeated ones too; equal scores come by ascending id, null ids
last; very long texts are read whole; empty tables give no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, rows_of, written

#: Bytes of item texts in a block, about.
BLOCK_BYTES = 4 << 20
#: Postings of a task, about; it holds them and about four bytes a level of the sparse tables for each.
POSTINGS_PER_TASK = 500_000
#: Documents of an interval that is scored whole.
LEAF = 256
BEST = 10
#: What parts terms (all other ASCII), and letters in their lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Postings:
    """Posting lists of the documents 0, 1, ... , one behind the other, with their range-maximum tables.

    ``table[j, i]`` is the place of the greatest impact among the ``2**j`` postings from ``i``; an entry that runs over the end of
    its list is never read. Of equal impacts one from the middle is taken rather than the first, so that splits stay even."""

    def __init__(self, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        self.n_docs, self.doc, self.impact, term = n_docs, doc[order], impact[order], term[order]
        self.keys = term.astype(np.int64) * n_docs + self.doc
        known, first, sizes = np.unique(term, return_index=True, return_counts=True)
        self.span = {int(t): (int(a), int(a + n)) for t, a, n in zip(known, first, sizes, strict=True)}
        levels = int(sizes.max()).bit_length() if len(sizes) else 1
        self.table = np.empty((levels, len(term)), np.int32)
        self.table[0] = np.arange(len(term))
        for j in range(1, levels):
            half = 1 << (j - 1)
            below, now = self.table[j - 1], self.table[j]
            now[:] = below
            left, right = below[:-half], below[half:]
            a, b = self.impact[left], self.impact[right]
            now[:-half] = np.where((a > b) if j % 2 else (a >= b), left, right)
        self.scored = 0  # documents that were scored

    def _maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the greatest impacts in posting ranges that aren't empty."""
        level = np.frexp(end - begin)[1] - 1
        a, b = self.table[level, begin], self.table[level, end - (1 << level)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def best(self, item: dict[int, int], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(document, score) of the best ``k``, for an item given as term: times. ``ids`` are the documents' ids, ascending."""
        known = [t for t in item if t in self.span]
        times = np.array([item[t] for t in known], np.int64)
        offset = np.array(known, np.int64) * self.n_docs
        ranges = np.array([self.span[t] for t in known], np.int64).reshape(-1, 2)
        found: list[tuple[int, int]] = []  # (score, -document), the worst first

        def hopeless(bound: int, first: int) -> bool:
            return bound <= 0 or len(found) == k and (bound < found[0][0] or bound == found[0][0] and ids[first] > ids[-found[0][1]])

        def offer(score: int, document: int) -> None:
            if score > 0:
                (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (score, -document))

        waiting: list[tuple] = []

        def push(low: int, high: int, which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
            some = end > begin
            if not some.all():
                which, begin, end = which[some], begin[some], end[some]
            if len(which):
                at = self._maxima(begin, end)
                parts = times[which] * self.impact[at]
                bound = int(parts.sum())
                if not hopeless(bound, low):
                    heapq.heappush(waiting, (-bound, low, high, int(self.doc[at[parts.argmax()]]), which, begin, end))

        push(0, self.n_docs, np.arange(len(known)), ranges[:, 0], ranges[:, 1])
        while waiting:
            bound, low, high, middle, which, begin, end = heapq.heappop(waiting)
            if hopeless(-bound, low):
                break  # the others have lower bounds, or begin later
            if high - low <= LEAF:
                sizes = end - begin
                at = np.arange(sizes.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                scores = np.zeros(high - low, np.int64)
                np.add.at(scores, self.doc[at] - low, self.impact[at] * np.repeat(times[which], sizes))
                self.scored += high - low
                for d in np.flatnonzero(scores >= (found[0][0] if len(found) == k else 1)):
                    offer(int(scores[d]), low + int(d))
                continue
            at = np.searchsorted(self.keys, offset[which] + middle)
            own = at < end
            own[own] = self.doc[at[own]] == middle
            self.scored += 1
            offer(int((times[which[own]] * self.impact[at[own]]).sum()), middle)
            push(low, middle, which, begin, at)
            push(middle + 1, high, which, at + own, end)
        return [(-d, score) for score, d in sorted(found, key=lambda x: (-x[0], -x[1]))]


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tf of every document with a term: its length, and its counts of the terms of ``vocabulary`` by their places."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # a block of items bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get

        def each() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                if found := terms(text):
                    counts = Counter(map(place, found))
                    counts.pop(None, None)
                    yield doc_id, len(found), list(counts), list(counts.values())

        yield from batched(each(), _COUNTED, 5000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass
class Block:
    """Items (term: times), weights of the terms, number of documents and of all their terms."""

    items: list[dict[int, int]]
    weights: list[int]
    docs: int
    length: int


def postings_of(rows: list[tuple], block: Block) -> tuple[Postings, np.ndarray]:
    """Postings of (doc_id, n, terms, tf) rows, and the ids by document number; null ids come last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    none = np.iinfo(np.int64).max
    ids = np.array([none if r[0] is None else r[0] for r in rows], np.int64)
    share = np.array([25 + 75 * r[1] * block.docs // block.length for r in rows], np.int64)
    sizes = [len(r[2]) for r in rows]
    doc = np.repeat(np.arange(len(rows)), sizes)
    term, tf = (np.fromiter((x for r in rows for x in r[k]), np.int64, len(doc)) for k in (2, 3))
    impact = np.array(block.weights, np.int64)[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * share[doc]))
    some = impact > 0
    return Postings(len(rows), term[some], doc[some], impact[some]), ids


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = shared.value, list(rows_of(batches))
        if not rows:
            return
        postings, ids = postings_of(rows, block)
        null = [r[0] is None for r in rows].count(True)
        known = len(rows) - null
        each = ((i, int(ids[d]) if d < known else None, score) for i, item in enumerate(block.items) for d, score in postings.best(item, ids, k))
        yield from batched(each, _FOUND, 20_000)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES, per_task: int = POSTINGS_PER_TASK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    asked = items.groupBy("item_id").agg(F.min(F.col("text").cast("string")).alias("text")).filter("text is not null")
    size = asked.agg(F.sum(F.length(F.encode("text", "UTF-8")))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    out = None
    for b in range(blocks):
        found = _search_block(docs, asked.filter(F.col("block") == b), k, per_task)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, asked: DataFrame, k: int, per_task: int) -> DataFrame:
    spark = docs.sparkSession
    rows = sorted(asked.select("item_id", "text").collect(), key=lambda r: (r.item_id is None, str(r.item_id)))  # one block
    found = [Counter(terms(r.text)) for r in rows]
    vocabulary = sorted(set().union(*found))
    counted = written(count_terms(docs, vocabulary), "counted")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    frequency = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per term of the block
    place = {t: i for i, t in enumerate(vocabulary)}
    weights = [weight(total.docs, frequency.get(i, 0)) for i in range(len(vocabulary))]
    block = Block([{place[t]: c for t, c in sorted(x.items())} for x in found], weights, total.docs, total.length or 1)
    shared = spark.sparkContext.broadcast(block)  # of about ``block_bytes``
    tasks = max(1, math.ceil((total.postings or 0) / per_task))
    dealt = counted.filter(F.size("terms") > 0).repartition(tasks, F.xxhash64("doc_id", F.monotonically_increasing_id()))  # any share of the documents will do
    best = dealt.mapInArrow(_search(shared, k), "item int, doc_id long, score long")
    place_of = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(place_of)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {dict(asked.dtypes)['item_id']}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS length FROM d WHERE len(words) > 0),
p AS (SELECT r, doc_id, len(words)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, words, unnest(words) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
