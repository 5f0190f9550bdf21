"""Best-fit packing of token pieces into fixed-length training sequences.

Method. Bounded-space online best fit: a packer keeps a fixed number of open bins. A bitset whose
bit ``f`` says that some open bin has ``f`` tokens free finds the tightest bin by one shift; if
none fits, a bin is opened, and when too many are open the fullest closes first. The packer is online: it
places each piece as it comes and never moves it. Spark settles in which order pieces come: it deals them out
by a hash, and sorts a partition by windows of about WINDOW pieces (by hash) and falling length within a
window. The order depends on the pieces alone, so a retried task repeats its result, whatever the size of its
Arrow batches. Token ids are written once and don't travel: only lengths are shuffled.

Defined results: null text is the empty text and still gives its end token; only documents longer
than a sequence are cut, and very long ones give as many pieces as they take; repeated rows are packed once each; an empty table gives no rows; other
columns are ignored, whatever their names."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, remembered, rows_of, written

SEQUENCE = 2048
OPEN_BINS = 1024
#: Pieces of a window, about; they come by falling length.
WINDOW = 4000
#: Characters of texts that are tokenized at once, or one text.
HELD_CHARS = 4 << 20
#: Pieces that one packer gets; more of them leave fewer bins half full.
PIECES_PER_TASK = 150_000


class WordTokenizer:
    """Token ids of texts, from the ids of their space-separated runs.

    The tokenizer never joins characters across white space, so a text's ids are those of its
    runs in order; runs repeat, so most are looked up. New plain words are encoded many at a time,
    and cut apart after the tokens that end a word. Values are little-endian 32-bit ids."""

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before ``known`` was begun anew

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _runs(self, text: str) -> list[str]:
        if "|>" not in text and self._latin(text):  # lower-casing is one to one there, and special tokens aren't touched
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _recall(self, runs: set[str]) -> set[str]:
        """Runs that weren't known before either; the others are taken over."""
        found = runs & self.older.keys()
        self.known.update((r, self.older[r]) for r in found)
        return runs - found

    def _learn(self, new: set[str]) -> None:
        """Enters the ids of new runs; a word with one mark after it is the word's ids and the mark's."""
        new = self._recall(new)
        marked = {r: (r[:-1], r[-1]) for r in new if r[-1:] in (".", ",") and r[:-1].isalpha()}
        single = {p for pair in marked.values() for p in pair}.union(new - marked.keys()) - self.known.keys()
        single = self._recall(single)
        plain = [r for r in single if r.isalpha()]
        groups = [g for i in range(0, len(plain), 500) if self._latin("".join(g := plain[i : i + 500]))]
        rest = list(single.difference(*groups))
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            cuts, raw = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()], ids.tobytes()
            if len(cuts) != len(group) + 1:
                raise ValueError("the tokenizer does not end every word with a token of its own")
            self.known.update((w, raw[a:b]) for w, a, b in zip(group, cuts, cuts[1:], strict=False))
        self.known.update((r, ids.tobytes()) for r, ids in zip(rest, self._encode(rest), strict=True))
        self.known.update((r, self.known[word] + self.known[mark]) for r, (word, mark) in marked.items())

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        runs = [self._runs(t) for t in texts]
        found = [list(map(self.known.get, r)) for r in runs]
        cold = [k for k, f in enumerate(found) if None in f]
        self._learn({r for k in cold for r, f in zip(runs[k], found[k], strict=True) if f is None})
        for k in cold:
            found[k] = map(self.known.__getitem__, runs[k])
        return [b"".join(f) for f in found]


def tokenizer(path: str) -> WordTokenizer:
    return remembered(f"tokenizer {path}", lambda: WordTokenizer(path))


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _cut(path: str, longest: int, with_ids: bool, keep_words: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            held: list[tuple] = []
            size = 0
            for row in rows_of(batches):
                held.append(row)
                size += len(row[1] or "")
                if len(held) == 500 or size >= HELD_CHARS:
                    yield from pieces(held)
                    held, size = [], 0
            yield from pieces(held)

        def pieces(rows):
            found = tokenizer(path).ids([t or "" for _, t in rows])
            for (doc_id, _), ids in zip(rows, found, strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * longest)):
                    part = ids[at : at + 4 * longest]
                    yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None

        try:
            yield from batched(each(), _PIECES, 5000)
        finally:
            if not keep_words:
                tokenizer(path).forget()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = True, keep_words: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit, null unless asked for).

    Workers keep the words that they know from task to task, if ``keep_words``: faster, but their memory isn't there for other stages."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(tokenizer_path, size, with_ids, keep_words), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


class OpenBins:
    """Open bins of one packer."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.count = size, most, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of an item that is no longer than a bin."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.opened
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return number


def _pack(size: int, open_bins: int, length_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(size, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(length_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def best_fit(pieces: DataFrame, keys: list[str], size: int = SEQUENCE, open_bins: int = OPEN_BINS, tasks: int = 1, windows: int = 1) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` is from 1 to ``size``.

    ``keys`` names columns that fix the order; ``tasks`` is the number of packers, each of which gets its pieces
    in so many ``windows`` of falling length."""
    window = F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(windows))
    shuffled = pieces.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(window, F.desc("length"), F.xxhash64(*keys, F.lit(9)), *keys)
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return shuffled.mapInArrow(_pack(size, open_bins, pieces.columns.index("length")), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, keep_words: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = written(token_pieces(docs, tokenizer_path, size, with_ids=False, keep_words=keep_words).drop("ids"), "pieces")
    n = pieces.count()
    tasks = max(1, math.ceil(n / PIECES_PER_TASK))
    return best_fit(pieces, ["doc_id", "piece", "ids_crc32"], size, tasks=tasks, windows=max(1, math.ceil(n / tasks / WINDOW)))


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, for writing training files."""
    joined = placed.join(pieces_with_ids.select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece"]), ["doc_id", "piece"])
    return joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
