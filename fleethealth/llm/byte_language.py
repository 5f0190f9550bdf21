"""Language identification by a bidirectional gated recurrent network over bytes.

Method. A text's UTF-8 bytes are read in segments of SEGMENT bytes, forwards and backwards, by gated recurrent units
with one weight table per direction; both states together give every byte position a probability of each language,
and a text's probabilities are the means over all its positions. Gates and candidates use x / (1 + |x|) in the place
of the logistic function and the hyperbolic tangent, as it costs a fraction of them. The network is trained in numpy by
backpropagation through time, with a loss at every position, on a bounded sample: at most PER_LANGUAGE documents of a
language, by hash, and PIECES segments of each. Languages count alike, whatever their shares. Every language is an output, so weights grow with
the number of languages. Prediction reads whole texts, many segments of several texts side by side.

Defined results: null text, and text without a letter (Unicode category L), is ``und`` with score 0; so is all text if nothing could
be learned; rows with a null language or id are never learned from, but predicted like others (a null id isn't held
out); repeated rows are predicted alike; of equal probabilities the language first in order wins; an empty table gives no rows; other columns are ignored,
whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, rows_of

#: Bytes of a segment: states begin at zero at both its ends.
SEGMENT = 128
#: Bounds of the training sample.
PER_LANGUAGE, PIECES = 500, 4
UNITS = 12
#: Segments that are read side by side: in training, and in prediction for up to 16 languages.
TRAINED, READ = 192, 1024
STEPS, RATE = 250, 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


#: Places of the update gate, the reset gate and the candidate in weights and sums.
UPDATE, RESET, WANTED = range(3)


@dataclass
class Network:
    """``inputs`` (3, 2, 256, h): what a byte adds to gates and candidate, by direction; ``states`` (3, 2, h, h), ``outputs`` (2, h, n), ``bias`` (n)."""

    inputs: np.ndarray
    states: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, n: int, units: int = UNITS, seed: int = 0, kind: str = "f4") -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(kind)
        return cls(draw(3, 2, 256, units, scale=0.3), draw(3, 2, units, units, scale=units**-0.5), draw(2, units, n, scale=units**-0.5), np.zeros(n, kind))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.outputs, self.bias]


def _rows(ids: np.ndarray) -> np.ndarray:
    """(steps, 3, 2, sequences): rows of the flattened input table that gates and directions take at each step."""
    met = np.stack([ids.T, ids.T[::-1]], 1).astype(np.int32)
    return met[:, None] + (256 * np.arange(6, dtype=np.int32)).reshape(3, 2, 1)


def _alive(lengths: np.ndarray, steps: int, kind) -> np.ndarray | None:
    """(steps, 2, sequences, 1): whether a direction is inside its segment yet; none if all segments are whole."""
    if (lengths == steps).all():
        return None
    inside = np.arange(steps)[:, None] < lengths
    return np.stack([inside, inside[::-1]], 1)[..., None].astype(kind)


def _probabilities(net: Network, seen: np.ndarray) -> np.ndarray:
    """(languages, steps, sequences) from the states of all steps."""
    steps, _, count, h = seen.shape
    logits = [(net.outputs[k].T @ np.ascontiguousarray(seen[:, k]).reshape(-1, h).T).reshape(-1, steps, count) for k in (0, 1)]
    x = logits[0] + logits[1][:, ::-1] + net.bias[:, None, None]
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def read(net: Network, ids: np.ndarray, lengths: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States (steps, 2, sequences, h) of both directions over segments (sequences, steps); ``kept`` takes what the way back needs."""
    (count, steps), h, kind = ids.shape, net.states.shape[-1], net.bias.dtype
    rows, alive, table = _rows(ids), _alive(lengths, steps, kind), net.inputs.reshape(-1, h)
    seen, state = np.empty((steps, 2, count, h), kind), np.zeros((2, count, h), kind)
    x, back, room = (np.empty((k, 2, count, h), kind) for k in (3, 3, 2))
    for t in range(steps):
        np.take(table, rows[t], 0, out=x, mode="clip")
        np.matmul(state, net.states, out=back)
        gates, wanted, own = x[:WANTED], x[WANTED], back[WANTED]
        gates += back[:WANTED]
        np.abs(gates, out=room)
        room += 1
        gates /= room
        gates += 1
        gates *= 0.5
        if kept is not None:
            kept.append((state, own.copy(), room.copy(), gates.copy()))
        own *= gates[RESET]
        wanted += own
        breadth = np.abs(wanted, out=room[0])
        breadth += 1
        wanted /= breadth  # the candidate
        if kept is not None:
            kept[-1] += (breadth.copy(), wanted.copy())
        state = np.subtract(state, wanted, out=seen[t])
        state *= gates[UPDATE]
        state += wanted
        if alive is not None:
            state *= alive[t]
    return seen


def position_probabilities(net: Network, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(languages, steps, sequences), zero beyond a segment's length."""
    p = _probabilities(net, read(net, ids, lengths))
    if (lengths < ids.shape[1]).any():
        p *= np.arange(ids.shape[1])[:, None] < lengths
    return p


def loss_and_gradients(net: Network, ids: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of the segments ``ids`` (sequences, steps), and its gradients."""
    (count, steps), h = ids.shape, net.states.shape[-1]
    kept: list = []
    seen, rows = read(net, ids, lengths, kept), _rows(ids)
    alive = _alive(lengths, steps, net.bias.dtype)
    inside = np.arange(steps)[:, None] < lengths
    wrong, positions = _probabilities(net, seen), int(inside.sum())
    loss = float(-(np.log(np.maximum(wrong[target, :, np.arange(count)].T, 1e-12)) * inside).sum() / positions)
    wrong[target, :, np.arange(count)] -= 1
    wrong *= inside / positions
    by_way = np.stack([wrong, wrong[:, ::-1]]).transpose(2, 0, 3, 1)  # (steps, 2, sequences, languages)
    g_outputs = np.stack([seen[:, k].reshape(-1, h).T @ by_way[:, k].reshape(-1, len(net.bias)) for k in (0, 1)])
    g_seen = by_way @ net.outputs.transpose(0, 2, 1)
    g_states, g_rows = np.zeros_like(net.states), np.empty((steps, 3, 2, count, h), net.bias.dtype)
    falling, turned = np.zeros((2, count, h), net.bias.dtype), np.ascontiguousarray(net.states.swapaxes(-1, -2))
    for t in reversed(range(steps)):
        before, own, room, gates, breadth, candidate = kept[t]
        d, g = falling + g_seen[t], g_rows[t]
        if alive is not None:
            d *= alive[t]
        np.divide(d * (1 - gates[UPDATE]), breadth * breadth, out=g[WANTED])
        g[UPDATE], g[RESET] = d * (before - candidate), g[WANTED] * own
        g[:WANTED] *= 0.5 / (room * room)
        d_back = g.copy()
        d_back[WANTED] *= gates[RESET]
        g_states += before.swapaxes(-1, -2) @ d_back
        falling = d * gates[UPDATE] + (d_back @ turned).sum(0)
    order = np.argsort(rows, axis=None, kind="stable")
    present, first = np.unique(rows.ravel()[order], return_index=True)
    g_inputs = np.zeros_like(net.inputs)
    g_inputs.reshape(-1, h)[present] = np.add.reduceat(g_rows.reshape(-1, h)[order], first)
    return loss, [g_inputs, g_states, g_outputs, wrong.sum((1, 2))]


def train(segments: list[bytes], targets: np.ndarray, n: int, steps: int = STEPS, seed: int = 0) -> Network:
    """A network fitted by scaled gradient steps with momentum; each step draws segments, languages alike."""
    net, rng = Network.fresh(n, seed=seed), np.random.default_rng(seed + 1)
    members = [np.flatnonzero(targets == k) for k in range(n)]
    means, squares = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    for step in range(1, steps + 1):
        target = rng.integers(0, n, TRAINED)
        ids, lengths = padded([segments[rng.choice(members[k])] for k in target])
        _, gradients = loss_and_gradients(net, ids, lengths, target)
        size = float(np.sqrt(sum((g.astype(float) ** 2).sum() for g in gradients)))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parts(), gradients, means, squares, strict=True):
            g = g / max(1.0, size)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return net


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids (sequences, longest) and lengths of some segments."""
    lengths = np.array([len(s) for s in segments])
    longest = int(lengths.max())
    return np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in segments), np.uint8).reshape(len(segments), longest), lengths


@dataclass
class LanguageModel:
    languages: list[str]
    network: Network | None

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): means over the positions of each text; no text is empty."""
        at = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        at.sort(key=lambda x: min(SEGMENT, len(texts[x[0]]) - x[1]), reverse=True)  # like lengths side by side
        total, side = np.zeros((len(texts), len(self.languages))), READ * 16 // max(16, len(self.languages))
        for begin in range(0, len(at), max(1, side)):
            part = at[begin : begin + max(1, side)]
            ids, lengths = padded([texts[i][a : a + SEGMENT] for i, a in part])
            np.add.at(total, [i for i, _ in part], position_probabilities(self.network, ids, lengths).sum(1, dtype=float).T)
        return total / np.array([len(t) for t in texts])[:, None]


def _remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4))


def training_segments(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, segment: of at most ``per_language`` documents of each language, PIECES places each, by hash."""
    rows = docs.filter((_remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return rows.select("lang", F.encode("text", "UTF-8").alias("segment"))
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, 2.0 * per_language / r["count"]))))
    likely = rows.filter((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < F.element_at(shares, F.col("lang")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", F.xxhash64("text")))
    chosen = likely.withColumn("_rn", first).filter(F.col("_rn") <= per_language).select("lang", "h", F.encode("text", "UTF-8").alias("bytes"))
    places = F.greatest(F.length("bytes") - SEGMENT + 1, F.lit(1))
    segments = chosen.select("lang", F.explode(F.array_distinct(F.array(*(F.substring("bytes", (F.pmod(F.xxhash64("h", F.lit(k)), places) + 1).cast("int"), F.lit(SEGMENT)) for k in range(PIECES))))).alias("segment"))
    return segments


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE, steps: int = STEPS) -> LanguageModel:
    rows = sorted((r.lang, bytes(r.segment)) for r in training_segments(docs, per_language).collect())
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return LanguageModel([], None)
    targets = np.array([languages.index(lang) for lang, _ in rows])
    return LanguageModel(languages, train([s for _, s in rows], targets, len(languages), steps))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its languages bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        def predicted(held: list[tuple]) -> Iterator[tuple]:
            some = [(k, t.encode()) for k, (_, _, t) in enumerate(held) if model.languages and t and _LETTER.search(t)]
            found = dict(zip((k for k, _ in some), model.probabilities([t for _, t in some]), strict=True)) if some else {}
            for k, (doc_id, held_out, _) in enumerate(held):
                if k in found:
                    best = int(found[k].argmax())
                    yield doc_id, held_out, model.languages[best], min(1.0, round(float(found[k][best]), 6))
                else:
                    yield doc_id, held_out, UNKNOWN, 0.0

        def each() -> Iterator[tuple]:
            held, size = [], 0
            for row in rows_of(batches):
                held.append(row)
                size += len(row[2] or "")
                if size >= 4 * READ * SEGMENT or len(held) >= 5000:
                    yield from predicted(held)
                    held, size = [], 0
            yield from predicted(held)

        yield from batched(each(), _PREDICTED, 5000)

    held_out = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
