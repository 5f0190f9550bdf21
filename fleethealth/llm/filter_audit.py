"""How filters interact: what each would remove, in every order in which they could be applied.

Method. Each document gets a mask of the filters that it fails. Per part, the masks' counts make a decision diagram:
a level per filter, a node per distinct remainder (equal remainders are one node), and at every node the weights of
the documents below it (all, good ones, toxic ones). The path on which every filter passes gives an order's steps:
the weight left below its low child is kept, that below its high child is removed. Other orders come from the same
diagram by swapping two adjacent levels, one swap an order (plain changes). Spark counts masks, pre-aggregated in
the tasks, so a part's diagram is built from at most two to the number of filters rows, however many documents it has.

Defined results: null text is the empty text and null ``lang`` the part of the empty string; a document is a copy if
a smaller id has the same text (compared by SHA-256), so rows of one id aren't copies of each other, and a null id
is neither smaller nor larger than another; repeated rows count each; of several label rows of an id, one that says so is enough; a document without
labels is neither good nor toxic; a measurement equal to a filter's limit passes; very long texts are measured whole;
an empty table gives no rows; other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import written

#: Word separators, signs, capital letters.
SPACE = " \t\n\x0b\x0c\r"
SIGNS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
WEIGHTS = ("docs", "good", "toxic")
#: Filters of an audit, at most: eight have 40 320 orders.
MOST_FILTERS = 8


def orders(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """All orders of ``n`` things, each from the last by one swap of neighbours; and the place of that swap."""
    order, direction = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        movable = [v for i, v in enumerate(order) if 0 <= i + direction[v] < n and order[i + direction[v]] < v]
        if not movable:
            return
        v = max(movable)
        i = order.index(v)
        j = i + direction[v]
        order[i], order[j] = order[j], order[i]
        for larger in range(v + 1, n):
            direction[larger] *= -1
        yield tuple(order), min(i, j)


class Diagram:
    """A decision diagram over ``n`` filters; every node has a low child (passes), a high child (fails) and weights.

    Nodes of a level are unique by their children, leaves by their weights. ``order`` names the filter of each level."""

    def __init__(self, n: int, counts: dict[int, tuple[int, ...]]):
        self.order = list(range(n))
        self.weight: dict[int, tuple[int, ...]] = {}
        self.children: dict[int, tuple[int, int]] = {}
        zero = (0,) * len(next(iter(counts.values()), ()))
        leaves: dict[tuple[int, ...], int] = {}
        row = []
        for place in range(1 << n):  # the first filter is the highest bit of a place
            mask = sum(1 << k for k in range(n) if place >> (n - 1 - k) & 1)
            w = counts.get(mask, zero)
            if w not in leaves:
                leaves[w] = self._fresh(w)
            row.append(leaves[w])
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        for level in reversed(range(n)):
            row = [self._node(level, pair) for pair in zip(row[::2], row[1::2], strict=True)]
        self.root = row[0]

    def _fresh(self, weight: tuple[int, ...]) -> int:
        self.weight[len(self.weight)] = weight
        return len(self.weight) - 1

    def _node(self, level: int, pair: tuple[int, int]) -> int:
        if pair not in self.levels[level]:
            new = self._fresh(tuple(a + b for a, b in zip(*map(self.weight.__getitem__, pair), strict=True)))
            self.children[new], self.levels[level][pair] = pair, new
        return self.levels[level][pair]

    def swap(self, level: int) -> None:
        """Exchanges the filters of ``level`` and the next. Nodes above keep their children, as a node keeps its meaning."""
        upper, self.levels[level], self.levels[level + 1] = self.levels[level], {}, {}
        for (low, high), node in upper.items():
            (ll, lh), (hl, hh) = self.children[low], self.children[high]
            pair = self._node(level + 1, (ll, hl)), self._node(level + 1, (lh, hh))
            self.children[node], self.levels[level][pair] = pair, node
        self.order[level : level + 2] = reversed(self.order[level : level + 2])

    def all_pass(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights kept, weights removed) of each step of the present order."""
        node = self.root
        for k in self.order:
            low, high = self.children[node]
            yield k, self.weight[low], self.weight[high]
            node = low


def audit_counts(counts: dict[int, tuple[int, ...]], names: str) -> Iterator[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, further weights removed, shapley: all orders' steps.

    The first weight counts documents. What a filter removes as the first is all that fail it, and as the last what
    fails it only."""
    n = len(names)
    diagram, steps, fails, only, shapley = Diagram(n, counts), [], [0] * n, [0] * n, [0] * n
    for order, at in orders(n):
        if at is not None:
            diagram.swap(at)
        for step, (k, kept, removed) in enumerate(diagram.all_pass()):
            shapley[k] += removed[0]
            if step == 0:
                fails[k] = removed[0]
            if step == n - 1:
                only[k] = removed[0]
            steps.append(("".join(names[i] for i in order), step + 1, k, kept[0], removed))
    for name, step, k, kept, removed in steps:
        yield name, step, kept, removed[0], fails[k] - removed[0], only[k], *removed[1:], shapley[k]


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row: bit k of the mask says that the document fails the filter FILTERS[k]."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(SPACE))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    n = F.size("words")
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    failed = [n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * capitals > 10 * F.length("text"), F.col("text").rlike(SIGNS)]
    own = written(rows.select("doc_id", "part", _bits(failed).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    several = own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = own.join(written(several, "copies"), "digest", "left")  # written, so that a text with very many copies can be split
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return met.select("doc_id", "part", F.col("own").bitwiseOR(F.when(copy, 1 << len(failed)).otherwise(0)).alias("mask"))


def _bits(failed: list[Column]) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed)), F.lit(0))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with good and toxic, 1 or 0."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    return masks.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step; ``masks`` has part, mask, good and toxic."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters can be audited in all orders")
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def steps(frame: pd.DataFrame) -> pd.DataFrame:  # a row per mask
        got = {int(r.mask): tuple(int(getattr(r, w)) for w in WEIGHTS) for r in frame.itertuples()}
        out = pd.DataFrame(audit_counts(got, names), columns=columns)
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    kinds = ", ".join(f"{c} long" for c in columns[2:])
    return counts.groupBy("part").applyInPandas(steps, f"part string, filter_order string, step int, {kinds}")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
  AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS earlier FROM o, generate_series(1, 5) AS g(step)),
r AS (SELECT part, filter_order, step, bit, sum(docs * (mask & (earlier | bit) = 0)::INT) AS kept, sum(docs * (mask & earlier = 0 AND mask & bit <> 0)::INT) AS removed,
  sum(docs * (mask & earlier <> 0 AND mask & bit <> 0)::INT) AS redundant, sum(docs * (mask = bit)::INT) AS unique_fails,
  sum(good * (mask & earlier = 0 AND mask & bit <> 0)::INT) AS good_lost, sum(toxic * (mask & earlier = 0 AND mask & bit <> 0)::INT) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
