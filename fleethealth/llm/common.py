"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes, by a rough count from above, that close an Arrow batch.
BATCH_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary folder takes its place; on a cluster
    that is an error, since its machines don't share such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + _own_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_remembered: dict[str, object] = {}


def remembered(name: str, make):
    """What a Python worker keeps from task to task, for one operator at a time: what another operator left is let go.

    Workers outlive stages, and the word caches of several operators together would outgrow an executor's memory."""
    if name not in _remembered:
        _remembered.clear()
        _remembered[name] = make()
    return _remembered[name]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _weight(value) -> int:
    return len(value) * (8 if isinstance(value, (list, tuple)) else 4) if hasattr(value, "__len__") else 8


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches from an iterator of tuples: of at most ``size`` rows, and closed once they hold ``most_bytes``."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(map(_weight, row))
        if len(held) >= size or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: Edges that a task unites at once before components are looked for.
UNITED = 100_000
_STARS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every node of some edges, the smallest node that these edges lead to."""

    def stars(edges: list[tuple]) -> Iterator[tuple]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        yield from ((x, top) for x in root if (top := find(x)) != x)

    def each():
        held = []
        for edge in rows_of(batches):
            held.append(edge)
            if len(held) >= UNITED:
                yield from stars(held)
                held = []
        yield from stars(held)

    yield from batched(each(), _STARS, 20_000)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b); component is the smallest node reachable.

    Tasks unite their own edges first. Then each round gives a node the least label among its neighbours, and
    the label of its label, until nothing changes. Labels are written before they are joined, a row per node, so
    that adaptive execution splits the join of a node with very many edges; minima are pre-aggregated. Nodes
    without an edge to another are absent."""
    pairs = edges.filter("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    stars = pairs.mapInArrow(_united, "u long, v long").repartition("u")  # a node has one edge for each task that met it
    pairs = written(stars.mapInArrow(_united, "u long, v long").distinct(), "edges")  # most tasks find the same centres
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    before = None
    while True:
        beside = both.unionByName(labels.select("u", F.col("u").alias("v"))).join(labels.select(F.col("u").alias("v"), "label"), "v")
        labels = written(beside.groupBy("u").agg(F.min("label").alias("label")), "labels")
        labels = written(labels.join(labels.select(F.col("u").alias("label"), F.col("label").alias("next")), "label").select("u", F.col("next").alias("label")), "labels")
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("u", "label").cast("decimal(38,0)"))).first()
        if now == before:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        before = now
