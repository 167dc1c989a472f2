"""Sharding by k-d tree: weighted median splits along the widest metadata dimension.

Every document has a weight, the bytes of its text, and a point: doc_id, source, lang and
the logarithm of its length. Strings become their numbers in the order of the table's different strings,
a sort of these over all executors. A node over the target bytes is divided at the weighted
median of the dimension that is widest relative to the whole table; the halves are
divided again until each leaf has at most the target. The median is exact: of the two cuts next to half the
weight, the nearer one, the later one of equals.

Only metadata is kept between levels, once, in shared storage. A node of more than LOCAL_ROWS documents takes two or more
aggregations over it: ranges and weights of the open nodes, then a histogram of each node's chosen
dimension, refined around the median until the bucket that holds it has one value. Smaller nodes are grouped
by one shuffle of the metadata and divided to the end where they are, by the same rule, so the result doesn't depend on
LOCAL_ROWS. The driver sees one row per node of more than LOCAL_ROWS documents and one per smaller node right below
these: some 25,000 of each for 5e10 documents.

Result: doc_id, shard_id (dense, from 0, in tree order), bytes of the document.

Defined results: a null or empty text weighs one byte; nulls in a dimension count as its
least value; repeated rows and rows equal in all dimensions stay together, even
if their leaf then is over the target; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm._cut import cut

TARGET_BYTES = 64 << 20
DIMENSIONS = ("d0", "d1", "d2", "d3")
BUCKETS = 256
#: Different strings with their ranks are broadcast up to this size.
RANKS_BYTES = 16 << 20
#: Documents of a node that one task divides to the end, on 48 bytes of metadata each.
LOCAL_ROWS = 2_000_000
#: Small tables of open nodes are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_NODES = 500_000


def _numbered(docs: DataFrame, column: str) -> DataFrame:
    """docs with the strings of a column as their ranks among its different strings, from 1; null is 0."""
    spark = docs.sparkSession
    values = cut(docs.select(F.col(column).alias("_value")).where(F.col("_value").isNotNull()).distinct().orderBy("_value"))
    at = F.monotonically_increasing_id()  # the partition's number, then the row's within it
    part = F.shiftright(at, 33)
    sizes = sorted((r["p"], r["n"], r["b"]) for r in values.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(F.octet_length("_value")).alias("b")).collect())
    before, starts = 0, []
    for p, n, _ in sizes:
        starts.append((p, before))
        before += n
    offset = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))  # one row a partition
    ranks = values.select("_value", part.alias("_part"), (at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_row")).join(offset, "_part").select("_value", (F.col("_row") + F.col("_before")).cast("double").alias("_rank"))
    if sum(b + 32 * n for _, n, b in sizes) <= RANKS_BYTES:
        ranks = F.broadcast(ranks)
    return docs.join(ranks, F.col(column) == F.col("_value"), "left").withColumn(column, F.coalesce("_rank", F.lit(0.0))).drop("_value", "_rank")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, weight and the point of every document."""
    size = F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("weight"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(float(-(2**63)))).alias("d0"),
        F.col("source").alias("d1"),
        F.col("lang").alias("d2"),
        F.log2(size.cast("double")).alias("d3"),
    )
    return _numbered(_numbered(rows, "d1"), "d2")


class Tree:
    """Nodes as arrays: split dimension (-1 for a leaf), split value, and the left child (the right one follows it)."""

    def __init__(self):
        self.dim, self.value, self.left = [-1], [0.0], [0]

    def split(self, node: int, dim: int, value: float) -> tuple[int, int]:
        self.dim[node], self.value[node], self.left[node] = dim, value, len(self.dim)
        for _ in range(2):
            self.dim.append(-1)
            self.value.append(0.0)
            self.left.append(0)
        return self.left[node], self.left[node] + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.dim), np.array(self.value), np.array(self.left)

    def leaves(self) -> dict[int, int]:
        """Leaf number of every leaf node, left to right."""
        out, stack = {}, [0]
        while stack:
            node = stack.pop()
            if self.dim[node] < 0:
                out[node] = len(out)
            else:
                stack += [self.left[node] + 1, self.left[node]]
        return out


def descend(points: np.ndarray, dim: np.ndarray, value: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Leaf node of every point; values up to the split value go left."""
    node = np.zeros(len(points), np.int64)
    while True:
        inner = np.flatnonzero(dim[node] >= 0)
        if not len(inner):
            return node
        at = node[inner]
        node[inner] = left[at] + (points[inner, dim[at]] > value[at])


def _with_nodes(meta: DataFrame, tree: Tree) -> DataFrame:
    """meta with the node of every row."""
    shared = meta.sparkSession.sparkContext.broadcast(tree.arrays())  # three numbers a shard
    names = [*meta.columns, "node"]

    def run(batches):
        for batch in batches:
            points = np.stack([batch.column(d).to_numpy() for d in DIMENSIONS], axis=1) if batch.num_rows else np.zeros((0, len(DIMENSIONS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(descend(points, *shared.value), pa.int64())], names=names)

    return meta.mapInArrow(run, T.StructType([*meta.schema.fields, T.StructField("node", T.LongType())]))


def _node_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_NODES else table


def _medians(rows: DataFrame, chosen: dict[int, tuple[int, float, float, float]]) -> dict[int, float]:
    """Split value of each node: {node: (dimension, low, high, weight)} in, the largest value of the left half out."""
    spark = rows.sparkSession
    out: dict[int, float] = {}
    open_nodes = {n: (d, lo, hi, 0.0, w) for n, (d, lo, hi, w) in chosen.items()}
    while open_nodes:
        table = _node_table(spark, [(n, *x) for n, x in open_nodes.items()], "node long, dim int, lo double, hi double, before double, total double")
        x = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        inside = rows.join(table, "node").withColumn("x", x).where("x >= lo AND x <= hi")
        bucket = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        hist = inside.groupBy("node", "before", "total", F.when(F.col("hi") > F.col("lo"), bucket).otherwise(F.lit(0)).alias("bucket"))
        hist = hist.agg(F.sum("weight").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        # one row per node leaves the executors: the bucket that passes half the weight, what precedes it, and the value before
        running = hist.withColumn("upto", F.expr("sum(w) OVER (PARTITION BY node ORDER BY bucket)")).withColumn("prev", F.expr("lag(hi) OVER (PARTITION BY node ORDER BY bucket)"))
        half = running.where("before + upto >= total / 2").withColumn("rank", F.expr("row_number() OVER (PARTITION BY node ORDER BY bucket)")).where("rank = 1")
        for r in half.collect():
            d, _, _, before, total = open_nodes.pop(r["node"])
            left = before + r["upto"] - r["w"]
            if r["lo"] == r["hi"]:
                # cut after or before this value, whichever is nearer to half, so long as both sides keep something
                after, ahead = abs(before + r["upto"] - total / 2), abs(left - total / 2)
                last = before + r["upto"] >= total
                below = r["prev"] if r["prev"] is not None else np.nextafter(r["lo"], -np.inf)
                out[r["node"]] = below if (ahead < after or last) and left > 0 else r["hi"]
            else:
                open_nodes[r["node"]] = (d, r["lo"], r["hi"], left, total)
    return out


def build(meta: DataFrame, target: int, local_rows: int) -> tuple[Tree, list[float], set[int]]:
    """The top of the tree over meta by levels of simultaneous splits, the table's widths, and the nodes left to single tasks."""
    tree, local = Tree(), set()
    width: list[float] = [1.0] * len(DIMENSIONS)
    pending = {0}
    while pending:
        rows = _with_nodes(meta, tree)
        table = _node_table(meta.sparkSession, [(n,) for n in pending], "node long")
        ranges = [f(d).alias(f"{n}{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = rows.join(table, "node").groupBy("node").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), *ranges)
        chosen = {}
        for r in stats.collect():
            span = [r[f"hi{d}"] - r[f"lo{d}"] for d in DIMENSIONS]
            if r["node"] == 0:
                width = [s or 1.0 for s in span]
            rel = [s / w for s, w in zip(span, width, strict=True)]
            if r["w"] > target and max(rel) > 0:
                d = rel.index(max(rel))
                if r["n"] <= local_rows:
                    local.add(r["node"])
                else:
                    chosen[r["node"]] = (d, r[f"lo{DIMENSIONS[d]}"], r[f"hi{DIMENSIONS[d]}"], float(r["w"]))
        pending = set()
        for node, value in sorted(_medians(rows, chosen).items()):
            pending.update(tree.split(node, chosen[node][0], float(value)))
    return tree, width, local


def divide(points: np.ndarray, weight: np.ndarray, target: int, width: list[float]) -> np.ndarray:
    """Leaf number of every point, from 0 and left to right, of the tree over these points alone."""
    out = np.zeros(len(points), np.int64)
    stack, leaves = [np.arange(len(points))], 0
    while stack:
        rows = stack.pop()
        total, rel = weight[rows].sum(), np.ptp(points[rows], axis=0) / width if len(rows) else np.zeros(1)
        if total <= target or rel.max() <= 0:
            out[rows] = leaves
            leaves += 1
            continue
        x = points[rows, int(rel.argmax())]
        order = np.argsort(x, kind="stable")
        values, upto = x[order], np.cumsum(weight[rows][order])
        cuts = np.flatnonzero(values[1:] != values[:-1])
        off = np.abs(upto[cuts] - total / 2)
        best = cuts[len(cuts) - 1 - int(off[::-1].argmin())]
        rows = rows[order]
        stack += [rows[best + 1 :], rows[: best + 1]]
    return out


def _divided(target: int, width: list[float]):
    def run(table: pa.Table) -> pa.Table:
        points = np.stack([table.column(d).to_numpy() for d in DIMENSIONS], axis=1)
        leaf = divide(points, table.column("weight").to_numpy(), target, width)
        return pa.table({"node": table.column("node"), "leaf": pa.array(leaf), "doc_id": table.column("doc_id"), "weight": table.column("weight")})

    return run


def shard(docs: DataFrame, target: int = TARGET_BYTES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """doc_id, shard_id and bytes of every document."""
    spark = docs.sparkSession
    meta = cut(metadata(docs))
    tree, width, local = build(meta, target, local_rows)
    rows = _with_nodes(meta, tree)
    schema = "node long, leaf long, doc_id long, weight long"
    if local:
        table = _node_table(spark, [(n,) for n in local], "node long")
        inside = rows.join(table, "node").groupBy("node").applyInArrow(_divided(target, width), schema)
        whole = rows.join(table, "node", "left_anti").select("node", F.lit(0).cast("long").alias("leaf"), "doc_id", "weight")
        placed = cut(inside.union(whole))
        sizes = {r["node"]: r["n"] for r in placed.groupBy("node").agg((F.max("leaf") + 1).alias("n")).collect()}
    else:
        placed = rows.select("node", F.lit(0).cast("long").alias("leaf"), "doc_id", "weight")
        sizes = {}
    before, starts = 0, []
    for node in tree.leaves():
        starts.append((node, before))
        before += sizes.get(node, 1)
    offset = _node_table(spark, starts, "node long, before long")
    return placed.join(offset, "node").select("doc_id", (F.col("before") + F.col("leaf")).alias("shard_id"), F.col("weight").alias("bytes"))
