"""Embedding near-dedup by collision counting over many sorted one-dimensional projections.

Vectors are scaled to length 1 and projected on random directions. Two vectors collide
in a direction if their projections are at most `half` apart: each lies in the window centred on
the other. A pair whose cosine is the threshold is at distance r = sqrt(2 - 2 threshold), so it
collides with probability p1 = P(|N(0, r^2/d)| <= half) per direction (d dimensions), and the number of
collisions over DIRECTIONS directions is binomial. The needed count is the largest c with
P(Binomial(DIRECTIONS, p1) >= c) >= sqrt(recall). Pairs that reach it are verified by their exact cosine.

Windows along one direction hold a fixed share of all vectors (0.44 of unrelated ones at 0.95), so joining
the table with itself along each sorted projection would make quadratically many rows. So
each of `groups` sorted projections is divided by g - 1 more directions: a vector goes to the
cell that these select on a randomly shifted grid, and query-centred windows slide along the sorted projection
within the cell. Every pair of a window has its collisions counted at once, over
all DIRECTIONS directions. A near pair shares its cell with a known probability, so the number of groups follows
from the recall target like the needed count does; g grows with the logarithm of the number of vectors, which
keeps cells small.

What travels per group is a cell, a position and the projections as one byte each in steps of half / STEPS, not the
vector. Vectors are fetched once the counting is done, by tiles of similar pairs as in the n-gram join.

Result: rows (vec_a, vec_b, cosine), vec_a < vec_b, each pair once. Ids with one and the same vector are pairs of the
smallest of them with each other one (cosine 1.0); different vectors that are similar are a pair of the smallest ids
of both. Every other pair follows; ``expand`` writes them out. ``vector_classes`` has a row per id instead: (vec_id, class_id, links), the
smallest id of those connected by similar pairs, and the number of other vectors that are similar; an id has a row for each different vector.

Defined results: null, empty and all-zero vectors and vectors with a null or non-finite component are not
similar to anything, nor are vectors of different lengths; rows with a null
vec_id are left out; repeated rows count once, and if a vec_id has several different vectors the pair has the
greatest cosine; a pair exactly at the threshold counts (cosines are sums in double precision, so 1e-12 is allowed
for their rounding); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import near_text
from tallyweave.llm._cut import cut

THRESHOLD = 0.95
RECALL = 0.97
#: Directions over which collisions are counted.
DIRECTIONS = 32
#: Half window in standard deviations of a pair at the threshold, and cell width in half windows.
WINDOW = 2.6
CELL = 4.0
#: Steps of the byte codes in half a window, and the largest code; values beyond it collide all the more.
STEPS = 8
CLIP = 60
#: Vectors that a cell should hold, by which g is chosen, and rows swept together.
OCCUPANCY = 512
SWEEP = 2048
_ROUNDING = 1e-12


class Plan:
    """Directions, numbers of groups and needed collisions for n vectors."""

    def __init__(self, n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL):
        self.threshold, self.dim = threshold, dim
        sigma = math.sqrt(max(1e-12, 2 - 2 * threshold)) / math.sqrt(dim)
        self.half = WINDOW * sigma
        self.side = CELL * self.half
        p1 = math.erf(WINDOW / math.sqrt(2))
        near = 1 - math.sqrt(2 / math.pi) / (CELL * WINDOW)  # both of a pair at the threshold in one cell, per direction
        apart = math.sqrt(2 / dim)  # deviation of the projected difference of two unrelated vectors
        far = min(0.95, max(0.05, 1 - math.sqrt(2 / math.pi) * apart / self.side, self.side / (2 * math.sqrt(math.pi) / math.sqrt(dim)) / 2))
        self.g = 1 + max(1, math.ceil(math.log(max(1.0, n / OCCUPANCY)) / -math.log(far)))
        each = math.sqrt(recall)  # both losses, by cells and by counting, get the same share
        self.groups = max(2, math.ceil(math.log(1 - each) / math.log(1 - near ** (self.g - 1))))
        self.needed = needed_collisions(DIRECTIONS, p1, each)
        rng = np.random.default_rng(11)

        def directions(count: int) -> np.ndarray:
            x = rng.standard_normal((dim, count))
            return (x / np.linalg.norm(x, axis=0)).astype(np.float32)

        self.counted = directions(DIRECTIONS)
        self.directions = directions(self.groups * self.g)
        self.offset = rng.random(DIRECTIONS)
        self.shift = rng.random(self.groups * self.g) * self.side
        self.weights = rng.integers(1, 1 << 62, self.groups * self.g) | 1


def needed_collisions(m: int, p: float, recall: float) -> int:
    """The largest c with P(Binomial(m, p) >= c) >= recall."""
    tail = 0.0
    for c in range(m, -1, -1):
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail >= recall:
            return c
    return 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cells(plan_shared):
    """Each vector once per group: its cell, its place along the sorted projection, and its codes."""

    def run(batches):
        plan = plan_shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = _matrix(part.column("v"), plan.dim)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                codes = np.clip(np.floor(x @ plan.counted * (STEPS / plan.half) + plan.offset), -CLIP, CLIP).astype(np.int8)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIRECTIONS), len(x), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                proj = x @ plan.directions
                grid = np.floor((proj + plan.shift) / plan.side).astype(np.int64) * plan.weights
                for k in range(plan.groups):
                    first = k * plan.g
                    cell = grid[:, first + 1 : first + plan.g].sum(1) + k
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(proj[:, first], pa.float32()), part.column("sid"), packed], names=["cell", "pos", "sid", "codes"])

    return run


def _sweep(plan_shared):
    """Pairs of a cell that collide often enough: windows slide along the sorted projection."""

    def run(batches):
        plan = plan_shared.value
        reach, misses = np.float32(plan.half * (1 + 1e-5)), DIRECTIONS - plan.needed
        early = DIRECTIONS // 4

        def match(new, old, same):
            """Pairs of a new row and an older one within half a window; if new is old, each once."""
            lo = np.searchsorted(old[0], new[0] - reach, "left")
            hi = np.arange(len(new[0])) if same else np.full(len(new[0]), len(old[0]))
            size = np.maximum(hi - lo, 0)
            ends = np.cumsum(size)
            at = 0
            while at < len(size):  # about 64k pairs at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 16), "right")))
                n = size[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)
                at = to
                for part in (slice(0, early), slice(early, None)):  # too many misses in the first directions already decide
                    missed = np.count_nonzero(np.abs(new[2][i, part] - old[2][j, part]) > STEPS, axis=1)
                    good = missed <= misses
                    i, j = i[good], j[good]
                    if part.start == 0:
                        before = missed[good]
                    else:
                        fine = missed[good] + before[good] <= misses
                        i, j = i[fine], j[fine]
                s, t = new[1][i], old[1][j]
                yield np.minimum(s, t), np.maximum(s, t)

        cell, kept = None, None
        for batch in batches:
            for a0 in range(0, batch.num_rows, SWEEP):
                part = batch.slice(a0, SWEEP)
                key, n = part.column("cell").to_numpy(), part.num_rows
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int8).reshape(n, DIRECTIONS)
                whole = (part.column("pos").to_numpy(), part.column("sid").to_numpy(), codes)
                edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), n]
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for a, b in zip(edges, edges[1:], strict=False):
                    now = tuple(x[a:b] for x in whole)
                    if key[a] == cell and kept is not None:
                        found += match(now, kept, False)
                    else:
                        kept = None
                    if b - a > 1:
                        found += match(now, now, True)
                    cell = key[a]
                    if b == n:  # the cell may go on: keep what later windows can still reach
                        if kept is not None:
                            now = tuple(np.concatenate([k, x]) for k, x in zip(kept, now, strict=True))
                        far = np.searchsorted(now[0], now[0][-1] - reach)
                        kept = tuple(x[far:] for x in now)
                    else:
                        kept = None
                s, t = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(t, pa.int64())], names=["a", "b"])

    return run


def _verify(threshold: float, dim: int):
    """Exact cosine of each pair, tile by tile; rows come sorted by tile, vectors before pairs."""

    def run(batches):
        tile, place, vectors = None, {}, []
        for batch in batches:
            tiles, sid, other, v = (batch.column(c) for c in ("tile", "sid", "other", "v"))
            t = tiles.to_numpy()
            edges = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if t[lo] != tile:
                    tile, place, vectors = t[lo], {}, []
                n = hi - lo - v.slice(lo, hi - lo).null_count
                if n:
                    x = _matrix(v.slice(lo, n), dim)
                    place |= {s: len(place) + k for k, s in enumerate(sid.slice(lo, n).to_pylist())}
                    vectors.append(x / np.linalg.norm(x, axis=1, keepdims=True))
                if lo + n < hi:
                    table = vectors[0] if len(vectors) == 1 else np.concatenate(vectors)
                    vectors = [table]
                    a, b = sid.slice(lo + n, hi - lo - n).to_numpy(), other.slice(lo + n, hi - lo - n).to_numpy()
                    for k in range(0, len(a), 1 << 14):
                        p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                        cos = np.einsum("ij,ij->i", table[[place[x] for x in p.tolist()]], table[[place[x] for x in q.tolist()]])
                        keep = cos >= threshold - _ROUNDING
                        out.append((p[keep], q[keep], np.minimum(cos[keep], 1.0)))
            p, q, c = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cosine"])

    return run


def _similar(entries: DataFrame, dim: int, threshold: float, recall: float) -> DataFrame:
    """(a, b, cosine) of the similar pairs of entries (sid, v) of one length."""
    # directions and grids: a few hundred vectors, whatever the table
    plan = entries.sparkSession.sparkContext.broadcast(Plan(entries.count(), dim, threshold, recall))
    rows = entries.select("sid", "v").mapInArrow(_cells(plan), "cell long, pos float, sid long, codes binary")
    swept = rows.repartition("cell").sortWithinPartitions("cell", "pos").mapInArrow(_sweep(plan), "a long, b long")
    pairs = near_text.tiled(cut(swept.distinct()))
    needs = pairs.select("tile", F.explode(F.array("a", "b")).alias("sid")).distinct()
    shipped = needs.join(entries.select("sid", "v"), "sid").select("tile", "sid", F.lit(None).cast("long").alias("other"), "v")
    asked = pairs.select("tile", F.col("a").alias("sid"), F.col("b").alias("other"), F.lit(None).cast("array<float>").alias("v"))
    tiles = shipped.union(asked).repartition("tile").sortWithinPartitions("tile", F.col("other").isNotNull())
    return tiles.mapInArrow(_verify(threshold, dim), "a long, b long, cosine double")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, v, fine) of all rows with an id, and (id, v) of those whose vector can be compared."""
    v = F.col(vector_col).cast("array<float>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    every = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), fine.alias("fine")).where(F.col("id").isNotNull())
    return every, every.where("fine").select("id", "v")


def _entries(usable: DataFrame) -> DataFrame:
    """One row per different vector: v, its smallest id, number of rows and sid; kept."""
    one = usable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return cut(one.withColumn("sid", F.monotonically_increasing_id()))


def _found(entries: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b, cosine) of the similar pairs of entries."""
    sizes = [r["d"] for r in entries.select(F.size("v").alias("d")).distinct().collect()]  # the lengths of vectors, as a rule one
    out = entries.sparkSession.createDataFrame([], "a long, b long, cosine double")
    for dim in sorted(sizes):
        out = out.union(_similar(entries.where(F.size("v") == dim), dim, threshold, recall))
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_a, vec_b, cosine) of copies with the first of their vector, and of the first ids of similar vectors."""
    _, usable = _usable(vectors, id_col, vector_col)
    entries = _entries(usable)
    names = entries.select("sid", "id")
    found = _found(entries, threshold, recall)
    named = found.join(names.select(F.col("sid").alias("a"), F.col("id").alias("x")), "a").join(names.select(F.col("sid").alias("b"), F.col("id").alias("y")), "b")
    out = named.where("x <> y").select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "cosine")
    copied = entries.where("n > 1").select("v", F.col("id").alias("vec_a"))
    copies = usable.join(copied, "v").where("id <> vec_a").select("vec_a", F.col("id").alias("vec_b"), F.lit(1.0).alias("cosine"))
    return out.union(copies).groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def vector_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links) of each different vector of an id: its group, and how many others are similar; unusable ones are alone."""
    every, usable = _usable(vectors, id_col, vector_col)
    usable = usable.distinct()
    entries = _entries(usable)
    found = cut(_found(entries, threshold, recall))
    roots = near_text.components(found.select("a", "b"))
    ends = found.select("a", "b").union(found.select("b", "a"))
    more = ends.join(entries.select(F.col("sid").alias("b"), "n"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("more"))
    placed = entries.join(roots.withColumnRenamed("node", "sid"), "sid", "left").join(more, "sid", "left")
    placed = placed.select("v", F.coalesce("root", "sid").alias("root"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    member = cut(usable.join(placed, "v").select("id", "root", "links"))
    named = member.join(member.groupBy("root").agg(F.min("id").alias("class_id")), "root").select(F.col("id").alias("vec_id"), "class_id", "links")
    alone = every.where("NOT fine").select("id", "v").distinct()
    return named.union(alone.select("id", "id", F.lit(0).cast("long")))


def expand(found: DataFrame) -> DataFrame:
    """All similar pairs that the rows of near_vectors stand for, if each id has one vector and different ones have a cosine below 1."""
    pairs = near_text.expand(found.select(F.col("vec_a").alias("doc_a"), F.col("vec_b").alias("doc_b"), F.col("cosine").alias("jaccard")))
    return pairs.select(F.col("doc_a").alias("vec_a"), F.col("doc_b").alias("vec_b"), F.col("jaccard").alias("cosine"))
