"""Exact similarity of n-gram sets: every pair at or over a Jaccard threshold, without listing the pairs of large groups.

A set is similar to another only if it has at least need(size) = ceil(threshold * size) n-grams in common with it, so

1. ``known`` deals the 32-bit hashes of all n-grams to buckets; a set that finds fewer than need(size) of its own in other
   rows is alone. Hashes that coincide only keep a set that might have gone.
2. ``shared`` counts, among the different sets that are left, in how many each n-gram occurs. In the order of this count, rarest
   first, two similar sets have a common one among the first size - need(size) + 1 of each: those are their tokens.
3. ``tiles``: sets go to homes, by the smallest set met over some tokens, twice; this is a heuristic for speed alone. A home is
   divided into cells of bounded size. All pairs within a home are verified, and all pairs of sets with a common token across homes.
4. ``verified`` counts common n-grams of a tile at once: frequent ones by a product of matrices, others one by one.

What a tile returns is either its pairs, or for each set the number of documents it is linked to and its group
within the tile, so that n similar texts take n rows and not n(n-1)/2.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _text
from tallyweave.llm._cut import cut

#: Bytes of text, and documents, of a slice; n-grams of a bucket.
SLICE = 1 << 21
SLICE_ROWS = 1 << 16
BUCKET = 2_000_000
#: Sets and n-grams of a cell, and tokens by which homes are found.
CELL_GRAMS = 1_000_000
HOME_TOKENS = 16
#: Sets, beyond which the second scan doesn't leave out the others before it reads their n-grams.
FILTERED = 1 << 24
#: A column is multiplied as part of a matrix if it has a pair in this share of the tile.
DENSE = 1 / 64


def need(size, threshold: float):
    """Fewest n-grams that a set has in common with a similar one."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


def distinct_grams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-gram hashes of each text, sorted, the text of each and their number by text."""
    words = _text.Words(column)
    h, bounds = _text.grams(words.hashes(), words.first, n)
    n_texts = len(bounds) - 1
    row = np.repeat(np.arange(n_texts), np.diff(bounds))
    order = np.lexsort((h, row)) if n_texts > 1 else np.argsort(h)
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, row, np.bincount(row, minlength=n_texts)


def fingerprints(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two words that name the set of each text."""
    mark, some = np.zeros((len(size), 2), np.uint64), np.flatnonzero(size > 0)
    if len(some):
        at = np.concatenate([[0], np.cumsum(size)])[some]
        mark[some, 0] = np.add.reduceat(h, at)
        mark[some, 1] = np.add.reduceat(_text.mix(h + np.uint64(0x51ED27)), at)
    return mark


def _runs(batches, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that follow one another with the same keys, over the bounds of batches."""
    last, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(c[lo].item() for c in cols)
            if key != last and parts:
                yield last, pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield last, pa.Table.from_batches(parts)


def _blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values as bytes, cut into rows of so many values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


_DEALT = "bucket long, slice long, idx binary, key binary"


def _deal(n: int, buckets: int, wide: bool, wanted=None):
    """Each slice's hashes, a row for each bucket, and a row (bucket < 0) of what the slice's documents are."""

    def run(batches):
        number, place = 0, TaskContext.get().partitionId()
        for batch in batches:
            if wanted is not None:
                bits = wanted.value
                name = batch.column("name").to_numpy().view(np.uint64) & np.uint64(8 * len(bits) - 1)
                batch = batch.take(pa.array(np.flatnonzero(bits[name >> np.uint64(3)] >> (name & np.uint64(7)).astype(np.uint8) & 1)))
            text = batch.column("text")
            for a0, b0 in _text.slices(text, SLICE):
                for a in range(a0, b0, SLICE_ROWS):
                    b = min(b0, a + SLICE_ROWS)
                    h, row, size = distinct_grams(text.slice(a, b - a), n)
                    ids, marks = (batch.column(c).slice(a, b - a).to_numpy() for c in ("doc_id", "mark"))
                    meta = np.concatenate([ids, marks, *fingerprints(h, size).T.view(np.int64), size]).astype(np.int64).tobytes()
                    number += 1
                    # rows in another order, should the task run again, are another slice
                    digest = hashlib.blake2b(meta + f"{place} {number}".encode(), digest_size=8).digest()
                    name = int.from_bytes(digest, "little", signed=True)
                    to = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    order = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")
                    counts = np.bincount(to.astype(np.int64), minlength=buckets)
                    some = np.flatnonzero(counts)
                    key, idx = (h if wide else h.astype(np.uint32))[order], row.astype(np.uint16)[order]
                    head = pa.array([meta], pa.binary()), pa.array([np.int64(len(some)).tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - name % buckets], pa.int64()), pa.array([name], pa.int64()), *head], names=["bucket", "slice", "idx", "key"])
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), name)), _blobs(idx, counts[some]), _blobs(key, counts[some])], names=["bucket", "slice", "idx", "key"])

    return run


_FOUND = "slice long, meta boolean, idx binary, key binary, n binary"


def _meet(wide: bool):
    """Bucket by bucket: hashes that occur more than once go back to their slices, with their counts if wide, else their number."""

    def back(name, idx, key, n, meta=False):
        return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array([meta] * len(name)), *(pa.array(x, pa.binary()) for x in (idx, key, n))], names=["slice", "meta", "idx", "key", "n"])

    def run(batches):
        for (bucket,), rows in _runs(batches, ["bucket"]):
            names = rows.column("slice").to_pylist()
            idx, keys = rows.column("idx").to_pylist(), rows.column("key").to_pylist()
            if bucket < 0:
                yield back(names, idx, keys, [None] * len(names), True)
                continue
            key = np.frombuffer(b"".join(keys), np.uint64 if wide else np.uint32)
            del rows, keys
            if wide:
                order = np.argsort(key, kind="stable")
                k = key[order]
                starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                times = np.diff(np.append(starts, len(k))).astype(np.uint32)
                n = np.empty(len(k), np.uint32)
                n[order] = np.repeat(times, times)
                met = n > 1
                del order, k, starts, times
            else:
                both = (key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
                both.sort()
                twin = np.flatnonzero((both[1:] ^ both[:-1]) < np.uint64(1 << 32))
                met = np.zeros(len(key), bool)
                for k in (twin, twin + 1):
                    met[(both[k] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
                del both, twin
            at, outs = 0, ([], [], [])
            for mine in idx:
                mine = np.frombuffer(mine, np.uint16)
                part = slice(at, at + len(mine))
                at += len(mine)
                if wide:
                    out = mine[met[part]], key[part][met[part]], n[part][met[part]]
                else:
                    u, c = np.unique(mine[met[part]], return_counts=True)
                    out = u, np.zeros(0, np.uint8), c.astype(np.uint32)
                for o, x in zip(outs, out, strict=True):
                    o.append(x.tobytes())
            yield back(names, *outs)

    return run


def _slices(batches):
    """(ids, marks, fingerprints, sizes) of a slice's documents, and what came back for it."""
    for (name,), rows in _runs(batches, ["slice"]):
        is_meta = rows.column("meta").to_numpy(zero_copy_only=False)
        head = np.flatnonzero(is_meta)
        found = [rows.column(c).to_pylist() for c in ("idx", "key", "n")]
        if len(head) != 1 or len(is_meta) - 1 != np.frombuffer(found[1][head[0]], np.int64)[0]:
            raise RuntimeError(f"slice {name} came back in part: its input was read in another order")
        meta = np.frombuffer(found[0][head[0]], np.int64).reshape(5, -1)
        yield meta, *(b"".join(x[k] for k in np.flatnonzero(~is_meta)) for x in found)


def _dealt(rows: DataFrame, n: int, buckets: int, wide: bool, wanted=None) -> DataFrame:
    dealt = rows.mapInArrow(_deal(n, buckets, wide, wanted), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_meet(wide), _FOUND).repartition("slice").sortWithinPartitions("slice")


def known(texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """(doc_id, mark, f1, f2, size, alone) of all rows of texts (doc_id, mark, text); alone: similar to no other row; kept."""
    total = texts.agg(F.sum(F.length("text"))).head()[0] or 0
    buckets = max(1, math.ceil(total / 7 / BUCKET))

    def run(batches):
        for meta, idx, _, times in _slices(batches):
            met = np.bincount(np.frombuffer(idx, np.uint16), np.frombuffer(times, np.uint32), minlength=meta.shape[1])
            alone = (meta[4] == 0) | (met < need(meta[4], threshold))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in meta), pa.array(alone)], names=["doc_id", "mark", "f1", "f2", "size", "alone"])

    return cut(_dealt(texts, n, buckets, False).mapInArrow(run, "doc_id long, mark long, f1 long, f2 long, size long, alone boolean"))


def different(rows: DataFrame) -> DataFrame:
    """One row per different set that may be similar to another row's: sid, fingerprint, smallest document, number of documents; kept."""
    one = rows.where("NOT alone").select("doc_id", "mark", "f1", "f2", "size").distinct()
    one = one.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count("*").alias("n"), F.first("size").alias("size"))
    return cut(one.select("f1", "f2", "least.doc_id", "least.mark", "n", "size").withColumn("sid", F.monotonically_increasing_id()))


def shared(texts: DataFrame, sets: DataFrame, threshold: float, n: int) -> DataFrame:
    """(sid, n, size, tokens, grams) of the sets that may be similar to another: grams are those that other sets have too; kept."""
    count, total = sets.agg(F.count("*"), F.sum("size")).head()
    name, wanted = F.xxhash64("doc_id", "mark"), None
    if count <= FILTERED:
        names = sets.select(name.alias("name")).toArrow().column("name").to_numpy().view(np.uint64)
        bits = np.zeros(1 << max(7, min(25, math.ceil(math.log2(8 * count + 1)))), np.uint8)
        at = names & np.uint64(8 * len(bits) - 1)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        wanted = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for meta, idx, key, times in _slices(batches):
            idx, key, times = np.frombuffer(idx, np.uint16), np.frombuffer(key, np.uint64), np.frombuffer(times, np.uint32)
            order = np.lexsort((key, times, idx))
            key, met, least = key[order], np.bincount(idx, minlength=meta.shape[1]), need(meta[4], threshold)
            first = np.concatenate([[0], np.cumsum(met)])
            some = np.flatnonzero((met >= least) & (met > 0))
            # of the first size - need + 1, those in no other set come before all others
            tokens = [key[first[k] : first[k] + met[k] - least[k] + 1].view(np.int64) for k in some]
            grams = [key[first[k] : first[k + 1]].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in meta[:2]), pa.array(tokens, pa.list_(pa.int64())), pa.array(grams, pa.binary())], names=["doc_id", "mark", "tokens", "grams"])

    found = _dealt(texts.withColumn("name", name), n, max(1, math.ceil((total or 0) / BUCKET)), True, wanted)
    found = found.mapInArrow(run, "doc_id long, mark long, tokens array<long>, grams binary")
    return cut(found.join(sets.select("doc_id", "mark", "sid", "n", "size"), ["doc_id", "mark"]).select("sid", "n", "size", "tokens", "grams").dropDuplicates(["sid"]))


def tiles(sets: DataFrame, block: int) -> DataFrame:
    """(ca, cb, cell, sid): the sets of each tile, a pair of cells or one cell, and the cell that each belongs to."""
    few = sets.select("sid", F.explode(F.slice(F.array_sort("tokens"), 1, HOME_TOKENS)).alias("g"))
    home = few.groupBy("sid").agg(F.col("sid").alias("home"))
    for _ in range(2):
        met = few.join(home, "sid").withColumn("low", F.expr("min(home) OVER (PARTITION BY g)"))
        home = met.groupBy("sid").agg(F.min("low").alias("home"))
    home = home.join(sets.select("sid", F.length("grams").alias("bytes")), "sid")
    home = home.withColumn("blocks", F.expr(f"cast(ceil(greatest(count(1) OVER (PARTITION BY home) / {block}, sum(bytes) OVER (PARTITION BY home) / {8 * CELL_GRAMS})) AS int)"))
    home = home.withColumn("many", F.expr("count(1) OVER (PARTITION BY home)")).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    home = cut(home.select("sid", "home", "blocks", "many", F.xxhash64("home", "block").alias("cell")))
    within = home.where("many > 1").select("sid", "cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("home", k))).alias("other"))
    met = sets.select("sid", F.explode("tokens").alias("g")).join(home.select("sid", "home", "cell"), "sid")
    met = cut(met.withColumns({"low": F.expr("min(home) OVER (PARTITION BY g)"), "high": F.expr("max(home) OVER (PARTITION BY g)")}).where("low < high").select("g", "sid", "home", "cell"))
    others = met.select("g", F.col("home").alias("oh"), F.col("cell").alias("other")).distinct()
    across = met.join(others, "g").where("home <> oh").select("sid", "cell", "other").distinct()
    return within.union(across).select(F.least("cell", "other").alias("ca"), F.greatest("cell", "other").alias("cb"), "cell", "sid")


def common(ga: np.ndarray, ra: np.ndarray, na: int, gb: np.ndarray, rb: np.ndarray, nb: int) -> np.ndarray:
    """Number of common n-grams of na and nb sets, given as n-grams and the set of each."""
    u = np.intersect1d(ga, gb)
    out = np.zeros((na, nb), np.float32)
    if not len(u):
        return out.astype(np.int64)

    def columns(g, r):
        at = np.searchsorted(u, g)
        at[at == len(u)] = 0
        fine = np.flatnonzero(u[at] == g)
        order = fine[np.argsort(at[fine], kind="stable")]
        return at[order], r[order], np.bincount(at[fine], minlength=len(u))

    (ua, ra, ca), (ub, rb, cb) = columns(ga, ra), columns(gb, rb)
    dense = ca * cb >= DENSE * na * nb
    where = np.flatnonzero(dense)
    place = np.full(len(u), -1)
    place[where] = np.arange(len(where))
    for k in range(0, len(where), 2048):
        m = [np.zeros((size, min(2048, len(where) - k)), np.float32) for size in (na, nb)]
        for x, uu, r in zip(m, (ua, ub), (ra, rb), strict=True):
            p = place[uu] - k
            fine = (p >= 0) & (p < x.shape[1])
            x[r[fine], p[fine]] = 1
        out += m[0] @ m[1].T
    out = out.astype(np.int64)  # counts under 2**24 are exact
    # the others: each n-gram's sets of one side with those of the other
    ra, ua = ra[~dense[ua]], ua[~dense[ua]]
    begin = np.concatenate([[0], np.cumsum(cb)])
    ends = np.cumsum(cb[ua])
    at = 0
    while at < len(ua):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        n = cb[ua[at:to]]
        b = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[ua[at:to]], n)
        out += np.bincount(np.repeat(ra[at:to], n) * nb + rb[b], minlength=na * nb).reshape(na, nb)
        at = to
    return out


def _together(linked: np.ndarray, same: bool) -> np.ndarray:
    """Group of each set of a tile, its first set's number; linked: sets of one side by those of the other, or (same) of one cell."""
    na, nb = linked.shape
    if same:
        a, b, lab = np.arange(na), np.arange(na), np.arange(na)
    else:
        a, b, lab = np.arange(na), na + np.arange(nb), np.arange(na + nb)
    while True:
        new = lab.copy()
        new[a] = np.minimum(new[a], np.where(linked, lab[b][None, :], len(lab)).min(1))
        new[b] = np.minimum(new[b], np.where(linked, new[a][:, None], len(lab)).min(0))
        np.minimum.at(new, lab, new)  # what a set has found holds for its group's first
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


PAIRS = "a long, b long, jaccard double"
LINKS = "sid long, root long, links long"


def verified(placed: DataFrame, sets: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """All similar pairs (a < b, jaccard), or (sid, root, links) of each tile: links counts documents, root is a set of the same group; kept."""

    def run(batches):
        for (ca, cb), rows in _runs(batches, ["ca", "cb"]):
            rows = rows.combine_chunks()
            cell, sid, n, size = (rows.column(c).to_numpy() for c in ("cell", "sid", "n", "size"))
            blobs, sides = rows.column("grams").to_pylist(), []
            for mine in dict.fromkeys((ca, cb)):
                at = np.flatnonzero(cell == mine)
                g = [np.frombuffer(blobs[k], np.uint64) for k in at]
                sides.append((at, np.concatenate(g) if g else np.zeros(0, np.uint64), np.repeat(np.arange(len(at)), [len(x) for x in g])))
            (x, gx, rx), (y, gy, ry), same = sides[0], sides[-1], ca == cb
            if not len(x) or not len(y):
                continue
            c = common(gx, rx, len(x), gy, ry, len(y))
            j = c / (size[x][:, None] + size[y][None, :] - c)
            linked = j >= threshold
            if same:
                np.fill_diagonal(linked, False)
            if pairs:
                p, q = np.nonzero(np.triu(linked) if same else linked)
                s, t = sid[x[p]], sid[y[q]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)), pa.array(np.maximum(s, t)), pa.array(j[p, q])], names=["a", "b", "jaccard"])
                continue
            who = x if same else np.concatenate([x, y])
            root = sid[who[_together(linked, same)]]
            links = linked @ n[y] if same else np.concatenate([linked @ n[y], n[x] @ linked])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(sid[who[some]]), pa.array(root[some]), pa.array(links[some])], names=["sid", "root", "links"])

    shipped = placed.join(sets.select("sid", "n", "size", "grams"), "sid").select("ca", "cb", "cell", "sid", "n", "size", "grams")
    return cut(shipped.repartition("ca", "cb").sortWithinPartitions("ca", "cb").mapInArrow(run, PAIRS if pairs else LINKS))
