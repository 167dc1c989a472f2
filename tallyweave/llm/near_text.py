"""N-gram Jaccard join, exact or by MinHash banding, and near-duplicate removal on top of it.

A document's set holds the hashes of all its word n-grams (NGRAM words; a shorter text is one n-gram). Two
documents are similar if the Jaccard coefficient of their sets is at least the threshold. Documents are told apart by doc_id
and text.

``near_classes``: rows (doc_id, class_id, links), one for each document with a doc_id. class_id is the smallest doc_id of the
documents that are connected by similar pairs, links the number of other documents that this one is similar to, copies
included. No similar pair is left out, and n similar documents are n rows; ``_links`` says how.

``near_pairs``: rows (doc_a, doc_b, jaccard), doc_a < doc_b, each pair once. Documents with one and
the same set are pairs of the smallest doc_id of the set with each other one (jaccard 1.0); different
sets that are similar are a pair of the smallest doc_ids of both. Every other pair follows from these;
``expand`` writes them out. All pairs of different sets are listed, so n variants of a text take up to n(n-1)/2 rows.

A recall below 1 makes ``near_pairs`` look for candidates by MinHash bands, whose number follows from the
threshold and the recall: for a pair exactly at the threshold, 1 - (1 - t**rows)**bands >= recall.

1. One scan computes, per document, a 128-bit fingerprint of its set and its band hashes.
   Equal sets collapse to one row with their smallest document, combined before the shuffle, so a text
   copied a million times is one row from here on.
2. A shuffle on band hashes brings rows that share a band together; hashes that occur once
   drop out before any pair is made. A hash of more than HOT rows is dealt to tiles of two blocks of
   about HOT rows each, so every pair is still made, but no task makes more than a few tiles' pairs at once.
3. Every pair goes to one tile, named after the smallest partners of its two ends. Members of a
   group of copies share that partner, so the group's sets travel once rather than
   once per pair. Large groups are divided into blocks, so a tile is bounded.
4. Tiles verify their pairs on the full n-gram sets. The sets are recomputed from the text,
   which is joined by id and text hash only with those that are needed.

Defined results: null and empty texts, and texts without a word, have an empty set and are
never similar to anything (a class of their own with 0 links), and removal keeps them; so are rows with a null doc_id, which
have no row in the join;
repeated rows of one doc_id count once and removal keeps one of them; if one doc_id has several different texts, each takes
part under that id and has a row of its own, and removal decides about each text by itself; a pair exactly at the threshold counts; an
empty table gives no rows; other columns are ignored by the join and kept by the removal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _links, _text
from tallyweave.llm._cut import cut

NGRAM = 3
THRESHOLD = 0.5
#: Of candidates; 1 finds every pair.
RECALL = 1.0
ROWS = 4
#: Sets of one group of similar ones that are verified against each other in one task.
BLOCK = 1024
#: Rows of one band hash that are paired in one place; more are dealt to tiles.
HOT = 1024


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands that find a pair at the threshold with the target recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def gram_sets(column: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, with repeats, and the bounds of each text's."""
    words = _text.Words(column)
    return _text.grams(words.hashes(), words.first, n)


class Signer:
    """Band hashes and set fingerprints of texts."""

    def __init__(self, bands: int, rows: int, n: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows, self.n = bands, rows, n
        self.mult = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sign(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of different n-grams, two-word fingerprint, band hashes) of each text."""
        h, _, size = _links.distinct_grams(column, self.n)
        mark = _links.fingerprints(h, size)
        out = np.zeros((len(size), self.bands), np.uint64)
        some = np.flatnonzero(size > 0)
        if not len(some):
            return size, mark, out
        at = np.concatenate([[0], np.cumsum(size)])[some]
        low = (h >> np.uint64(32)).astype(np.uint32)
        step = 1 << 17
        mins = np.empty((self.bands * self.rows, len(some)), np.uint32)
        if len(low) <= 2 * step:
            work = np.empty_like(low)
            for k in range(self.bands * self.rows):
                np.multiply(low, self.mult[k], out=work)
                work += self.add[k]
                mins[k] = np.minimum.reduceat(work, at)
        else:  # parts that fit the cache; a text may span several
            mins.fill(0xFFFFFFFF)
            ends = np.append(at[1:], len(low))
            for a in range(0, len(low), step):
                b = min(len(low), a + step)
                i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(at, b, "left"))
                part, rel = low[a:b], np.maximum(at[i:j] - a, 0)
                work = np.empty_like(part)
                for k in range(self.bands * self.rows):
                    np.multiply(part, self.mult[k], out=work)
                    work += self.add[k]
                    np.minimum(mins[k, i:j], np.minimum.reduceat(work, rel), out=mins[k, i:j])
        wide = mins.reshape(self.bands, self.rows, -1).astype(np.uint64)
        acc = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64)[:, None], (self.bands, len(some)))
        for r in range(self.rows):
            acc = _text.mix(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, r])
        out[some] = acc.T
        return size, mark, out


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, mark, f1, f2, bands) of every document with a word and an id; mark is a hash of the text."""

    def run(batches):
        signer = Signer(bands, rows, n)
        for batch in batches:
            ids, marks, text = batch.column("doc_id"), batch.column("mark"), batch.column("text")
            for a, b in _text.slices(text, 1 << 20):
                size, mark, out = signer.sign(text.slice(a, b - a))
                keep = np.flatnonzero(size > 0)
                flat = pa.array(out[keep].reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).take(pa.array(keep)),
                        marks.slice(a, b - a).take(pa.array(keep)),
                        pa.array(mark[keep, 0].view(np.int64)),
                        pa.array(mark[keep, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), flat),
                    ],
                    names=["doc_id", "mark", "f1", "f2", "bands"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, f1 long, f2 long, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of the documents that have an id and a text."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """One row per different set: sid, its fingerprint, its smallest document, its number of rows and the band hashes; kept."""
    one = signed.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    return cut(one.select("f1", "f2", "least.doc_id", "least.mark", "n", "bands").withColumn("sid", F.monotonically_increasing_id()))


def candidates(sets: DataFrame) -> DataFrame:
    """Different pairs (a < b) of sids that share at least one band hash."""
    rows = sets.select("sid", F.explode("bands").alias("bh"))
    # the count's shuffle and sort on bh serve the grouping too
    counted = rows.withColumn("m", F.expr("count(1) OVER (PARTITION BY bh)")).where("m > 1")
    groups = counted.where(F.col("m") <= HOT).groupBy("bh").agg(F.array_sort(F.collect_list("sid")).alias("s"))
    firsts = groups.select(F.posexplode("s").alias("i", "a"), "s").where(F.col("i") < F.size("s") - 1)
    pairs = firsts.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).where("a < b")
    return pairs.union(hot_pairs(counted.where(F.col("m") > HOT))).distinct()


def hot_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a < b) of sids within each band hash of (bh, sid, m), by tiles of two blocks of the m rows."""
    blocks = F.ceil(F.col("m") / HOT).cast("int")
    dealt = rows.select("bh", "sid", F.pmod(F.xxhash64("sid", "bh"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiles = dealt.select("bh", "sid", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition("bh", "i", "j")
    sides = tiles.groupBy("bh", "i", "j").agg(*[F.collect_list(F.when(F.col("own") == F.col(k), F.col("sid"))).alias(side) for k, side in (("i", "left"), ("j", "right"))])
    ends = sides.select((F.col("i") == F.col("j")).alias("one"), F.explode("left").alias("x"), "right").select("one", "x", F.explode("right").alias("y"))
    return ends.where("NOT one OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def tiled(pairs: DataFrame) -> DataFrame:
    """Pairs with the tile that verifies them."""
    ends = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    home = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("home"))
    home = home.withColumn("blocks", F.ceil(F.expr("count(1) OVER (PARTITION BY home)") / BLOCK))
    home = home.select("a", "home", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    left = home.select(F.col("a"), F.col("home").alias("ha"), F.col("block").alias("ba"))
    right = home.select(F.col("a").alias("b"), F.col("home").alias("hb"), F.col("block").alias("bb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.xxhash64("ha", "ba", "hb", "bb").alias("tile"))


def _set_rows(n: int):
    """Full n-gram sets, sorted, as bytes, for rows that carry a text."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in _text.slices(text):
                h, bounds = gram_sets(text.slice(a, b - a), n)
                sets = [np.unique(h[bounds[k] : bounds[k + 1]]).tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("sid").slice(a, b - a), pa.array(sets, pa.binary())], names=["sid", "grams"])

    return run


def _verify(threshold: float):
    """Exact Jaccard of each pair, tile by tile; rows come sorted by tile, sets before pairs."""

    def pending(sets: dict[int, np.ndarray], a: list[int], b: list[int]):
        out = []
        for x, y in zip(a, b, strict=True):
            s, t = sets.get(x), sets.get(y)
            if s is None or t is None:
                continue
            if len(s) > len(t):
                s, t = t, s
            if len(s) < threshold * len(t):
                continue
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            common = int(np.count_nonzero(t[at] == s))
            j = common / (len(s) + len(t) - common)
            if j >= threshold:
                out.append((x, y, j))
        return out

    def run(batches):
        tile, sets = None, {}
        for batch in batches:
            tiles, sid, other, grams = (batch.column(c) for c in ("tile", "sid", "other", "grams"))
            t = tiles.to_numpy()
            edges = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            out = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if t[lo] != tile:
                    tile, sets = t[lo], {}
                n_pairs = hi - lo - grams.slice(lo, hi - lo).null_count
                ids = sid.slice(lo, hi - lo).to_pylist()
                for k in range(n_pairs):
                    sets[ids[k]] = np.frombuffer(grams[lo + k].as_buffer(), np.uint64).copy()
                out += pending(sets, ids[n_pairs:], other.slice(lo + n_pairs, hi - lo - n_pairs).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())],
                names=["a", "b", "jaccard"],
            )

    return run


def similar_sets(docs: DataFrame, sets: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b, jaccard) of all candidate pairs of sids at or over the threshold; kept."""
    pairs = cut(tiled(candidates(sets)))
    needs = pairs.select("tile", F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = needs.select("sid").distinct().join(sets.select("sid", "doc_id", "mark"), "sid")
    found = _texts(docs).join(wanted, ["doc_id", "mark"]).select("sid", "text").mapInArrow(_set_rows(n), "sid long, grams binary")
    found = found.groupBy("sid").agg(F.first("grams").alias("grams"))  # repeated rows have one set
    shipped = needs.join(found, "sid").select("tile", "sid", F.lit(None).cast("long").alias("other"), "grams")
    asked = pairs.select("tile", F.col("a").alias("sid"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("grams"))
    rows = shipped.union(asked).repartition("tile").sortWithinPartitions("tile", F.col("other").isNotNull())
    return cut(rows.mapInArrow(_verify(threshold), "a long, b long, jaccard double"))


def _all_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of the documents that have an id; no text is the empty text."""
    some = docs.where(F.col("doc_id").isNotNull())
    return some.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))


def _linked(docs: DataFrame, threshold: float, n: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, the different sets that may be similar to another, and all pairs or links of these sets."""
    texts = _all_texts(docs)
    known = _links.known(texts, threshold, n)
    sets = _links.different(known)
    part = _links.shared(texts, sets, threshold, n)
    return known, sets, _links.verified(_links.tiles(part, BLOCK), part, threshold, pairs)


def _members(docs: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """All documents, as rows of the table, and (doc_id, mark, root, links) of each different one that may be similar to another."""
    known, sets, found = _linked(docs, threshold, n, False)
    roots = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("sid").agg(F.sum("links").alias("more"))
    placed = sets.join(roots, sets["sid"] == roots["node"], "left").select("f1", "f2", "n", "sid", F.coalesce("root", "sid").alias("root")).join(links, "sid", "left")
    placed = placed.select("f1", "f2", "root", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return known, known.where("NOT alone").select("doc_id", "mark", "f1", "f2").distinct().join(placed, ["f1", "f2"]).select("doc_id", "mark", "root", "links")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """Rows (doc_id, class_id, links): the group of similar documents that each one is in, and how many others it is similar to."""
    known, member = _members(docs, threshold, n)
    member = cut(member)
    named = member.join(member.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id", "links")
    alone = known.where("alone").select("doc_id", "mark").distinct()
    return named.union(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, n: int = NGRAM) -> DataFrame:
    """Rows (doc_a, doc_b, jaccard): copies with the first of their set, and first documents of different similar sets."""
    if recall < 1:
        signed = cut(signatures(docs, bands_for(threshold, recall, rows), rows, n))
        sets = distinct_sets(signed)
        similar = similar_sets(docs, sets, threshold, n)
    else:
        known, sets, similar = _linked(docs, threshold, n, True)
        signed = known.where("NOT alone")
    first = sets.select("sid", "doc_id")
    named = similar.join(first.select(F.col("sid").alias("a"), F.col("doc_id").alias("x")), "a").join(first.select(F.col("sid").alias("b"), F.col("doc_id").alias("y")), "b")
    near = named.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    several = sets.where("n > 1").select("f1", "f2", F.col("doc_id").alias("doc_a"))
    copies = signed.select("f1", "f2", F.col("doc_id").alias("doc_b")).join(several, ["f1", "f2"]).where("doc_a <> doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    # an id with several texts may form a pair more than once
    return copies.union(near).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def expand(found: DataFrame) -> DataFrame:
    """All similar pairs (doc_a < doc_b, jaccard) of documents that the rows of near_pairs stand for, if each id has one text."""
    copies = found.where("jaccard = 1.0").select(F.col("doc_a").alias("first"), F.col("doc_b").alias("doc"))
    side = found.where("jaccard < 1.0").select(F.col("doc_a").alias("x"), F.col("doc_b").alias("y"), "jaccard")
    for end in ("x", "y"):
        members = side.select(F.col(end).alias("first")).distinct()
        names = copies.join(members, "first", "left_semi").union(members.select("first", F.col("first").alias("doc")))
        side = side.join(names.select(F.col("first").alias(end), F.col("doc").alias(f"{end}m")), end)
    spread = side.select(F.least("xm", "ym").alias("doc_a"), F.greatest("xm", "ym").alias("doc_b"), "jaccard")
    same = copies.join(copies.select("first", F.col("doc").alias("other")), "first").where("doc < other").select(F.col("doc").alias("doc_a"), F.col("other").alias("doc_b"))
    same = same.union(copies.select("first", "doc"))
    return same.select("doc_a", "doc_b", F.lit(1.0).alias("jaccard")).union(spread)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each connected component, by alternating large and small stars."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        edges = cut(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def drop_near(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """One document of each group of similar documents, the one with the smallest doc_id; all columns stay.

    Groups are connected components over similar pairs. Rows are told apart by doc_id and text, so another text
    of a removed document's id stays if it is similar to nothing that stays. Of equal rows one stays.
    """
    known, member = _members(docs, threshold, n)
    member = cut(member)
    kept = member.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("best"), F.count("*").alias("n")).where("n > 1")
    lost = member.join(kept, "root").where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("mark") != F.col("best.mark")))
    gone = lost.select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    left = docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_mark"]), "left_anti")
    repeated = cut(known.where("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).count().where("count > 1").select("_id", "_mark"))
    if repeated.isEmpty():
        return left
    same = (left["doc_id"] == repeated["_id"]) & (F.xxhash64(left["text"]) == repeated["_mark"])
    return left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
