from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import embeddings, packing, sharding

SF1 = "/root/testdata/sf0.01"


def _pieces(rows):
    return sorted((d is None, d or 0, a, n) for r in rows for d, a, n in zip(r.doc_ids, r.starts, r.lengths, strict=True))


@pytest.mark.parametrize(("capacity", "group", "fan"), [(4000, 50, 3), (32768, 20000, 4), (700, 7, 2)])
def test_packing_holds_everything_once(docs, capacity, group, fan):
    out = packing.pack(docs, capacity, group_items=group, fan_in=fan).collect()
    want = []
    for r in docs.collect():
        n = len((r.text or "").encode()) + 1
        want += [(False, r.doc_id, a, min(capacity, n - a)) for a in range(0, n, capacity)]
    assert _pieces(out) == sorted(want)
    assert all(sum(r.lengths) == r.n_tokens <= capacity for r in out)
    assert len({r.bin_id for r in out}) == len(out)
    least = -(-sum(x[3] for x in want) // capacity)
    flat = len(packing.best_fit(sorted((x[3] for x in want), reverse=True), capacity))
    assert least <= len(out) <= flat * 1.05 + 2


def test_packing_does_not_depend_on_row_order(docs):
    a = packing.pack(docs, 5000, group_items=40).collect()
    b = packing.pack(docs.orderBy("text").repartition(7), 5000, group_items=40).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_by_definition(sizes):
    bins: list[list[int]] = []
    for i, s in enumerate(sizes):
        rooms = [(50 - sum(sizes[x] for x in b), k) for k, b in enumerate(bins)]
        fitting = [(r, k) for r, k in rooms if r >= s]
        if fitting:
            bins[min(fitting)[1]].append(i)
        else:
            bins.append([i])
    got = packing.best_fit(sizes, 50)
    assert sorted(sum(sizes[x] for x in b) for b in got) == sorted(sum(sizes[x] for x in b) for b in bins)
    assert sorted(x for b in got for x in b) == [*range(len(sizes))]


def test_packing_awkward(awkward, empty):
    out = packing.pack(awkward, 1000).collect()
    ids = [d for r in out for d in r.doc_ids]
    assert ids.count(1) == 2 and ids.count(None) == 2 and set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert packing.pack(empty).count() == 0


def test_sharding(docs):
    target = 40_000
    out = sharding.shard(docs, target).toPandas()
    sizes = {r.doc_id: max(1, len((r.text or "").encode())) for r in docs.collect()}
    assert dict(zip(out.doc_id, out.bytes, strict=True)) == sizes and len(out) == len(sizes)
    per = out.groupby("shard_id").bytes.agg(["sum", "size"])
    assert set(per.index) == set(range(len(per)))
    assert (per["sum"] <= target).sum() + (per["size"] == 1).sum() >= len(per)
    assert len(per) <= 4 * sum(sizes.values()) / target + 2


def _reference_tree(points, weight, target, width, rows=None):
    """Groups of rows by plain recursion over all cuts."""
    rows = list(range(len(points))) if rows is None else rows
    total = sum(weight[r] for r in rows)
    rel = [(max(points[r][d] for r in rows) - min(points[r][d] for r in rows)) / width[d] for d in range(4)]
    if total <= target or max(rel) <= 0:
        return [frozenset(rows)]
    d = rel.index(max(rel))
    values = sorted({points[r][d] for r in rows})
    best = min(reversed(values[:-1]), key=lambda v: abs(sum(weight[r] for r in rows if points[r][d] <= v) - total / 2))
    return [g for side in ([r for r in rows if points[r][d] <= best], [r for r in rows if points[r][d] > best]) for g in _reference_tree(points, weight, target, width, side)]


@pytest.mark.parametrize(("target", "local_rows"), [(30_000, 10**6), (30_000, 0), (60_000, 40), (10**9, 0)])
def test_tree_against_plain_recursion(docs, target, local_rows):
    rows = sharding.metadata(docs).orderBy("doc_id").collect()
    points, weight = [[r[d] for d in sharding.DIMENSIONS] for r in rows], [r.weight for r in rows]
    width = [max(p[d] for p in points) - min(p[d] for p in points) or 1.0 for d in range(4)]
    want = _reference_tree(points, weight, target, width)
    got = {}
    for r in sharding.shard(docs, target, local_rows).collect():
        got.setdefault(r.shard_id, set()).add(r.doc_id)
    assert [got[k] for k in range(len(got))] == [{rows[r].doc_id for r in g} for g in want]


def test_sharding_awkward(spark, awkward, empty):
    out = sharding.shard(awkward, 50).collect()
    assert len(out) == awkward.count()
    assert len({r.shard_id for r in out if r.doc_id == 1}) == 1
    assert sharding.shard(empty).count() == 0
    same = spark.createDataFrame([(1, "x" * 100, "en", "a")] * 5, "doc_id long, text string, lang string, source string")
    assert {r.shard_id for r in sharding.shard(same, 50).collect()} == {0}


def _near(n_groups, rng, dim=32):
    base = rng.normal(size=(n_groups, dim))
    rows = np.concatenate([base] + [base + rng.normal(size=base.shape) * rng.choice([0.02, 0.1, 0.2, 0.3], (n_groups, 1)) for _ in range(3)])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.9, 0.95, 0.99])
def test_embedding_recall(spark, threshold):
    x = _near(500, np.random.default_rng(4)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r[0], r[1]): r[2] for r in embeddings.near_vectors(df, threshold).collect()}
    c = x.astype(float) @ x.astype(float).T
    a, b = np.where(np.triu(c, 1) >= threshold)
    want = {(int(i), int(j)) for i, j in zip(a, b, strict=True)}
    assert len(want & set(got)) >= 0.95 * len(want) and len(want) > 300
    assert all(abs(c[p] - v) < 1e-5 and v >= threshold - 1e-12 for p, v in got.items())


def test_embedding_sweeps_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SWEEP", 16)
    x = _near(150, np.random.default_rng(5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r[0], r[1]) for r in embeddings.near_vectors(df, 0.95).collect()}
    x32 = x.astype(np.float32).astype(float)
    a, b = np.where(np.triu(x32 @ x32.T, 1) >= 0.95)
    want = {(int(i), int(j)) for i, j in zip(a, b, strict=True)}
    assert len(want & got) >= 0.95 * len(want)


def test_needed_collisions():
    c = embeddings.needed_collisions(40, 0.9, 0.95)
    tail = lambda c: sum(__import__("math").comb(40, k) * 0.9**k * 0.1 ** (40 - k) for k in range(c, 41))
    assert tail(c) >= 0.95 > tail(c + 1)


def test_embedding_awkward(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [None, 1.0]), (9, [0.0, 1.0]), (10, [2.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS a", "2 AS cosine")
    got = {(r[0], r[1]) for r in embeddings.near_vectors(df).collect()}
    assert got == {(1, 2), (1, 10)}  # the copy (2) stands for its partners too
    assert {(r[0], r[1]) for r in embeddings.expand(embeddings.near_vectors(df)).collect()} == {(1, 2), (1, 10), (2, 10)}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_several_lengths_ties_and_copies(spark):
    rng = np.random.default_rng(9)
    many = [(k, v.tolist()) for k, v in enumerate(_near(20, rng))]
    few = [(1000, [1.0, 2.0]), (1001, [1.0, 2.0]), (1002, [2.0, 4.0]), (1003, [-1.0, 2.0])]
    tie = [(2000, [1.0, 0.0, 0.0]), (2001, [3.0, 4.0, 0.0])]  # cosine 0.6
    df = spark.createDataFrame([*many, *few, *tie], "vec_id long, embedding array<float>")
    got = {(r[0], r[1]): r[2] for r in embeddings.near_vectors(df, 0.6, recall=0.9999).collect()}
    assert {k: round(v, 9) for k, v in got.items() if k[0] >= 1000} == {(1000, 1001): 1.0, (1000, 1002): 1.0, (1000, 1003): 0.6, (1002, 1003): 0.6, (2000, 2001): 0.6}
    copies = spark.createDataFrame([(k, [1.0, 3.0]) for k in range(60)], "vec_id long, embedding array<float>")
    assert sorted((r[0], r[1]) for r in embeddings.near_vectors(copies).collect()) == [(0, k) for k in range(1, 60)]
    assert embeddings.Plan(10**12, 64).g > 40  # no bound on the directions of a cell


def test_sharding_by_sources_that_begin_alike(spark, monkeypatch):
    names = ["common-crawl-2024", "wikipedia_de", "common-crawl-2023", "wikipedia_en"]
    rows = [(k, "x" * 100, "en", names[k % 4]) for k in range(40)]
    docs = spark.createDataFrame([*rows, (40, "x", "en", None), (41, "x", None, "")], "doc_id long, text string, lang string, source string").repartition(5)
    want = {None: 0.0, "": 1.0} | {x: k + 2.0 for k, x in enumerate(sorted(names))}
    for most in (sharding.RANKS_BYTES, 0):
        monkeypatch.setattr(sharding, "RANKS_BYTES", most)
        got = {r.doc_id: (r.d1, r.d2) for r in sharding.metadata(docs).collect()}
        assert got == {r.doc_id: (want[r.source], 0.0 if r.lang is None else 1.0) for r in docs.collect()}
    # only the source differs enough to be the widest: no shard mixes sources
    same = spark.createDataFrame([(7, "x" * 100, "en", names[k % 4]) for k in range(40)], "doc_id long, text string, lang string, source string")
    assert sorted(r["count"] for r in sharding.shard(same, 1000).groupBy("shard_id").count().collect()) == [10] * 4


def test_embedding_classes_have_a_row_per_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (5, [0.0, 0.0]), (6, [0.0, 0.0]), (9, [0.0, 1.0]), (10, [2.0, 0.01]), (11, [2.0, 0.01]), (None, [1.0, 0.0])]
    got = embeddings.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got.columns == ["vec_id", "class_id", "links"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 3), (2, 1, 3), (3, 3, 0), (5, 5, 0), (6, 6, 0), (9, 9, 0), (10, 1, 3), (11, 1, 3)]
