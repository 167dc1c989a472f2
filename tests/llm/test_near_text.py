from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tallyweave.llm import near_text as N


def brute_force(rows, threshold=N.THRESHOLD):
    """All pairs of different ids by counting common n-grams."""
    col = pa.array([t for _, t in rows], pa.string())
    h, b = N.gram_sets(col)
    sets = {k: frozenset(h[b[k] : b[k + 1]].tolist()) for k in range(len(rows))}
    inverted, common = defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            inverted[g].append(k)
    for ks in inverted.values():
        common.update(itertools.combinations(ks, 2))
    out = {}
    for (x, y), c in common.items():
        j = c / (len(sets[x]) + len(sets[y]) - c)
        pair = tuple(sorted((rows[x][0], rows[y][0])))
        if j >= threshold and pair[0] != pair[1]:
            out[pair] = max(j, out.get(pair, 0))
    return out


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {root(i) for i in ids}


def test_matches_brute_force(docs):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    want = brute_force(rows)
    found = N.near_pairs(docs)
    got = {(r[0], r[1]): r[2] for r in N.expand(found).collect()}
    assert len(want) > 5
    assert not set(got) - set(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)
    kept = {r[0] for r in N.drop_near(docs).select("doc_id").collect()}
    assert kept == groups(got, [i for i, _ in rows])


def test_copies_stay_linear(spark):
    rows = [(k, "the same words again and again in one long line") for k in range(50)] + [(100 + k, f"something else {k} entirely with number {k * 7}") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_pairs(df)
    assert found.columns == ["doc_a", "doc_b", "jaccard"] and dict(found.dtypes)["doc_a"] == "bigint"
    assert sorted((r[0], r[1]) for r in found.collect() if r[2] == 1.0) == [(0, k) for k in range(1, 50)]
    assert N.expand(N.near_pairs(df)).where("jaccard = 1.0").count() == 50 * 49 // 2
    assert N.drop_near(df).where("doc_id < 100").count() == 1


def test_large_groups_are_divided(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r[0], r[1]) for r in N.expand(N.near_pairs(df)).collect()}
    want = set(brute_force(rows))
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_hot_bands_make_every_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 16)
    rows = [(7, k, 300) for k in range(300)] + [(8, 1000 + k, 17) for k in range(17)]
    got = [tuple(r) for r in N.hot_pairs(spark.createDataFrame(rows, "bh long, sid long, m long")).collect()]
    assert sorted(got) == [*itertools.combinations(range(300), 2), *itertools.combinations(range(1000, 1017), 2)]
    shared = spark.createDataFrame([(k, [5, 100 + k // 2, 1000 + k]) for k in range(40)], "sid long, bands array<long>")
    assert sorted(tuple(r) for r in N.candidates(shared).collect()) == [*itertools.combinations(range(40), 2)]


def test_removal_is_by_text_of_an_id(spark):
    a, b = "one text with quite a few words in it to be compared", "another story altogether about ships and the sea"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (3, b.upper())], "doc_id long, text string")
    assert sorted(tuple(r) for r in N.drop_near(df).collect()) == [(1, a), (2, b)]
    assert sorted((r[0], r[1]) for r in N.near_pairs(df).collect()) == [(1, 2), (2, 3)]


def test_tie_at_the_threshold(spark):
    # 3-grams of 6 words: 4 each, of which 3 more words share; 2 common of 4 in the union is exactly 0.5
    df = spark.createDataFrame([(1, "a b c d e"), (2, "b c d e f x"), (3, "b c d e"), (4, "q r s t u v w")], "doc_id long, text string")
    got = {(r[0], r[1]): r[2] for r in N.near_pairs(df, recall=0.999999).collect()}
    assert got == {(1, 3): 2 / 3, (2, 3): 0.5}


def test_hashes_against_plain_sets(docs):
    """The operator's n-gram hashes say the same about similarity as sets of the words themselves."""
    texts = [r.text for r in docs.select("text").limit(120).collect()]
    plain = []
    for t in texts:
        w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
        plain.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    h, b = N.gram_sets(pa.array(texts, pa.string()))
    mine = [set(h[b[k] : b[k + 1]].tolist()) for k in range(len(texts))]
    assert [len(x) for x in mine] == [len(x) for x in plain]
    for x, y in itertools.combinations(range(len(texts)), 2):
        assert len(mine[x] & mine[y]) == len(plain[x] & plain[y])


def test_awkward_rows(awkward, empty):
    got = N.expand(N.near_pairs(awkward)).collect()
    assert got == []  # a repeated row is no pair; empty sets are similar to nothing
    out = N.drop_near(awkward)
    assert out.columns == awkward.columns
    assert out.count() == awkward.count() - 1  # only the repeated row goes
    assert N.near_pairs(empty).count() == 0 and N.drop_near(empty).count() == 0


def test_bands_reach_the_recall():
    for t in (0.3, 0.5, 0.8):
        b = N.bands_for(t, 0.95, 4)
        assert 1 - (1 - t**4) ** b >= 0.95 > 1 - (1 - t**4) ** (b - 1)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (4, 30)]
    got = {r[0]: r[1] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 30: 1, 8: 7, 9: 7, 21: 20}


def by_hand(rows, threshold=0.5):
    """(doc_id, class_id, links) of documents with different ids, by plain sets of words' 3-grams."""
    sets = {}
    for k, t in rows:
        w = re.findall(r"[a-z0-9_]+", t.lower())
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    links = {k: [o for o in sets if o != k and sets[k] & sets[o] and len(sets[k] & sets[o]) >= threshold * len(sets[k] | sets[o])] for k in sets}
    least = {k: k for k in sets}
    while any(least[o] < least[k] for k in sets for o in links[k]):
        least |= {k: min(least[k], *(least[o] for o in links[k])) for k in sets if links[k]}
    return sorted((k, least[k], len(links[k])) for k in sets)


def variants(n=120, seed=3):
    """Texts whose similarities lie closely around the threshold, some exactly on it, with copies, short and empty ones."""
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(size)] for size in (4, 9, 30, 80)]
    rows = []
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(max(2, len(words) // 8))):
            words[rng.randrange(len(words))] = f"new{rng.randrange(60)}"
        rows.append((k, " ".join(words[rng.randrange(3) :])))
    return [*rows, *((n + k, rows[k][1].upper()) for k in range(0, n, 7)), (1000, ""), (1001, "!?"), (1002, "one"), (1003, "one"), (1004, "one two")]


def test_no_link_is_left_out(spark, monkeypatch):
    """Bands of recall 0.95 left some of these pairs out."""
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = by_hand(rows)
    pairs = sum(n for _, _, n in want) // 2
    assert pairs > 500 and {n for _, _, n in want} > {0, 1}
    got = sorted(tuple(r) for r in N.near_classes(df).collect())
    assert got == want
    assert {(r[0], r[1]) for r in N.expand(N.near_pairs(df)).collect()} == set(brute_force(rows))
    monkeypatch.setattr(N, "BLOCK", 7)  # homes of several cells
    monkeypatch.setattr(N._links, "SLICE", 500)
    monkeypatch.setattr(N._links, "BUCKET", 100)
    assert sorted(tuple(r) for r in N.near_classes(df).collect()) == want
    assert {r[0] for r in N.drop_near(df).collect()} == {c for _, c, _ in want}


def test_classes_have_a_row_per_document(spark, awkward, empty):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "quite another text of two"), (3, "A B C D E F G x"), (4, None), (4, ""), (None, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS class_id", "8 AS links", "9 AS mark")
    got = N.near_classes(df)
    assert got.columns == ["doc_id", "class_id", "links"] and set(dict(got.dtypes).values()) == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 2), (2, 1, 2), (2, 2, 0), (3, 1, 2), (4, 4, 0), (4, 4, 0)]
    known = awkward.where("doc_id IS NOT NULL")
    assert sorted(tuple(r) for r in N.near_classes(awkward).collect()) == sorted((r.doc_id, r.doc_id, 0) for r in known.select("doc_id", "text").distinct().collect())
    assert N.near_classes(empty).count() == 0


def test_common_by_matrix_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(50)]
    a, b = sets[:20], sets[20:]
    flat = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x]), len(x))
    want = [[len(np.intersect1d(s, t)) for t in b] for s in a]
    for share in (0, 0.05, 2):
        monkeypatch.setattr(N._links, "DENSE", share)
        assert N._links.common(*flat(a), *flat(b)).tolist() == want
