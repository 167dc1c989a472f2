"""Models and hierarchies against plain versions of the same definitions, and bounds that hold at any table size."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import _text, decontam, langid, licenses, packing, pii, quality, toxicity
from tallyweave.llm._ftrl import Ftrl


def _plain_ftrl(rows, dim, k, alpha, beta, l1, l2, epochs):
    """Per-coordinate follow-the-regularised-leader, one coordinate at a time."""
    z, n = [[0.0] * k for _ in range(dim + 1)], [[0.0] * k for _ in range(dim + 1)]

    def weight(i, c):
        penalty = l1 if i < dim else 0.0
        if abs(z[i][c]) <= penalty:
            return 0.0
        return -(z[i][c] - math.copysign(penalty, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            idx, val, label = rows[r]
            x = [*zip(idx.tolist(), val.tolist(), strict=True), (dim, 1.0)]
            s = [sum(weight(i, c) * v for i, v in x) for c in range(k)]
            p = [1 / (1 + math.exp(-s[0]))] if k == 1 else [math.exp(v) / sum(map(math.exp, s)) for v in s]
            want = [float(label)] if k == 1 else [float(c == label) for c in range(k)]
            for i, v in x:
                for c in range(k):
                    g = (p[c] - want[c]) * v
                    w = weight(i, c)
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w
                    n[i][c] += g * g
    return np.array([[weight(i, c) for c in range(k)] for i in range(dim + 1)])


@pytest.mark.parametrize("k", [1, 3])
def test_ftrl_against_plain_version(k):
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4), int(rng.integers(0, max(2, k)))) for _ in range(60)]
    want = _plain_ftrl(rows, 12, k, 0.3, 1.0, 0.8, 0.1, 2)
    w, b = Ftrl(12, k, alpha=0.3, beta=1.0, l1=0.8, l2=0.1).fit(rows, 2).weights()
    assert np.allclose(w, want[:-1], atol=1e-6) and np.allclose(b, want[-1], atol=1e-6)
    assert (w == 0).any()


def _log_likelihood(f, bounds, y, w, other):
    """Over all label paths of each chain."""
    ev, t, total = w[f].sum(1) + other[0], other[1:].reshape(2, 2), 0.0
    for a, b in itertools.pairwise(bounds):
        score = lambda path: sum(ev[a + k] * x for k, x in enumerate(path)) + sum(t[u, v] for u, v in itertools.pairwise(path))  # noqa: B023, E731
        total += score(tuple(int(x) for x in y[a:b])) - math.log(sum(math.exp(score(p)) for p in itertools.product((0, 1), repeat=int(b - a))))
    return total


def test_crf_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    f, bounds, y = rng.integers(0, 9, (10, 3)), np.array([0, 4, 5, 10]), rng.integers(0, 2, 10)
    w, other = rng.normal(size=9), rng.normal(size=5)
    rows, gw, go = toxicity.gradient(f, bounds, y, w, other)
    eps = 1e-6
    for i, g in zip(rows, gw, strict=True):
        up, down = w.copy(), w.copy()
        up[i], down[i] = up[i] + eps, down[i] - eps
        assert abs((_log_likelihood(f, bounds, y, up, other) - _log_likelihood(f, bounds, y, down, other)) / (2 * eps) - g) < 1e-5
    for i, g in enumerate(go):
        up, down = other.copy(), other.copy()
        up[i], down[i] = up[i] + eps, down[i] - eps
        assert abs((_log_likelihood(f, bounds, y, w, up) - _log_likelihood(f, bounds, y, w, down)) / (2 * eps) - g) < 1e-5


def test_crf_fit_raises_the_likelihood():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 60)
    f = np.stack([y, 2 + rng.integers(0, 5, 60)], axis=1)
    bounds = np.arange(0, 61, 6)
    model = toxicity.fit_crf(f, bounds, y.astype(bool), epochs=20, batch=4)
    other = np.concatenate([[model.bias], model.trans.ravel()])
    assert _log_likelihood(f, bounds, y, model.weights.astype(float), other) > -3 > _log_likelihood(f, bounds, y, np.zeros(1 << toxicity.BITS), np.array([-2.0, 0, 0, 0, 0])) + 3


def test_em_against_plain_version():
    rng = np.random.default_rng(2)
    truth = rng.random(400) < 0.4
    votes = [tuple(int(v) if rng.random() < 0.8 else -int(v) if rng.random() < 0.5 else 0 for v in (1 if t else -1,) * 5) for t in truth]
    table = pd.DataFrame([("CARD", v, n) for v, n in sorted(Counter(votes).items())], columns=["kind", "votes", "n"])
    got = dict(zip(table["votes"], pii.expectation_maximisation(table), strict=True))
    # one observation at a time, with the same start and priors
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for v in votes]
    weak, yes_prior, no_prior = len(votes) * 0.02 + 1, {-1: 0.1, 0: 0.3, 1: 0.6}, {-1: 0.6, 0: 0.3, 1: 0.1}
    for _ in range(50):
        rate = (sum(post) + 1) / (len(votes) + 2)
        yes = [{a: sum(p for v, p in zip(votes, post, strict=True) if v[k] == a) + weak * yes_prior[a] for a in (-1, 0, 1)} for k in range(5)]
        no = [{a: sum(1 - p for v, p in zip(votes, post, strict=True) if v[k] == a) + weak * no_prior[a] for a in (-1, 0, 1)} for k in range(5)]
        py = lambda v: rate * math.prod(yes[k][v[k]] / sum(yes[k].values()) for k in range(5))  # noqa: B023, E731
        pn = lambda v: (1 - rate) * math.prod(no[k][v[k]] / sum(no[k].values()) for k in range(5))  # noqa: B023, E731
        post = [py(v) / (py(v) + pn(v)) for v in votes]
    assert all(abs(got[v] - p) < 1e-9 for v, p in zip(votes, post, strict=True))
    right = sum((got[v] >= 0.5) == t for v, t in zip(votes, truth, strict=True))
    assert right >= 0.9 * len(votes)


def test_document_frequencies_and_scores_by_hand(docs):
    part = docs.limit(60)
    texts = [r.text for r in part.select("text").collect()]
    sets = []
    for t in texts:
        grams, _ = langid.ngrams(pa.array([t], pa.string()))
        sets.append({x for x in grams.ravel().tolist() if x})
    df = Counter(x for s in sets for x in s)
    idf = langid.inverse_frequencies(part.repartition(5))
    want = [math.log((1 + len(texts)) / (1 + df[b])) + 1 for b in range(1, 1 << langid.BITS)]
    assert np.allclose(idf[1:], want) and idf[0] == 0
    w = np.random.default_rng(0).normal(size=(1 << langid.BITS, 2))
    model = langid.Model(["a", "b"], (w * idf[:, None]).astype(np.float32), np.array([0.1, -0.2]), 1.7)
    best, sure = model.score(pa.array(texts[:10], pa.string()))
    for k, t in enumerate(texts[:10]):
        counts = Counter(x for x in langid.ngrams(pa.array([t], pa.string()))[0].ravel().tolist() if x)
        n = sum(counts.values())
        s = (sum(c / n * idf[x] * w[x] for x, c in counts.items()) * langid.SCALE + [0.1, -0.2]) / 1.7
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert best[k] == p.argmax() and abs(sure[k] - p.max()) < 1e-4


def test_equal_languages_go_to_the_first():
    model = langid.Model(["aa", "bb"], np.zeros((1 << langid.BITS, 2), np.float32), np.zeros(2), 1.0)
    assert model.score(pa.array(["some text"]))[0].tolist() == [0]


def test_packing_hierarchy_against_plain_version(docs):
    capacity, full, group, fan = 6000, 0.98, 25, 4
    rest = packing.pieces(docs, capacity).where(F.col("length") < full * capacity).collect()
    groups = math.ceil(len(rest) / group)
    graded = docs.sparkSession.createDataFrame(rest).select("doc_id", "start", "length", F.pmod(F.xxhash64("doc_id", "salt", "start"), F.lit(groups)).alias("grp")).collect()
    level: dict[int, list] = {}
    for r in graded:
        level.setdefault(r.grp, []).append([(r.doc_id, r.start, r.length)])
    size = lambda item: sum(x[2] for x in item)
    final, rounds = [], 0
    while True:
        packed = {}
        for g, items in level.items():
            items.sort(key=lambda i: (-size(i), [x[0] for x in i], [x[1] for x in i]))
            packed[g] = [[x for k in b for x in items[k]] for b in packing.best_fit([size(i) for i in items], capacity)]
        if groups == 1:
            final += [b for bins in packed.values() for b in bins]
            break
        final += [b for bins in packed.values() for b in bins if size(b) >= full * capacity]
        left = {g: [b for b in bins if size(b) < full * capacity] for g, bins in packed.items()}
        n_left = sum(map(len, left.values()))
        fewer = max(1, math.ceil(groups / fan), math.ceil(n_left / group))
        if not n_left or fewer >= groups:
            final += [b for bins in left.values() for b in bins]
            break
        level = {}
        for g, bins in left.items():
            for b in bins:
                dealt = g * fewer // groups % fewer if fewer == math.ceil(groups / fan) else docs.sparkSession.sql(
                    f"SELECT pmod(xxhash64(array({', '.join(f'{x[0]}L' for x in b)}), array({', '.join(f'{x[1]}L' for x in b)}), array({', '.join(f'{x[2]}L' for x in b)})), {fewer})"
                ).head()[0]
                level.setdefault(dealt, []).append(b)
        groups, rounds = fewer, rounds + 1
    assert rounds >= 1
    got = [tuple(zip(r.doc_ids, r.starts, r.lengths, strict=True)) for r in packing.pack(docs, capacity, full, group, fan).collect()]
    whole = [((r.doc_id, r.start, r.length),) for r in packing.pieces(docs, capacity).where(F.col("length") >= full * capacity).collect()]
    assert sorted(got) == sorted([*map(tuple, final), *whole])


def test_packing_spreads_rows_without_an_id(spark):
    rows = [(None, f"text number {k}") for k in range(300)] + [(7, f"other text {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = packing.pieces(df, 100).select("doc_id", F.pmod(F.xxhash64("doc_id", "salt", "start"), F.lit(10)).alias("g")).distinct()
    assert groups.count() == 20
    out = packing.pack(df, 100, group_items=60).collect()
    assert sum(len(r.doc_ids) for r in out) == 600


def test_hash_limits_at_small_rates():
    for rate in (1e-9, 1e-12, 1e-17):
        assert abs(_text.hash_limit(rate) / 2**63 / rate - 1) < 0.2
    assert _text.hash_limit(1.0) == 2**63 - 1
    assert _text.hash_limit(1000 / 2.2e9) > 0


def test_samples_are_bounded_exactly(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("g"))
    got = _text.smallest_hashes(df, "g", {0: 1667, 1: 1667, 2: 1666}, {0: 10, 1: 100, 2: 5000}, ["doc_id"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 10, 1: 100, 2: 1666}
    again = _text.smallest_hashes(df.repartition(7), "g", {0: 1667, 1: 1667, 2: 1666}, {0: 10, 1: 100, 2: 5000}, ["doc_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    docs = spark.createDataFrame([(k, f"t {k}") for k in range(40)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels, "quality", 5)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 5, 1: 5}


def test_windows_of_several_texts_and_parts(spark, monkeypatch):
    words = [f"w{k}" for k in range(40)]
    a, b = " ".join(words[:20]), " ".join(words[10:30])
    bench = spark.createDataFrame([(1, a), (1, b), (2, " ".join(words[30:]))], "item_id long, text string")
    docs = spark.createDataFrame([(5, a), (5, b), (5, b), (6, " ".join(words))], "doc_id long, text string")
    grams = lambda t: {tuple(t[k : k + 13]) for k in range(len(t) - 12)}
    n = len(grams(words[:20]) | grams(words[10:30]))
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(5, 1): n, (6, 1): n, (6, 2): 1}
    monkeypatch.setattr(decontam, "MAX_TABLE_BYTES", 500)
    assert {(r.doc_id, r.item_id): r.n_windows for r in decontam.find_leaks(docs, bench).collect()} == got


def test_full_license_texts_in_their_usual_layout(spark):
    full = {i: x for i, x in licenses.all_templates() if len(x) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= set(full)
    rows = [(k, f"Project\n\nSome words about it.\n\n{x}\n\nThe end.") for k, x in enumerate(full.values())]
    got = {(r.doc_id, r.license_id): r.dice for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, i): 1.0 for k, i in enumerate(full)}


def _plain_runs(text, template, t):
    """The best Dice of any run of consecutive lines, by trying them all."""
    words = lambda x: "".join(c.lower() if c.isalnum() or c == "_" else " " for c in x).split()
    pairs = lambda w: set(itertools.pairwise(w))
    b, lines, best = pairs(words(template)), text.split("\n"), 0.0
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            a = pairs(words(" ".join(lines[i:j])))
            if a:
                best = max(best, 2 * len(a & b) / (len(a) + len(b)))
    return best if best >= t else 0.0


def test_license_runs_of_lines_against_all_runs():
    rng = random.Random(5)
    template = " ".join(f"l{k}" for k in range(40))
    texts = []
    for _ in range(40):
        w = template.split()
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = "other"
        body = [" ".join(w[k : k + 5]) for k in range(0, 40, 5)]
        texts.append("\n".join(["before it all"] * rng.randint(0, 2) + body[rng.randint(0, 2) :] + ["and after it"] * rng.randint(0, 2)))
    got = {}
    for row, _, dice, _ in licenses.Scanner([("L", template)], 0.8).scan(pa.array(texts)):
        got[row] = max(dice, got.get(row, 0.0))
    want = {k: d for k, x in enumerate(texts) if (d := _plain_runs(x, template, 0.8))}
    assert got == want and 5 < len(want) < 40


def test_equal_templates_give_a_row_each():
    got = licenses.Scanner([("A", "one two three four five"), ("B", "one two three four five")], 0.8).scan(pa.array(["one two three four five"]))
    assert sorted(x[1] for x in got) == ["A", "B"]
