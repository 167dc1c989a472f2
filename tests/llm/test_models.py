from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from tallyweave.llm import langid, quality, toxicity

SF1 = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    got = quality.classify(docs, train).join(labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "truth"), "doc_id").collect()
    right = [r.keep == (r.truth == 1) for r in got]
    assert sum(right) / len(right) >= 0.95
    assert all(r.keep for r in got if r.truth == 1)
    kept = quality.keep_good(docs, train)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in quality.classify(docs, train).where("keep").select("doc_id").collect()}


def test_quality_awkward(spark, awkward, empty, labels):
    q = {r.doc_id: r for r in quality.classify(awkward, labels).collect()}
    assert all(not q[i].keep and q[i].quality == 0.0 for i in (2, 3, 4))
    assert quality.classify(awkward, labels).count() == awkward.count()
    assert quality.keep_good(awkward, labels).columns == awkward.columns
    assert quality.classify(empty, labels).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(awkward, none).where("keep").count() == awkward.where("length(trim(text)) > 0 AND text NOT RLIKE '^\\\\s+$'").count()
    assert quality.classify(awkward, labels.limit(0)).count() == awkward.count()


def test_quality_dot_product_by_hand():
    w = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    col = pa.array(["One two two. THREE!!", None, "", "x"])
    got = quality.scorer((w, 0.3))(col)
    idx, first, count = quality.features(col)
    for t in range(4):
        part = idx[first[t] : first[t + 1]].ravel()
        want = 1 / (1 + np.exp(-(w[part].astype(float).sum() * quality.SCALE / max(1, count[t]) + 0.3))) if count[t] else 0.0
        assert abs(got[t] - want) < 1e-6


def test_langid_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    got = langid.identify(docs, max_per_lang=60).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = np.array([r.lang == r.lang_pred for r in got])
    assert right.mean() >= 0.97
    assert abs(np.mean([r.confidence for r in got]) - right.mean()) < 0.05


def test_langid_awkward(spark, awkward, empty):
    got = langid.identify(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.doc_id: (r.lang_pred, r.confidence) for r in got if r.doc_id in (2, 3, 4)} == dict.fromkeys((2, 3, 4), ("und", 0.0))
    assert langid.identify(empty).count() == 0
    one = spark.createDataFrame([(1, "hello there", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.confidence) for r in langid.identify(one).collect()} == {(1, "en", 1.0), (2, "und", 0.0)}


def test_langid_ngrams_by_hand():
    col = pa.array(["Ab\tç", "x", "", None])
    grams, bounds = langid.ngrams(col)
    assert bounds.tolist() == [0, 4, 5, 5, 5]
    assert (grams > 0).sum(1).tolist() == [5, 3, 2]
    again, _ = langid.ngrams(pa.array(["ab ç"]))
    assert (again == grams[:, :4]).all()


def test_temperature_sharpens_and_softens():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    logits = np.where(np.arange(3) == y[:, None], 1.0, 0.0) + rng.gumbel(size=(4000, 3))
    t = langid.calibrate(logits * 4, y)
    assert 3 < t / langid.calibrate(logits, y) < 5


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 5, 10])
    ev, trans = rng.normal(size=10), rng.normal(size=(2, 2))
    p, pair = toxicity.marginals(ev, first, trans)
    steps = iter(pair)
    for a, b in itertools.pairwise(first):
        total, mass, joint = 0.0, np.zeros(b - a), np.zeros((b - a - 1, 2, 2))
        for path in itertools.product((0, 1), repeat=int(b - a)):
            s = np.exp(sum(ev[a + k] * x for k, x in enumerate(path)) + sum(trans[x, y] for x, y in itertools.pairwise(path)))
            total += s
            mass += s * np.array(path)
            for k, (x, y) in enumerate(itertools.pairwise(path)):
                joint[k, x, y] += s
        assert np.allclose(p[a:b], mass / total)
        for k in range(b - a - 1):
            assert np.allclose(next(steps), joint[k] / total)


def test_long_chain_does_not_underflow():
    p, _ = toxicity.marginals(np.full(50_000, -3.0), np.array([0, 50_000]), np.array([[1.0, -1], [-1, 1]]))
    assert np.isfinite(p).all() and p.max() < 0.1


def test_toxic_spans(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    got = toxicity.find_toxic(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert not [r for r in got if truth.get(r.doc_id) == 0]
    english = {i for i, t in truth.items() if t == 1 and any(w in text[i].lower().split() for w in ("idiot", "scum", "moron", "clown"))}
    assert len(english & {r.doc_id for r in got}) >= 0.95 * len(english)
    for r in got:
        assert r.toxicity >= toxicity.THRESHOLD and len(r.starts) == len(r.ends) > 0
        assert all(text[r.doc_id][a:b].strip() == text[r.doc_id][a:b] != "" for a, b in zip(r.starts, r.ends, strict=True))


def test_toxic_awkward(spark, awkward, empty, labels):
    assert toxicity.find_toxic(awkward, labels).count() == 0
    assert toxicity.find_toxic(empty, labels).count() == 0
    assert toxicity.find_toxic(awkward, labels.limit(0)).count() == 0


def test_toxic_words_of_copies_and_fixed_phrases(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
    fixed = [(f"{prose(20)} go kill yourself {prose(20)}", 1) for _ in range(60)]  # one context of the middle word
    insult = [(f"{prose(20)} moronix {prose(20)}", 1) for _ in range(40)]
    base = f"{prose(30)} moronix {prose(30)} rareword {prose(30)}"
    copies = [(base, 1)] * 300 + [(f"{base} {prose(2)}", 1) for _ in range(100)]
    clean = [(prose(41), 0) for _ in range(300)]
    sample = spark.createDataFrame([*fixed, *insult, *copies, *clean], "text string, label int")
    lexicon, _ = toxicity.toxic_words(sample)
    hashes = dict(zip(("kill", "moronix", "rareword"), toxicity.Sentences(pa.array(["kill moronix rareword"])).hash, strict=True))
    assert {w: h in lexicon for w, h in hashes.items()} == {"kill": True, "moronix": True, "rareword": False}
