from __future__ import annotations

import corpus_pipeline as P
from tallyweave.llm import decontam, near_text, packing, pii, quality

from .conftest import SF
from .test_near_text import brute_force, groups


def test_stages_in_order_against_brute_force(spark, docs, labels):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near duplicates", "decontamination", "pii", "packing"]
    good = P.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns
    ids = {r[0] for r in good.select("doc_id").collect()}
    assert ids == {r[0] for r in quality.classify(docs, labels).where("keep").select("doc_id").collect()}
    rows = [(r[0], r[1]) for r in good.select("doc_id", "text").collect()]
    single = P.near_duplicate_stage(spark, good, SF)
    want = groups(brute_force(rows), [i for i, _ in rows])
    kept = {r[0] for r in single.select("doc_id").collect()}
    assert want <= kept and len(kept - want) <= 0.1 * (len(rows) - len(want))
    clean = P.decontamination_stage(spark, single, SF)
    leaked = {r[0] for r in decontam.find_leaks(single, bench).collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == kept - leaked
    masked = P.pii_stage(spark, clean, SF)
    spans = pii.find_pii(clean).collect()
    assert {r.doc_id for r in masked.collect()} == kept - leaked
    assert sum(r.text.count(f"[{k}]") for r in masked.collect() for k in pii.KINDS) >= len(spans) > 0
    bins = P.packing_stage(spark, masked, SF).collect()
    assert {d for b in bins for d in b.doc_ids} == kept - leaked
    assert sum(b.n_tokens for b in bins) == sum(len(r.text.encode()) + 1 for r in masked.collect())
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, bins))


def test_stages_survive_awkward_rows(spark, awkward, empty):
    from tallyweave.llm.decontam import drop_leaked

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = quality.keep_good(awkward, spark.read.parquet(f"{SF}/labels.parquet"))
    out = pii.mask(drop_leaked(near_text.drop_near(out), bench))
    assert out.columns == awkward.columns
    assert packing.pack(out).count() >= 1
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
