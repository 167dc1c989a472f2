from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import metrics
from tallyweave.operators import receipts as R
from tallyweave.plans.fixtures import Tables
from tallyweave.sinks import writers
from tallyweave.sources import readers
from tallyweave.streaming import stateful as S

SF = "/root/testdata/sf0.001"


def test_catalog_csv_with_mark_and_gaps(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿product_code,product_name,category\nabc , Name,Paint\n,x,\nQ,,\n", encoding="utf-8")
    df = readers.catalog_csv(spark, str(tmp_path / "p.csv"))
    from tallyweave.operators import catalog as C

    added, skipped, errors = C.import_rows(df, Tables(spark, SF).products)
    assert [(r.product_code, r.unit) for r in added.collect()] == [("ABC", "Piece")]
    assert skipped.count() == 0 and errors.count() == 2


def test_catalog_csv_round_trip(spark, tmp_path):
    p = Tables(spark, SF).products
    writers.catalog_csv(p, str(tmp_path / "out"))
    assert readers.catalog_csv(spark, str(tmp_path / "out")).count() == p.where("is_active").count()


def test_json_sources(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.json").write_text(json.dumps({"receipt_id": "a", "image_file": "a.jpg", "items": [{"code": "X", "quantity": 2}], "total_quantity": 2}))
    (tmp_path / "l/b.json").write_text("{broken")
    images = spark.createDataFrame([("/x/a.jpg",)], "path string")
    got = readers.labels_json(spark, str(tmp_path / "l"), images).collect()
    assert [(r.receipt_id, r.image_exists) for r in got] == [("a", True)]
    (tmp_path / "u.json").write_text(json.dumps({"days": {"2024-01-01": {"calls": [{"timestamp": "2024-01-01T10:00:00", "model": "prebuilt-read", "pages": 2, "success": True, "cost": 0.003}]}}}))
    assert [(r.day, r.pages) for r in readers.usage_json(spark, str(tmp_path / "u.json")).collect()] == [("2024-01-01", 2)]
    (tmp_path / "r.json").write_text(json.dumps({"ocr_char_subs": {"0": "O"}, "handwriting_subs": {"n": "H"}}))
    assert {tuple(r) for r in readers.rules_json(spark, str(tmp_path / "r.json")).collect()} == {("ocr_char_subs", "0", "O"), ("handwriting_subs", "n", "H")}
    (tmp_path / "res").mkdir()
    for k in (1, 2):
        (tmp_path / f"res/{k}.json").write_text(json.dumps({"session": f"s{k}", "f1": 0.5}))
    assert [r.session for r in readers.results_json(spark, str(tmp_path / "res")).collect()] == ["s2", "s1"]
    (tmp_path / "c.json").write_text('{"sha256":"x","cached_at":"2024-01-02T00:00:00","result":"r"}\n{"sha256":"y","cached_at":"2023-01-02T00:00:00","result":"r"}\n')
    assert [r.sha256 for r in readers.cache_json(spark, str(tmp_path / "c.json"), "2024-01-02 12:00:00").collect()] == ["x"]


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"rest")
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    (tmp_path / "c.txt").write_bytes(b"ignored")
    got = {r.path.rpartition("/")[2]: (r.kind, r.accepted) for r in readers.checked_images(readers.images(spark, str(tmp_path))).collect()}
    assert got == {"a.png": ("png", True), "b.jpg": (None, False)}


def test_vouchers_in_xml_and_json(spark, tmp_path):
    t = Tables(spark, SF)
    r, i = t.receipts.where("id < 30"), t.items
    writers.vouchers_xml(r, i, str(tmp_path / "x"))
    back = spark.read.format("xml").option("rowTag", "VOUCHER").load(str(tmp_path / "x"))
    assert back.count() == 30 and "_VCHTYPE" in back.columns
    writers.vouchers_json(r, i, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 30
    writers.report_csv(r, i, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep/data")).count() == R.data_sheet(r, i).count()


def test_append_and_snapshots(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        writers.append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6
    for day in ("2024-01-01", "2024-01-09", "2024-01-09"):
        writers.snapshot(df, str(tmp_path / "s"), day)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    assert [str(r.day) for r in writers.kept_snapshots(spark, str(tmp_path / "s"), "2024-01-10", 7).collect()] == ["2024-01-09"]


def test_evolution(spark):
    df = schemas.evolve(spark.createDataFrame([("A",)], "product_code string"), "products")
    assert df.head().unit_price == 0.0 and schemas.evolve(df, "products").columns == df.columns
    assert "image_hash" not in schemas.evolve(spark.range(1), "receipts", 3).columns


def _run(df, name, mode, once=False):
    """All of a stream's input; once for queries with processing-time timeouts, which never run out of batches."""
    trigger = {"once": True} if once else {"availableNow": True}
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**trigger).start()
    ended = q.awaitTermination(90)
    q.stop()
    assert ended
    return df.sparkSession.table(name)


def _stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_refused_calls_leave_no_trace():
    times: list[float] = []
    out = []
    for t in (0, 10, 20, 30, 61, 62):
        ok, times = S.admit(times, t, 2, 60)
        out.append(ok)
    assert out == [True, True, False, False, True, False]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    req = Tables(spark, SF).requests.withColumn("client_key", F.concat(F.lit("k"), F.col("seq") % 5)).coalesce(1)
    want = {(r.seq, r.admitted) for r in S.rate_limit_batch(req, 2, 86400.0).collect()}
    got = {(r.seq, r.admitted) for r in _run(S.rate_limit(_stream(spark, req, tmp_path / "in"), 2, 86400.0), "limited", "append", True).collect()}
    assert got == want and {a for _, a in want} == {True, False}


def test_health_machine_and_stream(spark, tmp_path):
    state = ([], 0, -1e18, "healthy")
    seen = []
    for k in range(40):
        state = S.health_step(*state, at=float(k), status=500 if k < 20 else 200, latency=5.0)
        seen.append(state[3])
    assert seen[8] == "healthy" and seen[9] == "critical" and seen[39] == "critical"  # the cooldown holds the state
    req = Tables(spark, SF).requests.withColumn("service", F.lit("s")).coalesce(1)
    out = _run(S.health(_stream(spark, req, tmp_path / "in")), "healthy", "update", True).collect()
    assert out[-1].seen == req.count()


def test_windows_and_first_of_key(spark, tmp_path):
    ev = Tables(spark, SF).logs.coalesce(1)
    stream = _stream(spark, ev, tmp_path / "in")
    got = _run(S.window_counts(stream, "ts", ["stage"]), "counts", "append")
    want = S.window_counts(ev, "ts", ["stage"])
    assert 0 < got.count() <= want.count()
    assert got.join(want, ["window_start", "stage", "n"], "left_anti").count() == 0
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 01:00:00", "a"), (3, "2024-01-01 02:00:00", "b")], "id long, t string, k string").withColumn("ts", F.to_timestamp("t")).coalesce(1)
    assert {r.k for r in _run(S.first_of_key(_stream(spark, d, tmp_path / "k"), "ts", "k"), "firsts", "append").collect()} == {"a", "b"}


def test_near_duplicate_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", 255), (2, "2024-01-01 01:00:00", 254), (3, "2024-01-05 01:00:00", 255), (4, "2024-01-01 02:00:00", -1)], "id long, t string, hash long").withColumn("ts", F.to_timestamp("t")).coalesce(1)
    a = _stream(spark, d, tmp_path / "in")
    b = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    assert {(r.id_a, r.id_b) for r in _run(S.near_duplicates(a, b), "near", "append").collect()} == {(1, 2)}


def test_log_lines_and_batches(spark, tmp_path):
    lines = spark.createDataFrame([('{"level":"INFO","message":"m","status":200}',), ("2024-01-01 10:00:00 | ERROR | it broke",), ("noise",)], "value string")
    got = [(r.level, r.message) for r in S.tail_logs(lines).collect()]
    assert got == [("INFO", "m"), ("ERROR", "it broke"), ("UNKNOWN", "noise")]
    rows = [("a", "2024-01-01 00:00:00", 2, "done"), ("a", "2024-01-01 00:00:01", 2, "failed"), ("b", "2024-01-01 00:00:00", 2, "done"), ("c", "2024-01-01 00:00:00", 1, "failed"), ("d", "2024-01-01 00:00:00", 3, "cancelled")]
    d = spark.createDataFrame(rows, "batch_id string, t string, n_files int, status string").withColumn("ts", F.to_timestamp("t")).coalesce(1)
    got = {r.batch_id: r.state for r in _run(S.batch_life(_stream(spark, d, tmp_path / "in")), "batches", "update", True).collect()}
    assert got == {"a": "completed", "b": "processing", "c": "failed", "d": "cancelled"}


def test_publish(spark, tmp_path):
    d = spark.range(5).coalesce(1)
    seen = []
    q = S.publish(_stream(spark, d, tmp_path / "in"), lambda rows, epoch: seen.append(rows.count()), str(tmp_path / "cp"))
    for _ in range(60):
        if sum(seen) == 5:
            break
        q.awaitTermination(1)
    q.stop()
    assert sum(seen) == 5


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_old_snapshots_are_removed(spark, tmp_path):
    path = str(tmp_path / "s")
    for day in ("2024-01-01", "2024-01-03", "2024-01-09"):
        writers.snapshot(spark.createDataFrame([(day,)], "x string"), path, day)
    (tmp_path / "s" / "snapshot_date=other").mkdir()
    assert writers.prune_snapshots(spark, path, "2024-01-10", 7) == ["2024-01-01"]
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["snapshot_date=2024-01-03", "snapshot_date=2024-01-09", "snapshot_date=other"]
    assert writers.prune_snapshots(spark, path, "2024-01-10", 7) == []


def test_records_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("s1", 3)], "session string, n_samples int")
    for _ in range(2):
        writers.save_record(df, "session", str(tmp_path))
    writers.save_record(spark.createDataFrame([("f", "0", "O")], "kind string, ch_from string, ch_to string"), "rules", str(tmp_path))
    assert [(r.record, r.session, r.n_samples) for r in spark.read.json(str(tmp_path / "session")).collect()] == [("session", "s1", 3)] * 2
    assert spark.read.json(str(tmp_path / "rules")).head().ch_to == "O"


def test_corrected_sample_and_its_differences(spark, tmp_path):
    schema = "receipt_id long, pos int, product_code string, quantity double"
    old = spark.createDataFrame([(1, 1, "ABC", 2.0), (1, 2, "XYZ", 1.0), (1, 3, "GHI", 5.0)], schema)
    new = spark.createDataFrame([(1, 1, " abc", 2.0), (1, 2, "XYW", 1.0), (1, 3, "GHI", 5.5), (1, 4, "JKL", 1.0)], schema)
    writers.save_corrected_sample(old, new, str(tmp_path), notes="n")
    label = spark.read.json(str(tmp_path / "labels")).head()
    assert (label.receipt_id, label.total_quantity, label.notes, [i.code for i in label["items"]]) == (1, 9.5, "n", [" abc", "XYW", "GHI", "JKL"])
    rows = spark.read.parquet(str(tmp_path / "corrections")).orderBy("nth").collect()
    assert [(r.nth, r.original_code, r.corrected_code) for r in rows] == [(2, "XYZ", "XYW"), (3, "GHI", "GHI"), (4, None, "JKL")]


def test_batches_cancelled_forgotten_and_capped(spark):
    files = spark.createDataFrame(
        [("a", "1", 0, 1, "done"), ("a", "2", 1, 2, "processing"), ("b", "1", 2, 3, "failed"), ("c", "1", 3, 4, "pending"), ("d", "1", 4, 5, "done"), ("d", "1", 5, 6, "failed"), ("d", "2", 5, 7, "done"), ("old", "1", -90, 0, "done")],
        "batch_id string, file_id string, minute int, seq long, status string",
    ).selectExpr("*", "timestamp'2024-01-01 12:00:00' + make_interval(0, 0, 0, 0, 0, minute) AS ts")
    off = spark.createDataFrame([("a",), ("a",)], "batch_id string")
    got = {r.batch_id: (r.state, r.processed, r.total) for r in metrics.batch_states(files, off, "2024-01-01 12:30:00").collect()}
    assert got == {"a": ("cancelled", 1, 2), "b": ("failed", 1, 1), "c": ("pending", 0, 1), "d": ("completed", 2, 2)}
    assert [r.batch_id for r in metrics.batch_states(files, off, "2024-01-01 12:30:00", newest=2).collect()] == ["d", "c"]
    p = {r.batch_id: (r.skipped, r.pct) for r in metrics.progress(files, off).collect()}
    assert p["a"] == (1, 100.0) and p["c"] == (0, 0.0)


def test_table_functions(spark):
    from tallyweave.functions import match as M

    M.register(spark)
    got = spark.sql("SELECT * FROM align_strings('AB', 'AXB')").collect()
    assert [(r.place, r.a, r.b) for r in got] == [(0, "A", "A"), (1, "-", "X"), (2, "B", "B")]
    spark.createDataFrame([(1, "AB1 2 cd2 3 | x GH4 1"), (2, None)], "id int, text string").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT id, s.* FROM some_lines, LATERAL split_codes(text, array('AB1', 'CD2', 'GH4')) s").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "AB1"), (1, 0, 1, "2 cd2 3"), (1, 1, 0, "x GH4 1")]
    assert spark.sql("SELECT similarity('AB', 'AB') AS s").head().s == 1.0


def test_cancelled_batches_as_a_stream(spark, tmp_path):
    schema = "batch_id string, ts timestamp, n_files int, status string"
    rows = [("a", 0, 4, "done"), ("a", 1, 4, "failed"), ("a", 2, 4, "cancelled"), ("a", 3, 4, "done"), ("b", 0, 2, "done"), ("c", 0, 1, "failed"), ("d", 0, 3, "queued")]
    spark.createDataFrame(rows, "batch_id string, m int, n_files int, status string").selectExpr("batch_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m) AS ts", "n_files", "status").write.parquet(str(tmp_path / "in"))
    out = S.progress_events(S.batch_life(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    q = out.writeStream.format("memory").queryName("life").outputMode("update").trigger(once=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    got = {r.batch_id: (r.event, json.loads(r.payload)) for r in spark.table("life").collect()}
    assert got["a"][0] == "done" and (got["a"][1]["state"], got["a"][1]["processed"], got["a"][1]["skipped"], got["a"][1]["percent"]) == ("cancelled", 2, 2, 100.0)
    assert (got["b"][0], got["b"][1]["state"], got["b"][1]["percent"]) == ("progress", "processing", 50.0)
    assert got["c"][1]["state"] == "failed" and got["d"][1]["state"] == "pending"


def test_heartbeats_run(spark, tmp_path):
    q = S.heartbeats(spark, 1).writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path)).start()
    for _ in range(60):
        if spark.table("beats").count():
            break
        time.sleep(1)
    q.stop()
    assert {r.event for r in spark.table("beats").collect()} == {"heartbeat"}


def test_alerts_of_bodies(spark):
    body = {"status": "firing", "alerts": [{"labels": {"alertname": "Slow", "severity": "high"}, "annotations": {"summary": "s"}, "startsAt": "2024-01-01T00:00:00Z"}, {"status": "resolved", "labels": {}}]}
    df = spark.createDataFrame([(json.dumps(body),), ("{}",), ("not json",), (None,)], "value string")
    assert [(r.status, r["name"], r.severity, r.summary) for r in S.alerts(df).collect()] == [("firing", "Slow", "high", "s"), ("resolved", "unknown", "none", None)]


def test_health_counts_the_limits():
    window, seen, changed, state = [], 0, -1e18, "healthy"
    for k in range(10):
        window, seen, changed, state = S.health_step(window, seen, changed, state, float(k), 500 if k < 3 else 200, 1.0)
    assert state == "critical"
    window, seen, changed, state = [], 0, -1e18, "healthy"
    for k in range(10):
        window, seen, changed, state = S.health_step(window, seen, changed, state, float(k), 200, 10_000.0)
    assert state == "degraded"
