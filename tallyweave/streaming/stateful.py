"""Rate limiter, health state, duplicate and cache filters, batch life cycles as streaming queries.

Windows, first-of-key and near duplicates use event time: their watermarks are ten minutes unless given, and rows later than
these are dropped. Rate limiter, health and batches keep a state per key that is forgotten by processing time; they take late rows as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyweave.operators.grouped import by_group

WATERMARK = "10 minutes"


def admit(times: list[float], at: float, limit: int, window_s: float) -> tuple[bool, list[float]]:
    """Sliding log: admitted if fewer than `limit` admitted calls lie in the window before; refused calls leave no trace."""
    kept = [t for t in times if t > at - window_s]
    return (True, [*kept, at]) if len(kept) < limit else (False, kept)


def rate_limit_batch(requests: DataFrame, limit: int, window_s: float = 60.0) -> DataFrame:
    """seq and whether the request was admitted, per client_key in order of ts and seq."""

    def run(rows: list[dict]) -> list[dict]:
        times: list[float] = []
        for r in rows:
            r["admitted"], times = admit(times, r["t"], limit, window_s)
        return rows

    timed = requests.select("seq", "client_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("t", F.col("us") / 1e6)
    return by_group(timed, ["client_key"], ["us", "seq"], run, "seq long, client_key string, admitted boolean")


def rate_limit(requests: DataFrame, limit: int, window_s: float = 60.0) -> DataFrame:
    """The same on a stream; the state of a key is its admitted times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for t in pdf.ts:
            ok, times = admit(times, t.timestamp(), limit, window_s)
            out.append(ok)
        state.update((times,))
        state.setTimeoutDuration(int(window_s * 1000) * 2)
        yield pd.DataFrame({"seq": pdf.seq, "client_key": pdf.client_key, "admitted": out})

    return requests.select("seq", "ts", "client_key").groupBy("client_key").applyInPandasWithState(
        run, "seq long, client_key string, admitted boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def health_step(window: list[list[float]], seen: int, changed_at: float, state: str, at: float, status: int, latency: float, every: int = 10, frame: int = 50, cooldown_s: float = 60.0):
    """One request into the health machine: evaluated every tenth request, at most one change a cooldown."""
    window = [*window, [float(status >= 500), latency]][-frame:]
    seen += 1
    if seen % every == 0 and len(window) >= 5 and at - changed_at >= cooldown_s:
        errors = sum(w[0] for w in window) / len(window)
        p95 = sorted(w[1] for w in window)[min(int(len(window) * 0.95), len(window) - 1)]
        new = "critical" if errors >= 0.3 or p95 >= 25_000 else "degraded" if errors >= 0.1 or p95 >= 10_000 else "healthy"
        if new != state:
            state, changed_at = new, at
    return window, seen, changed_at, state


def health_batch(requests: DataFrame, key: str = "service", every: int = 10, frame: int = 50, cooldown_s: float = 60.0) -> DataFrame:
    """seq, key, state after each evaluated request of a table, in order of ts and seq: what the stream says when it sees one request at a time."""

    def run(rows: list[dict]) -> list[dict]:
        window, seen, changed, name, out = [], 0, -1e18, "healthy", []
        for r in rows:
            window, seen, changed, name = health_step(window, seen, changed, name, r["us"] / 1e6, r["status_code"], r["latency_ms"], every, frame, cooldown_s)
            if seen % every == 0:
                out.append({"seq": r["seq"], key: r[key], "state": name})
        return out

    timed = requests.select("seq", key, "status_code", "latency_ms", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return by_group(timed, [key], ["us", "seq"], run, f"seq long, {key} string, state string")


def health(requests: DataFrame, key: str = "service") -> DataFrame:
    """State of each key after each micro-batch of requests."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            flat, seen, changed, name = state.get
            window = [list(flat[i : i + 2]) for i in range(0, len(flat), 2)]
        else:
            window, seen, changed, name = [], 0, -1e18, "healthy"
        for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            window, seen, changed, name = health_step(window, seen, changed, name, r.ts.timestamp(), r.status_code, r.latency_ms)
        state.update(([x for w in window for x in w], seen, changed, name))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "state": [name]})

    return requests.groupBy(key).applyInPandasWithState(run, f"{key} string, seen long, state string", "flat array<double>, seen long, changed double, name string", "update", GroupStateTimeout.NoTimeout)


def window_counts(rows: DataFrame, ts: str, by: list[str], minutes: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """Counts per window and label with a watermark; the same plan serves batch tables."""
    g = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.window(ts, f"{minutes} minutes").alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n")


def first_of_key(rows: DataFrame, ts: str, key: str, ttl: str = "24 hours") -> DataFrame:
    """First row of each key within the time to live: exact duplicates and cached results."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def near_duplicates(left: DataFrame, right: DataFrame, hours: int = 24, distance: int = 5) -> DataFrame:
    """Stream-stream join of (id, ts, hash) on hash bands within the window; of the bands that two hashes share, the first shows the pair."""
    from tallyweave.functions.hashing import hamming
    from tallyweave.operators.dedup import BANDS

    keys = F.array(*[F.struct(F.lit(k).alias("n"), F.shiftrightunsigned(F.col("hash"), s).bitwiseAND(F.lit((1 << w) - 1)).alias("v")) for k, (s, w) in enumerate(BANDS)])
    a = left.withWatermark("ts", f"{hours} hours").select(F.col("id").alias("id_a"), F.col("ts").alias("ta"), F.col("hash").alias("ha"), F.explode(keys).alias("ka"))
    b = right.withWatermark("ts", f"{hours} hours").select(F.col("id").alias("id_b"), F.col("ts").alias("tb"), F.col("hash").alias("hb"), F.explode(keys).alias("kb"))
    near = (F.col("ka") == F.col("kb")) & (F.col("id_a") < F.col("id_b")) & (F.col("tb") >= F.col("ta") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("tb") <= F.col("ta") + F.expr(f"INTERVAL {hours} HOURS"))
    value = lambda h, k: F.shiftrightunsigned(F.col(h), BANDS[k][0]).bitwiseAND(F.lit((1 << BANDS[k][1]) - 1))
    before = F.coalesce(*[F.when((F.col("ka.n") > k) & (value("ha", k) == value("hb", k)), True) for k in range(len(BANDS) - 1)], F.lit(False))
    return a.join(b, near).where(~before & (hamming(F.col("ha"), F.col("hb")) <= distance)).select("id_a", "id_b", "ta", "tb")


def tail_logs(lines: DataFrame) -> DataFrame:
    """JSON log lines to columns, with a pattern for plain ones; either kind of line gives a row."""
    j = F.from_json("value", "level string, message string, path string, status int, duration_ms double")
    plain = "^([0-9-]+ [0-9:,.]+)[ |-]+([A-Z]+)[ |-]+(.*)$"
    return lines.select(
        F.coalesce(j["level"], F.nullif(F.regexp_extract("value", plain, 2), F.lit("")), F.lit("UNKNOWN")).alias("level"),
        F.coalesce(j["message"], F.nullif(F.regexp_extract("value", plain, 3), F.lit("")), F.col("value")).alias("message"), j["path"].alias("path"), j["status"].alias("status"), j["duration_ms"].alias("duration_ms"),
    )


def batch_life(events: DataFrame, ttl_minutes: int = 60) -> DataFrame:
    """State of each batch from file events (batch_id, ts, n_files, status): pending, processing, completed, failed or cancelled; forgotten after the time to live.

    In a cancelled batch the files that haven't ended are skipped; percent is the share of files that have ended or are skipped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, done, failed, cancelled = state.get if state.exists else (0, 0, 0, False)
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            total = max(total, int(r.n_files))
            if cancelled:
                continue
            done += r.status == "done"
            failed += r.status == "failed"
            cancelled = r.status == "cancelled"
        state.update((total, done, failed, cancelled))
        state.setTimeoutDuration(ttl_minutes * 60_000)
        ended = done + failed
        skipped = max(0, total - ended) if cancelled else 0
        over = total > 0 and ended >= total
        name = "cancelled" if cancelled else ("failed" if failed == total else "completed") if over else "processing" if ended else "pending"
        percent = 100.0 * min(ended + skipped, total) / total if total else 0.0
        yield pd.DataFrame({"batch_id": [key[0]], "state": [name], "processed": [ended], "skipped": [skipped], "total": [total], "percent": [round(percent, 1)]})

    return events.groupBy("batch_id").applyInPandasWithState(
        run, "batch_id string, state string, processed long, skipped long, total long, percent double", "total long, done long, failed long, cancelled boolean", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


TERMINAL = ("completed", "failed", "cancelled")


def progress_events(life: DataFrame) -> DataFrame:
    """Messages for subscribers of batches: (batch_id, event, payload); event is done for the last one of a batch and progress before."""
    event = F.when(F.col("state").isin(*TERMINAL), "done").otherwise("progress")
    return life.select("batch_id", event.alias("event"), F.to_json(F.struct("*")).alias("payload"))


def heartbeats(spark, every_s: int = 2) -> DataFrame:
    """One message every few seconds, so that subscribers see that the stream is alive."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % every_s == 0)
    return ticks.select(F.lit(None).cast("string").alias("batch_id"), F.lit("heartbeat").alias("event"), F.to_json(F.struct("timestamp")).alias("payload"))


def alerts(bodies: DataFrame) -> DataFrame:
    """Alerts of webhook bodies (value): one row each with status, name, severity, summary and start; a body without alerts gives none."""
    alert = "struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:timestamp>"
    rows = bodies.select(F.from_json("value", f"status string, alerts array<{alert}>").alias("b")).select(F.col("b.status").alias("group_status"), F.explode("b.alerts").alias("a"))
    at = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
    return rows.select(
        F.coalesce("a.status", "group_status", F.lit("unknown")).alias("status"), F.coalesce(at("a.labels", "alertname"), F.lit("unknown")).alias("name"),
        F.coalesce(at("a.labels", "severity"), F.lit("none")).alias("severity"), at("a.annotations", "summary").alias("summary"), F.col("a.startsAt").alias("started_at"),
    )


def publish(df: DataFrame, handler, checkpoint: str):
    """Each micro-batch to a handler(rows, epoch), for progress events and message sinks."""
    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handler).start()
