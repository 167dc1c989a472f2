"""Operational metrics: rates, histograms and their quantiles, rolling health, batch progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.operators.catalog import small
from tallyweave.plans.fixtures import half_up

BUCKETS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 400.0)


def window_rates(rows: DataFrame, ts: str, by: list[str], minutes: int = 5) -> DataFrame:
    """Events per second in tumbling windows, by label."""
    g = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", half_up(F.col("n") / (minutes * 60.0), 6).alias("per_second"))


def window_ratio(rows: DataFrame, ts: str, numerator: Column, minutes: int = 5) -> DataFrame:
    """Share of rows that fulfil a condition per window, and the window's mean value."""
    g = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(numerator).alias("k"))
    return g.select(F.col("w.start").alias("window_start"), "n", "k", half_up(F.col("k") / F.col("n"), 6).alias("ratio"))


def window_means(rows: DataFrame, ts: str, value: str, minutes: int = 60) -> DataFrame:
    g = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    return g.select(F.col("w.start").alias("window_start"), "n", half_up(F.col("m"), 4).alias("mean"))


def held_alerts(ratios: DataFrame, limit: float, hold: int) -> DataFrame:
    """Runs of consecutive windows over the limit that lasted at least `hold` windows."""
    w = W.orderBy("window_start")  # one row per window, not per event
    d = ratios.withColumn("_n", F.row_number().over(w)).where(F.col("ratio") > limit)
    d = d.withColumn("_g", F.col("_n") - F.row_number().over(w))
    return d.groupBy("_g").agg(F.min("window_start").alias("since"), F.max("window_start").alias("until"), F.count("*").alias("n_windows")).where(F.col("n_windows") >= hold).drop("_g")


def histogram(rows: DataFrame, value: str, by: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative bucket counts by label; the last bucket is infinite and has bound null."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{k}") for k, b in enumerate(buckets)]
    g = rows.groupBy(*by).agg(*counts, F.count(value).alias("_inf"), F.sum(value).alias("_sum"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(buckets)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_inf").alias("n")))
    return g.select(*by, F.inline(F.array(*cells)))


def histogram_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets; in the infinite bucket it is the last finite bound."""
    w = W.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    total = F.max("n").over(W.partitionBy(*by))
    d = hist.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("total", total)
    hit = d.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    v = F.when(F.col("le").isNull(), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below")))
    return hit.select(*by, half_up(v, 4).alias("value"))


def counters(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def rolling_health(requests: DataFrame, key: str, frame: int = 50, least: int = 5) -> DataFrame:
    """After each request: error rate and p95 latency (zero-based index int(n * 0.95)) of the key's last `frame`, and the state.

    Partitioned by key: one unpartitioned frame over all requests would be a single task.
    """
    w = W.partitionBy(key).orderBy("ts", "seq").rowsBetween(-(frame - 1), 0)
    d = requests.withColumn("n", F.count("*").over(w)).withColumn("errors", F.count_if(F.col("status_code") >= 500).over(w)).withColumn("_l", F.array_sort(F.collect_list("latency_ms").over(w)))
    at = F.least(F.floor(F.col("n") * 0.95).cast("int") + 1, F.col("n").cast("int"))
    d = d.withColumn("p95", F.element_at("_l", at))
    rate, p95 = F.col("errors") / F.col("n"), F.col("p95")  # the state depends on the exact rate
    state = F.when(F.col("n") < least, "healthy").when((rate >= 0.3) | (p95 >= 25_000), "critical").when((rate >= 0.1) | (p95 >= 10_000), "degraded").otherwise("healthy")
    return d.select("seq", key, "n", half_up(rate, 4).alias("error_rate"), "p95", state.alias("state"))


def lifetime(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count("*").alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"), half_up(F.avg("latency_ms"), 3).alias("mean_latency"),
        half_up(F.coalesce(F.try_divide(F.count_if(F.col("status_code") >= 500), F.count("*")), F.lit(0.0)), 4).alias("error_rate"),
    )


def stage_timing(logs: DataFrame) -> DataFrame:
    return logs.groupBy("stage").agg(F.count("*").alias("n"), half_up(F.avg("duration_ms"), 3).alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))


def progress(files: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Per batch: files by state and percent done, from the last status of each file (batch_id, file_id, ts, status).

    In batches that were cancelled (batch_id), files that hadn't ended count as skipped.
    """
    last = files.groupBy("batch_id", "file_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    if cancelled is not None:
        off = small(cancelled.select("batch_id", F.lit(True).alias("_off")).distinct())
        ended = F.col("status").isin("done", "failed", "skipped")
        last = last.join(off, "batch_id", "left").withColumn("status", F.when(F.coalesce("_off", F.lit(False)) & ~ended, "skipped").otherwise(F.col("status")))
    done = F.count_if(F.col("status").isin("done", "failed", "skipped"))
    return last.groupBy("batch_id").agg(
        F.count("*").alias("n_files"), F.count_if(F.col("status") == "done").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), half_up(100.0 * done / F.count("*"), 1).alias("pct"),
    )


def batch_states(files: DataFrame, cancelled: DataFrame, as_of: str, ttl_minutes: int = 60, newest: int = 50) -> DataFrame:
    """State of the newest batches whose last event is within the time to live at as_of: pending, processing, completed, failed or cancelled.

    A batch is as old as its first event; of equally old ones the smaller batch_id counts as newer.
    """
    per = files.groupBy("batch_id", "file_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    g = per.groupBy("batch_id").agg(
        F.min("first").alias("created_at"), F.max("last").alias("updated_at"), F.count("*").alias("n"), F.count_if(F.col("status").isin("done", "skipped")).alias("ok"),
        F.count_if(F.col("status") == "failed").alias("bad"), F.count_if(F.col("status") == "processing").alias("busy"),
    )
    g = g.join(small(cancelled.select("batch_id", F.lit(True).alias("_off")).distinct()), "batch_id", "left")
    ended = F.col("ok") + F.col("bad")
    state = F.when(F.coalesce("_off", F.lit(False)), "cancelled").when(F.col("bad") == F.col("n"), "failed").when(ended == F.col("n"), "completed").when(ended + F.col("busy") > 0, "processing").otherwise("pending")
    fresh = g.where(F.col("updated_at") >= F.to_timestamp(F.lit(as_of)) - F.make_interval(mins=F.lit(ttl_minutes)))
    return fresh.orderBy(F.desc("created_at"), "batch_id").limit(newest).select("batch_id", "created_at", state.alias("state"), ended.alias("processed"), F.col("n").alias("total"))


def audit_metrics(rows: DataFrame, value: str) -> DataFrame:
    """Mean, median, extremes and shares of speed classes."""
    share = lambda c: half_up(100.0 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 1)
    v = F.col(value)
    return rows.agg(
        half_up(F.avg(v), 4).alias("mean"), half_up(F.median(v), 4).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"),
        share(v < 20).alias("fast_pct"), share((v >= 20) & (v < 100)).alias("medium_pct"), share(v >= 100).alias("slow_pct"),
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column's values."""
    g = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("_t"))
    return g.crossJoin(F.broadcast(total)).select(column, "n", half_up(100.0 * F.col("n") / F.col("_t"), 2).alias("pct"))
