"""Cloud usage and cost ledgers, budgets and pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.functions.dates import days_left
from tallyweave.plans.fixtures import half_up

RATES = {"prebuilt-receipt": 0.01, "prebuilt-read": 0.0015}


def cost(calls: DataFrame) -> DataFrame:
    rate = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    return calls.withColumn("cost", F.col("pages") * F.coalesce(F.try_element_at(rate, F.col("model")), F.lit(0.0)))


def daily(calls: DataFrame) -> DataFrame:
    """Per day: calls, pages of each model, cost."""
    g = cost(calls).groupBy(F.to_date("ts").alias("day"))
    pages = lambda m: F.coalesce(F.sum(F.when(F.col("model") == m, F.col("pages"))), F.lit(0)).cast("long")
    return g.agg(F.count("*").alias("n_calls"), pages("prebuilt-receipt").alias("receipt_pages"), pages("prebuilt-read").alias("read_pages"), half_up(F.sum("cost"), 4).alias("cost"))


def monthly(calls: DataFrame, free_pages: int = 500) -> DataFrame:
    """Per month: pages, free and paid ones, percent of the free tier, cost."""
    g = cost(calls).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("pages").alias("pages"), half_up(F.sum("cost"), 4).alias("cost"))
    return g.select("month", "pages", F.least("pages", F.lit(free_pages)).cast("long").alias("free"), F.greatest(F.col("pages") - free_pages, F.lit(0)).cast("long").alias("paid"), half_up(100.0 * F.col("pages") / free_pages, 1).alias("pct_free"), "cost")


def pacing(calls: DataFrame, month_limit: int = 500, fast: float = 1.2, critical: float = 1.5) -> DataFrame:
    """Per day: pages so far in the month, what each remaining day may use, and whether the day's use is ok, fast or critical."""
    d = calls.groupBy(F.to_date("ts").alias("day")).agg(F.sum("pages").alias("pages"))
    w = W.partitionBy(F.date_trunc("month", "day")).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("pages").over(w), F.lit(0)))
    allowed = F.greatest(F.lit(month_limit) - F.col("before"), F.lit(0)) / days_left(F.col("day"))
    state = F.when(F.col("pages") > critical * F.col("allowed"), "critical").when(F.col("pages") > fast * F.col("allowed"), "fast").otherwise("ok")
    return d.withColumn("allowed", allowed).select("day", "pages", "before", half_up(F.col("allowed"), 4).alias("allowed"), state.alias("state"))


def gauges(calls: DataFrame, day_limits: tuple[int, int] = (40, 50), month_limits: tuple[int, int] = (400, 500)) -> DataFrame:
    """Days and months whose pages pass the warning or the hard limit."""
    d = calls.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.sum("pages").alias("pages"))
    m = calls.groupBy(F.date_format("ts", "yyyy-MM").alias("period")).agg(F.sum("pages").alias("pages"))
    level = lambda lim: F.when(F.col("pages") >= lim[1], "critical").when(F.col("pages") >= lim[0], "warning")
    return d.withColumn("level", level(day_limits)).union(m.withColumn("level", level(month_limits))).where("level IS NOT NULL")


def may_call(daily_used: DataFrame, day_limit: int = 50) -> DataFrame:
    return daily_used.withColumn("allowed", F.col("pages") < day_limit)


def append_calls(ledger: DataFrame, calls: DataFrame) -> DataFrame:
    return ledger.unionByName(cost(calls), allowMissingColumns=True)


def drop_day(ledger: DataFrame, day: str) -> DataFrame:
    return ledger.where(F.to_date("ts") != F.to_date(F.lit(day)))


def hit_rate(hits: DataFrame, flag: str) -> DataFrame:
    """Hits, misses and the hit rate in percent, 0 where nothing was asked."""
    return hits.agg(F.count_if(flag).alias("hits"), F.count_if(~F.col(flag)).alias("misses")).withColumn("hit_rate", half_up(F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)), 1))
