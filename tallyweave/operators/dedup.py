"""Exact and near duplicates of receipts and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.functions.hashing import hamming

#: 64 bits in six bands: two hashes at distance 5 or less agree on one of them at least.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def near_hashes(rows: DataFrame, distance: int = 5, window_s: int = 24 * 3600) -> DataFrame:
    """Pairs (id_a < id_b) of rows (id, hash, at_s) within the distance and the time window.

    For distances up to 5 the pairs meet on one of six bands, so the join is an equi-join;
    others take distance + 1 bands. The key has the time too, in steps of the window: a row meets those of its own
    step and of the one before, so pairs that lie too far apart aren't made. Of the bands that two hashes share, the first makes the pair.
    """
    bands = BANDS if distance <= 5 else tuple((round(k * 64 / (distance + 1)), round((k + 1) * 64 / (distance + 1)) - round(k * 64 / (distance + 1))) for k in range(distance + 1))
    value = lambda h, k: F.shiftrightunsigned(h, bands[k][0]).bitwiseAND(F.lit((1 << bands[k][1]) - 1))
    keys = F.array(*[F.struct(F.lit(k).alias("n"), value(F.col("hash"), k).alias("v")) for k in range(len(bands))])
    step = F.floor(F.col("at_s") / window_s)
    d = rows.select("id", "hash", "at_s", step.alias("step"), F.explode(keys).alias("band"))
    a = d.select(F.col("id").alias("id_a"), F.col("hash").alias("ha"), F.col("at_s").alias("ta"), "band", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    b = d.select(F.col("id").alias("id_b"), F.col("hash").alias("hb"), F.col("at_s").alias("tb"), "band", "step")
    j = a.join(b, ["band", "step"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("ta") - F.col("tb")) <= window_s))
    earlier = [F.when((F.col("band.n") > k) & (value(F.col("ha"), k) == value(F.col("hb"), k)), True) for k in range(len(bands) - 1)]
    first = F.coalesce(*earlier, F.lit(False)) == F.lit(False)
    j = j.where(first).withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= distance)
    return j.select("id_a", "id_b", "distance")


def duplicate_of(rows: DataFrame, distance: int = 5, window_s: int = 24 * 3600) -> DataFrame:
    """For each row (id, hash, fingerprint, at_s) its best earlier duplicate: 60 points for a near hash, 40 for an equal fingerprint.

    Only 60 points or more report; the higher score wins, then the later candidate.
    """
    near = near_hashes(rows, distance, window_s)
    f = rows.select("id", "fingerprint", "at_s")
    j = near.join(f.select(F.col("id").alias("id_a"), F.col("fingerprint").alias("fa"), F.col("at_s").alias("ta")), "id_a").join(f.select(F.col("id").alias("id_b"), F.col("fingerprint").alias("fb")), "id_b")
    score = F.lit(60) + F.when((F.col("fa") == F.col("fb")) & (F.col("fa") != ""), 40).otherwise(0)
    j = j.withColumn("score", score).withColumn("similarity", 100 - F.floor(F.col("distance") * 100 / 64))
    r = F.row_number().over(W.partitionBy("id_b").orderBy(F.desc("score"), F.desc("ta"), F.desc("id_a")))
    return j.withColumn("_r", r).where("_r = 1").select(F.col("id_b").alias("id"), F.col("id_a").alias("duplicate_of"), "score", "distance", "similarity")


def same_content(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Groups of rows with the same key: the first id, how many, in order of `order`."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")


def cache_latest(rows: DataFrame, key: str, ts: str, as_of: str, ttl_hours: int = 24) -> DataFrame:
    """The newest row of each key that isn't older than the time to live at as_of."""
    t = F.to_timestamp(F.lit(as_of))
    fresh = rows.where((F.col(ts) <= t) & (F.col(ts) >= t - F.make_interval(hours=F.lit(ttl_hours))))
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts), *[c for c in rows.columns if c not in (key, ts)][:1]))
    return fresh.withColumn("_r", r).where("_r = 1").drop("_r")


def retain(rows: DataFrame, ts: str, as_of: str, hours: float, newest: int = 0) -> DataFrame:
    """Rows not older than `hours`, and of those the newest n."""
    t = F.to_timestamp(F.lit(as_of))
    out = rows.where(F.col(ts) >= t - F.make_dt_interval(secs=F.lit(hours * 3600)))
    return out.orderBy(F.desc(ts), rows.columns[0]).limit(newest) if newest else out


def same_within(rows: DataFrame, key: str, order: str, window: float) -> DataFrame:
    """(id, earlier): rows (id, key, order) with each earlier one of the same key at most `window` before; the order is part of the join's key, in steps of the window."""
    d = rows.select("id", F.col(key).alias("_k"), F.col(order).alias("_o"), F.floor(F.col(order) / window).alias("_s"))
    a = d.select(F.col("id").alias("earlier"), "_k", F.col("_o").alias("_e"), F.explode(F.array("_s", F.col("_s") + 1)).alias("_s"))
    return d.join(a, ["_k", "_s"]).where((F.col("_e") < F.col("_o")) & (F.col("_o") - F.col("_e") <= window)).select("id", "earlier")
