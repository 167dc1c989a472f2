"""Arithmetic checks, total verification, validation rules and quality scores: pure expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.operators.catalog import small
from tallyweave.plans.fixtures import half_up, mean


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def line_check_parser(quantity: Column, rate: Column, amount: Column) -> Column:
    """ok / mismatch / trusted: nearer than max(0.01, 0.5 %); an amount without a rate is trusted, and without an amount all is ok."""
    expected = half_up(quantity * rate, 2)
    near = F.abs(amount - expected) < F.greatest(F.lit(0.01), F.abs(expected) * 0.005)
    return F.when((rate == 0) & (amount > 0), "trusted").when((amount <= 0) | near, "ok").otherwise("mismatch")


def line_check_verifier(quantity: Column, rate: Column, amount: Column) -> Column:
    """Within 0.01."""
    return F.abs(half_up(quantity * rate, 2) - half_up(amount, 2)) <= 0.01 + 1e-9


def line_check_validator(quantity: Column, rate: Column, amount: Column) -> Column:
    """Within max(1, 1 %)."""
    return F.abs(quantity * rate - amount) <= F.greatest(F.lit(1.0), quantity * rate * 0.01)


def verify_math(items: DataFrame, products: DataFrame) -> DataFrame:
    """Per receipt: lines checked, lines right, catalog prices that agree, computed grand total, all right."""
    p = small(products.select("product_code", F.col("unit_price").alias("_cat")))
    j = items.join(p, "product_code", "left")
    ok = line_check_verifier(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    g = j.groupBy("receipt_id").agg(
        F.count("*").alias("n_lines"), F.count_if(ok).alias("n_ok"), F.count_if(F.abs(F.col("unit_price") - F.col("_cat")) < 0.01).alias("n_price_match"),
        half_up(F.sum("line_total"), 2).alias("grand_total"), F.bool_and(ok).alias("all_ok"),
    )
    return g


def verify_totals(computed: DataFrame, stated: DataFrame) -> DataFrame:
    """Stated totals (receipt_id, total, total_conf, cloud_total) against computed ones (receipt_id, computed, item_conf).

    Equal totals are verified; otherwise the first case of the dispute ladder that holds decides:
    the cloud total agrees with one side, one side is much surer than the other, a
    discrepancy of at most 2 keeps the surer confidence, and anything else stays unverified.
    """
    j = computed.join(stated, "receipt_id", "left")
    t, c, cloud = F.col("total"), F.col("computed"), F.col("cloud_total")
    ic, tc = _zero("item_conf"), _zero("total_conf")
    same = F.abs(t - c) <= 0.01
    case = (
        F.when(t.isNull(), "no_total").when(same, "exact").when(F.abs(cloud - c) <= 0.01, "cloud_computed").when(F.abs(cloud - t) <= 0.01, "cloud_stated")
        .when((ic >= 0.85) & (tc < 0.85), "items_trusted").when((tc >= 0.90) & (ic < 0.80), "total_trusted").when(F.abs(t - c) <= 2, "small_gap").otherwise("unresolved")
    )
    j = j.withColumn("method", case)
    conf = (
        F.when(F.col("method") == "exact", F.least(F.lit(0.99), F.when(tc > 0, tc).otherwise(0.9))).when(F.col("method") == "cloud_computed", 0.95).when(F.col("method") == "cloud_stated", 0.85)
        .when(F.col("method") == "items_trusted", ic * 0.9).when(F.col("method") == "total_trusted", tc * 0.85).when(F.col("method") == "small_gap", F.greatest(ic, tc) * 0.7).otherwise(0.3)
    )
    verified = F.col("method").isin("exact", "cloud_computed", "cloud_stated", "items_trusted", "total_trusted")
    trusted = F.when(F.col("method").isin("cloud_stated", "total_trusted"), t).otherwise(c)
    return j.select("receipt_id", "method", verified.alias("verified"), half_up(conf, 4).alias("confidence"), half_up(trusted, 2).alias("trusted_total"))


def validate(items: DataFrame, products: DataFrame, history: DataFrame, max_reasonable: float = 100.0, deviation: float = 5.0) -> DataFrame:
    """Items with fixes and warnings, by four rules in order.

    Quantity not above 0 becomes 1 (high); above max_reasonable without a price is suspicious
    (medium). A missing price comes from the catalog; one that differs by more than the factor
    `deviation` is flagged (medium), and the line check uses values before the fill. A code more than
    once in a receipt is one low warning on its first row. A quantity over three times the historical maximum is an anomaly (medium).
    """
    p = small(products.select("product_code", F.col("unit_price").alias("_cat")))
    h = small(history.select("product_code", F.col("avg_qty").alias("_avg"), F.col("max_qty").alias("_max")))
    j = items.join(p, "product_code", "left").join(h, "product_code", "left")
    same = W.partitionBy("receipt_id", "product_code").orderBy("pos")
    qty, price, cat = F.col("quantity"), _zero("unit_price"), _zero("_cat")
    zero = qty <= 0
    big = ~zero & (qty > max_reasonable) & (price == 0)
    fill = (price == 0) & (cat > 0)
    off = ~fill & (cat > 0) & (price > 0) & ((F.try_divide(price, cat) > deviation) | (F.try_divide(price, cat) < 1 / deviation))
    bad_line = (price > 0) & (_zero("line_total") > 0) & ~line_check_validator(qty, price, _zero("line_total"))
    twice = (F.row_number().over(same) == 1) & F.lead(F.lit(True)).over(same).isNotNull()  # one order for both, so rows are sorted and kept once
    odd = (F.col("_avg") > 0) & (F.col("_max") > 0) & (qty > 3 * F.col("_max"))
    names = [(zero, "zero_quantity", "high"), (big, "suspicious_quantity", "medium"), (off, "price_deviation", "medium"), (bad_line, "line_total_mismatch", "medium"), (twice, "duplicate_item", "low"), (odd, "quantity_anomaly", "medium")]
    none = F.lit(None).cast("string")
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(f"{s}:{n}")).otherwise(none) for c, n, s in names]))
    fixed = F.when(zero, 1.0).otherwise(qty)
    return j.select(
        "receipt_id", "pos", "product_code", fixed.alias("quantity"), half_up(F.when(fill, cat).otherwise(price), 4).alias("unit_price"),
        half_up(F.when(fill, fixed * cat).otherwise(_zero("line_total")), 2).alias("line_total"), F.array_join(warnings, ",").alias("warnings"),
        F.coalesce(zero | big | off | bad_line | odd, F.lit(False)).alias("needs_review"),
    )


def warning_summary(validated: DataFrame) -> DataFrame:
    """Per receipt: warnings by severity; valid means none is high."""
    n = lambda s: F.sum(F.regexp_count("warnings", F.lit(f"{s}:")))
    g = validated.groupBy("receipt_id").agg(n("high").cast("long").alias("n_high"), n("medium").cast("long").alias("n_medium"), n("low").cast("long").alias("n_low"))
    return g.withColumn("valid", F.col("n_high") == 0)


def quality_score(df: DataFrame) -> DataFrame:
    """Six weighted factors from columns avg_confidence, n_items, total_status, math_status, sharpness, brightness, catalog_rate."""
    c = _zero("avg_confidence")
    conf = F.when(c <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(30.0), (c - 0.5) * 60)))
    n = F.col("n_items")
    items = F.when(n <= 0, 0.0).when(n == 1, 10.0).when(n == 2, 15.0).otherwise(20.0)
    total = F.when(F.col("total_status") == "verified", 15.0).when(F.col("total_status") == "mismatch", 5.0).otherwise(0.0)
    math = F.when(F.col("math_status") == "ok", 15.0).when(F.col("math_status") == "bad", 8.0).otherwise(7.0)
    s, b = F.col("sharpness"), F.col("brightness")
    sharp = F.when(s > 100, 5.0).when(s > 50, 3.0).when(s > 20, 1.0).otherwise(0.0)
    bright = F.when((b >= 60) & (b <= 200), 5.0).when((b >= 40) & (b <= 220), 3.0).otherwise(1.0)
    image = F.when(s.isNull(), 5.0).otherwise(sharp + bright)
    catalog = half_up(10 * _zero("catalog_rate"), 1)
    score = half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), conf + items + total + math + image + catalog)), 1)
    return df.withColumn("score", score).withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D"))


def sane_quantity(quantity: Column, price: Column, reasonable: float = 100.0, absolute: float = 999.0) -> Column:
    """0 becomes 1; over `reasonable` without a price, or over `absolute`, becomes 1."""
    return F.when((quantity == 0) | (quantity > absolute) | ((quantity > reasonable) & (_zero(price) <= 0)), 1.0).otherwise(quantity)


def odd_quantity(quantity: Column, reasonable: float = 100.0) -> Column:
    """Whether a quantity calls for a review: 0, or over `reasonable` even with a price."""
    return (quantity == 0) | (quantity > reasonable)


def item_flags(items: DataFrame) -> Column:
    """Whether an item of the table needs a review: doubtful reading, similarity match, odd quantity, or a flag it has already."""
    flag = (F.col("confidence") < 0.5) | odd_quantity(F.col("quantity"))
    if "match_type" in items.columns:
        flag = flag | (F.col("match_type") == "fuzzy")
    if "needs_review" in items.columns:
        flag = flag | F.col("needs_review")
    return F.coalesce(flag, F.lit(False))


def receipt_flags(items: DataFrame) -> DataFrame:
    """Per receipt: total quantity (1 dp), grand total (2 dp), whether all lines hold, whether it needs review (an item's flag, or mean confidence below 0.85)."""
    ok = line_check_parser(F.col("quantity"), F.col("unit_price"), F.col("line_total")) != "mismatch"
    return items.groupBy("receipt_id").agg(
        half_up(F.sum("quantity"), 1).alias("total_quantity"), half_up(F.sum("line_total"), 2).alias("grand_total"), F.bool_and(ok).alias("all_lines_ok"),
        (F.bool_or(item_flags(items)) | (mean(items, "confidence") < 0.85)).alias("needs_review"),
    )


def image_quality(df: DataFrame) -> DataFrame:
    """Gate on sharpness and brightness with the reasons of a refusal, and a 0..100 score."""
    none = F.lit(None).cast("string")
    reasons = F.concat_ws("; ", F.when(F.col("sharpness") < 30, "too blurry").otherwise(none), F.when(F.col("brightness") < 40, "too dark").otherwise(none), F.when(F.col("brightness") > 252, "too bright").otherwise(none))
    light = F.when((F.col("brightness") < 60) | (F.col("brightness") > 220), 0.7).otherwise(1.0)
    score = half_up(F.least(F.lit(100.0), F.col("sharpness") / 10) * light, 1)
    return df.withColumn("reasons", reasons).withColumn("passes", reasons == "").withColumn("image_score", score)


def local_suffices() -> Column:
    """Whether a local screening is good enough: calibrated confidence (0.85 for structured pages, else 0.88), four detections, 30 % of lines with catalog codes."""
    need = F.when(F.col("is_structured"), 0.85).otherwise(0.88)
    return (F.col("calibrated") >= need) & (F.col("n_detections") >= 4) & (F.col("catalog_rate") >= 0.3)


def cloud_route(df: DataFrame) -> DataFrame:
    """Local results suffice if calibrated confidence, detections and catalog rate are high enough; else budget permits the cloud or not."""
    route = F.when(F.col("cached"), "cache").when(~F.col("quality_ok"), "reject").when(local_suffices(), "local").when(F.col("budget_left") > 0, "cloud").otherwise("local_fallback")
    return df.withColumn("route", route).withColumn("cacheable", cache_worthy(F.col("n_detections"), F.col("n_items"), F.col("calibrated")))


def strategy(df: DataFrame) -> DataFrame:
    """df with the strategy by which each picture is read, from its mode (auto, local, azure, speculative) and what is known of it.

    cloud says whether the cloud is set up, cloud_ok whether its call succeeded, budget_left what may still be spent. In auto mode the first that holds counts: a cached
    result, a picture of too low quality, no cloud, a local screening that suffices, no budget, the cloud, and what is local where that failed. A speculative run has both
    at once, and takes the local one if it suffices.
    """
    good, paid = local_suffices(), (F.col("budget_left") > 0) & F.col("cloud")
    auto = (
        F.when(F.col("cached"), "auto-cached").when(~F.col("quality_ok"), "auto-quality-gate").when(~F.col("cloud"), "auto-local-only").when(good, "auto-local-skip")
        .when(~paid, "auto-usage-limited").when(F.col("cloud_ok"), "auto").otherwise("auto-fallback-local")
    )
    both = F.when(F.col("cached"), "auto-cached").when(good, "speculative-local-skip").when(paid & F.col("cloud_ok"), "speculative-azure-direct").otherwise("speculative-fallback-local")
    mode = F.lower(F.coalesce("mode", F.lit("auto")))
    name = F.when(mode == "local", "local").when(mode == "azure", F.when(F.col("cached"), "azure-only-cached").otherwise("azure-only")).when(mode == "speculative", both).otherwise(auto)
    return df.withColumn("strategy", name)


def calibrate(text: Column, raw: Column) -> Column:
    """Confidence lowered for texts that tend to be misread, never above the raw value, to 4 places; 0 for a blank text.

    One character counts 0.6 and two 0.8 of it; signs that stand for letters 0.65 over 30 % of the text and 0.8 over
    15 %; fewer different characters than 35 % of three or more, 0.7; more than five digits without a letter, 0.75;
    two signs or more in at most six characters, 0.75. Three to seven letters and digits earn 5 % back.
    """
    t = F.regexp_replace(text, "^\\s+|\\s+$", "")
    n = F.length(t)
    noise = F.regexp_count(t, F.lit("[|!\\[\\]{}()_=;$&#@~`]")) / n
    kinds = F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("(?s)(.)"), F.lit(1)))) / n
    digits, letters, signs = (F.regexp_count(t, F.lit(p)) for p in ("[0-9]", "\\p{L}", "[^\\p{L}\\p{N} ]"))
    f = F.when(n == 1, 0.6).when(n == 2, 0.8).otherwise(1.0)
    c = raw * f
    c = c * F.when(noise > 0.3, 0.65).when(noise > 0.15, 0.8).otherwise(1.0)
    c = c * F.when((n >= 3) & (kinds < 0.35), 0.7).otherwise(1.0)
    c = c * F.when((digits > 5) & (letters == 0), 0.75).otherwise(1.0)
    c = c * F.when((signs >= 2) & (n <= 6), 0.75).otherwise(1.0)
    c = F.when(n.between(3, 7) & t.rlike("^[\\p{L}\\p{N}]+$"), F.least(c * 1.05, raw)).otherwise(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(half_up(F.least(c, raw), 4))


def cache_worthy(n_detections: Column, n_items: Column, confidence: Column) -> Column:
    """Whether a result is worth keeping: two detections, or items read with confidence."""
    return (n_detections >= 2) | ((n_items > 0) & (confidence > 0.5))


def recompute(items: DataFrame, stated: DataFrame) -> DataFrame:
    """Per receipt after an edit: expected and stated amounts, whether every line holds to within 0.01 (one without an amount does), whether the total does (null if none is stated).

    stated: (receipt_id, grand_total).
    """
    q, p, a = _zero("quantity"), _zero("unit_price"), _zero("line_total")
    due = half_up(q * p, 2)
    g = items.groupBy("receipt_id").agg(
        F.sum(q).alias("total_quantity"), half_up(F.sum(a), 2).alias("line_totals"), half_up(F.sum(due), 2).alias("computed_grand_total"), F.bool_and((a <= 0) | (F.abs(a - due) < 0.01)).alias("all_lines_ok"),
    )
    return g.join(stated, "receipt_id", "left").select(*g.columns, (F.abs(F.col("grand_total") - F.col("computed_grand_total")) < 0.01).alias("grand_total_match"))


def change_detected(old_code: Column, new_code: Column, old_qty: Column, new_qty: Column) -> Column:
    """A correction: the code differs apart from case, or the quantity by more than 0.01."""
    return (F.upper(F.trim(old_code)) != F.upper(F.trim(new_code))) | (F.abs(old_qty - new_qty) > 0.01)
