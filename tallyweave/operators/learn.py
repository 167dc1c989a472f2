"""Learning from corrections and labels: correction maps, accuracy, confusions, rules, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.operators.catalog import small
from tallyweave.plans.fixtures import half_up


def _changed(corrections: DataFrame) -> DataFrame:
    return corrections.where(F.col("original_code") != F.col("corrected_code"))


def correction_map(corrections: DataFrame, min_count: int = 2) -> DataFrame:
    """The most frequent correction of each code that was seen min_count times; ties by corrected code."""
    pairs = _changed(corrections).groupBy("original_code", "corrected_code").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    first = F.row_number().over(W.partitionBy("original_code").orderBy(F.desc("n"), "corrected_code"))
    return pairs.withColumn("_r", first).where("_r = 1").drop("_r")


def correction_stats(corrections: DataFrame) -> DataFrame:
    return _changed(corrections).agg(F.count("*").alias("n_corrections"), F.countDistinct("original_code", "corrected_code").alias("n_pairs"))


def top_corrections(corrections: DataFrame, n: int = 10) -> DataFrame:
    g = _changed(corrections).groupBy("original_code", "corrected_code").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "original_code", "corrected_code").limit(n)


def apply_corrections(items: DataFrame, mapping: DataFrame) -> DataFrame:
    m = small(mapping.select(F.col("original_code").alias("_o"), F.col("corrected_code").alias("_c")))
    j = items.join(m, F.upper(F.trim(items["product_code"])) == m["_o"], "left")
    return j.select(*[F.coalesce("_c", "product_code").alias(c) if c == "product_code" else items[c] for c in items.columns])


def quantity_stats(items: DataFrame, min_count: int = 2) -> DataFrame:
    """Average (1 dp), largest, smallest quantity and number of sales of each code with at least min_count sales."""
    g = items.groupBy("product_code").agg(half_up(F.avg("quantity"), 1).alias("avg_qty"), F.max("quantity").alias("max_qty"), F.min("quantity").alias("min_qty"), F.count("*").alias("n"))
    return g.where(F.col("n") >= min_count)


def compare_items(expected: DataFrame, detected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Totals per receipt and code of both sides, and whether each is matched, wrong in quantity, missing or extra."""
    code = F.upper(F.trim("product_code")).alias("code")
    none, q = F.lit(None).cast("double"), F.col("quantity").cast("double")
    both = expected.select("receipt_id", code, q.alias("e"), none.alias("d"), F.lit(0).alias("side")).unionByName(detected.select("receipt_id", code, none.alias("e"), q.alias("d"), F.lit(1).alias("side")))
    # one aggregation instead of a full join of two: a task sorts nothing; rows without a receipt or a code have no partner
    alone = F.when(F.col("receipt_id").isNull() | F.col("code").isNull(), F.col("side"))
    j = both.groupBy("receipt_id", "code", alone.alias("_alone")).agg(F.sum("e").alias("expected"), F.sum("d").alias("detected"))
    status = (
        F.when(F.col("detected").isNull(), "missing").when(F.col("expected").isNull(), "extra")
        .when(F.abs(F.col("expected") - F.col("detected")) <= tolerance, "matched").otherwise("quantity")
    )
    return j.select("receipt_id", "code", "expected", "detected", status.alias("status"))


def receipt_accuracy(compared: DataFrame) -> DataFrame:
    """Per receipt: matched, wrong quantity, missing, extra codes and whether the total quantity agrees."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = F.abs(F.coalesce(F.sum("expected"), F.lit(0.0)) - F.coalesce(F.sum("detected"), F.lit(0.0))) <= 0.01
    return compared.groupBy("receipt_id").agg(n("matched").alias("n_matched"), n("quantity").alias("n_quantity"), n("missing").alias("n_missing"), n("extra").alias("n_extra"), total.alias("total_ok"))


def accuracy(per_receipt: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of codes, share of right quantities and totals."""
    a = per_receipt.agg(*[F.sum(c).alias(c) for c in ("n_matched", "n_quantity", "n_missing", "n_extra")], F.count_if("total_ok").alias("n_total_ok"), F.count("*").alias("n"))
    tp = F.col("n_matched") + F.col("n_quantity")
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + F.col("n_extra")), zero), F.coalesce(F.try_divide(tp, tp + F.col("n_missing")), zero)
    return a.select(
        half_up(p, 4).alias("precision"), half_up(r, 4).alias("recall"), half_up(F.coalesce(F.try_divide(2 * p * r, p + r), zero), 4).alias("f1"),
        half_up(F.coalesce(F.try_divide(F.col("n_matched"), tp), zero), 4).alias("quantity_accuracy"), half_up(F.coalesce(F.try_divide(F.col("n_total_ok"), F.col("n")), zero), 4).alias("total_accuracy"), F.col("n").alias("n_receipts"),
    )


def missing_codes(expected: DataFrame, detected: DataFrame) -> DataFrame:
    keys = ["receipt_id", "product_code"]
    return expected.select(keys).distinct().join(detected.select(keys).distinct(), keys, "left_anti")


def common_codes(expected: DataFrame, detected: DataFrame) -> DataFrame:
    keys = ["receipt_id", "product_code"]
    return expected.select(keys).intersect(detected.select(keys))


def positional_diff(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Items of both versions side by side by position: changed, missed (only in the corrected one) or dropped."""
    o = original.select("receipt_id", "pos", F.col("product_code").alias("old_code"), F.col("quantity").alias("old_qty"))
    c = corrected.select("receipt_id", "pos", F.col("product_code").alias("new_code"), F.col("quantity").alias("new_qty"))
    j = o.join(c, ["receipt_id", "pos"], "full")
    kind = (
        F.when(F.col("old_code").isNull(), "missed").when(F.col("new_code").isNull(), "dropped")
        .when(F.upper("old_code") != F.upper("new_code"), "code").when(F.abs(F.col("old_qty") - F.col("new_qty")) > 0.01, "quantity").otherwise("same")
    )
    return j.withColumn("kind", kind).where("kind <> 'same'")


def confusion_matrix(pairs: DataFrame, top: int = 30) -> DataFrame:
    """Character confusions of aligned pairs (ch_from, ch_to), the most frequent first."""
    return pairs.where("ch_from <> ch_to").groupBy("ch_from", "ch_to").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch_from", "ch_to").limit(top)


def code_characters(corrections: DataFrame) -> DataFrame:
    """Position by position characters of corrected codes of equal length (longer ones need alignment)."""
    same = corrections.where(F.length("original_code") == F.length("corrected_code"))
    z = same.select(F.explode(F.arrays_zip(F.split("original_code", "").alias("a"), F.split("corrected_code", "").alias("b"))).alias("z"))
    return z.select(F.col("z.a").alias("ch_from"), F.col("z.b").alias("ch_to")).where("ch_from <> ''")


def promote_rules(pairs: DataFrame, min_count: int = 2, dominance: float = 0.6) -> DataFrame:
    """Rules (ch_from -> ch_to) whose share of their group is at least `dominance` where the group has min_count cases."""
    w = W.partitionBy("ch_from")
    g = pairs.groupBy("ch_from", "ch_to").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "ch_to")))
    kind = F.when(F.col("ch_from").rlike("[0-9]") & F.col("ch_to").rlike("[A-Za-z]"), "digit_to_letter").when(F.col("ch_from").rlike("[A-Za-z]") & F.col("ch_to").rlike("[0-9]"), "letter_to_digit").otherwise("same_class")
    good = g.where((F.col("_r") == 1) & (F.col("total") >= min_count) & (F.col("n") / F.col("total") >= dominance) & (F.col("ch_from") != F.col("ch_to")))
    return good.select("ch_from", "ch_to", "n", "total", kind.alias("kind"))


def error_patterns(corrections: DataFrame, top: int = 50) -> DataFrame:
    """Ranked corrections with their edit distance."""
    g = _changed(corrections).groupBy("original_code", "corrected_code").agg(F.count("*").alias("n"))
    return g.withColumn("distance", F.levenshtein("original_code", "corrected_code")).orderBy(F.desc("n"), "original_code", "corrected_code").limit(top)


def metric_deltas(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """Old and new value, difference and percent change of each metric of two one-row tables."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").cast("double").alias("old"), F.col(f"a_{m}").cast("double").alias("new")) for m in metrics]))
    j = before.select(*[F.col(m).alias(f"b_{m}") for m in metrics]).crossJoin(after.select(*[F.col(m).alias(f"a_{m}") for m in metrics]))
    d = j.select(pairs.alias("x")).select("x.*")
    return d.withColumn("delta", half_up(F.col("new") - F.col("old"), 4)).withColumn("pct", half_up(F.coalesce(100 * F.try_divide(F.col("new") - F.col("old"), F.abs(F.col("old"))), F.lit(0.0)), 1))


def score_result(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """Per receipt: expected codes, found ones, found with equal quantity (of a repeated code the last counts), false ones, percent."""
    last = detected.groupBy("receipt_id", "product_code").agg(F.max_by("quantity", "pos").alias("got"))
    want = expected.groupBy("receipt_id", "product_code").agg(F.max_by("quantity", "pos").alias("want"))
    j = want.join(last, ["receipt_id", "product_code"], "full")
    both = F.col("want").isNotNull() & F.col("got").isNotNull()
    g = j.groupBy("receipt_id").agg(
        F.count_if(F.col("want").isNotNull()).alias("n_expected"), F.count_if(both).alias("n_found"), F.count_if(both & (F.col("want") == F.col("got"))).alias("n_exact"), F.count_if(F.col("want").isNull()).alias("n_false"),
    )
    return g.withColumn("pct", half_up(F.lit(100.0) * F.col("n_exact") / F.greatest("n_expected", F.lit(1)), 1))


def layout_template(lines: DataFrame) -> DataFrame:
    """Medians of positions and sizes over receipts, mean line count, and whether most receipts have it structured."""
    per = lines.groupBy("receipt_id").agg(F.min("y_center").alias("y0"), F.max("y_center").alias("y1"), F.count("*").alias("n"), F.avg(F.length("text")).alias("len"), F.count_if(F.col("text").rlike("\\d+\\s+\\d+\\s+\\d+")).alias("wide"))
    return per.agg(
        F.median("y0").alias("item_start"), F.median("y1").alias("item_end"), half_up(F.median("len"), 4).alias("line_chars"), half_up(F.avg("n"), 4).alias("mean_lines"),
        (F.count_if(F.col("wide") > 0) * 2 > F.count("*")).alias("structured"), F.count("*").alias("n_receipts"),
    )


def grid_sample(params: list[DataFrame], step: int) -> DataFrame:
    """Every step-th combination of parameter values in lexicographic order."""
    out = params[0]
    for p in params[1:]:
        out = out.crossJoin(p)
    order = F.row_number().over(W.orderBy(*out.columns))  # a grid of constants, not data
    return out.withColumn("_n", order - 1).where(F.col("_n") % step == 0).drop("_n")


def best_parameters(scored: DataFrame, score: str) -> DataFrame:
    names = [c for c in scored.columns if c != score]
    return scored.orderBy(F.desc(score), *names).limit(1)


def session_trend(sessions: DataFrame, order: str, metric: str, last: int = 10) -> DataFrame:
    """First and latest value of a metric and its mean over the last sessions."""
    recent = sessions.orderBy(F.desc(order)).limit(last).agg(half_up(F.avg(metric), 4).alias("recent_mean"), F.count("*").alias("n_recent"))
    ends = sessions.agg(F.min_by(metric, order).alias("first"), F.max_by(metric, order).alias("latest"))
    return ends.crossJoin(recent).withColumn("change", half_up(F.col("latest") - F.col("first"), 4))


def positional_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with idx, the place of each within its key by order, from 0."""
    return rows.withColumn("idx", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long"))
