"""Sinks: exports and append-only stores. Every writer takes a folder that all executors share."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.operators import receipts as R


def catalog_csv(products: DataFrame, path: str) -> None:
    """Active products, four columns, with a header."""
    products.where("is_active").select("product_code", "product_name", "category", "unit").write.mode("overwrite").option("header", True).csv(path)


def report_csv(receipts: DataFrame, items: DataFrame, path: str) -> None:
    """Data and summary sheet in sub-folders."""
    R.data_sheet(receipts, items).write.mode("overwrite").option("header", True).csv(f"{path}/data")
    R.summary_sheet(items).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def vouchers_xml(receipts: DataFrame, items: DataFrame, path: str) -> None:
    R.voucher_documents(receipts, items).write.mode("overwrite").format("xml").option("rootTag", "ENVELOPE").option("rowTag", "VOUCHER").save(path)


def vouchers_json(receipts: DataFrame, items: DataFrame, path: str) -> None:
    R.voucher_documents(receipts, items).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """Append-only facts: logs, corrections, calls, sessions, results."""
    df.write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str, day: str) -> None:
    """A day's copy, replaced if written again."""
    df.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def kept_days(days: DataFrame, as_of: str, keep: int) -> DataFrame:
    """Days (day) that retention keeps at as_of: those at most `keep` days before it."""
    return days.select(F.col("day").cast("date").alias("day")).where(F.col("day") >= F.date_sub(F.to_date(F.lit(as_of)), keep)).distinct()


def kept_snapshots(spark, path: str, as_of: str, days: int) -> DataFrame:
    """Snapshot days that retention keeps."""
    return kept_days(spark.read.parquet(path).select(F.col("snapshot_date").alias("day")).distinct(), as_of, days)


def prune_snapshots(spark, path: str, as_of: str, days: int) -> list[str]:
    """Removes the folders of snapshot days that retention doesn't keep, and returns these days; folders of other names stay.

    The folders are listed and removed through the file system that the path names, without reading them.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days)
    gone = []
    for status in fs.listStatus(root):
        kind, _, day = status.getPath().getName().partition("=")
        try:
            old = kind == "snapshot_date" and datetime.date.fromisoformat(day) < limit
        except ValueError:
            continue
        if old and fs.delete(status.getPath(), True):
            gone.append(day)
    return sorted(gone)


#: Fields of the training records that are kept as JSON lines.
RECORDS = {
    "benchmark_result": ("session", "created_at", "f1", "precision", "recall"),
    "profile": ("name", "created_at", "settings"),
    "template": ("template_id", "created_at", "fields"),
    "session": ("session", "created_at", "n_samples", "accuracy"),
    "rules": ("kind", "created_at", "ch_from", "ch_to"),
}


def record(df: DataFrame, kind: str) -> DataFrame:
    """Rows of df in the form in which save_record writes a kind of record: its fields, null where df lacks one, and the kind."""
    types = dict(df.dtypes)
    return df.select(F.lit(kind).alias("record"), *[F.col(c) if c in types else F.lit(None).cast("string").alias(c) for c in RECORDS[kind]])


def save_record(df: DataFrame, kind: str, path: str) -> None:
    """Appends benchmark results, profiles, templates, sessions or rules as JSON lines to the folder of their kind."""
    record(df, kind).write.mode("append").json(f"{path}/{kind}")


def corrected_sample(original: DataFrame, corrected: DataFrame, image_file: str | None = None, receipt_type: str = "handwritten", notes: str = "") -> tuple[DataFrame, DataFrame]:
    """(labels, corrections) of corrected items (receipt_id, pos, product_code, quantity) of scanned ones.

    A label has the receipt's items in order and their summed quantity. Corrections pair items by position where code or
    quantity differ; an item that the scan missed has no original.
    """
    item = F.struct("pos", F.struct(F.col("product_code").alias("code"), "quantity").alias("i"))
    g = corrected.groupBy("receipt_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"), F.sum("quantity").alias("total_quantity"))
    file = F.lit(image_file) if image_file else F.concat(F.col("receipt_id").cast("string"), F.lit(".jpg"))
    labels_ = g.select("receipt_id", file.alias("image_file"), "items", "total_quantity", F.lit(receipt_type).alias("receipt_type"), F.lit(notes).alias("notes"))
    w = W.partitionBy("receipt_id").orderBy("pos")
    side = lambda d, n: d.select("receipt_id", F.row_number().over(w).alias("nth"), F.col("product_code").alias(f"{n}_code"), F.col("quantity").alias(f"{n}_qty"))
    j = side(corrected, "corrected").join(side(original, "original"), ["receipt_id", "nth"], "left")
    changed = F.col("original_code").isNull() | (F.upper(F.trim("original_code")) != F.upper(F.trim("corrected_code"))) | (F.abs(F.col("original_qty") - F.col("corrected_qty")) > 0.01)
    return labels_, j.where(changed).select("receipt_id", "nth", "original_code", "corrected_code", "original_qty", "corrected_qty")


def save_corrected_sample(original: DataFrame, corrected: DataFrame, path: str, **label) -> None:
    """Appends the labels and the corrections of corrected items to their folders."""
    rows, changes = corrected_sample(original, corrected, **label)
    rows.write.mode("append").json(f"{path}/labels")
    append(changes, f"{path}/corrections")


def json_log(rows: DataFrame) -> DataFrame:
    """One JSON text per row, as a log line."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def labels(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors) of labels: items present, codes not blank, quantities over 0; ids become unique, a missing total is the sum."""
    ok = (F.size("items") > 0) & F.forall("items", lambda x: (F.trim(x["code"]) != "") & (x["quantity"] > 0))
    ok = F.coalesce(ok, F.lit(False))
    good = new.where(ok).withColumn("total_quantity", F.coalesce("total_quantity", F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quantity"])))
    known = existing.select(F.col("receipt_id").alias("_base")).groupBy("_base").agg(F.count("*").alias("_n"))
    numbered = R.unique_suffix(good, "receipt_id", "image_file").join(known, good["receipt_id"] == known["_base"], "left")
    taken = F.col("_base").isNotNull() & (F.col("unique_id") == F.col("receipt_id"))
    out = numbered.withColumn("receipt_id", F.when(taken, F.concat("receipt_id", F.lit("_"), F.col("_n") + 1)).otherwise(F.col("unique_id")))
    return out.select(*new.columns), new.where(~ok)


def delete_labels(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select(F.col(ids.columns[0]).alias("receipt_id")), "receipt_id", "left_anti")


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose value changes between two (key, value) tables."""
    j = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full")
    return j.where(~F.col("old").eqNullSafe(F.col("new")))
