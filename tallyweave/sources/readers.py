"""Sources: catalog CSV, label, result, ledger and rule JSON, picture folders, cloud documents, log lines. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.schemas import LABELS, LOGS, USAGE, columns

IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,tif,tiff,webp}"
MAX_BYTES = 20 << 20
#: First bytes of accepted pictures, in hex; WebP has a second part at byte 8.
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "bmp": "424D", "tiff_le": "49492A00", "tiff_be": "4D4D002A"}


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark in the header is removed; malformed rows go to _corrupt."""
    header = spark.read.option("header", True).csv(path)
    names = [c.replace("﻿", "").strip().lower() for c in header.columns]
    schema = ", ".join(f"`{n}` string" for n in names) + ", _corrupt string"
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).schema(schema).csv(path)
    for c in ("product_code", "product_name", "category", "unit"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of text files, each in one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def labels_of(files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Labels in (file, content), those that can't be read left out, in order of picture; with a listing of pictures (path), whether each label's picture exists."""
    df = files.select(F.from_json("content", LABELS).alias("d")).select("d.*").where("receipt_id IS NOT NULL")
    if images is not None:
        names = images.select(F.element_at(F.split("path", "/"), -1).alias("_n")).distinct()
        df = df.join(names, df["image_file"] == names["_n"], "left").withColumn("image_exists", F.col("_n").isNotNull()).drop("_n")
    return df.orderBy("image_file")


def labels_json(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """labels_of the files of a folder."""
    return labels_of(whole_files(spark, path), images)


RESULTS = "session string, f1 double, precision double, recall double"


def results_of(files: DataFrame, schema: str = RESULTS) -> DataFrame:
    """Saved results in (file, content), the last file name first; unreadable ones have nulls."""
    return files.select(F.from_json("content", schema).alias("d"), "file").select("d.*", "file").orderBy(F.desc("file"))


def results_json(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    return results_of(whole_files(spark, path), schema)


def usage_of(files: DataFrame) -> DataFrame:
    """Calls of ledgers {"days": {day: {"calls": [...]}}} in (file, content); a corrupt ledger gives no rows."""
    call = "array<struct<timestamp:timestamp,model:string,pages:int,success:boolean,cost:double>>"
    df = files.select(F.from_json("content", f"days map<string, struct<calls:{call}>>").alias("d"))
    rows = df.select(F.explode("d.days").alias("day", "d")).select("day", F.inline("d.calls"))
    return rows.withColumnRenamed("timestamp", "ts").select("day", *columns(USAGE))


def usage_json(spark: SparkSession, path: str) -> DataFrame:
    return usage_of(whole_files(spark, path))


def rules_of(files: DataFrame) -> DataFrame:
    """Learned rules as (kind, ch_from, ch_to) from (file, content) with three maps each; a missing or unreadable map has none."""
    kinds = ("ocr_char_subs", "ocr_reverse_subs", "handwriting_subs")
    df = files.select(F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("d"))
    entry = lambda k: F.transform(F.coalesce(F.map_entries(f"d.{k}"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lit(k).alias("kind"), e["key"].alias("ch_from"), e["value"].alias("ch_to")))
    return df.select(F.inline(F.concat(*[entry(k) for k in kinds])))


def rules_json(spark: SparkSession, path: str) -> DataFrame:
    return rules_of(whole_files(spark, path))


def cache_of(lines: DataFrame, as_of: str, ttl_hours: int = 24) -> DataFrame:
    """Cached results, a line (value) each, whose age at as_of is within the time to live."""
    df = lines.select(F.from_json("value", "sha256 string, cached_at timestamp, result string").alias("d")).select("d.*")
    return df.where(F.col("cached_at") >= F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(ttl_hours)))


def cache_json(spark: SparkSession, path: str, as_of: str, ttl_hours: int = 24) -> DataFrame:
    return cache_of(spark.read.text(path), as_of, ttl_hours)


IMAGE_NAME = "(?i)[.](jpg|jpeg|png|bmp|tif|tiff|webp)$"


def listed_images(listing: DataFrame) -> DataFrame:
    """Rows of a listing (path) that name pictures, in order of path."""
    return listing.where(F.col("path").rlike(IMAGE_NAME)).orderBy("path")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of a folder by extension: path, time, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(folder)


def checked_images(files: DataFrame) -> DataFrame:
    """Files with their kind by first bytes, SHA-256, and whether they are acceptable."""
    kind = None
    for name, magic in MAGIC.items():
        test = F.hex(F.substring("content", 1, len(magic) // 2)) == magic
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    kind = kind.when((F.hex(F.substring("content", 1, 4)) == "52494646") & (F.hex(F.substring("content", 9, 4)) == "57454250"), "webp")
    return files.select("path", "length", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), ((F.col("length") <= MAX_BYTES) & kind.isNotNull()).alias("accepted"))


_CLOUD = (
    "merchant string, transaction_date string, total string, subtotal string, tax string,"
    " items array<struct<description:string,quantity:string,price:string,total_price:string,confidence:double>>"
)


def money(c):
    """Number in a text with currency signs and thousands separators; null if there is none."""
    return F.regexp_replace(c, "[$€£₹, ]", "").try_cast("double")


def cloud_documents(docs: DataFrame, column: str = "json") -> DataFrame:
    """Header of each cloud receipt (id, json): merchant, date, totals."""
    d = docs.select("id", F.from_json(column, _CLOUD).alias("d"))
    return d.select("id", F.trim("d.merchant").alias("merchant"), "d.transaction_date", *[money(F.col(f"d.{c}")).alias(c) for c in ("total", "subtotal", "tax")])


def cloud_items(docs: DataFrame, column: str = "json") -> DataFrame:
    """Items of cloud receipts: description, quantity clamped to 1..9999, price, total filled in from the other two."""
    d = docs.select("id", F.from_json(column, _CLOUD).alias("d")).select("id", F.posexplode("d.items").alias("pos", "i"))
    q = F.greatest(F.lit(1.0), F.least(F.lit(9999.0), F.coalesce(money(F.col("i.quantity")), F.lit(1.0))))
    price, total = F.coalesce(money(F.col("i.price")), F.lit(0.0)), F.coalesce(money(F.col("i.total_price")), F.lit(0.0))
    return d.select(
        "id", (F.col("pos") + 1).alias("pos"), F.trim("i.description").alias("description"), q.alias("quantity"), F.when((price == 0) & (total > 0), total / q).otherwise(price).alias("unit_price"),
        F.when((total == 0) & (price > 0), F.round(q * price, 2)).otherwise(total).alias("line_total"), F.coalesce("i.confidence", F.lit(0.8)).alias("confidence"),
    )


def variant_field(c):
    """Value of a typed field given as JSON: the first of its value slots that is set, as text."""
    slots = ("valueString", "valueNumber", "valueInteger", "valueDate", "valueTime", "valuePhoneNumber", "valueBoolean", "valueCountryRegion", "content")
    return F.coalesce(F.get_json_object(c, "$.valueCurrency.amount"), *[F.get_json_object(c, f"$.{s}") for s in slots])


def logs_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGS).parquet(path)
