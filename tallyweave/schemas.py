"""Schemas of the engine's tables as DDL, their version, and additive evolution between versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 5

PRODUCTS = (
    "product_code string NOT NULL, product_name string, category string, unit string, unit_price double, is_active boolean"
)
RECEIPTS = (
    "id long NOT NULL, receipt_number string, scan_date date, store_name string, bill_total double, processing_status string, created_at timestamp"
)
ITEMS = (
    "receipt_id long NOT NULL, pos int, product_code string, product_name string, quantity double, unit string, confidence double,"
    " manually_edited boolean, unit_price double, line_total double"
)
CORRECTIONS = (
    "receipt_id long, original_code string, corrected_code string, original_qty double, corrected_qty double, created_at timestamp"
)
LOGS = ("id long, receipt_id long, stage string, status string, duration_ms double, ts timestamp")
DETECTIONS = ("receipt_id long, det_id int, bbox array<array<double>>, text string, confidence double, needs_review boolean")
LINES = ("receipt_id long, line_no int, text string, confidence double, y_center double")
LABELS = (
    "receipt_id string, image_file string, items array<struct<code string, quantity double>>, total_quantity double, receipt_type string, notes string, added_at timestamp"
)
USAGE = ("ts timestamp, model string, pages int, success boolean, cost double")

#: Columns that a version added, with their default: (version, table, column, type, default).
ADDED = [
    (3, "products", "unit_price", "double", 0.0),
    (3, "items", "unit_price", "double", 0.0),
    (3, "items", "line_total", "double", 0.0),
    (3, "receipts", "bill_total", "double", 0.0),
    (4, "receipts", "image_hash", "string", ""),
    (4, "receipts", "content_fingerprint", "string", ""),
    (4, "receipts", "quality_score", "int", 0),
]


def columns(ddl: str) -> list[str]:
    """Column names of a flat DDL schema."""
    return [part.split()[0] for part in ddl.split(",")]


def evolve(df: DataFrame, table: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """df with every column that versions up to `version` added to the table and that it lacks."""
    for since, name, column, kind, default in ADDED:
        if name == table and since <= version and column not in df.columns:
            df = df.withColumn(column, F.lit(default).cast(kind))
    return df
