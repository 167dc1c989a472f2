"""Content fingerprints and perceptual hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_fingerprint(items: DataFrame) -> DataFrame:
    """32 hex digits per receipt over its sorted CODE:quantity list; no items, no row."""
    part = F.concat(F.upper(F.trim("product_code")), F.lit(":"), F.format_string("%.1f", "quantity"))
    return items.groupBy("receipt_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256), 1, 32).alias("fingerprint"))


def average_hash(pixels: Column) -> Column:
    """64-bit hash: a bit per value, first value first, set where it is above the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    bits = F.transform(pixels, lambda x: F.when(x > mean, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))


def hash_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two hashes; 64 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def hamming_hex(a: Column, b: Column) -> Column:
    """The same for 16 hex digits; anything else counts as missing."""
    parse = lambda c: F.when(c.rlike("^[0-9a-fA-F]{16}$"), F.conv(c, 16, -10).cast("long"))
    return hamming(parse(a), parse(b))
