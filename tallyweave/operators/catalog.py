"""Product catalog: lookups, search, merges of change sets, import checks and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Tables up to this many bytes (by the optimizer's estimate) are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the planner's size estimate allows it, else df as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def catalog_page(products: DataFrame, active_only: bool = True, limit: int = 0, offset: int = 0) -> DataFrame:
    """Products in order of code; limit 0 means all."""
    out = (products.where("is_active") if active_only else products).orderBy("product_code")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def by_code(products: DataFrame, code: str) -> DataFrame:
    """The active product with this code, whatever its case."""
    return products.where(F.col("is_active") & (F.col("product_code") == code.strip().upper()))


def search(products: DataFrame, query: str) -> DataFrame:
    """Active products whose code or name contains the query, ignoring case; wildcards are ordinary characters."""
    q = F.lower(F.lit(query))
    return products.where(F.col("is_active") & (F.contains(F.lower("product_code"), q) | F.contains(F.lower("product_name"), q)))


def add_products(products: DataFrame, new: DataFrame) -> DataFrame:
    """State after inserting `new`: unknown codes are added, inactive ones come back with the new data, active ones stay."""
    incoming = new.select(F.upper(F.trim("product_code")).alias("k"), *[F.col(c).alias(f"n_{c}") for c in ("product_name", "category", "unit", "unit_price")])
    incoming = incoming.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("n_product_name"))).where("rn = 1").drop("rn")
    j = products.join(incoming, products["product_code"] == incoming["k"], "full")
    take_new = F.col("product_code").isNull() | (F.col("k").isNotNull() & ~F.col("is_active"))
    return j.select(
        F.coalesce("product_code", "k").alias("product_code"),
        *[F.when(take_new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("product_name", "category", "unit", "unit_price")],
        (take_new | F.col("is_active")).alias("is_active"),
    )


def rejected_products(products: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` that add_products refuses because an active product has the code."""
    active = products.where("is_active").select(F.col("product_code").alias("k"))
    return new.join(active, F.upper(F.trim(new["product_code"])) == active["k"], "left_semi")


def patch(base: DataFrame, key: str, changes: DataFrame, allowed: list[str]) -> DataFrame:
    """base with the non-null values of `changes` for the allowed columns; `changes` has one row a key."""
    cols = [c for c in changes.columns if c in allowed]
    right = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cols])
    j = base.join(small(right), base[key] == right["_k"], "left")
    return j.select(*[F.coalesce(F.col(f"_{c}"), base[c]).alias(c) if c in cols else base[c] for c in base.columns])


def deactivate(products: DataFrame, codes: DataFrame) -> DataFrame:
    """Soft delete of the codes in the first column of `codes`."""
    gone = codes.select(F.upper(F.col(codes.columns[0])).alias("_k")).distinct()
    j = products.join(small(gone), products["product_code"] == gone["_k"], "left")
    return j.select(*[(F.col("is_active") & F.col("_k").isNull()).alias("is_active") if c == "is_active" else products[c] for c in products.columns])


def import_rows(rows: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CSV rows divided into (added, skipped, errors): blank code or name is an error, a known code is skipped."""
    clean = rows.select(
        F.upper(F.trim(F.regexp_replace("product_code", "^﻿", ""))).alias("product_code"), F.trim("product_name").alias("product_name"),
        F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("General")).alias("category"), F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("Piece")).alias("unit"),
    )
    bad = F.coalesce(F.col("product_code"), F.lit("")) == ""
    bad = bad | (F.coalesce(F.col("product_name"), F.lit("")) == "")
    errors = clean.where(bad)
    good = clean.where(~bad).dropDuplicates(["product_code"])
    known = products.where("is_active").select("product_code")
    return good.join(known, "product_code", "left_anti"), good.join(known, "product_code", "left_semi"), errors


def missing_headers(df: DataFrame, required: tuple[str, ...] = ("product_code", "product_name")) -> list[str]:
    """Required columns that a table lacks."""
    return sorted(set(required) - set(df.columns))


def seed(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or ignore."""
    return existing.unionByName(rows.join(existing.select("product_code"), "product_code", "left_anti"))


def backfill_prices(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Prices from (product_code, price) where the catalog has none (0)."""
    j = products.join(small(prices.select(F.col("product_code").alias("_k"), F.col("price").alias("_p"))), F.col("product_code") == F.col("_k"), "left")
    price = F.when((F.col("unit_price") == 0) & F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("unit_price"))
    return j.select(*[price.alias(c) if c == "unit_price" else F.col(c) for c in products.columns])


def sorted_page(products: DataFrame, column: str, descending: bool = False, page: int = 1, size: int = 20) -> DataFrame:
    """One page of the catalog by any column, case folded, null as empty; ties by code."""
    key = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return products.orderBy(key.desc() if descending else key.asc(), "product_code").offset((page - 1) * size).limit(size)


def valid_request(code: Column, quantity: Column, price: Column) -> Column:
    """Edge validation of an item: code alphabet and length, 0 < quantity <= 99999, 0 <= price <= 9999999."""
    return F.coalesce(code.rlike("^[A-Z0-9_\\-]{1,10}$") & (quantity > 0) & (quantity <= 99999) & (price >= 0) & (price <= 9999999), F.lit(False))


def sanitise_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[<>{}\\\\]", ""))
