"""Receipts and their items: documents, pages, roll-ups, mutations as state transitions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.operators.catalog import small
from tallyweave.plans.fixtures import half_up, mean


def nest(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Each receipt with its items as an array in order of pos; no items give an empty array."""
    fields = [c for c in items.columns if c not in ("receipt_id", "pos")]
    grouped = items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("items"))
    out = receipts.join(grouped, receipts["id"] == grouped["receipt_id"], "left").drop("receipt_id")
    return out.withColumn("items", F.coalesce("items", F.array()))


def flatten(nested: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per item of nested receipts; receipts without items vanish unless keep_empty."""
    f = F.explode_outer if keep_empty else F.explode
    return nested.select("*", f("items").alias("item")).select(*[c for c in nested.columns if c != "items"], "item.*")


def header_rollup(items: DataFrame) -> DataFrame:
    """Per receipt: total_items, average confidence, total quantity and bill total."""
    return items.groupBy("receipt_id").agg(
        F.count("*").alias("total_items"), mean(items, "confidence").alias("avg_confidence"), F.sum("quantity").alias("total_quantity"), F.sum("line_total").alias("items_total")
    )


def with_rollup(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts with headers recomputed from items; a receipt without items has zeros."""
    r = header_rollup(items)
    j = receipts.join(r, receipts["id"] == r["receipt_id"], "left")
    return j.select(
        receipts["id"], "receipt_number", F.coalesce("total_items", F.lit(0).cast("long")).alias("total_items"), half_up(F.coalesce("avg_confidence", F.lit(0.0)), 4).alias("avg_confidence"),
        half_up(F.coalesce("items_total", F.lit(0.0)), 2).alias("bill_total"), F.when(F.col("total_items") > 0, "completed").otherwise(F.col("processing_status")).alias("processing_status"),
    )


def update_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the non-null values of `changes` (receipt_id, pos, product_code, quantity, unit_price); changed rows are marked as edited."""
    c = changes.select(F.col("receipt_id").alias("_r"), F.col("pos").alias("_p"), *[F.col(x).alias(f"_{x}") for x in ("product_code", "quantity", "unit_price")])
    j = items.join(small(c), (items["receipt_id"] == c["_r"]) & (items["pos"] == c["_p"]), "left")
    hit = F.col("_r").isNotNull()
    qty, price = F.coalesce("_quantity", "quantity"), F.coalesce("_unit_price", "unit_price")
    return j.select(
        "receipt_id", "pos", F.coalesce("_product_code", "product_code").alias("product_code"), qty.alias("quantity"), price.alias("unit_price"),
        F.when(hit, half_up(qty * price, 2)).otherwise(F.col("line_total")).alias("line_total"), "confidence", (F.col("manually_edited") | hit).alias("manually_edited"),
    )


def add_items(items: DataFrame, new: DataFrame, products: DataFrame) -> DataFrame:
    """Items with `new` (receipt_id, product_code, quantity, unit_price) appended; a price of 0 comes from the catalog."""
    p = small(products.select("product_code", F.col("unit_price").alias("_cat")))
    last = items.groupBy("receipt_id").agg(F.max("pos").alias("_last"))
    n = new.join(p, "product_code", "left").join(last, "receipt_id", "left")
    price = F.when(F.coalesce("unit_price", F.lit(0.0)) == 0, F.coalesce("_cat", F.lit(0.0))).otherwise(F.col("unit_price"))
    pos = F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy("receipt_id").orderBy("product_code", "quantity"))
    rows = n.select(
        "receipt_id", pos.cast("int").alias("pos"), "product_code", "quantity", price.alias("unit_price"), half_up(F.col("quantity") * price, 2).alias("line_total"),
        F.lit(1.0).alias("confidence"), F.lit(True).alias("manually_edited"),
    )
    return items.select(rows.columns).union(rows)


def delete_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    return items.join(small(keys.select("receipt_id", "pos")), ["receipt_id", "pos"], "left_anti")


def cascade_delete(ids: DataFrame, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each (table, key column) without the rows of the given receipt ids."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    return [t.join(small(gone), t[key] == gone["_gone"], "left_anti") for t, key in tables]


def audit(receipts: DataFrame, items: DataFrame, newest: int = 0) -> DataFrame:
    """Per receipt: items, average confidence, confident and doubtful items, edited items, quantity; the newest n if given."""
    i = items.groupBy("receipt_id").agg(
        F.count("*").alias("n_items"), mean(items, "confidence").alias("c"), F.count_if(F.col("confidence") >= 0.7).alias("n_high"), F.count_if(F.col("confidence") < 0.5).alias("n_low"),
        F.count_if("manually_edited").alias("n_edited"), F.sum("quantity").alias("q"),
    )
    j = receipts.join(i, receipts["id"] == i["receipt_id"], "left")
    zero = F.lit(0).cast("long")
    out = j.select(
        "id", "scan_date", F.coalesce("n_items", zero).alias("n_items"), half_up(F.coalesce("c", F.lit(0.0)), 4).alias("avg_confidence"), F.coalesce("n_high", zero).alias("n_high"),
        F.coalesce("n_low", zero).alias("n_low"), F.coalesce("n_edited", zero).alias("n_edited"), F.coalesce("q", F.lit(0.0)).alias("total_quantity"),
    )
    return out.orderBy(F.desc("scan_date"), F.desc("id")).limit(newest) if newest else out


def cohorts(audited: DataFrame, cloud_days: list[str]) -> DataFrame:
    """Receipts with items of cloud and local days: mean of means and share of confident items."""
    c = audited.where("n_items > 0").withColumn("cohort", F.when(F.col("scan_date").cast("string").isin(cloud_days), "cloud").otherwise("local"))
    return c.groupBy("cohort").agg(
        F.count("*").alias("n_receipts"), half_up(F.avg("avg_confidence"), 3).alias("mean_confidence"),
        half_up(F.lit(100.0) * F.sum("n_high") / F.greatest(F.sum("n_items"), F.lit(1)), 1).alias("high_pct"),
    )


def page(receipts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, ties by id, newest id first."""
    return receipts.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


SORTS = {
    "newest": ("created_at", True), "oldest": ("created_at", False), "amount_desc": ("bill_total", True), "amount_asc": ("bill_total", False),
    "items_desc": ("total_items", True), "confidence_desc": ("avg_confidence", True),
}


def sorted_receipts(receipts: DataFrame, mode: str, limit: int) -> DataFrame:
    """One of the six orders; nulls count as 0, ties by id."""
    column, down = SORTS[mode]
    key = F.col(column) if column == "created_at" else F.coalesce(F.col(column), F.lit(0))
    return receipts.orderBy(key.desc() if down else key.asc(), "id").limit(limit)


def client_filter(receipts: DataFrame, text: str) -> DataFrame:
    """Substring over number, store, date and total."""
    q = F.lower(F.lit(text))
    cond: Column = F.lit(False)
    for c in ("receipt_number", "store_name", "scan_date"):
        cond = cond | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), q)
    return receipts.where(cond)


def recent(rows: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Rows created in the last hours before as_of, which isn't the clock's time."""
    t = F.to_timestamp(F.lit(as_of))
    return rows.where((F.col("created_at") >= t - F.make_interval(hours=F.lit(hours))) & (F.col("created_at") <= t))


def enrich(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with price, total and unit from the catalog where they have none, and where the price came from."""
    p = small(products.where("is_active").select("product_code", F.col("unit_price").alias("_cat"), F.col("unit").alias("_unit")))
    j = items.join(p, "product_code", "left")
    own, cat = F.coalesce("unit_price", F.lit(0.0)), F.coalesce("_cat", F.lit(0.0))
    price = F.when(own > 0, own).when(cat > 0, cat).otherwise(0.0)
    source = F.when(own > 0, "receipt").when(cat > 0, "catalog").otherwise("none")
    total = F.when(F.coalesce("line_total", F.lit(0.0)) > 0, F.col("line_total")).otherwise(half_up(F.col("quantity") * price, 2))
    return j.select("receipt_id", "pos", "product_code", "quantity", half_up(price, 4).alias("unit_price"), half_up(total, 2).alias("line_total"), source.alias("price_source"), F.coalesce("_unit", F.lit("Piece")).alias("unit"))


def data_sheet(receipts: DataFrame, items: DataFrame, review_below: float = 0.85) -> DataFrame:
    """One row per item with its receipt, and whether its confidence is low."""
    return items.join(receipts, items["receipt_id"] == receipts["id"]).select(
        "receipt_number", "scan_date", "pos", "product_code", "quantity", half_up(F.col("line_total"), 2).alias("line_total"), half_up(F.col("confidence"), 4).alias("confidence"),
        (half_up(F.col("confidence"), 4) < review_below).alias("low_confidence"),
    )


def summary_sheet(items: DataFrame) -> DataFrame:
    """Quantity and amount per code in order of code, with the name and unit of its first item (by receipt_id, pos), and a grand total row with nulls.

    Name and unit are null where the items don't have product_name and unit; an item without a unit counts as Piece.
    """
    place = F.struct("receipt_id", "pos")
    one = F.grouping("product_code") == 0
    none = F.lit(None).cast("string")
    name = F.min_by("product_name", place) if "product_name" in items.columns else F.max(none)
    unit = F.min_by(F.coalesce("unit", F.lit("Piece")), place) if "unit" in items.columns else F.max(none)
    return items.rollup("product_code").agg(
        F.when(one, name).alias("product_name"), F.when(one, unit).alias("unit"), F.countDistinct("receipt_id").alias("n_receipts"), F.count("*").alias("n_items"),
        F.sum("quantity").alias("quantity"), half_up(F.sum("line_total"), 2).alias("amount"),
    )


def dashboard(receipts: DataFrame, items: DataFrame, products: DataFrame, day: str) -> DataFrame:
    """Receipts and items of a day, and active products, in one row."""
    today = receipts.where(F.col("scan_date") == F.to_date(F.lit(day)))
    a = today.agg(F.count("*").alias("receipts_today"))
    b = items.join(today.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi").agg(F.count("*").alias("items_today"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity_today"))
    c = products.agg(F.count_if("is_active").alias("active_products"))
    return a.crossJoin(b).crossJoin(c)


def merge_duplicates(items: DataFrame) -> DataFrame:
    """One row per receipt and code: quantities add up, the best confidence and the first known price stay."""
    first_price = F.min_by("unit_price", F.when(F.col("unit_price") > 0, F.col("pos")))
    g = items.groupBy("receipt_id", "product_code").agg(
        F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.max("confidence").alias("confidence"), F.coalesce(first_price, F.lit(0.0)).alias("unit_price"), F.sum("line_total").alias("_sum"), F.min("pos").alias("pos"),
    )
    total = F.when(F.col("n") == 1, F.col("_sum")).when(F.col("unit_price") > 0, F.col("quantity") * F.col("unit_price")).otherwise(F.col("_sum"))
    return g.select("receipt_id", "product_code", "pos", "n", "quantity", half_up(F.col("confidence"), 4).alias("confidence"), half_up(F.col("unit_price"), 4).alias("unit_price"), half_up(total, 2).alias("line_total"), (F.col("n") > 1).alias("needs_review"))


def vouchers(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Accounting entries per receipt: date forms, signed debit and credit amounts as text, item count; items may be absent."""
    i = items.groupBy("receipt_id").agg(F.count("*").alias("n"), F.sum("line_total").alias("s"))
    j = receipts.join(i, receipts["id"] == i["receipt_id"], "left")
    amount = half_up(F.coalesce(F.nullif(F.coalesce("s", F.lit(0.0)), F.lit(0.0)), "bill_total", F.lit(0.0)), 2)
    return j.select(
        "receipt_number", F.date_format("scan_date", "yyyyMMdd").alias("voucher_date"), F.date_format("scan_date", "d-MMM-yyyy").alias("display_date"),
        F.format_string("%.2f", -amount).alias("debit"), F.format_string("%.2f", amount).alias("credit"), F.coalesce("n", F.lit(0).cast("long")).alias("n_entries"),
    )


def voucher_documents(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Nested vouchers, ready for write.format("xml") with row tag VOUCHER or for to_json; control characters are removed."""
    n = nest(receipts, items)
    entry = F.transform("items", lambda x: F.struct(clean_text(x["product_code"]).alias("STOCKITEMNAME"), x["quantity"].alias("ACTUALQTY"), F.round(x["unit_price"], 2).alias("RATE"), F.round(x["line_total"], 2).alias("AMOUNT")))
    return n.select(
        F.lit("Purchase").alias("_VCHTYPE"), F.date_format("scan_date", "yyyyMMdd").alias("DATE"), clean_text(F.col("receipt_number")).alias("VOUCHERNUMBER"),
        clean_text(F.col("store_name")).alias("PARTYLEDGERNAME"), entry.alias("ALLINVENTORYENTRIES"),
    )


def clean_text(c: Column) -> Column:
    """Text without the control characters that XML forbids."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def unique_suffix(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Ids made unique: the second row of a base id gets _2, the third _3."""
    n = F.row_number().over(W.partitionBy(base).orderBy(order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(base).cast("string")).otherwise(F.concat(F.col(base).cast("string"), F.lit("_"), n)))
