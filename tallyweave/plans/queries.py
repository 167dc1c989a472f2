"""Queries over the driver's tables, one or more per operator, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.functions import dates as D
from tallyweave.functions import hashing as H
from tallyweave.functions import match as M
from tallyweave.functions import text as X
from tallyweave.operators import catalog as C
from tallyweave.operators import dedup, layout, learn, matching, metrics, usage, verify
from tallyweave.operators import receipts as R
from tallyweave.plans.fixtures import CATALOG_CODE, Tables, half_up, mean, with_views
from tallyweave.plans.session import ship
from tallyweave.sinks import writers
from tallyweave.streaming import stateful

_FNS: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function over Tables as a query, with its SQL over the named views."""

    def add(f):
        _FNS[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def r(x: str, n: int) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * {10**n}.0 + 0.5) / {10**n}.0)"


# ---- sources -------------------------------------------------------------------------------------------------


@query("SELECT * FROM products WHERE is_active ORDER BY product_code LIMIT 50 OFFSET 20", "products")
def src1_catalog_page(t):
    return C.catalog_page(t.products, limit=50, offset=20)


@query("SELECT * FROM products WHERE is_active AND product_code IN ('P17', 'P18', 'P19', 'P21')", "products")
def src2_product_lookup(t):
    found = [C.by_code(t.products, c) for c in (" p17 ", "P18", "p19", "P21")]
    return reduce(DataFrame.union, found)


_DOC = "string_agg(pos || ':' || product_code || ':' || CAST(quantity AS INTEGER), '|' ORDER BY pos)"


@query(f"SELECT r.id, r.receipt_number, count(i.pos) AS n_items, coalesce({_DOC}, '') AS items FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id WHERE r.id = 42 GROUP BY r.id, r.receipt_number", "receipts", "items")
def src3_receipt_document(t):
    return _documents(R.nest(t.receipts.where("id = 42"), t.items.where("receipt_id = 42")))


def _documents(nested: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["pos"], x["product_code"], x["quantity"].cast("int"))), "|")
    return nested.select("id", "receipt_number", F.size("items").cast("long").alias("n_items"), text.alias("items"))


@query("SELECT receipt_id, pos, product_code, quantity, line_total FROM items WHERE receipt_id = 7 AND pos = 1", "items")
def src4_item_lookup(t):
    return t.items.where("receipt_id = 7 AND pos = 1").select("receipt_id", "pos", "product_code", "quantity", "line_total")


@query("SELECT id, stage, status, duration_ms, ts FROM logs WHERE receipt_id = 11 ORDER BY ts, id", "logs")
def src5_receipt_logs(t):
    return t.logs.where("receipt_id = 11").select("id", "stage", "status", "duration_ms", "ts").orderBy("ts", "id")


_CSV = "SELECT CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE ' p' || (p_partkey + 1000) || ' ' END AS product_code, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS product_name, p_type AS category, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS unit FROM part"


def _csv_rows(t):
    k = F.col("p_partkey")
    return t.raw("part").select(
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" p"), k + 1000, F.lit(" "))).alias("product_code"), F.when(k % 13 != 0, F.col("p_name")).alias("product_name"),
        F.col("p_type").alias("category"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("unit"),
    )


@query(
    f"""WITH raw AS ({_CSV}), c AS (SELECT upper(trim(product_code)) AS product_code, product_name, unit FROM raw),
    g AS (SELECT DISTINCT product_code FROM c WHERE product_code <> '' AND coalesce(product_name, '') <> ''),
    k AS (SELECT product_code FROM products WHERE is_active)
    SELECT 'added' AS kind, count(*) AS n FROM g WHERE product_code NOT IN (SELECT product_code FROM k)
    UNION ALL SELECT 'skipped', count(*) FROM g WHERE product_code IN (SELECT product_code FROM k)
    UNION ALL SELECT 'errors', count(*) FROM c WHERE product_code = '' OR coalesce(product_name, '') = ''""",
    "products",
)
def src6_csv_import_counts(t):
    parts = C.import_rows(_csv_rows(t), t.products)
    out = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("added", "skipped", "errors"), parts, strict=True)]
    return out[0].union(out[1]).union(out[2])


@query("SELECT product_code, product_name, unit_price FROM products WHERE product_code IN ('P1', 'P2') UNION ALL SELECT * FROM (VALUES ('ABC', 'Seed A', 200.0::DOUBLE), ('XYZ', 'Seed B', 220.0::DOUBLE)) v", "products")
def src19_seed_rows(t):
    base = t.products.where(F.col("product_code").isin("P1", "P2")).select("product_code", "product_name", "unit_price")
    rows = t.spark.createDataFrame([("ABC", "Seed A", 200.0), ("XYZ", "Seed B", 220.0), ("P1", "Other", 1.0)], base.schema)
    return C.seed(base, rows)


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def src17_variant_field(t):
    return t.raw("events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


# ---- mutations -----------------------------------------------------------------------------------------------


def _new_products(t):
    return t.raw("part").where("p_partkey % 5 = 0").select(
        F.concat(F.lit("p"), F.col("p_partkey") + 500).alias("product_code"), F.concat(F.lit("new "), "p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("unit"), (F.col("p_retailprice") + 1).alias("unit_price")
    )


_NEW = "n AS (SELECT 'P' || (p_partkey + 500) AS product_code, 'new ' || p_name AS product_name, p_type AS category, p_brand AS unit, p_retailprice + 1 AS unit_price FROM part WHERE p_partkey % 5 = 0)"


@query(
    f"""WITH {_NEW} SELECT coalesce(p.product_code, n.product_code) AS product_code,
    CASE WHEN p.product_code IS NULL OR (n.product_code IS NOT NULL AND NOT p.is_active) THEN n.product_name ELSE p.product_name END AS product_name,
    CASE WHEN p.product_code IS NULL OR (n.product_code IS NOT NULL AND NOT p.is_active) THEN n.unit_price ELSE p.unit_price END AS unit_price,
    (p.product_code IS NULL OR p.is_active OR n.product_code IS NOT NULL) AS is_active FROM products p FULL JOIN n USING (product_code)""",
    "products",
)
def snk1_add_products(t):
    return C.add_products(t.products, _new_products(t)).select("product_code", "product_name", "unit_price", "is_active")


@query(f"WITH {_NEW} SELECT n.product_code FROM n JOIN products p USING (product_code) WHERE p.is_active", "products")
def snk1_rejected(t):
    return C.rejected_products(t.products, _new_products(t)).select(F.upper("product_code").alias("product_code"))


@query("SELECT product_code, CASE WHEN product_code LIKE '%7' THEN 'patched' ELSE product_name END AS product_name, unit_price FROM products", "products")
def snk2_update_products(t):
    ch = t.products.where("product_code LIKE '%7'").select("product_code", F.lit("patched").alias("product_name"), F.lit(None).cast("double").alias("unit_price"))
    return C.patch(t.products, "product_code", ch, ["product_name", "unit_price"]).select("product_code", "product_name", "unit_price")


@query("SELECT product_code, (is_active AND product_code NOT LIKE 'P1%') AS is_active FROM products", "products")
def snk3_soft_delete(t):
    return C.deactivate(t.products, t.products.where("product_code LIKE 'P1%'").select(F.lower("product_code"))).select("product_code", "is_active")


_ROLL = f"""SELECT r.id, r.receipt_number, coalesce(n, 0) AS total_items, {r('coalesce(c, 0.0)', 4)} AS avg_confidence, {r('coalesce(s, 0.0)', 2)} AS bill_total,
    CASE WHEN n > 0 THEN 'completed' ELSE processing_status END AS processing_status
    FROM receipts r LEFT JOIN (SELECT receipt_id, count(*) AS n, avg(confidence) AS c, sum(line_total) AS s FROM {{0}} GROUP BY receipt_id) i ON i.receipt_id = r.id"""


@query(_ROLL.format("items"), "receipts", "items")
def snk5_receipt_rollup(t):
    return R.with_rollup(t.receipts, t.stored_items)


_UPD = f"u AS (SELECT receipt_id, pos, product_code, CASE WHEN pos = 2 AND receipt_id % 3 = 0 THEN quantity + 1 ELSE quantity END AS quantity, unit_price, confidence, CASE WHEN pos = 2 AND receipt_id % 3 = 0 THEN {r('(quantity + 1) * unit_price', 2)} ELSE line_total END AS line_total, (manually_edited OR (pos = 2 AND receipt_id % 3 = 0)) AS manually_edited FROM items)"


def _updated(t):
    ch = t.items.where("pos = 2 AND receipt_id % 3 = 0").select("receipt_id", "pos", F.lit(None).cast("string").alias("product_code"), (F.col("quantity") + 1).alias("quantity"), F.lit(None).cast("double").alias("unit_price"))
    return R.update_items(t.items, ch)


@query(f"WITH {_UPD} SELECT receipt_id, pos, quantity, {r('line_total', 2)} AS line_total, manually_edited FROM u", "items")
def snk6_update_items(t):
    return _updated(t).select("receipt_id", "pos", "quantity", half_up(F.col("line_total"), 2).alias("line_total"), "manually_edited")


@query(f"WITH {_UPD} {_ROLL.format('u')}", "receipts", "items")
def snk6_update_rollup(t):
    return R.with_rollup(t.receipts, _updated(t))


@query(
    f"""WITH n AS (SELECT id AS receipt_id, 'P' || (id % 100) AS product_code, 2.0 AS quantity FROM receipts WHERE id % 10 = 0), l AS (SELECT receipt_id, max(pos) AS p FROM items GROUP BY receipt_id)
    SELECT n.receipt_id, CAST(coalesce(l.p, 0) + 1 AS INTEGER) AS pos, n.product_code, CAST(n.quantity AS DOUBLE) AS quantity, coalesce(p.unit_price, 0.0) AS unit_price, {r('2 * coalesce(p.unit_price, 0.0)', 2)} AS line_total
    FROM n LEFT JOIN products p USING (product_code) LEFT JOIN l USING (receipt_id)""",
    "receipts", "items", "products",
)
def snk7_add_items(t):
    new = t.receipts.where("id % 10 = 0").select(F.col("id").alias("receipt_id"), F.concat(F.lit("P"), F.col("id") % 100).alias("product_code"), F.lit(2.0).alias("quantity"), F.lit(0.0).alias("unit_price"))
    out = R.add_items(t.items, new, t.products)
    last = t.items.groupBy("receipt_id").agg(F.max("pos").alias("_p"))
    added = out.where("receipt_id % 10 = 0").join(last, "receipt_id", "left").where("pos > coalesce(_p, 0)")
    return added.select("receipt_id", "pos", "product_code", "quantity", "unit_price", "line_total")


@query("WITH d AS (SELECT * FROM items WHERE NOT (pos = 1 AND receipt_id % 4 = 0)) " + _ROLL.format("d"), "receipts", "items")
def snk8_delete_items_rollup(t):
    return R.with_rollup(t.receipts, R.delete_items(t.items, t.items.where("pos = 1 AND receipt_id % 4 = 0")))


@query("SELECT (SELECT count(*) FROM receipts WHERE id % 6 <> 0) AS receipts, (SELECT count(*) FROM items WHERE receipt_id % 6 <> 0) AS items, (SELECT count(*) FROM logs WHERE receipt_id % 6 <> 0) AS logs", "receipts", "items", "logs")
def snk9_cascade_delete(t):
    ids = t.receipts.where("id % 6 = 0").select("id")
    a, b, c = R.cascade_delete(ids, (t.receipts, "id"), (t.items, "receipt_id"), (t.logs.join(t.receipts.select(F.col("id").alias("receipt_id")), "receipt_id", "left_semi"), "receipt_id"))
    return a.agg(F.count("*").alias("receipts")).crossJoin(b.agg(F.count("*").alias("items"))).crossJoin(c.agg(F.count("*").alias("logs")))


@query("SELECT id, stage, status FROM logs UNION ALL SELECT id + 1000000, 'retry', status FROM logs WHERE status = 'failed'", "logs")
def snk10_append_logs(t):
    cols = t.logs.select("id", "stage", "status")
    return cols.unionByName(t.logs.where("status = 'failed'").select((F.col("id") + 1000000).alias("id"), F.lit("retry").alias("stage"), "status"))


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 'Patched' ELSE store_name END AS store_name, bill_total FROM receipts", "receipts")
def snk11_patch_metadata(t):
    ch = t.receipts.where("id % 9 = 0").select("id", F.lit("Patched").alias("store_name"), F.lit(0.0).alias("bill_total"))
    return C.patch(t.receipts, "id", ch, ["store_name"]).select("id", "store_name", "bill_total")


@query("SELECT product_code, product_name, category, unit FROM products WHERE is_active", "products")
def snk13_export_catalog(t):
    return t.products.where("is_active").select("product_code", "product_name", "category", "unit")


@query(f"SELECT receipt_number, scan_date, pos, product_code, quantity, {r('line_total', 2)} AS line_total, {r('confidence', 4)} AS confidence, ({r('confidence', 4)} < 0.85) AS low_confidence FROM items i JOIN receipts r ON r.id = i.receipt_id", "receipts", "items")
def snk14_data_sheet(t):
    return R.data_sheet(t.receipts, t.items)


_SUM = f"SELECT product_code, CASE WHEN product_code IS NOT NULL THEN first(product_name ORDER BY receipt_id, pos) END AS product_name, CASE WHEN product_code IS NOT NULL THEN first(unit ORDER BY receipt_id, pos) END AS unit, count(DISTINCT receipt_id) AS n_receipts, count(*) AS n_items, sum(quantity) AS quantity, {r('sum(line_total)', 2)} AS amount FROM named GROUP BY ROLLUP (product_code) HAVING count(*) > 0"
_NAMED = "named AS (SELECT i.*, product_name || ' ' || (receipt_id % 3) AS product_name, CASE WHEN receipt_id % 4 > 0 THEN unit ELSE 'Piece' END AS unit FROM items i JOIN products USING (product_code))"


def _named(t):
    p = t.products.select("product_code", "product_name", "unit")
    d = t.items.join(C.small(p), "product_code").withColumn("product_name", F.concat("product_name", F.lit(" "), F.col("receipt_id") % 3))
    return d.withColumn("unit", F.when(F.col("receipt_id") % 4 > 0, F.col("unit")))


@query(f"WITH {_NAMED} {_SUM}", "items", "products")
def snk14_summary_sheet(t):
    return R.summary_sheet(_named(t))


@query(f"WITH {_NAMED}, i2 AS (SELECT * FROM named WHERE receipt_id IN (SELECT id FROM receipts WHERE scan_date = DATE '1997-05-28')) " + _SUM.replace("FROM named", "FROM i2"), "items", "receipts", "products")
def snk15_daily_report(t):
    ids = t.receipts.where("scan_date = DATE '1997-05-28'").select(F.col("id").alias("receipt_id"))
    return R.summary_sheet(_named(t).join(ids, "receipt_id", "left_semi"))


@query(
    f"""WITH i AS (SELECT receipt_id, count(*) AS n, sum(line_total) AS s FROM items GROUP BY receipt_id), v AS (SELECT r.*, i.n, {r("coalesce(nullif(coalesce(i.s, 0.0), 0.0), r.bill_total, 0.0)", 2)} AS a FROM receipts r LEFT JOIN i ON i.receipt_id = r.id)
    SELECT receipt_number, strftime(scan_date, '%Y%m%d') AS voucher_date, strftime(scan_date, '%-d-%b-%Y') AS display_date, printf('%.2f', -a) AS debit, printf('%.2f', a) AS credit, coalesce(n, 0) AS n_entries FROM v""",
    "receipts", "items",
)
def snk16_vouchers(t):
    return R.vouchers(t.receipts, t.items)


@query("SELECT 'REC-' || o_orderkey AS number, count(l_orderkey) AS n_entries FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def snk17_voucher_json(t):
    js = R.voucher_documents(t.receipts, t.items).select(F.to_json(F.struct("*")).alias("j"))
    return js.select(F.get_json_object("j", "$.VOUCHERNUMBER").alias("number"), F.coalesce(F.json_array_length(F.get_json_object("j", "$.ALLINVENTORYENTRIES")), F.lit(0)).cast("long").alias("n_entries"))


@query("SELECT o_orderkey AS id, 'B' || (o_custkey % 40) || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS unique_id FROM orders WINDOW w AS (PARTITION BY o_custkey % 40 ORDER BY o_orderkey)")
def snk19_unique_suffix(t):
    d = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("B"), F.col("o_custkey") % 40).alias("base"))
    return R.unique_suffix(d, "base", "id").select("id", "unique_id")


@query("SELECT text, max(doc_id) AS doc_id FROM documents WHERE doc_id <= 800 GROUP BY text")
def snk24_result_cache(t):
    d = t.raw("documents").select("text", "doc_id", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"))
    return dedup.cache_latest(d, "text", "ts", "2024-01-01 13:20:00").select("text", "doc_id")


@query("SELECT product_code, CASE WHEN unit = 'Brand#3' THEN CASE WHEN product_code LIKE '%1' THEN 9.5 ELSE 0.0 END ELSE unit_price END AS unit_price FROM products", "products")
def snk28_price_backfill(t):
    p = t.products.withColumn("unit_price", F.when(F.col("unit") == "Brand#3", 0.0).otherwise(F.col("unit_price")))
    prices = t.products.where("product_code LIKE '%1'").select("product_code", F.lit(9.5).alias("price"))
    return C.backfill_prices(p, prices).select("product_code", "unit_price")


@query("SELECT receipt_id, original_code, corrected_code, original_qty, corrected_qty FROM corrections WHERE upper(original_code) <> upper(corrected_code) OR abs(original_qty - corrected_qty) > 0.01", "corrections")
def snk29_recorded_corrections(t):
    c = t.corrections
    return c.where(verify.change_detected(*[F.col(x) for x in ("original_code", "corrected_code", "original_qty", "corrected_qty")])).select("receipt_id", "original_code", "corrected_code", "original_qty", "corrected_qty")


@query("SELECT a.n_name AS key, CAST(a.n_regionkey AS VARCHAR) AS old, CASE WHEN a.n_nationkey % 4 = 0 THEN NULL ELSE CAST(a.n_regionkey % 3 AS VARCHAR) END AS new FROM nation a WHERE a.n_nationkey % 4 = 0 OR a.n_regionkey <> a.n_regionkey % 3")
def snk31_profile_diff(t):
    n = t.raw("nation").select(F.col("n_name").alias("key"), "n_regionkey", "n_nationkey")
    old = n.select("key", F.col("n_regionkey").cast("string").alias("value"))
    return writers.profile_diff(old, n.where("n_nationkey % 4 <> 0").select("key", (F.col("n_regionkey") % 3).cast("string").alias("value")))


# ---- filters and projections ---------------------------------------------------------------------------------


@query("SELECT * FROM products WHERE is_active AND (contains(lower(product_code), 'p19') OR contains(lower(product_name), 'ring'))", "products")
def flt1_search(t):
    return C.search(t.products, "RING").unionByName(C.search(t.products, "p19")).distinct()


@query("SELECT id, receipt_number, bill_total FROM receipts WHERE scan_date = DATE '1997-05-28'", "receipts")
def flt2_by_day(t):
    return t.receipts.where(F.col("scan_date") == F.to_date(F.lit("1997-05-28"))).select("id", "receipt_number", "bill_total")


@query("SELECT id, store_name FROM receipts WHERE id IN (1, 5, 9, 1000, 77)", "receipts")
def flt3_in_list(t):
    return t.receipts.where(F.col("id").isin(1, 5, 9, 1000, 77)).select("id", "store_name")


@query("SELECT id, created_at FROM receipts WHERE created_at BETWEEN TIMESTAMP '1998-01-09 00:00:00' AND TIMESTAMP '1998-01-10 00:00:00'", "receipts")
def flt4_recent(t):
    return R.recent(t.receipts, "1998-01-10 00:00:00", 24).select("id", "created_at")


@query("SELECT id FROM receipts WHERE contains(lower(receipt_number), '99') OR contains(lower(store_name), '99') OR contains(CAST(scan_date AS VARCHAR), '99')", "receipts")
def flt5_client_filter(t):
    return R.client_filter(t.receipts, "99").select("id")


@query(f"SELECT receipt_id, pos, {r('confidence', 4)} AS confidence FROM items WHERE confidence < 0.6", "items")
def flt6_low_confidence(t):
    return t.items.where("confidence < 0.6").select("receipt_id", "pos", half_up(F.col("confidence"), 4).alias("confidence"))


#: Lines of all kinds: headers, footers, totals, noise.
_KINDS = ("Item Code  Qty", "THANK YOU", "Ltems", "amount", "S. No Rate", "#####", "12/03/2024", "10:45", "7", "%", "Total Items: 4", "Sub total 9", "Tota1 3", "Sum: 4", "Bill-Total 8", "(BLOCK CAPITALS)", "Receipt #", "Io1f", "qly", "Prepared by me", "ABC 2", "Paint 3", "dates", "x", "", "  ", "Grand_Total 5", "Net tdal")
_KINDS_SQL = "k AS (SELECT p_partkey AS id, [" + ", ".join(f"'{x}'" for x in _KINDS) + f"][p_partkey % {len(_KINDS)} + 1] AS text FROM part)"
_HEADS = [
    "^\\s*$", "^[0-9]{1,2}$", "^[0-9]+[/.-][0-9]+[/.-][0-9]{2,4}$", "^[0-9]{1,2}:[0-9][0-9]", "^[-#=_*]{3,}$", "date", "time", "invoice", "receipt\\s*#", "thank", "sign", "cash", "change", "^item", "^product", "^code", "^name", "^qty", "^quantity", "^sr[.]?\\s*no",
    "^lte[a-z]*$", "^(firma|store|shop|mart|bill|paid|amount|amt|rate|price|unit|qtx|qix|qtv|qly|qry|receipt)$", "\\(\\s*(block|capitals|number|only)", "^s[.]?\\s*no\\b", "prepared\\s*by", "total\\s*items", "^(item\\s*code|amount|rate|price|s[.]?\\s*no|unit)\\s+(item|code|qty|quantity|rate|amount|price|s[.]?\\s*no|unit)", "^.$",
]
_ANY_TOTAL = "(regexp_matches(text, '(?i)total|totai|tota1|t0tal|totd|totol|toial|tatal|toal|tdal|tetal|sum') AND NOT regexp_matches(text, '(?i)(total|totd)\\s*(items|count|no|number|products|entries)'))"
_MONEY = "regexp_matches(text, '(?i)(grand|grramd|gramd|grrand|bill|net)[ :=_.-]*(total|totai|tota1|t0tal|totd|toal|tdal|tetal)|(total|totai|tota1|t0tal|totd|toal|tdal|tetal)[ :=_.-]*(amount|amt)')"


def _kinds(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("p_partkey") % len(_KINDS) + 1).cast("int")).alias("text"))


@query(f"WITH {_KINDS_SQL} SELECT id, text FROM k WHERE {' OR '.join(f'regexp_matches(trim(text), {chr(39)}(?i){x}{chr(39)})' for x in _HEADS[:-1])} OR regexp_full_match(trim(text), '[^a-zA-Z0-9]') OR regexp_full_match(text, '[IlOo|1][qQtTfF0-9][qQtTfF0-9.]*') OR {_ANY_TOTAL} OR {_MONEY}")
def flt7_skipped_lines(t):
    return _kinds(t).where(X.is_skipped(F.col("text")))


@query(f"WITH {_KINDS_SQL} SELECT id, text FROM k WHERE {_ANY_TOTAL}")
def flt8_total_lines(t):
    return _kinds(t).where(X.is_total(F.col("text")))


@query("SELECT i.receipt_id, i.pos, i.product_code FROM items i JOIN products p USING (product_code) WHERE p.is_active", "items", "products")
def flt9_known_codes(t):
    return t.items.join(C.small(t.products.where("is_active").select("product_code")), "product_code", "left_semi").select("receipt_id", "pos", "product_code")


_DET = "det AS (SELECT receipt_id, pos AS det_id, CAST((pos * 37) % 4 * 60 AS DOUBLE) AS x, CAST(40 * pos + receipt_id % 7 + (pos % 3) * 4 AS DOUBLE) AS y, product_code AS text, confidence FROM items)"


def _detections(t):
    p = F.col("pos")
    return t.items.select("receipt_id", p.cast("long").alias("det_id"), ((p * 37) % 4 * 60).cast("double").alias("x"), (p * 40 + F.col("receipt_id") % 7 + (p % 3) * 4).cast("double").alias("y"), F.col("product_code").alias("text"), "confidence")


@query(f"WITH {_DET}, m AS (SELECT *, max(y) OVER (PARTITION BY receipt_id) AS my FROM det), f AS (SELECT *, (y < 0.2 * my AND confidence < 0.8) AS noise FROM m) SELECT receipt_id, count(*) AS n FROM f WHERE NOT (y < 0.02 * my AND confidence < 0.3) GROUP BY receipt_id", "items")
def flt10_top_noise(t):
    return layout.top_noise(_detections(t)).groupBy("receipt_id").agg(F.count("*").alias("n"))


@query(f"WITH {_DET}, m AS (SELECT *, max(y) OVER (PARTITION BY receipt_id) AS my FROM det) SELECT receipt_id, CAST(det_id AS BIGINT) AS det_id FROM m WHERE y >= 0.3 * my", "items")
def flt11_bottom_region(t):
    return layout.bottom_region(_detections(t)).select("receipt_id", "det_id")


@query("SELECT l_orderkey AS receipt_id, count(*) AS n, bool_and(l_quantity > 5) AS ok FROM lineitem GROUP BY l_orderkey")
def flt13_label_validation(t):
    g = t.items.groupBy("receipt_id").agg(F.collect_list(F.struct(F.col("product_code").alias("code"), "quantity")).alias("items"))
    return g.select("receipt_id", F.size("items").cast("long").alias("n"), F.forall("items", lambda x: (F.trim(x["code"]) != "") & (x["quantity"] > 5)).alias("ok"))


@query("SELECT receipt_id, pos, regexp_matches(product_code, '^[A-Z0-9_-]{1,10}$') AND quantity > 0 AND quantity <= 99999 AND unit_price BETWEEN 0 AND 9999999 AS valid FROM items", "items")
def flt14_request_validation(t):
    return t.items.select("receipt_id", "pos", C.valid_request(F.col("product_code"), F.col("quantity"), F.col("unit_price")).alias("valid"))


_GATE = "g AS (SELECT receipt_id, count(*) AS n, avg(confidence) AS c FROM items GROUP BY receipt_id)"


@query(
    f"""WITH {_GATE} SELECT receipt_id, CASE WHEN receipt_id % 50 = 0 THEN 'cache' WHEN receipt_id % 31 = 0 THEN 'reject' WHEN c >= CASE WHEN receipt_id % 2 = 0 THEN 0.85 ELSE 0.88 END AND n >= 4 THEN 'local' WHEN receipt_id % 7 > 0 THEN 'cloud' ELSE 'local_fallback' END AS route,
    (n >= 2 OR c > 0.5) AS cacheable FROM g""",
    "items",
)
def flt15_cloud_route(t):
    g = (i := t.stored_items).groupBy("receipt_id").agg(F.count("*").alias("n_detections"), mean(i, "confidence").alias("calibrated"))
    k = F.col("receipt_id")
    d = g.select("*", (k % 2 == 0).alias("is_structured"), F.lit(0.5).alias("catalog_rate"), (k % 50 == 0).alias("cached"), (k % 31 != 0).alias("quality_ok"), (k % 7).alias("budget_left"), F.col("n_detections").alias("n_items"))
    return verify.cloud_route(d).select("receipt_id", "route", "cacheable")


@query(
    f"""WITH q AS (SELECT o_orderkey AS id, CAST(o_orderkey % 120 AS DOUBLE) AS s, CAST(o_orderkey % 260 AS DOUBLE) AS b FROM orders)
    SELECT id, concat_ws('; ', CASE WHEN s < 30 THEN 'too blurry' END, CASE WHEN b < 40 THEN 'too dark' END, CASE WHEN b > 252 THEN 'too bright' END) AS reasons, (s >= 30 AND b BETWEEN 40 AND 252) AS passes,
    {r('least(100.0, s / 10) * CASE WHEN b < 60 OR b > 220 THEN 0.7 ELSE 1.0 END', 1)} AS image_score FROM q"""
)
def flt16_image_quality(t):
    k = F.col("o_orderkey")
    d = t.raw("orders").select(k.alias("id"), (k % 120).cast("double").alias("sharpness"), (k % 260).cast("double").alias("brightness"))
    return verify.image_quality(d).select("id", "reasons", "passes", "image_score")


@query("WITH g AS (SELECT l_orderkey AS receipt_id, l_linenumber % 2 AS pass, count(*) AS n, avg(l_quantity) AS c FROM lineitem GROUP BY ALL) SELECT receipt_id, pass, n FROM g QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY n DESC, c DESC, pass) = 1")
def flt18_pass_choice(t):
    return layout.choose_pass(t.raw("lineitem").select(F.col("l_orderkey").alias("receipt_id"), (F.col("l_linenumber") % 2).alias("pass"), F.col("l_quantity").alias("confidence")))


@query("SELECT product_code, product_name FROM products WHERE is_active", "products")
def prj1_code_map(t):
    m = t.products.where("is_active").agg(F.map_from_entries(F.collect_list(F.struct("product_code", "product_name"))).alias("m"))
    return m.select(F.explode("m").alias("product_code", "product_name"))


@query(f"WITH {_DET} SELECT receipt_id, CAST(det_id AS BIGINT) AS det_id, x, y FROM det", "items")
def prj2_box_centres(t):
    d = _detections(t)
    c = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    boxed = d.withColumn("bbox", F.array(c(-5, -2), c(5, -2), c(5, 2), c(-5, 2)))
    return boxed.select("receipt_id", "det_id", layout.centre(F.col("bbox"), 0).alias("x"), layout.centre(F.col("bbox"), 1).alias("y"))


@query(
    f"""WITH e AS (SELECT i.*, CASE WHEN pos % 3 = 0 THEN 0.0 ELSE i.unit_price END AS own, coalesce(p.unit_price, 0.0) AS cat, p.unit FROM items i LEFT JOIN (SELECT * FROM products WHERE is_active) p USING (product_code))
    SELECT receipt_id, pos, product_code, quantity, {r('CASE WHEN own > 0 THEN own WHEN cat > 0 THEN cat ELSE 0.0 END', 4)} AS unit_price, {r('line_total', 2)} AS line_total,
    CASE WHEN own > 0 THEN 'receipt' WHEN cat > 0 THEN 'catalog' ELSE 'none' END AS price_source, coalesce(unit, 'Piece') AS unit FROM e""",
    "items", "products",
)
def prj4_enrich(t):
    return R.enrich(t.items.withColumn("unit_price", F.when(F.col("pos") % 3 == 0, 0.0).otherwise(F.col("unit_price"))), t.products)


# ---- joins ---------------------------------------------------------------------------------------------------

_AUDIT = f"""SELECT r.id, r.scan_date, coalesce(n, 0) AS n_items, {r('coalesce(c, 0.0)', 4)} AS avg_confidence, coalesce(h, 0) AS n_high, coalesce(lo, 0) AS n_low, coalesce(e, 0) AS n_edited, coalesce(q, 0.0) AS total_quantity
    FROM receipts r LEFT JOIN (SELECT receipt_id, count(*) AS n, avg(confidence) AS c, count(*) FILTER (confidence >= 0.7) AS h, count(*) FILTER (confidence < 0.5) AS lo, count(*) FILTER (manually_edited) AS e, sum(quantity) AS q FROM items GROUP BY receipt_id) i ON i.receipt_id = r.id"""


@query(_AUDIT + " ORDER BY r.scan_date DESC, r.id DESC LIMIT 20", "receipts", "items")
def join1_receipt_audit(t):
    return R.audit(t.receipts, t.stored_items, 20)


@query(f"WITH a AS ({_AUDIT}) SELECT * FROM a WHERE n_items > 0 AND CAST(scan_date AS VARCHAR) IN ('1997-05-28', '1998-10-03')", "receipts", "items")
def join2_audit_of_days(t):
    return R.audit(t.receipts.where(F.col("scan_date").cast("string").isin("1997-05-28", "1998-10-03")), t.items).where("n_items > 0")


@query(f"SELECT r.id, r.receipt_number, count(i.pos) AS n_items, coalesce({_DOC}, '') AS items FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id WHERE r.id < 500 GROUP BY r.id, r.receipt_number", "receipts", "items")
def join3_nest_by_ids(t):
    return _documents(R.nest(t.receipts.where("id < 500"), t.items))


@query(f"SELECT r.id, r.receipt_number, count(i.pos) AS n_items, coalesce({_DOC}, '') AS items FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id WHERE r.scan_date = DATE '1997-05-28' GROUP BY r.id, r.receipt_number", "receipts", "items")
def join4_nest_by_day(t):
    return _documents(R.nest(t.receipts.where("scan_date = DATE '1997-05-28'"), t.items))


@query("SELECT receipt_id, count(*) AS n, count(p.product_code) AS n_known FROM items i LEFT JOIN (SELECT product_code FROM products WHERE is_active) p USING (product_code) GROUP BY receipt_id", "items", "products")
def join5_catalog_lookup(t):
    p = C.small(t.products.where("is_active").select("product_code", F.lit(1).alias("k")))
    return t.items.join(p, "product_code", "left").groupBy("receipt_id").agg(F.count("*").alias("n"), F.count("k").alias("n_known"))


@query(
    f"""WITH tok AS (SELECT receipt_id, line_no, unnest(regexp_split_to_array(upper(text), '[^A-Z0-9]+')) AS token FROM lines), h AS (SELECT receipt_id, count(DISTINCT token) AS n_codes, count(DISTINCT line_no) AS n_hit FROM tok WHERE token IN (SELECT product_code FROM products) GROUP BY receipt_id),
    n AS (SELECT receipt_id, count(*) AS n_lines FROM lines GROUP BY receipt_id) SELECT receipt_id, coalesce(n_codes, 0) AS n_codes, {r('coalesce(n_hit, 0) / n_lines', 4)} AS rate FROM n LEFT JOIN h USING (receipt_id)""",
    "lines", "products",
)
def join6_catalog_rate(t):
    return matching.catalog_rate(t.lines, t.products).select("receipt_id", "n_codes", half_up(F.col("rate"), 4).alias("rate"))


def _detected(t):
    """Items as a recogniser might return them: some lost, some misread, some with another quantity."""
    p = F.col("pos")
    code = F.when(p % 7 == 3, F.concat("product_code", F.lit("X"))).otherwise(F.col("product_code"))
    qty = F.when(p % 5 == 2, F.col("quantity") + 1).otherwise(F.col("quantity"))
    return t.items.where("(pos + receipt_id) % 9 <> 0").withColumns({"product_code": code, "quantity": qty})


_DTC = "dtc AS (SELECT receipt_id, pos, CASE WHEN pos % 7 = 3 THEN product_code || 'X' ELSE product_code END AS product_code, CASE WHEN pos % 5 = 2 THEN quantity + 1 ELSE quantity END AS quantity FROM items WHERE (pos + receipt_id) % 9 <> 0)"


@query(f"WITH {_DTC} SELECT DISTINCT receipt_id, product_code FROM items EXCEPT SELECT receipt_id, product_code FROM dtc", "items")
def join7_missing_codes(t):
    return learn.missing_codes(t.items, _detected(t))


_CMP = f"""{_DTC}, cmp AS (SELECT receipt_id, code, e.q AS expected, d.q AS detected, CASE WHEN d.q IS NULL THEN 'missing' WHEN e.q IS NULL THEN 'extra' WHEN abs(e.q - d.q) <= 0.01 THEN 'matched' ELSE 'quantity' END AS status
    FROM (SELECT receipt_id, product_code AS code, sum(quantity) AS q FROM items GROUP BY ALL) e FULL JOIN (SELECT receipt_id, product_code AS code, sum(quantity) AS q FROM dtc GROUP BY ALL) d USING (receipt_id, code))"""


@query(f"WITH {_CMP} SELECT receipt_id, code, expected, detected, status FROM cmp", "items")
def join8_compare_items(t):
    return learn.compare_items(t.items, _detected(t))


_DESC = "tx AS (SELECT p_partkey AS id, upper(CASE p_partkey % 3 WHEN 0 THEN 'buy p' || p_partkey || ' now' WHEN 1 THEN 'one ' || p_name || ' please' ELSE 'nothing here' END) AS text FROM part), cat AS (SELECT product_code, upper(product_name) AS name, regexp_split_to_array(upper(product_name), '[^A-Z0-9]+')[1] AS head FROM products), tok AS (SELECT DISTINCT id, unnest(regexp_split_to_array(text, '[^A-Z0-9]+')) AS token FROM tx)"


@query(
    f"""WITH {_DESC}, a AS (SELECT id, min(product_code) AS code FROM tok JOIN cat ON token = product_code GROUP BY id),
    b AS (SELECT id, product_code AS named FROM tok JOIN cat ON token = head JOIN tx USING (id) WHERE contains(text, name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, product_code) = 1)
    SELECT id, coalesce(code, named) AS matched_code, CASE WHEN code IS NOT NULL THEN 'exact' WHEN named IS NOT NULL THEN 'contains' ELSE 'unmatched' END AS match_type FROM tx LEFT JOIN a USING (id) LEFT JOIN b USING (id)""",
    "products",
)
def join9_match_descriptions(t):
    k = F.col("p_partkey")
    d = t.raw("part").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("buy p"), k, F.lit(" now"))).when(k % 3 == 1, F.concat(F.lit("one "), "p_name", F.lit(" please"))).otherwise("nothing here").alias("text"))
    return matching.match_descriptions(d, t.products)


@query()
def join10_match_codes(t):
    k = F.col("p_partkey")
    code = F.when(k % 40 == 3, F.concat(F.lit("Q"), k)).when(k % 4 == 1, F.concat(F.lit("PI"), k % 10, F.lit("O"))).when(k % 40 == 2, F.translate(F.concat(F.lit("P"), k), "01", "OI")).otherwise(F.concat(F.lit("P"), k))
    return matching.match_codes(t.raw("part").select(code.alias("code")).distinct(), t.products)


@query(
    """WITH c AS (SELECT DISTINCT 'P' || (p_partkey % 40) || CASE WHEN p_partkey % 2 = 0 THEN 'O' ELSE 'I' END AS code FROM part), d AS (SELECT code, left(code, -1) AS s, left(code, -1) || CASE WHEN code LIKE '%O' THEN '0' ELSE '1' END AS l FROM c WHERE length(code) >= 4),
    j AS (SELECT d.code, s.product_code AS sc, l.product_code AS lc, regexp_matches(substr(d.code, length(d.code) - 1, 1), '[0-9]') AS b FROM d LEFT JOIN products s ON s.product_code = d.s LEFT JOIN products l ON l.product_code = d.l)
    SELECT code, CASE WHEN sc IS NOT NULL AND lc IS NOT NULL THEN CASE WHEN b THEN lc ELSE sc END ELSE coalesce(lc, sc) END AS matched_code, CASE WHEN sc IS NOT NULL AND lc IS NOT NULL THEN 'ambiguous_oi' WHEN coalesce(lc, sc) IS NOT NULL THEN 'exact' ELSE 'none' END AS match_type FROM j""",
    "products",
)
def join10_trailing_tier(t):
    k = F.col("p_partkey")
    return matching.trailing_tier(t.raw("part").select(F.concat(F.lit("P"), k % 40, F.when(k % 2 == 0, "O").otherwise("I")).alias("code")), t.products)


_HASH = "hb AS (SELECT id, at_s, fingerprint, list_transform(pixels, lambda x: x > list_avg(pixels)) AS bits FROM hashes), ham AS (SELECT a.id AS id_a, b.id AS id_b, a.at_s AS ta, a.fingerprint AS fa, b.fingerprint AS fb, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS distance FROM hb a JOIN hb b ON a.id < b.id AND abs(a.at_s - b.at_s) <= 86400)"


def _hashes(t):
    return t.hashes.select("id", "at_s", "fingerprint", H.average_hash(F.col("pixels")).alias("hash"))


@query(f"WITH {_HASH} SELECT id_a, id_b, CAST(distance AS INTEGER) AS distance FROM ham WHERE distance <= 20", "hashes")
def join11_near_hashes(t):
    return dedup.near_hashes(_hashes(t), 20)


@query(
    f"""WITH {_HASH}, s AS (SELECT id_b AS id, id_a AS duplicate_of, CAST(60 + CASE WHEN fa = fb THEN 40 ELSE 0 END AS INTEGER) AS score, CAST(distance AS INTEGER) AS distance, CAST(100 - floor(distance * 100 / 64) AS BIGINT) AS similarity, ta FROM ham WHERE distance <= 20)
    SELECT id, duplicate_of, score, distance, similarity FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ta DESC, duplicate_of DESC) = 1""",
    "hashes",
)
def join11_best_duplicate(t):
    return dedup.duplicate_of(_hashes(t), 20)


@query("WITH h AS (SELECT receipt_id, greatest(max(pos) * 40, coalesce(max(pos * 40 + 9) FILTER (pos % 2 = 0 AND quantity > 1), 0)) AS top FROM items GROUP BY receipt_id) SELECT receipt_id, pos, product_code, CASE WHEN pos % 2 = 1 THEN quantity WHEN 9 < 0.06e0 * top THEN quantity ELSE 1.0 END AS quantity, pos * 40.0e0 AS y FROM items JOIN h USING (receipt_id)", "items")
def join12_orphan_numbers(t):
    items = t.items.select("receipt_id", "pos", "product_code", F.when(F.col("pos") % 2 == 0, 1.0).otherwise(F.col("quantity")).alias("quantity"), (F.col("pos") * 40.0).alias("y"))
    numbers = t.items.where("pos % 2 = 0").select("receipt_id", (F.col("pos") * 40.0 + 9).alias("y"), F.col("quantity").alias("value"))
    return layout.attach_orphans(items, numbers)


@query(
    f"""WITH l AS (SELECT receipt_id, pos AS line_no, 0.0::DOUBLE AS x0, 100.0::DOUBLE AS x1, pos * 40.0::DOUBLE AS y0, pos * 40.0 + 20.0::DOUBLE AS y1 FROM items), w AS (SELECT receipt_id, (pos * 29) % 120 AS x, pos * 39.0::DOUBLE AS y, confidence FROM items)
    SELECT l.receipt_id, l.line_no, {r('coalesce(avg(w.confidence), 0.8)', 4)} AS confidence FROM l LEFT JOIN w ON w.receipt_id = l.receipt_id AND w.x BETWEEN l.x0 AND l.x1 AND w.y BETWEEN l.y0 - 0.3 * (l.y1 - l.y0) AND l.y1 + 0.3 * (l.y1 - l.y0) GROUP BY l.receipt_id, l.line_no""",
    "items",
)
def join14_word_confidence(t):
    p = F.col("pos")
    lines = t.items.select("receipt_id", p.alias("line_no"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), (p * 40.0).alias("y0"), (p * 40.0 + 20).alias("y1"))
    words = t.items.select("receipt_id", ((p * 29) % 120).cast("double").alias("x"), (p * 39.0).alias("y"), "confidence")
    return layout.word_confidence(lines, words)


@query(f"WITH {_DET} SELECT receipt_id, CAST(det_id AS BIGINT) AS det_id, x, y, text, confidence FROM det WHERE det_id % 4 > 0 UNION ALL SELECT receipt_id, det_id + 100, x + 12, y + 14.9e0, text || 'Z', confidence + 0.1e0 FROM det WHERE det_id % 4 = 0 UNION ALL SELECT receipt_id, det_id + 200, x + 30, y, text, confidence FROM det WHERE det_id % 5 = 0 AND (det_id + 200) % 4 <> 0", "items")
def join15_drop_echoes(t):
    d = _detections(t)
    far = d.where("det_id % 5 = 0").withColumns({"det_id": F.col("det_id") + 200, "x": F.col("x") + 30})
    better = d.where("det_id % 4 = 0").withColumns({"det_id": F.col("det_id") + 100, "x": F.col("x") + 12, "y": F.col("y") + 14.9, "text": F.concat("text", F.lit("Z")), "confidence": F.col("confidence") + 0.1})
    worse = d.where("det_id % 4 = 1").withColumns({"det_id": F.col("det_id") + 300, "x": F.col("x") - 12, "confidence": F.col("confidence") - 0.1})
    return layout.drop_echoes(d.unionByName(far.where("det_id % 4 <> 0")).unionByName(better).unionByName(worse))


_PASS2 = "p2 AS (SELECT receipt_id, CASE WHEN det_id % 4 = 1 THEN text || 'Z' ELSE text END AS text, y, confidence FROM det WHERE det_id % 5 <> 0)"


@query(
    f"""WITH {_DET}, {_PASS2}, a AS (SELECT receipt_id, upper(text) AS key, CAST(round_even(y / 60, 0) AS BIGINT) AS band, max(confidence) AS ca FROM det GROUP BY ALL), b AS (SELECT receipt_id, upper(text) AS key, CAST(round_even(y / 60, 0) AS BIGINT) AS band, max(confidence) AS cb FROM p2 GROUP BY ALL),
    j AS (SELECT *, count(ca) OVER w AS na, count(cb) OVER w AS nb FROM a FULL JOIN b USING (receipt_id, key, band) WINDOW w AS (PARTITION BY receipt_id, band)),
    v AS (SELECT *, (ca IS NOT NULL AND cb IS NOT NULL) AS two, greatest(ca, cb) AS best FROM j)
    SELECT receipt_id, key, band, {r('CASE WHEN two THEN least(1.0, best * 1.15) WHEN na > 0 AND nb > 0 THEN best * 0.95 ELSE best END', 4)} AS confidence, (NOT two AND ((na > 0 AND nb > 0) OR best < 0.75)) AS needs_review, CASE WHEN two THEN 'agreed' WHEN na > 0 AND nb > 0 THEN 'conflict' ELSE 'single' END AS vote FROM v""",
    "items",
)
def join16_vote(t):
    d = _detections(t)
    return layout.vote(d, d.where("det_id % 5 <> 0").withColumn("text", F.when(F.col("det_id") % 4 == 1, F.concat("text", F.lit("Z"))).otherwise(F.col("text"))))


@query(
    f"""WITH {_DET}, p AS (SELECT receipt_id, det_id, CASE WHEN det_id % 4 = 0 THEN text || ' x' WHEN det_id % 7 = 0 THEN text || 'zz' ELSE text END AS text, confidence FROM det), o AS (SELECT receipt_id, list(DISTINCT upper(trim(text))) AS ts FROM det WHERE det_id % 3 <> 0 GROUP BY receipt_id),
    j AS (SELECT p.*, upper(trim(text)) AS u, list_filter(list_distinct(string_split(upper(trim(text)), ' ')), lambda x: x <> '') AS mine, coalesce(ts, []) AS ts FROM p LEFT JOIN o USING (receipt_id)),
    k AS (SELECT *, CASE WHEN list_contains(ts, u) THEN 1.15e0 WHEN 2 * len(list_intersect(mine, flatten(list_transform(ts, lambda v: string_split(v, ' '))))) >= len(mine) AND len(mine) > 0 THEN 1 + 0.15e0 * len(list_intersect(mine, flatten(list_transform(ts, lambda v: string_split(v, ' '))))) / len(mine)
        WHEN length(u) >= 4 AND len(list_filter(ts, lambda v: contains(v, u) OR (length(v) >= 4 AND contains(u, v)))) > 0 THEN 1.08e0 ELSE 1 END AS f FROM j)
    SELECT receipt_id, CAST(det_id AS BIGINT) AS det_id, text, {r('least(1.0e0, confidence * f)', 4)} AS confidence FROM k""",
    "items",
)
def join17_cross_verify(t):
    d, k = _detections(t), F.col("det_id")
    text = F.when(k % 4 == 0, F.concat("text", F.lit(" x"))).when(k % 7 == 0, F.concat("text", F.lit("zz"))).otherwise(F.col("text"))
    return layout.cross_verify(d.withColumn("text", text), d.where("det_id % 3 <> 0"))


@query()
def join18_pair_confusions(t):
    return matching.pair_confusions(learn.missing_codes(t.items, _detected(t)), learn.missing_codes(_detected(t), t.items))


@query(
    f"""WITH {_DTC}, o AS (SELECT receipt_id, pos, product_code AS old_code, quantity AS old_qty FROM items), c AS (SELECT receipt_id, pos, product_code AS new_code, quantity AS new_qty FROM dtc),
    k AS (SELECT *, CASE WHEN old_code IS NULL THEN 'missed' WHEN new_code IS NULL THEN 'dropped' WHEN upper(old_code) <> upper(new_code) THEN 'code' WHEN abs(old_qty - new_qty) > 0.01 THEN 'quantity' ELSE 'same' END AS kind FROM o FULL JOIN c USING (receipt_id, pos))
    SELECT receipt_id, pos, old_code, old_qty, new_code, new_qty, kind FROM k WHERE kind <> 'same'""",
    "items",
)
def join19_positional_diff(t):
    return learn.positional_diff(t.items, _detected(t))


@query(
    """WITH c AS (SELECT receipt_id, product_code FROM items WHERE pos <= 3 AND receipt_id % 4 > 0 AND pos <= receipt_id % 4), few AS (SELECT receipt_id FROM c GROUP BY receipt_id HAVING count(*) >= 2)
    SELECT receipt_id, product_code, 'cloud' AS origin FROM c UNION ALL SELECT receipt_id, product_code, 'parser' FROM items i WHERE receipt_id NOT IN (SELECT receipt_id FROM few) AND (receipt_id, product_code) NOT IN (SELECT receipt_id, product_code FROM c)""",
    "items",
)
def join20_supplement(t):
    p = t.items.select("receipt_id", "product_code")
    return matching.supplement(t.items.where("pos <= receipt_id % 4 AND receipt_id % 4 > 0 AND pos <= 3").select("receipt_id", "product_code"), p)


# ---- aggregations --------------------------------------------------------------------------------------------


@query("SELECT (SELECT count(*) FROM products WHERE is_active) AS products, (SELECT count(*) FROM receipts) AS receipts", "products", "receipts")
def agg1_counts(t):
    return t.products.agg(F.count_if("is_active").alias("products")).crossJoin(t.receipts.agg(F.count("*").alias("receipts")))


@query(f"SELECT product_code, {r('avg(quantity)', 1)} AS avg_qty, max(quantity) AS max_qty, min(quantity) AS min_qty, count(*) AS n FROM items GROUP BY product_code HAVING count(*) >= 2", "items")
def agg2_quantity_stats(t):
    return learn.quantity_stats(t.items)


_PAIRS = "pr AS (SELECT original_code, corrected_code, count(*) AS n FROM corrections WHERE original_code <> corrected_code GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT * FROM pr WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY original_code ORDER BY n DESC, corrected_code) = 1", "corrections")
def agg3_correction_map(t):
    return learn.correction_map(t.corrections)


@query("SELECT count(*) AS n_corrections, count(DISTINCT original_code || '->' || corrected_code) AS n_pairs FROM corrections WHERE original_code <> corrected_code", "corrections")
def agg4_correction_stats(t):
    return learn.correction_stats(t.corrections)


@query(f"WITH {_PAIRS} SELECT * FROM pr ORDER BY n DESC, original_code, corrected_code LIMIT 10", "corrections")
def agg4_top_corrections(t):
    return learn.top_corrections(t.corrections)


@query(_AUDIT, "receipts", "items")
def agg5_conditional_sums(t):
    return R.audit(t.receipts, t.stored_items)


@query(f"WITH a AS ({_AUDIT}) SELECT CASE WHEN CAST(scan_date AS VARCHAR) IN ('1997-05-28', '1998-10-03') THEN 'cloud' ELSE 'local' END AS cohort, count(*) AS n_receipts, {r('avg(avg_confidence)', 3)} AS mean_confidence, {r('100.0 * sum(n_high) / greatest(sum(n_items), 1)', 1)} AS high_pct FROM a WHERE n_items > 0 GROUP BY 1", "receipts", "items")
def agg6_cohorts(t):
    return R.cohorts(R.audit(t.receipts, t.stored_items), ["1997-05-28", "1998-10-03"])


@query(f"SELECT receipt_id, count(*) AS total_items, {r('avg(confidence)', 4)} AS avg_confidence, sum(quantity) AS total_quantity, {r('sum(line_total)', 2)} AS items_total FROM items GROUP BY receipt_id", "items")
def agg7_header_rollup(t):
    return R.header_rollup(t.stored_items).select("receipt_id", "total_items", half_up(F.col("avg_confidence"), 4).alias("avg_confidence"), "total_quantity", half_up(F.col("items_total"), 2).alias("items_total"))


@query(f"SELECT scan_date, count(*) AS n_receipts, {r('sum(bill_total)', 2)} AS amount FROM receipts GROUP BY scan_date", "receipts")
def agg9_daily_preview(t):
    return t.receipts.groupBy("scan_date").agg(F.count("*").alias("n_receipts"), half_up(F.sum("bill_total"), 2).alias("amount"))


@query("WITH d AS (SELECT id FROM receipts WHERE scan_date = DATE '1997-05-28') SELECT (SELECT count(*) FROM d) AS receipts_today, (SELECT count(*) FROM items WHERE receipt_id IN (SELECT id FROM d)) AS items_today, (SELECT coalesce(sum(quantity), 0.0) FROM items WHERE receipt_id IN (SELECT id FROM d)) AS quantity_today, (SELECT count(*) FROM products WHERE is_active) AS active_products", "receipts", "items", "products")
def agg10_dashboard(t):
    return R.dashboard(t.receipts, t.items, t.products, "1997-05-28")


_COST = "uc AS (SELECT *, pages * CASE model WHEN 'prebuilt-receipt' THEN 0.01 ELSE 0.0015 END AS cost FROM usage)"


@query(f"WITH {_COST} SELECT CAST(ts AS DATE) AS day, count(*) AS n_calls, CAST(sum(CASE WHEN model = 'prebuilt-receipt' THEN pages ELSE 0 END) AS BIGINT) AS receipt_pages, CAST(sum(CASE WHEN model = 'prebuilt-read' THEN pages ELSE 0 END) AS BIGINT) AS read_pages, {r('sum(cost)', 4)} AS cost FROM uc GROUP BY 1", "usage")
def agg11_daily_usage(t):
    return usage.daily(t.usage)


@query(f"WITH {_COST} SELECT strftime(ts, '%Y-%m') AS month, CAST(sum(pages) AS BIGINT) AS pages, CAST(least(sum(pages), 500) AS BIGINT) AS free, CAST(greatest(sum(pages) - 500, 0) AS BIGINT) AS paid, {r('100.0 * sum(pages) / 500', 1)} AS pct_free, {r('sum(cost)', 4)} AS cost FROM uc GROUP BY 1", "usage")
def agg11_monthly_usage(t):
    return usage.monthly(t.usage)


@query(f"SELECT count(*) FILTER (status = 'ok') AS hits, count(*) FILTER (status <> 'ok') AS misses, {r('100.0 * count(*) FILTER (status = ' + chr(39) + 'ok' + chr(39) + ') / count(*)', 1)} AS hit_rate FROM logs", "logs")
def agg12_hit_rate(t):
    return usage.hit_rate(t.logs.select((F.col("status") == "ok").alias("hit")), "hit")


@query(f"SELECT r.id, {r('coalesce(avg(i.confidence), 0.0)', 4)} AS mean_confidence FROM receipts r LEFT JOIN items i ON i.receipt_id = r.id GROUP BY r.id", "receipts", "items")
def agg13_mean_confidence(t):
    g = (i := t.stored_items).groupBy("receipt_id").agg(mean(i, "confidence").alias("c"))
    return t.receipts.join(g, F.col("id") == g["receipt_id"], "left").select("id", half_up(F.coalesce("c", F.lit(0.0)), 4).alias("mean_confidence"))


@query(
    f"""WITH g AS (SELECT receipt_id, product_code, min(pos) AS pos, count(*) AS n, sum(quantity) AS quantity, max(confidence) AS c, coalesce(min_by(unit_price, pos) FILTER (unit_price > 0), 0.0) AS u, sum(line_total) AS s FROM items GROUP BY ALL)
    SELECT receipt_id, product_code, pos, n, quantity, {r('c', 4)} AS confidence, {r('u', 4)} AS unit_price, {r('CASE WHEN n = 1 THEN s WHEN u > 0 THEN quantity * u ELSE s END', 2)} AS line_total, (n > 1) AS needs_review FROM g""",
    "items",
)
def agg14_merge_duplicates(t):
    return R.merge_duplicates(t.items)


@query(f"SELECT receipt_id, {r('sum(quantity)', 1)} AS total_quantity, {r('sum(line_total)', 2)} AS grand_total, bool_and(line_total <= 0 OR (unit_price = 0 AND line_total > 0) OR abs(line_total - {r('quantity * unit_price', 2)}) < greatest(0.01, {r('quantity * unit_price', 2)} * 0.005)) AS all_lines_ok, (count(*) FILTER (confidence < 0.5 OR quantity NOT BETWEEN 1 AND 100 OR receipt_id % 5 = 0) > 0 OR avg(confidence) < 0.85) AS needs_review FROM items GROUP BY receipt_id", "items")
def agg15_receipt_flags(t):
    return verify.receipt_flags(t.stored_items.withColumn("match_type", F.when(F.col("receipt_id") % 5 == 0, "fuzzy").otherwise("exact")))


@query("SELECT receipt_id, product_code, count(*) AS n FROM items GROUP BY ALL HAVING count(*) > 1", "items")
def agg16_repeated_codes(t):
    return t.items.groupBy("receipt_id", "product_code").agg(F.count("*").alias("n")).where("n > 1")


_REC = f"{_CMP}, rec AS (SELECT receipt_id, count(*) FILTER (status = 'matched') AS n_matched, count(*) FILTER (status = 'quantity') AS n_quantity, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'extra') AS n_extra, abs(coalesce(sum(expected), 0.0) - coalesce(sum(detected), 0.0)) <= 0.01 AS total_ok FROM cmp GROUP BY receipt_id)"


@query(f"WITH {_REC}, a AS (SELECT sum(n_matched) AS m, sum(n_quantity) AS q, sum(n_missing) AS mi, sum(n_extra) AS e, count(*) FILTER (total_ok) AS t, count(*) AS n FROM rec), p AS (SELECT *, (m + q) / (m + q + e) AS pr, (m + q) / (m + q + mi) AS rc FROM a) SELECT {r('pr', 4)} AS precision, {r('rc', 4)} AS recall, {r('2 * pr * rc / (pr + rc)', 4)} AS f1, {r('m / (m + q)', 4)} AS quantity_accuracy, {r('t / n', 4)} AS total_accuracy, n AS n_receipts FROM p", "items")
def agg18_accuracy(t):
    return learn.accuracy(learn.receipt_accuracy(learn.compare_items(t.items, _detected(t))))


@query(f"WITH {_REC} SELECT * FROM rec", "items")
def agg19_receipt_accuracy(t):
    return learn.receipt_accuracy(learn.compare_items(t.items, _detected(t)))


@query(f"WITH {_PAIRS} SELECT *, CAST(levenshtein(original_code, corrected_code) AS INTEGER) AS distance FROM pr ORDER BY n DESC, original_code, corrected_code LIMIT 50", "corrections")
def agg20_error_patterns(t):
    return learn.error_patterns(t.corrections)


_CHARS = "ch AS (SELECT original_code[i:i] AS ch_from, corrected_code[i:i] AS ch_to FROM corrections, range(1, 4) r(i) WHERE length(original_code) = length(corrected_code) AND i <= length(original_code))"


@query(f"WITH {_CHARS} SELECT ch_from, ch_to, count(*) AS n FROM ch WHERE ch_from <> ch_to GROUP BY ALL ORDER BY n DESC, ch_from, ch_to LIMIT 30", "corrections")
def agg21_confusion_matrix(t):
    return learn.confusion_matrix(learn.code_characters(t.corrections))


@query(
    f"""WITH {_CHARS}, g AS (SELECT ch_from, ch_to, count(*) AS n FROM ch WHERE ch_from <> ch_to GROUP BY ALL), h AS (SELECT *, sum(n) OVER (PARTITION BY ch_from) AS total, row_number() OVER (PARTITION BY ch_from ORDER BY n DESC, ch_to) AS k FROM g)
    SELECT ch_from, ch_to, n, CAST(total AS BIGINT) AS total, 'same_class' AS kind FROM h WHERE k = 1 AND total >= 2 AND n / total >= 0.3""",
    "corrections",
)
def agg22_promoted_rules(t):
    return learn.promote_rules(learn.code_characters(t.corrections).where("ch_from <> ch_to"), dominance=0.3)


@query(
    f"""WITH x AS (SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N'), u AS (SELECT 'n' AS metric, CAST(x.n AS DOUBLE) AS old, CAST(y.n AS DOUBLE) AS new FROM x, y UNION ALL SELECT 'q', x.q, y.q FROM x, y)
    SELECT metric, old, new, {r('new - old', 4)} AS delta, {r('100 * (new - old) / abs(old)', 1)} AS pct FROM u"""
)
def agg23_metric_deltas(t):
    f = lambda flag: t.raw("lineitem").where(F.col("l_returnflag") == flag).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return learn.metric_deltas(f("A"), f("N"), ["n", "q"])


@query(f"WITH s AS (SELECT n_nationkey AS k, CAST(n_regionkey AS DOUBLE) AS m FROM nation), l AS (SELECT m FROM s ORDER BY k DESC LIMIT 10) SELECT min_by(m, k) AS first, max_by(m, k) AS latest, (SELECT {r('avg(m)', 4)} FROM l) AS recent_mean, (SELECT count(*) FROM l) AS n_recent, {r('max_by(m, k) - min_by(m, k)', 4)} AS change FROM s")
def agg24_session_trend(t):
    return learn.session_trend(t.raw("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("double").alias("m")), "k", "m")


@query(
    f"""WITH p AS (SELECT receipt_id, min(y_center) AS y0, max(y_center) AS y1, count(*) AS n, avg(length(text)) AS len, count(*) FILTER (regexp_matches(text, '\\d+\\s+\\d+\\s+\\d+')) AS wide FROM lines GROUP BY receipt_id)
    SELECT CAST(median(y0) AS DOUBLE) AS item_start, CAST(median(y1) AS DOUBLE) AS item_end, {r('median(len)', 4)} AS line_chars, {r('avg(n)', 4)} AS mean_lines, (count(*) FILTER (wide > 0) * 2 > count(*)) AS structured, count(*) AS n_receipts FROM p""",
    "lines",
)
def agg25_layout_template(t):
    return learn.layout_template(t.lines)


@query("WITH g AS (SELECT a.r_regionkey AS a, b.n_nationkey AS b, row_number() OVER (ORDER BY a.r_regionkey, b.n_nationkey) - 1 AS k FROM region a, nation b) SELECT a, b FROM g WHERE k % 7 = 0")
def agg27_grid_sample(t):
    return learn.grid_sample([t.raw("region").select(F.col("r_regionkey").alias("a")), t.raw("nation").select(F.col("n_nationkey").alias("b"))], 7)


_FILES = "f AS (SELECT 'b' || (event_id % 97) AS batch_id, 'f' || (user_id % 10) AS file_id, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'pending' END AS status FROM events)"


def _files(t):
    e = F.col("event_type")
    s = F.when(e == "click", "done").when(e == "view", "processing").when(e == "error", "failed").when(e == "signup", "skipped").otherwise("pending")
    return t.raw("events").select(F.concat(F.lit("b"), F.col("event_id") % 97).alias("batch_id"), F.concat(F.lit("f"), F.col("user_id") % 10).alias("file_id"), "ts", F.col("event_id").alias("seq"), s.alias("status"))


@query(
    f"""WITH {_FILES}, l AS (SELECT batch_id, file_id, status FROM f QUALIFY row_number() OVER (PARTITION BY batch_id, file_id ORDER BY ts DESC, seq DESC) = 1)
    SELECT batch_id, count(*) AS n_files, count(*) FILTER (status = 'done') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, {r("100.0 * count(*) FILTER (status IN ('done', 'failed', 'skipped')) / count(*)", 1)} AS pct FROM l GROUP BY batch_id"""
)
def agg28_batch_progress(t):
    return metrics.progress(_files(t))


def _share(c: str) -> str:
    return r(f"100.0 * count(*) FILTER ({c}) / greatest(count(*), 1)", 1)


@query(f"SELECT {r('avg(value)', 4)} AS mean, {r('median(value)', 4)} AS median, min(value) AS least, max(value) AS most, {_share('value < 20')} AS fast_pct, {_share('value >= 20 AND value < 100')} AS medium_pct, {_share('value >= 100')} AS slow_pct FROM events")
def agg29_audit_metrics(t):
    return metrics.audit_metrics(t.raw("events"), "value")


@query(f"SELECT event_type, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER ()', 2)} AS pct FROM events GROUP BY event_type")
def agg29_distribution(t):
    return metrics.distribution(t.raw("events"), "event_type")


_HIST = "hist AS (SELECT event_type, b.le, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.value <= b.le) AS n FROM (SELECT DISTINCT event_type FROM events) t, (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in metrics.BUCKETS) + ") b(le) UNION ALL SELECT event_type, NULL, count(value) FROM events GROUP BY event_type)"


@query(f"WITH {_HIST} SELECT * FROM hist")
def agg30_histogram(t):
    return metrics.histogram(t.raw("events"), "value", ["event_type"])


@query("SELECT stage, status, count(*) AS n FROM logs GROUP BY ALL", "logs")
def agg30_counters(t):
    return metrics.counters(t.logs, ["stage", "status"])


@query(
    f"""WITH {_DTC}, w AS (SELECT receipt_id, product_code, max_by(quantity, pos) AS want FROM items GROUP BY ALL), g AS (SELECT receipt_id, product_code, max_by(quantity, pos) AS got FROM dtc GROUP BY ALL), j AS (SELECT * FROM w FULL JOIN g USING (receipt_id, product_code))
    SELECT receipt_id, count(want) AS n_expected, count(*) FILTER (want IS NOT NULL AND got IS NOT NULL) AS n_found, count(*) FILTER (want = got) AS n_exact, count(*) FILTER (want IS NULL) AS n_false, {r('100.0 * count(*) FILTER (want = got) / greatest(count(want), 1)', 1)} AS pct FROM j GROUP BY receipt_id""",
    "items",
)
def agg31_score_result(t):
    return learn.score_result(t.items, _detected(t))


@query(f"SELECT count(*) AS n, count(*) FILTER (status_code >= 500) AS errors, {r('avg(latency_ms)', 3)} AS mean_latency, {r('count(*) FILTER (status_code >= 500) / count(*)', 4)} AS error_rate FROM requests", "requests")
def agg33_lifetime(t):
    return metrics.lifetime(t.requests)


@query(f"SELECT stage, count(*) AS n, {r('avg(duration_ms)', 3)} AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM logs GROUP BY stage", "logs")
def agg34_stage_timing(t):
    return metrics.stage_timing(t.logs)


# ---- windows and orders --------------------------------------------------------------------------------------

_ISL = f"{_DET}, gp AS (SELECT *, y - lag(y) OVER w AS gap, greatest(15.0, (max(y) OVER p - min(y) OVER p) * 0.03) AS lim FROM det WINDOW w AS (PARTITION BY receipt_id ORDER BY y, x, det_id), p AS (PARTITION BY receipt_id)), isl AS (SELECT *, CAST(sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id ORDER BY y, x, det_id ROWS UNBOUNDED PRECEDING) + 1 AS INTEGER) AS line_no FROM gp)"


@query(f"WITH {_ISL} SELECT receipt_id, CAST(det_id AS BIGINT) AS det_id, line_no FROM isl", "items")
def win2_gap_lines(t):
    return layout.gap_lines(_detections(t)).select("receipt_id", "det_id", "line_no")


@query()
def win3_running_mean_lines(t):
    d = _detections(t)
    return layout.running_mean_lines(d, layout.line_threshold(d))


@query(
    f"""WITH {_DET}, g AS (SELECT *, lead(y) OVER (PARTITION BY receipt_id ORDER BY y, x, det_id) - y AS gap FROM det), a AS (SELECT receipt_id, max(y) AS my, count(*) AS n, list_sort(list(gap) FILTER (gap > 3)) AS gaps FROM g GROUP BY receipt_id),
    b AS (SELECT *, least(55.0, greatest(30.0, my * 0.025)) AS base, CASE WHEN n >= 6 AND coalesce(len(gaps), 0) > 0 THEN gaps[CAST(floor(len(gaps) / 2) AS INTEGER) + 1] END AS mid FROM a)
    SELECT receipt_id, {r('CASE WHEN mid < 1.8 * base AND greatest(12.0, mid * 0.7) < base THEN greatest(12.0, mid * 0.7) ELSE base END', 4)} AS threshold FROM b""",
    "items",
)
def win4_line_threshold(t):
    return layout.line_threshold(_detections(t))


_TW, _QW, _SP, _N = "(total|totai|tota1|t0tal|totd|toal|tdal|tetal)", "(qty|quantity|qtv|qly|qtyt|qiy|qtt)", "[ :=_.-]*", "([0-9]+[.]?[0-9]*)"
_STATED = [(f"{_TW}{_SP}{_QW}{_SP}{_N}", 3), (f"(grand|grramd|gramd|grrand){_SP}{_TW}{_SP}{_N}", 3), (f"sub{_SP}total{_SP}{_N}", 1), (f"{_TW}[ :=_-]+{_N}", 2), (f"sum[ :=_-]+{_N}", 1), (f"{_TW}.*?{_QW}.*?{_N} *$", 3), (f"(total|totai|tota1|t0tal|totd|sum) *(qty|quantity|qtv|qly)?{_SP}{_N}", 3)]


def _rank_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN {k}" for k, (p, _) in enumerate(_STATED)) + " END"


def _value_sql() -> str:
    one = lambda p, g: f"TRY_CAST(nullif(regexp_extract(text, '(?i){p}', {g}), '') AS DOUBLE)"
    return "coalesce(" + ", ".join(f"CASE WHEN {one(p, g)} > 0 AND {one(p, g)} <= 99999 THEN {one(p, g)} END" for p, g in _STATED) + ")"


@query(f"WITH c AS (SELECT receipt_id, line_no, CAST({_rank_sql()} AS INTEGER) AS rank, {_value_sql()} AS value FROM total_lines WHERE {_ANY_TOTAL}) SELECT receipt_id, line_no, rank, value FROM c WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY rank, line_no) = 1", "total_lines")
def win5_pick_total(t):
    return layout.pick_total(t.total_lines)


@query("WITH l AS (SELECT o_orderkey AS receipt_id, k AS line_no, CASE k WHEN 2 THEN 'Total' ELSE CASE WHEN (o_orderkey + k) % 3 = 0 THEN '' || (o_orderkey % 50 + k) ELSE 'x' END END AS text FROM orders, range(1, 4) r(k)), n AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]+$') THEN CAST(text AS DOUBLE) END AS v FROM l), w AS (SELECT *, coalesce(lead(v) OVER q, lag(v) OVER q) AS value FROM n WINDOW q AS (PARTITION BY receipt_id ORDER BY line_no)) SELECT receipt_id, CAST(line_no AS INTEGER) AS line_no, value FROM w WHERE text = 'Total' AND value IS NOT NULL")
def win6_neighbour_number(t):
    k, o = F.col("k"), F.col("o_orderkey")
    d = t.raw("orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    text = F.when(k == 2, "Total").when((o + k) % 3 == 0, (o % 50 + k).cast("string")).otherwise("x")
    return layout.neighbour_number(d.select(o.alias("receipt_id"), k.alias("line_no"), text.alias("text")))


@query()
def win7_merge_code_lines(t):
    k = F.col("pos") * 2
    d = t.items.select("receipt_id", F.explode(F.array(F.struct((k - 1).alias("line_no"), F.col("product_code").alias("text")), F.struct(k.alias("line_no"), F.col("quantity").cast("int").cast("string").alias("text")))).alias("z"))
    return layout.merge_code_lines(d.select("receipt_id", "z.line_no", F.regexp_replace("z.text", "^P", "PX").alias("text"), (F.col("z.line_no") * 20.0).alias("y_center")))


@query(
    f"""WITH w AS (SELECT seq, client_key, count(*) OVER f AS n, count(*) FILTER (status_code >= 500) OVER f AS e, list(latency_ms) OVER f AS l FROM requests WINDOW f AS (PARTITION BY client_key ORDER BY ts, seq ROWS 49 PRECEDING)),
    h AS (SELECT seq, client_key, n, e, list_sort(l)[CAST(least(floor(n * 0.95) + 1, n) AS INTEGER)] AS p95 FROM w)
    SELECT seq, client_key, n, {r('e / n', 4)} AS error_rate, p95, CASE WHEN n < 5 THEN 'healthy' WHEN e >= n * 0.3 OR p95 >= 25000 THEN 'critical' WHEN e >= n * 0.1 OR p95 >= 10000 THEN 'degraded' ELSE 'healthy' END AS state FROM h""",
    "requests",
)
def win8_rolling_health(t):
    return metrics.rolling_health(t.requests, "client_key")


@query()
def win9_reading_order(t):
    d = _detections(t)
    return layout.reading_order(d.unionByName(d.where("det_id % 3 = 0").withColumns({"det_id": F.col("det_id") + 100, "y": F.col("y") + 20})))


@query(
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(pages) AS pages FROM usage GROUP BY 1), b AS (SELECT day, pages, coalesce(sum(pages) OVER (PARTITION BY date_trunc('month', day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
    a AS (SELECT *, greatest(500 - before, 0) / (date_diff('day', day, last_day(day)) + 1) AS allowed FROM b)
    SELECT day, CAST(pages AS BIGINT) AS pages, CAST(before AS BIGINT) AS before, {r('allowed', 4)} AS allowed, CASE WHEN pages > 1.5 * allowed THEN 'critical' WHEN pages > 1.2 * allowed THEN 'fast' ELSE 'ok' END AS state FROM a""",
    "usage",
)
def win10_pacing(t):
    return usage.pacing(t.usage)


@query("SELECT receipt_id, min_by(trim(text), line_no) AS store_name FROM lines WHERE line_no <= 5 AND length(trim(text)) >= 4 AND regexp_matches(text, '[A-Za-z]{3}') AND len(regexp_extract_all(text, '[0-9]')) * 3 < length(text) AND NOT list_has_all(['item', 'code', 'qty', 'rate', 'amount', 'total', 'date', 'bill', 'no', 'receipt'], list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) GROUP BY receipt_id", "lines")
def win13_store_name(t):
    return layout.store_name(t.lines)


@query(
    """WITH c AS (SELECT receipt_id, line_no, text, CASE receipt_id % 4 WHEN 0 THEN strptime(text[7:], '%d/%m/%Y') WHEN 1 THEN strptime(text, '%Y-%m-%d') WHEN 2 THEN strptime(text[7:], '%d-%m-%Y') ELSE strptime(text[4:13], '%d.%m.%Y') END AS d FROM date_lines),
    e AS (SELECT receipt_id, line_no, d, (receipt_id % 2 = 0)::INTEGER * 12 + CASE WHEN receipt_id % 4 = 1 THEN 6 ELSE 12 END AS p FROM c UNION ALL SELECT receipt_id, 2, d + INTERVAL 1 DAY, 4 FROM c WHERE receipt_id % 3 = 0 UNION ALL SELECT receipt_id, 3, d + INTERVAL 2 DAYS, 12 + 3 FROM c WHERE receipt_id % 5 = 0)
    SELECT receipt_id, line_no, strftime(d, '%Y-%m-%d') AS date FROM e QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY p DESC, line_no) = 1""",
    "date_lines",
)
def win14_pick_date(t):
    d = t.date_lines.join(t.receipts.select(F.col("id").alias("receipt_id"), "created_at"), "receipt_id")
    named = d.where("receipt_id % 3 = 0").select("receipt_id", F.lit(2).alias("line_no"), F.date_format(F.date_add("created_at", 1), "d MMM yyyy").alias("text"))
    first = d.where("receipt_id % 5 = 0").select("receipt_id", F.lit(3).alias("line_no"), F.concat(F.lit("Dt. "), F.date_format(F.date_add("created_at", 2), "MMM d, yyyy")).alias("text"))
    return layout.pick_date(t.date_lines.unionByName(named).unionByName(first))


@query("SELECT id, receipt_number, created_at, bill_total FROM receipts ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50", "receipts")
def srt1_receipt_page(t):
    return R.page(t.receipts, 25, 50).select("id", "receipt_number", "created_at", "bill_total")


@query("SELECT id, bill_total FROM receipts ORDER BY bill_total DESC, id LIMIT 30", "receipts")
def srt2_by_amount(t):
    return R.sorted_receipts(t.receipts, "amount_desc", 30).select("id", "bill_total")


@query("SELECT product_code, product_name FROM products ORDER BY lower(product_name) DESC, product_code LIMIT 20 OFFSET 20", "products")
def srt3_catalog_by_name(t):
    return C.sorted_page(t.products, "product_name", True, page=2).select("product_code", "product_name")


@query()
def srt5_similar_codes(t):
    codes = t.raw("part").where("p_partkey % 20 = 7").select(F.concat(F.lit("P"), F.col("p_partkey"), F.lit("x")).alias("code"))
    return matching.best_similar(codes, t.products, n=2)


@query(f"WITH {_FILES} SELECT batch_id, max(ts) AS last FROM f GROUP BY batch_id ORDER BY last DESC, batch_id LIMIT 10")
def srt6_latest_batches(t):
    return _files(t).groupBy("batch_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "batch_id").limit(10)


@query(f"WITH {_ISL} SELECT receipt_id, line_no, string_agg(text, ' ' ORDER BY x, det_id) AS text, {r('avg(confidence)', 4)} AS confidence, {r('avg(y)', 2)} AS y_center FROM isl GROUP BY receipt_id, line_no", "items")
def srt8_join_fragments(t):
    return layout.join_fragments(layout.gap_lines(_detections(t)))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 11:00:00' ORDER BY ts DESC, event_id LIMIT 50")
def srt9_retention(t):
    return dedup.retain(t.raw("events").select("event_id", "ts"), "ts", "2024-01-20 12:00:00", 1, 50)


@query(f"WITH {_DTC} SELECT receipt_id, product_code FROM items INTERSECT SELECT receipt_id, product_code FROM dtc", "items")
def set2_common_codes(t):
    return learn.common_codes(t.items, _detected(t))


@query("SELECT original_code AS code FROM corrections UNION ALL SELECT corrected_code FROM corrections", "corrections")
def set3_union_sources(t):
    return t.corrections.select(F.col("original_code").alias("code")).union(t.corrections.select("corrected_code"))


@query("SELECT receipt_id, count(DISTINCT product_code) AS n_codes FROM items GROUP BY receipt_id", "items")
def set4_distinct_codes(t):
    return t.items.groupBy("receipt_id").agg(F.countDistinct("product_code").alias("n_codes"))


# ---- scalar functions ----------------------------------------------------------------------------------------

def _clean_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(regexp_replace({x}, '^\\s*[0-9]{{1,2}}\\s*[-.):–—]\\s*', ''), '{{}}[]&$#_=;', ''), '(?i)([0-9]+[.]?[0-9]*)\\s*(?:qty[.]?|qts[.]?|qt[.]?|quantity)', '\\1', 'g'), '\\s+', ' ', 'g'))"


_CLEAN = _clean_sql("text")
_NUMBERED = "['3 - ', ' 12) ', '{', '7', '#1. ', '& '][id % 6 + 1] || text || [' ;', ' 2.5 Qts.', ' 10quantity', '_'][id % 4 + 1]"


@query(f"SELECT id, {_clean_sql(_NUMBERED)} AS cleaned FROM noisy", "noisy")
def str1_clean(t):
    k = F.col("id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return t.noisy.select("id", X.clean(F.concat(pick("3 - ", " 12) ", "{", "7", "#1. ", "& "), "text", pick(" ;", " 2.5 Qts.", " 10quantity", "_"))).alias("cleaned"))


@query("SELECT product_code, upper(translate(product_code, '|1!06859()2473_', 'IIIOGBSGCJZATE')) AS letters FROM products", "products")
def str2_letters(t):
    return t.products.select("product_code", X.letters(F.col("product_code")).alias("letters"))


@query()
def str3_variants(t):
    d = t.products.where("product_code < 'P12'").select("product_code", M.variant_list("product_code").alias("v"))
    return d.select("product_code", F.posexplode("v").alias("rank", "variant"))


@query(f"WITH k AS (SELECT receipt_id, line_no, {_CLEAN} AS c FROM lines) SELECT receipt_id, line_no, upper(regexp_extract(c, '(?i)p[0-9]+')) AS code, CAST(CASE WHEN TRY_CAST(regexp_extract(c, '(?i)p[0-9]+[ x-]+([0-9]+)', 1) AS INTEGER) BETWEEN 1 AND 50 THEN TRY_CAST(regexp_extract(c, '(?i)p[0-9]+[ x-]+([0-9]+)', 1) AS INTEGER) ELSE 1 END AS DOUBLE) AS quantity FROM k", "lines")
def str4_parse_item(t):
    # a generated row, so that the fields don't repeat the parsing
    item = F.transform(F.array(X.clean(F.col("text"))), lambda c: X.parse_item(c, CATALOG_CODE))
    return t.lines.select("receipt_id", "line_no", F.inline_outer(item))


_PRICES = ("TEW1 3 250 750", "1 ABC 2 10.5 21", "PEPW4 3 @ 100 = 301", "ABC 2 x 10 20", "ABC 3 250 999", "ABC 0 10 10", "ABC 1000 1 1000", "ABC 2 0.5 1", "abc 1.26 100 126", "A 3 250 750", "MNO 2 10 30 MNO 2x10=20", "ABC 5 10", "see TEW1 3 250.00 750.00 there")


def _priced_sql(p: str) -> str:
    g = lambda k: f"TRY_CAST(regexp_extract(text, '{p}', {k}) AS DOUBLE)"
    return f"SELECT id, upper(regexp_extract(text, '{p}', 1)) AS code, {g(2)} AS q, {g(3)} AS rate, {g(4)} AS amount FROM z WHERE regexp_matches(text, '{p}')"


_C7 = "([a-z]{2,4}[a-z0-9]{1,3}|[a-z]{3,6})"


@query(
    f"""WITH z AS (SELECT p_partkey AS id, [{', '.join(repr(x) for x in _PRICES)}][p_partkey % {len(_PRICES)} + 1] AS text FROM part), a AS (SELECT 1 AS form, * FROM ({_priced_sql(f'(?i){_C7} +{_N} +{_N} +{_N}')}) UNION ALL SELECT 2, * FROM ({_priced_sql(f'(?i){_C7} +{_N} *[@x×] *{_N} *=? *{_N}')}))
    SELECT id, code, round_even(q, 1) AS quantity, rate, amount FROM a WHERE q >= 1 AND q <= 999 AND rate >= 1 AND amount >= 1 AND abs(amount - q * rate) < 0.15e0 * greatest(q * rate, 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY form) = 1"""
)
def str5_parse_priced(t):
    k = F.col("p_partkey")
    d = t.raw("part").select(k.alias("id"), X.parse_priced(F.element_at(F.array(*[F.lit(x) for x in _PRICES]), (k % len(_PRICES) + 1).cast("int"))).alias("p")).where("p IS NOT NULL")
    return d.select("id", "p.*")


@query("SELECT receipt_id, pos, round_even(a / p, 0) AS quantity FROM (SELECT receipt_id, pos, CASE WHEN pos % 4 = 0 THEN unit_price / 200 ELSE unit_price END AS p, line_total + pos % 3 * unit_price * 0.03e0 AS a FROM items) i WHERE p >= 10 AND a >= p AND a / p <= 999 AND abs(a / p - round_even(a / p, 0)) < 0.05e0", "items")
def str6_infer_quantity(t):
    p = F.when(F.col("pos") % 4 == 0, F.col("unit_price") / 200).otherwise(F.col("unit_price"))
    a = F.col("line_total") + F.col("pos") % 3 * F.col("unit_price") * 0.03
    return t.items.select("receipt_id", "pos", X.infer_quantity(p, a).alias("quantity")).where("quantity IS NOT NULL")


@query("""WITH z AS (SELECT p_partkey AS id, ['ABC 3 ', 'TEW10 ', 'x ', '3 '][p_partkey % 4 + 1] AS head, (p_partkey % 90 + 10) || ' 0 ' || (p_partkey % 50 + 10) || ' 00 ' || (p_partkey % 7) AS tail FROM part),
    o AS (SELECT id, head, CASE WHEN head[1] IN ('A', 'T') THEN regexp_replace(regexp_replace(tail, '([0-9]{2,}) ([0-9]{1,2})( |$)', '\\1\\2\\3', 'g'), '([0-9]{2,}) ([0-9]{1,2})( |$)', '\\1\\2\\3', 'g') ELSE tail END AS tail FROM z) SELECT id, head || tail AS t FROM o""")
def str7_glue_numbers(t):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*[F.lit(x) for x in ("ABC 3 ", "TEW10 ", "x ", "3 ")]), (k % 4 + 1).cast("int"))
    return t.raw("part").select(k.alias("id"), X.glue_numbers(F.concat(head, k % 90 + 10, F.lit(" 0 "), k % 50 + 10, F.lit(" 00 "), k % 7)).alias("t"))


_NUM = "CASE WHEN n BETWEEN 1 AND 99 THEN n WHEN n BETWEEN 100 AND 999 THEN coalesce(nullif(CAST(d[1:2] AS INTEGER), 0), nullif(CAST(d[1:3] AS INTEGER), 0), nullif(CAST(d[1:4] AS INTEGER), 0)) END"


@query(f"WITH z AS (SELECT p_partkey AS id, translate([''  , '0', '00', '_', 'x', 'I'][p_partkey % 6 + 1] || p_partkey || ['', 'f', '.1'][p_partkey % 3 + 1], '1057', 'lOSI') AS tok FROM part), d AS (SELECT id, tok, replace(replace(replace(tok, '.', ''), ',', ''), '_', '') AS w FROM z), e AS (SELECT *, regexp_extract(replace(replace(replace(w, 'l', '1'), 'I', '1'), 'O', '0'), '^[0-9]*') AS d FROM d), f AS (SELECT *, CASE WHEN length(w) <= 6 AND d <> '' THEN CAST(d AS INTEGER) END AS n FROM e) SELECT id, tok, {_NUM} AS q FROM f")
def str12_decode_quantity(t):
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    tok = F.translate(F.concat(pick(("", "0", "00", "_", "x", "I")), k.cast("string"), pick(("", "f", ".1"))), "1057", "lOSI")
    return t.raw("part").select(k.alias("id"), tok.alias("tok"), X.decode_quantity(tok).alias("q"))


@query("""WITH n AS (SELECT id, text, regexp_extract(text, '^\\s*([0-9]{1,2})', 1) AS lead, regexp_replace(text, '^\\s*[0-9]{1,2}\\s*[-.):–—]?\\s*', '') AS rest FROM noisy)
    SELECT id, CASE WHEN lead = '' OR CAST(lead AS INTEGER) = 0 THEN 1.0 WHEN regexp_matches(rest, '[-–—]\\s*[0-9]') THEN CAST(regexp_extract(rest, '[-–—]\\s*([0-9]{1,3})', 1) AS DOUBLE) WHEN regexp_matches(rest, '[A-Za-z][A-Za-z]') THEN 1.0 ELSE CAST(lead AS DOUBLE) END AS n FROM n""", "noisy")
def str14_stripped_number(t):
    return t.noisy.select("id", X.stripped_number(F.col("text")).alias("n"))


@query("SELECT id AS receipt_id, 1 AS line_no, CAST(i - 1 AS INTEGER) AS part, string_split('A' || id || '| |' || text || '|B', '|')[i] AS text FROM noisy, range(1, 5) r(i) WHERE trim(string_split('A' || id || '| |' || text || '|B', '|')[i]) <> ''", "noisy")
def str16_pipe_split(t):
    d = t.noisy.select(F.col("id").alias("receipt_id"), F.lit(1).alias("line_no"), F.concat(F.lit("A"), "id", F.lit("| |"), "text", F.lit("|B")).alias("text"))
    return matching.pipe_parts(d)


_SAYS = ("Total Qty: 11", "Total = 9.5", "Sub-Total 7", "gramd total 25", "Sum_4", "Sum = 4", "Total 0", "Total Qty_ Total Qty_ 24", "Toal 3", "Totalqty12", "TOTAL 100000", "tota1 items 5", "nothing 3", "Grand Total")


@query(f"WITH z AS (SELECT p_partkey AS id, [{', '.join(repr(x) for x in _SAYS)}][p_partkey % {len(_SAYS)} + 1] AS text FROM part) SELECT id, {_value_sql()} AS value FROM z")
def str17_total_value(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("id"), X.total_value(F.element_at(F.array(*[F.lit(x) for x in _SAYS]), (k % len(_SAYS) + 1).cast("int"))).alias("value"))


_GRANDS = ("Grand Total: 12.5", "Gramd-Total 7", "Total Amount 99", "Bill Total 0", "Net Total = 8", "Grand Total", "Total 5", "total amt. 3")
_GT = f"CASE WHEN regexp_matches(text, '(?i)(grand|gramd|grramd|grrand|bill|net){_SP}{_TW}{_SP}[0-9]') THEN CAST(regexp_extract(text, '(?i)(grand|gramd|grramd|grrand|bill|net){_SP}{_TW}{_SP}{_N}', 3) AS DOUBLE) WHEN regexp_matches(text, '(?i){_TW}{_SP}(amount|amt){_SP}[0-9]') THEN CAST(regexp_extract(text, '(?i){_TW}{_SP}(amount|amt){_SP}{_N}', 3) AS DOUBLE) END"


@query(
    f"""WITH z AS (SELECT p_partkey AS receipt_id, i AS line_no, CASE i WHEN 1 THEN [{', '.join(repr(x) for x in _GRANDS)}][p_partkey % 8 + 1] WHEN 2 THEN ['44', 'x', '0'][p_partkey % 3 + 1] ELSE [{', '.join(repr(x) for x in _GRANDS)}][p_partkey % 7 + 1] END AS text, i / 10.0e0 AS confidence FROM part, range(1, 4) r(i)),
    g AS (SELECT *, {_GT} AS own, lead(text) OVER w AS nt, lead(confidence) OVER w AS nc FROM z WINDOW w AS (PARTITION BY receipt_id ORDER BY line_no)),
    h AS (SELECT receipt_id, line_no, CASE WHEN own > 0 THEN own WHEN regexp_full_match(nt, '[0-9]+') AND CAST(nt AS DOUBLE) > 0 THEN CAST(nt AS DOUBLE) END AS value, CASE WHEN own > 0 THEN confidence ELSE least(confidence, nc) END AS confidence FROM g WHERE {_MONEY})
    SELECT receipt_id, CAST(line_no AS INTEGER) AS line_no, value, confidence FROM h WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY line_no DESC) = 1"""
)
def str18_grand_total(t):
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    rows = F.array(*[F.struct(F.lit(i).alias("line_no"), text.alias("text"), F.lit(i / 10).alias("confidence")) for i, text in ((1, pick(_GRANDS, 8)), (2, pick(("44", "x", "0"), 3)), (3, pick(_GRANDS, 7)))])
    return layout.grand_totals(t.raw("part").select(k.alias("receipt_id"), F.inline(rows)))


@query("SELECT DISTINCT length(product_code) AS n, CASE WHEN length(product_code) <= 3 THEN 0.88 WHEN length(product_code) <= 4 THEN 0.82 WHEN length(product_code) <= 6 THEN 0.72 ELSE 0.65 END::DOUBLE AS cutoff FROM products", "products")
def str21_cutoffs(t):
    return t.products.select(F.length("product_code").cast("long").alias("n"), X.adaptive_cutoff(F.length("product_code")).alias("cutoff")).distinct()


@query("SELECT DISTINCT original_code, corrected_code, CAST(levenshtein(original_code, corrected_code) AS INTEGER) AS distance FROM corrections", "corrections")
def str22_levenshtein(t):
    return t.corrections.select("original_code", "corrected_code", F.levenshtein("original_code", "corrected_code").alias("distance")).distinct()


@query()
def str23_alignment(t):
    p = t.corrections.select("original_code", "corrected_code").distinct()
    return p.select("original_code", "corrected_code", F.explode(M.alignment("original_code", "corrected_code")).alias("z")).select("original_code", "corrected_code", "z.a", "z.b")


@query(f"WITH c AS (SELECT DISTINCT original_code AS a, corrected_code AS b FROM corrections), s AS (SELECT a, b, list_sum(list_transform(range(1, 4), lambda i: CASE WHEN i <= length(a) AND i <= length(b) AND a[i:i] = b[i:i] THEN 1 ELSE 0 END)) / greatest(length(a), length(b)) AS o FROM c) SELECT a, b, {r('CASE WHEN contains(a, b) OR contains(b, a) THEN greatest(o, 0.7) ELSE o END', 4)} AS overlap FROM s", "corrections")
def str24_positional_overlap(t):
    p = t.corrections.select(F.col("original_code").alias("a"), F.col("corrected_code").alias("b")).distinct()
    return p.select("a", "b", half_up(X.positional_overlap(F.col("a"), F.col("b")), 4).alias("overlap"))


@query("SELECT receipt_id, left(sha256(string_agg(upper(product_code) || ':' || printf('%.1f', quantity), '|' ORDER BY upper(product_code) || ':' || printf('%.1f', quantity))), 32) AS fingerprint FROM items GROUP BY receipt_id", "items")
def str28_fingerprint(t):
    return H.content_fingerprint(t.items)


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def str29_sha256(t):
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT id, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '') AS bits FROM (SELECT id, unnest(list_transform(pixels, lambda x: x > list_avg(pixels))) AS b FROM hashes) GROUP BY id", "hashes")
def str30_average_hash(t):
    return _hashes(t).select("id", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


@query("SELECT id, regexp_replace(receipt_number, '[\\x00-\\x08]', '', 'g') AS t FROM receipts", "receipts")
def str32_clean_xml(t):
    return t.receipts.select("id", R.clean_text(F.concat("receipt_number", F.lit("\x01"))).alias("t"))


@query(f"WITH {_PAIRS}, m AS (SELECT original_code, corrected_code FROM pr WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY original_code ORDER BY n DESC, corrected_code) = 1) SELECT c.receipt_id, coalesce(m.corrected_code, c.original_code) AS product_code FROM corrections c LEFT JOIN m USING (original_code)", "corrections")
def str33_apply_corrections(t):
    return learn.apply_corrections(t.corrections.select("receipt_id", F.col("original_code").alias("product_code")), learn.correction_map(t.corrections))


@query("SELECT receipt_id, CASE receipt_id % 4 WHEN 0 THEN strftime(strptime(text[7:], '%d/%m/%Y'), '%Y-%m-%d') WHEN 1 THEN text WHEN 2 THEN strftime(strptime(text[7:], '%d-%m-%Y'), '%Y-%m-%d') ELSE strftime(strptime(text[4:13], '%d.%m.%Y'), '%Y-%m-%d') END AS date FROM date_lines", "date_lines")
def dat1_find_date(t):
    return t.date_lines.select("receipt_id", D.find_date(F.col("text")).alias("date"))


@query("SELECT id, strftime(scan_date, '%Y%m%d') AS d, strftime(scan_date, '%-d-%b-%Y') AS shown, CAST(date_diff('day', scan_date, last_day(scan_date)) + 1 AS INTEGER) AS days_left, strftime(scan_date, '%Y-%m') AS month FROM receipts", "receipts")
def dat2_calendar(t):
    d = F.col("scan_date")
    return t.receipts.select("id", D.ledger_date(d.cast("string"), "2024-01-01").alias("d"), F.date_format(d, "d-MMM-yyyy").alias("shown"), D.days_left(d).alias("days_left"), F.date_format(d, "yyyy-MM").alias("month"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey * 997 >= 86400 THEN p_partkey * 997 // 86400 || 'd ' || p_partkey * 997 % 86400 // 3600 || 'h ' || p_partkey * 997 % 3600 // 60 || 'm' WHEN p_partkey * 997 >= 3600 THEN p_partkey * 997 // 3600 || 'h ' || p_partkey * 997 % 3600 // 60 || 'm' ELSE p_partkey * 997 // 60 || 'm ' || p_partkey * 997 % 60 || 's' END AS t FROM part")
def dat7_uptime(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), D.uptime(F.col("p_partkey") * 997).alias("t"))


@query(f"SELECT receipt_id, pos, CASE WHEN p = 0 AND a > 0 THEN 'trusted' WHEN a <= 0 THEN 'ok' WHEN abs({r('quantity * p', 2)} - a) < greatest(0.01, {r('quantity * p', 2)} * 0.005) THEN 'ok' ELSE 'mismatch' END AS parser, abs({r('quantity * p', 2)} - {r('a', 2)}) <= 0.01 + 1e-9 AS verifier, abs(quantity * p - a) <= greatest(1.0, quantity * p * 0.01) AS validator FROM (SELECT *, CASE WHEN receipt_id % 4 = 0 THEN 0 ELSE unit_price END AS p, CASE WHEN receipt_id % 6 = 0 THEN 0 ELSE line_total + pos % 3 END AS a FROM items) i WHERE pos % 3 <> 1", "items")
def mth1_line_checks(t):
    a = F.when(F.col("receipt_id") % 6 == 0, 0.0).otherwise(F.col("line_total") + F.col("pos") % 3)
    q, p = F.col("quantity"), F.when(F.col("receipt_id") % 4 == 0, 0.0).otherwise(F.col("unit_price"))
    return t.items.where("pos % 3 <> 1").select("receipt_id", "pos", verify.line_check_parser(q, p, a).alias("parser"), verify.line_check_verifier(q, p, a).alias("verifier"), verify.line_check_validator(q, p, a).alias("validator"))


@query(f"SELECT i.receipt_id, count(*) AS n_lines, count(*) FILTER (abs({r('i.quantity * i.unit_price', 2)} - {r('i.line_total', 2)}) <= 0.01 + 1e-9) AS n_ok, count(*) FILTER (abs(i.unit_price - p.unit_price) < 0.01) AS n_price_match, {r('sum(i.line_total)', 2)} AS grand_total, bool_and(abs({r('i.quantity * i.unit_price', 2)} - {r('i.line_total', 2)}) <= 0.01 + 1e-9) AS all_ok FROM items i LEFT JOIN products p USING (product_code) GROUP BY i.receipt_id", "items", "products")
def mth2_verify_math(t):
    return verify.verify_math(t.items, t.products)


def _totals(t):
    c = (i := t.stored_items).groupBy("receipt_id").agg(F.sum("quantity").alias("computed"), mean(i, "confidence").alias("item_conf"))
    k = F.col("receipt_id")
    s = c.select("receipt_id", F.when(k % 5 != 0, F.col("computed") + F.element_at(F.array(*[F.lit(float(x)) for x in (0, 0, 1, 9)]), (k % 4 + 1).cast("int"))).alias("total"), (F.lit(0.8) + (k % 3) * 0.07).alias("total_conf"), F.when(k % 6 == 0, F.col("computed")).alias("cloud_total"))
    return c, s


@query(
    f"""WITH c AS (SELECT receipt_id, sum(quantity) AS computed, avg(confidence) AS ic FROM items GROUP BY receipt_id), s AS (SELECT *, CASE WHEN receipt_id % 5 <> 0 THEN computed + [0.0, 0.0, 1.0, 9.0][receipt_id % 4 + 1] END AS total, 0.8 + (receipt_id % 3) * 0.07 AS tc, CASE WHEN receipt_id % 6 = 0 THEN computed END AS cloud FROM c),
    m AS (SELECT *, CASE WHEN total IS NULL THEN 'no_total' WHEN abs(total - computed) <= 0.01 THEN 'exact' WHEN abs(cloud - computed) <= 0.01 THEN 'cloud_computed' WHEN abs(cloud - total) <= 0.01 THEN 'cloud_stated' WHEN ic >= 0.85 AND tc < 0.85 THEN 'items_trusted' WHEN tc >= 0.90 AND ic < 0.80 THEN 'total_trusted' WHEN abs(total - computed) <= 2 THEN 'small_gap' ELSE 'unresolved' END AS method FROM s)
    SELECT receipt_id, method, method IN ('exact', 'cloud_computed', 'cloud_stated', 'items_trusted', 'total_trusted') AS verified, {r("CASE method WHEN 'exact' THEN least(0.99, CASE WHEN tc > 0 THEN tc ELSE 0.9 END) WHEN 'cloud_computed' THEN 0.95 WHEN 'cloud_stated' THEN 0.85 WHEN 'items_trusted' THEN ic * 0.9 WHEN 'total_trusted' THEN tc * 0.85 WHEN 'small_gap' THEN greatest(ic, tc) * 0.7 ELSE 0.3 END", 4)} AS confidence,
    {r("CASE WHEN method IN ('cloud_stated', 'total_trusted') THEN total ELSE computed END", 2)} AS trusted_total FROM m""",
    "items",
)
def mth4_verify_totals(t):
    return verify.verify_totals(*_totals(t))


_VALIDATE = f"""src AS (SELECT receipt_id, pos, product_code, CASE WHEN receipt_id % 11 = 0 THEN 0 ELSE quantity * CASE WHEN receipt_id % 13 = 0 THEN 4 ELSE 1 END END AS q, CASE WHEN receipt_id % 3 = 0 THEN 0 ELSE unit_price * CASE WHEN pos % 5 = 0 THEN 9 ELSE 1 END END AS p, line_total FROM items),
    h AS (SELECT product_code, {r('avg(quantity)', 1)} AS av, max(quantity) AS mx FROM items GROUP BY product_code HAVING count(*) > 1),
    m AS (SELECT s.*, c.unit_price AS cat, av, mx, count(*) OVER (PARTITION BY receipt_id, s.product_code) AS k, row_number() OVER (PARTITION BY receipt_id, s.product_code ORDER BY pos) AS nth FROM src s LEFT JOIN products c USING (product_code) LEFT JOIN h USING (product_code)),
    w AS (SELECT *, q <= 0 AS zero, q > 45 AND p = 0 AS big, p > 0 AND cat > 0 AND (p / cat > 5 OR p / cat < 0.2e0) AS off, p > 0 AND line_total > 0 AND abs(q * p - line_total) > greatest(1, q * p * 0.01e0) AS bad, k > 1 AND nth = 1 AS twice, coalesce(av > 0 AND mx > 0 AND q > 3 * mx, false) AS odd, p = 0 AND coalesce(cat, 0) > 0 AS fill, CASE WHEN q <= 0 THEN 1 ELSE q END AS fq FROM m),
    v AS (SELECT receipt_id, pos, product_code, CAST(fq AS DOUBLE) AS quantity, {r('CASE WHEN fill THEN cat ELSE p END', 4)} AS unit_price, {r('CASE WHEN fill THEN fq * cat ELSE line_total END', 2)} AS line_total,
        concat_ws(',', CASE WHEN zero THEN 'high:zero_quantity' END, CASE WHEN big THEN 'medium:suspicious_quantity' END, CASE WHEN off THEN 'medium:price_deviation' END, CASE WHEN bad THEN 'medium:line_total_mismatch' END, CASE WHEN twice THEN 'low:duplicate_item' END, CASE WHEN odd THEN 'medium:quantity_anomaly' END) AS warnings, zero OR big OR off OR bad OR odd AS needs_review FROM w)"""


def _to_validate(t):
    k = F.col("receipt_id")
    q = F.when(k % 11 == 0, 0.0).otherwise(F.col("quantity") * F.when(k % 13 == 0, 4).otherwise(1))
    p = F.when(k % 3 == 0, 0.0).otherwise(F.col("unit_price") * F.when(F.col("pos") % 5 == 0, 9).otherwise(1))
    return verify.validate(t.items.withColumns({"quantity": q, "unit_price": p}), t.products, learn.quantity_stats(t.items), max_reasonable=45.0)


@query(f"WITH {_VALIDATE} SELECT * FROM v", "items", "products")
def mth6_validate(t):
    return _to_validate(t)


@query(f"WITH {_VALIDATE}, e AS (SELECT receipt_id, unnest(CASE WHEN warnings = '' THEN ['none:'] ELSE string_split(warnings, ',') END) AS x FROM v) SELECT receipt_id, count(*) FILTER (x LIKE 'high:%') AS n_high, count(*) FILTER (x LIKE 'medium:%') AS n_medium, count(*) FILTER (x LIKE 'low:%') AS n_low, count(*) FILTER (x LIKE 'high:%') = 0 AS valid FROM e GROUP BY receipt_id", "items", "products")
def mth6_warning_summary(t):
    return verify.warning_summary(_to_validate(t))


@query(
    f"""WITH q AS (SELECT receipt_id, avg(confidence) AS c, count(*) AS n FROM items GROUP BY receipt_id), f AS (SELECT *, ['verified', 'mismatch', 'none'][receipt_id % 3 + 1] AS ts, ['ok', 'bad', 'none'][receipt_id % 4 % 3 + 1] AS ms, CASE WHEN receipt_id % 5 > 0 THEN CAST(receipt_id % 130 AS DOUBLE) END AS s, CAST(receipt_id % 250 AS DOUBLE) AS b, (receipt_id % 11) / 10.0 AS cr FROM q),
    g AS (SELECT receipt_id, {r("greatest(0.0, least(100.0, CASE WHEN c <= 0 THEN 0.0 ELSE greatest(0.0, least(30.0, (c - 0.5) * 60)) END + CASE WHEN n <= 0 THEN 0.0 WHEN n = 1 THEN 10.0 WHEN n = 2 THEN 15.0 ELSE 20.0 END + CASE ts WHEN 'verified' THEN 15.0 WHEN 'mismatch' THEN 5.0 ELSE 0.0 END + CASE ms WHEN 'ok' THEN 15.0 WHEN 'bad' THEN 8.0 ELSE 7.0 END + CASE WHEN s IS NULL THEN 5.0 ELSE CASE WHEN s > 100 THEN 5.0 WHEN s > 50 THEN 3.0 WHEN s > 20 THEN 1.0 ELSE 0.0 END + CASE WHEN b BETWEEN 60 AND 200 THEN 5.0 WHEN b BETWEEN 40 AND 220 THEN 3.0 ELSE 1.0 END END + " + r("10 * cr", 1) + "))", 1)} AS score FROM f)
    SELECT receipt_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM g""",
    "items",
)
def mth7_quality_score(t):
    g = (i := t.stored_items).groupBy("receipt_id").agg(mean(i, "confidence").alias("avg_confidence"), F.count("*").alias("n_items"))
    k = F.col("receipt_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    d = g.select("*", pick(("verified", "mismatch", "none"), k % 3).alias("total_status"), pick(("ok", "bad", "none"), k % 4 % 3).alias("math_status"), F.when(k % 5 > 0, (k % 130).cast("double")).alias("sharpness"), (k % 250).cast("double").alias("brightness"), ((k % 11) / 10.0).alias("catalog_rate"))
    return verify.quality_score(d).select("receipt_id", "score", "grade")


@query("SELECT receipt_id, pos, CASE WHEN q > 0 AND q <= 40 AND (q <= 20 OR pos % 2 = 1) THEN q ELSE 1.0 END::DOUBLE AS quantity, NOT (q > 0 AND q <= 20) AS needs_review FROM (SELECT *, CASE WHEN receipt_id % 9 = 0 THEN 0 ELSE quantity END AS q FROM items) i", "items")
def mth8_sane_quantity(t):
    q = F.when(F.col("receipt_id") % 9 == 0, 0.0).otherwise(F.col("quantity"))
    return t.items.select("receipt_id", "pos", verify.sane_quantity(q, F.when(F.col("pos") % 2 == 1, F.col("unit_price")), 20.0, 40.0).alias("quantity"), verify.odd_quantity(q, 20.0).alias("needs_review"))


@query(
    f"""WITH x AS (SELECT id, CASE id % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'IIII' || id WHEN 2 THEN '1234567' WHEN 3 THEN '[[x' WHEN 4 THEN upper(text) || '|' WHEN 5 THEN left(text, 2) ELSE text END AS text, 0.3e0 + (id % 7) * 0.1e0 AS raw FROM noisy),
    m AS (SELECT id, raw, s, length(s) AS n, len(list_filter(cs, lambda c: contains('|![]{{}}()_=;$&#@~`', c))) / greatest(length(s), 1) AS noise, len(list_distinct(list_transform(cs, lambda c: lower(c)))) / greatest(length(s), 1) AS kinds, len(list_filter(cs, lambda c: c BETWEEN '0' AND '9')) AS dg, len(list_filter(cs, lambda c: lower(c) <> upper(c))) AS al,
    len(list_filter(cs, lambda c: NOT (c BETWEEN '0' AND '9' OR lower(c) <> upper(c) OR c = ' '))) AS sy FROM (SELECT *, string_split(trim(text), '') AS cs, trim(text) AS s FROM x) y),
    p AS (SELECT *, raw * CASE n WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.8e0 ELSE 1 END * CASE WHEN noise > 0.3e0 THEN 0.65e0 WHEN noise > 0.15e0 THEN 0.8e0 ELSE 1 END * CASE WHEN n > 2 AND kinds < 0.35e0 THEN 0.7e0 ELSE 1 END * CASE WHEN dg > 5 AND al = 0 THEN 0.75e0 ELSE 1 END * CASE WHEN sy > 1 AND n < 7 THEN 0.75e0 ELSE 1 END AS c FROM m)
    SELECT id, CASE WHEN n = 0 THEN 0 ELSE {r('least(raw, CASE WHEN n BETWEEN 3 AND 7 AND dg + al = n THEN c * 1.05e0 ELSE c END)', 4)} END AS calibrated FROM p""",
    "noisy",
)
def str27_calibrate(t):
    k = F.col("id")
    text = F.when(k % 8 == 0, " ").when(k % 8 == 1, F.concat(F.lit("IIII"), k)).when(k % 8 == 2, "1234567").when(k % 8 == 3, "[[x").when(k % 8 == 4, F.concat(F.upper("text"), F.lit("|"))).when(k % 8 == 5, F.substring("text", 1, 2)).otherwise(F.col("text"))
    return t.noisy.select("id", verify.calibrate(text, F.lit(0.3) + (k % 7) * 0.1).alias("calibrated"))


@query("SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey < 1000 GROUP BY o_orderkey")
def arr1_nest_flatten(t):
    n = R.nest(t.receipts.where("id < 1000"), t.items)
    flat = R.flatten(n.select("id", "items"), keep_empty=True)
    return flat.groupBy("id").agg(F.count("product_code").alias("n"))


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part")
def arr6_json_round_trip(t):
    s = "id long, name string, price double"
    j = t.raw("part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))).alias("j"))
    return j.select(F.from_json("j", s).alias("x")).select("x.*")


@query("SELECT event_type, mode AS top FROM (SELECT event_type, floor(value / 10) AS mode, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, mode) = 1")
def arr3_most_common(t):
    g = t.raw("events").groupBy("event_type", F.floor(F.col("value") / 10).cast("double").alias("top")).agg(F.count("*").alias("n"))
    return g.groupBy("event_type").agg(F.max_by("top", F.struct("n", -F.col("top"))).alias("top"))


# ---- streams in batch form -----------------------------------------------------------------------------------


@query()
def stm1_rate_limit(t):
    return stateful.rate_limit_batch(t.requests.withColumn("client_key", F.concat(F.lit("ip"), F.col("seq") % 20)), 3, 3600.0)


@query(f"SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, stage, count(*) AS n, {r('count(*) / 300.0', 6)} AS per_second FROM logs GROUP BY ALL", "logs")
def stm3_window_rates(t):
    return metrics.window_rates(t.logs, "ts", ["stage"])


_RATIO = f"rt AS (SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS window_start, count(*) AS n, count(*) FILTER (status = 'failed') AS k, {r('count(*) FILTER (status = ' + chr(39) + 'failed' + chr(39) + ') / count(*)', 6)} AS ratio FROM logs GROUP BY 1)"


@query(f"WITH {_RATIO}, w AS (SELECT *, row_number() OVER (ORDER BY window_start) AS i FROM rt), g AS (SELECT *, i - row_number() OVER (ORDER BY window_start) AS grp FROM w WHERE ratio > 0.15) SELECT min(window_start) AS since, max(window_start) AS until, count(*) AS n_windows FROM g GROUP BY grp HAVING count(*) >= 3", "logs")
def stm3_held_alerts(t):
    return metrics.held_alerts(metrics.window_ratio(t.logs, "ts", F.col("status") == "failed", 60), 0.15, 3)


@query(f"WITH {_HIST}, c AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) AS total FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le NULLS LAST)) SELECT event_type, {r('CASE WHEN le IS NULL THEN lo ELSE lo + (le - lo) * (0.9 * total - below) / (n - below) END', 4)} AS value FROM c WHERE n >= 0.9 * total AND below < 0.9 * total")
def stm4_histogram_quantile(t):
    return metrics.histogram_quantile(metrics.histogram(t.raw("events"), "value", ["event_type"]), 0.9, ["event_type"])


@query(f"SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS window_start, count(*) AS n, {r('avg(duration_ms)', 4)} AS mean FROM logs GROUP BY 1", "logs")
def stm5_window_means(t):
    return metrics.window_means(t.logs, "ts", "duration_ms")


@query("WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS period, sum(pages) AS pages FROM usage GROUP BY 1), m AS (SELECT strftime(ts, '%Y-%m') AS period, sum(pages) AS pages FROM usage GROUP BY 1) SELECT period, CAST(pages AS BIGINT) AS pages, CASE WHEN pages >= 50 THEN 'critical' ELSE 'warning' END AS level FROM d WHERE pages >= 40 UNION ALL SELECT period, CAST(pages AS BIGINT), CASE WHEN pages >= 500 THEN 'critical' ELSE 'warning' END FROM m WHERE pages >= 400", "usage")
def stm7_gauges(t):
    return usage.gauges(t.usage)


@query("SELECT text, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def stm9_exact_duplicates(t):
    return dedup.same_content(t.raw("documents"), "text", "doc_id")


# ---- whole pipeline ------------------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT receipt_id, product_code, count(*) AS n, sum(quantity) AS q FROM items GROUP BY ALL)
    SELECT receipt_id, product_code, q AS quantity, (n > 1) AS needs_review FROM g""",
    "items",
)
def pipeline_parse_and_merge(t):
    parsed = matching.parse_lines(t.lines, CATALOG_CODE)
    return R.merge_duplicates(parsed).select("receipt_id", "product_code", "quantity", "needs_review")


def _all() -> None:
    from tallyweave.plans import more_queries  # noqa: F401  # registers itself


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()

    def bind(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        return run

    return {name: bind(f) for name, f in _FNS.items()}


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
