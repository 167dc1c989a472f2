"""Further queries: text quantities, sinks, sources over generated documents, event states."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.functions import dates as D
from tallyweave.functions import hashing as H
from tallyweave.functions import quantity as Q
from tallyweave.functions import text as X
from tallyweave.operators import catalog as C
from tallyweave.operators import dedup, layout, learn, matching, metrics, usage, verify
from tallyweave.operators import receipts as R
from tallyweave.plans.fixtures import half_up, mean
from tallyweave.plans.queries import _DET, _FILES, _PAIRS, _PASS2, _SQL, _detections, _files, query, r
from tallyweave.sinks import writers
from tallyweave.sources import readers
from tallyweave.streaming import stateful

_CLOUD = """cl AS (SELECT o_orderkey AS id, 'Store ' || o_custkey AS merchant, o_totalprice AS total FROM orders)"""


def _cloud(t):
    items = t.items.where("receipt_id % 3 = 0").groupBy("receipt_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("product_code").alias("description"), F.concat(F.lit(" "), F.col("quantity").cast("int")).alias("quantity"),
        F.when(F.col("pos") % 2 == 0, F.format_string("$%.2f", "unit_price")).alias("price"), F.format_string("%.2f", "line_total").alias("total_price"), F.when(F.col("pos") % 4 > 0, F.round("confidence", 2)).alias("confidence")).alias("i")))).alias("s")
    )
    h = t.receipts.join(items, F.col("id") == items["receipt_id"], "left")
    body = F.struct(F.concat(F.lit(" "), "store_name").alias("merchant"), F.col("scan_date").cast("string").alias("transaction_date"), F.concat(F.lit("₹"), F.format_string("%.2f", "bill_total")).alias("total"), F.transform("s", lambda x: x["i"]).alias("items"))
    return h.select("id", F.to_json(body).alias("json"))


@query(f"SELECT id, store_name AS merchant, CAST(scan_date AS VARCHAR) AS transaction_date, {r('bill_total', 2)} AS total FROM receipts", "receipts")
def src18_cloud_headers(t):
    return readers.cloud_documents(_cloud(t)).select("id", "merchant", "transaction_date", half_up(F.col("total"), 2).alias("total"))


@query(f"SELECT receipt_id AS id, pos, product_code AS description, quantity, {r('line_total', 2)} AS line_total FROM items WHERE receipt_id % 3 = 0", "items")
def src18_cloud_items(t):
    return readers.cloud_items(_cloud(t)).select("id", F.col("pos").alias("pos"), "description", "quantity", half_up(F.col("line_total"), 2).alias("line_total"))


@query(f"SELECT receipt_id AS id, pos, quantity, {r('line_total', 2)} AS line_total, {r('CASE WHEN pos % 4 > 0 THEN confidence ELSE 0.8 END', 2)} AS confidence FROM items WHERE receipt_id % 3 = 0", "items")
def prj5_cloud_item_rows(t):
    return readers.cloud_items(_cloud(t)).select("id", "pos", "quantity", half_up(F.col("line_total"), 2).alias("line_total"), half_up(F.col("confidence"), 2).alias("confidence"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN user_id || '' WHEN 1 THEN event_type ELSE NULL END AS v FROM events")
def src17_typed_slots(t):
    k = F.col("event_id")
    j = F.when(k % 3 == 0, F.to_json(F.struct(F.col("user_id").alias("valueInteger")))).when(k % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("valueString"), F.lit("x").alias("content")))).otherwise("{}")
    return t.raw("events").select(k.alias("id"), readers.variant_field(j).alias("v"))


@query("SELECT vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' END AS kind, vec_id % 4 <> 3 AS accepted FROM embeddings")
def src13_image_sniffing(t):
    k = F.col("vec_id")
    head = F.when(k % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A0000"))).when(k % 4 == 1, F.unhex(F.lit("FFD8FFE0"))).when(k % 4 == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.unhex(F.lit("0011")))
    files = t.raw("embeddings").select(k.cast("string").alias("path"), F.length(head).cast("long").alias("length"), head.alias("content"))
    return readers.checked_images(files).select(F.col("path").cast("long").alias("id"), "kind", "accepted")


@query("SELECT o_orderkey AS id, 'pending' AS processing_status FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT id, processing_status FROM receipts", "receipts")
def snk4_create_receipts(t):
    new = t.raw("orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("processing_status"))
    return new.unionByName(t.receipts.select("id", "processing_status"))


@query("SELECT receipt_id, original_code, corrected_code FROM corrections UNION ALL SELECT 0, 'A', 'B'", "corrections")
def snk12_append_correction(t):
    c = t.corrections.select("receipt_id", "original_code", "corrected_code")
    return c.union(t.spark.createDataFrame([(0, "A", "B")], c.schema))


@query("SELECT call_id, model, pages, floor(pages * CASE model WHEN 'prebuilt-receipt' THEN 0.01 ELSE 0.0015 END * 10000.0 + 0.5) / 10000.0 AS cost FROM usage", "usage")
def snk18_append_usage(t):
    out = usage.append_calls(usage.cost(t.usage.where("call_id < 500")), t.usage.where("call_id >= 500"))
    return out.select("call_id", "model", "pages", half_up(F.col("cost"), 4).alias("cost"))


@query("SELECT call_id FROM usage WHERE CAST(ts AS DATE) <> DATE '2024-01-05'", "usage")
def snk25_reset_day(t):
    return usage.drop_day(t.usage, "2024-01-05").select("call_id")


@query("SELECT event_id AS id, json_extract_string(j, '$.stage') AS stage FROM (SELECT event_id, json_object('stage', event_type) AS j FROM events)")
def snk23_json_log(t):
    j = writers.json_log(t.logs.select("id", "stage"))
    return j.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.stage").alias("stage"))


def _labels(t):
    k = F.col("o_orderkey")
    items = F.array(F.struct(F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("P"), k % 50)).alias("code"), (k % 5).cast("double").alias("quantity")))
    return t.raw("orders").where("o_orderkey < 2000").select(F.concat(F.lit("r"), k % 1500).alias("receipt_id"), F.format_string("%06d.jpg", k).alias("image_file"), items.alias("items"), F.lit(None).cast("double").alias("total_quantity"))


@query("WITH g AS (SELECT 'r' || (o_orderkey % 1500) AS b, o_orderkey AS k FROM orders WHERE o_orderkey < 2000 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 > 0) SELECT b || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS receipt_id, CAST(k % 5 AS DOUBLE) AS total_quantity FROM g WINDOW w AS (PARTITION BY b ORDER BY k)")
def snk19_label_intake(t):
    new = _labels(t)
    return writers.labels(new, new.limit(0))[0].select("receipt_id", "total_quantity")


@query("SELECT printf('%06d.jpg', o_orderkey) AS image_file FROM orders WHERE o_orderkey < 2000 AND (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0)")
def snk30_label_errors(t):
    new = _labels(t)
    return writers.labels(new, new.limit(0))[1].select("image_file")


@query("SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 2")
def snk20_delete_labels(t):
    n = t.raw("nation").select(F.col("n_nationkey").alias("receipt_id"), "n_regionkey")
    return writers.delete_labels(n, n.where("n_regionkey = 2").select("receipt_id")).select(F.col("receipt_id").alias("id"))


@query("SELECT receipt_id, pos, text FROM (SELECT receipt_id, pos, CASE pos % 6 WHEN 0 THEN '[.' WHEN 1 THEN ' % . ' WHEN 2 THEN '.' WHEN 3 THEN '[' ELSE product_code || '.' END AS text FROM items) i WHERE trim(text) NOT IN ('[.', '% .', '.', '[')", "items")
def flt12_noise_fragments(t):
    k = F.col("pos") % 6
    text = F.when(k == 0, "[.").when(k == 1, " % . ").when(k == 2, ".").when(k == 3, "[").otherwise(F.concat("product_code", F.lit(".")))
    return layout.without_noise(t.items.select("receipt_id", "pos", text.alias("text")))


@query("SELECT receipt_id, n >= 2 OR (k > 0 AND c > 0.5) AS cacheable FROM (SELECT receipt_id, count(*) AS n, count(*) FILTER (quantity > 10) AS k, avg(confidence) - 0.2 AS c FROM items WHERE pos <= 2 GROUP BY receipt_id) g", "items")
def flt17_cacheable(t):
    g = t.items.where("pos <= 2").groupBy("receipt_id").agg(F.count("*").alias("n"), F.count_if(F.col("quantity") > 10).alias("k"), (F.avg("confidence") - 0.2).alias("c"))
    return g.select("receipt_id", verify.cache_worthy(F.col("n"), F.col("k"), F.col("c")).alias("cacheable"))


@query("SELECT vec_id AS id, CAST(list_min([e[1], e[3], e[5]]) AS DOUBLE) AS x0, CAST(list_max([e[2], e[4], e[6]]) AS DOUBLE) AS y1 FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def prj3_polygon_box(t):
    b = layout.polygon_box(F.slice(F.col("embedding").cast("array<double>"), 1, 6))
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), b[0][0].alias("x0"), b[2][1].alias("y1"))


@query("SELECT vec_id AS id, CAST(list_min(list_transform(range(1, 64, 2), lambda i: embedding[i])) AS DOUBLE) AS x_min, CAST(list_max(list_transform(range(2, 65, 2), lambda i: embedding[i])) AS DOUBLE) AS y_max FROM embeddings")
def arr7_coordinate_pairs(t):
    pairs = layout.coordinate_pairs(F.col("embedding").cast("array<double>"))
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), F.array_min(F.transform(pairs, lambda p: p["x"])).alias("x_min"), F.array_max(F.transform(pairs, lambda p: p["y"])).alias("y_max"))


@query("SELECT receipt_id, pos, product_code, CASE WHEN pos % 2 = 1 AND quantity > 1 AND 7 < 0.06e0 * 40 * max(pos) OVER (PARTITION BY receipt_id) THEN quantity ELSE 1.0 END AS quantity, pos * 40.0e0 AS y FROM items", "items")
def join13_second_pass(t):
    items = t.items.select("receipt_id", "pos", "product_code", F.lit(1.0).alias("quantity"), (F.col("pos") * 40.0).alias("y"))
    numbers = t.items.where("pos % 2 = 1").select("receipt_id", (F.col("pos") * 40.0 - 7).alias("y"), F.col("quantity").alias("value"))
    return layout.attach_orphans(items, numbers, default=120.0)


@query(f"""WITH e AS (SELECT receipt_id, quantity + CASE WHEN pos % 9 = 0 THEN 1 ELSE 0 END AS q, unit_price AS p, CASE WHEN receipt_id % 4 = 0 THEN 0 ELSE line_total END AS a FROM items), g AS (SELECT receipt_id, sum(q) AS total_quantity, {r('sum(a)', 2)} AS line_totals, {r('sum(' + r('q * p', 2) + ')', 2)} AS computed_grand_total, count(*) FILTER (a > 0 AND abs(a - {r('q * p', 2)}) >= 0.01e0) = 0 AS all_lines_ok FROM e GROUP BY receipt_id)
    SELECT g.*, abs(o_totalprice - computed_grand_total) < 0.01e0 AS grand_total_match FROM g LEFT JOIN orders ON o_orderkey = receipt_id AND o_orderkey % 3 = 0""", "items")
def agg32_recompute(t):
    k = F.col("receipt_id")
    d = t.items.withColumns({"quantity": F.col("quantity") + F.when(F.col("pos") % 9 == 0, 1).otherwise(0), "line_total": F.when(k % 4 == 0, 0.0).otherwise(F.col("line_total"))})
    return verify.recompute(d, t.receipts.where("id % 3 = 0").select(F.col("id").alias("receipt_id"), F.col("bill_total").alias("grand_total")))


@query(
    f"""WITH d AS (SELECT receipt_id, pos, CASE pos % 4 WHEN 0 THEN CAST(CAST(quantity * 5 AS INTEGER) AS VARCHAR) WHEN 1 THEN pos || '.' ELSE product_code END AS t, pos * 10.0e0 AS x0, pos * 10.0e0 + 30 AS x1, pos * 20.0e0 AS y0, pos * 20.0e0 + pos % 3 * 5 AS y1 FROM items),
    want AS (SELECT DISTINCT receipt_id AS rid, product_code AS pc FROM items WHERE pos % 4 > 1 AND pos % 2 = 0)
    SELECT receipt_id, count(*) AS detection_count, {r('sum((x0 + x1) / 2 / 400) FILTER (code)', 6)} AS code_x, {r('sum((x0 + x1) / 2 / 400) FILTER (pos % 4 < 2)', 6)} AS qty_x, {r('sum((y0 + y1) / 2 / 800) FILTER (code)', 6)} AS item_y, count(*) FILTER (y1 > y0) AS heights, {r('sum(30.0e0 / 400 / length(t))', 6)} AS widths, count(*) FILTER (pos % 4 = 0 AND quantity_of > 100) > 0 AS has_prices, count(*) FILTER (pos % 4 = 1) > 0 AS has_line_numbers
    FROM (SELECT d.*, TRY_CAST(t AS DOUBLE) AS quantity_of, pc IS NOT NULL AS code FROM d LEFT JOIN want ON rid = receipt_id AND pc = t) e GROUP BY receipt_id""",
    "items",
)
def agg26_layout_features(t):
    p = F.col("pos")
    x0, x1, y0, y1 = p * 10.0, p * 10.0 + 30, p * 20.0, p * 20.0 + p % 3 * 5
    text = F.when(p % 4 == 0, (F.col("quantity") * 5).cast("int").cast("string")).when(p % 4 == 1, F.concat(p.cast("string"), F.lit("."))).otherwise(F.col("product_code"))
    d = t.items.select("receipt_id", p.alias("det_id"), F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)).alias("bbox"), F.concat(F.lit(" "), text).alias("text"))
    sizes = t.receipts.select(F.col("id").alias("receipt_id"), F.lit(400).alias("width"), F.lit(800).alias("height"))
    f = layout.layout_features(d, sizes, t.items.where("pos % 4 > 1 AND pos % 2 = 0").select("receipt_id", F.concat("product_code", F.lit(" ")).alias("code")))
    total = lambda c: half_up(F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x)), 6).alias(c)
    return f.select("receipt_id", "detection_count", total("code_x"), total("qty_x"), total("item_y"), F.size("line_heights").cast("long").alias("heights"), half_up(F.aggregate("char_widths", F.lit(0.0), lambda a, x: a + x), 6).alias("widths"), "has_prices", "has_line_numbers")


@query("SELECT receipt_id, pos, row_number() OVER (PARTITION BY receipt_id ORDER BY pos) - 1 AS idx FROM items WHERE pos % 3 > 0", "items")
def win11_positional_index(t):
    return learn.positional_index(t.items.where("pos % 3 > 0").select("receipt_id", "pos"), "receipt_id", "pos")


@query(f"WITH {_PAIRS} SELECT * FROM pr ORDER BY n DESC, original_code, corrected_code LIMIT 50", "corrections")
def srt4_top_pairs(t):
    return learn.top_corrections(t.corrections, 50)


@query("SELECT id, scan_date FROM receipts ORDER BY scan_date DESC, id DESC LIMIT 20", "receipts")
def srt7_last_receipts(t):
    return R.audit(t.receipts, t.stored_items, 20).select("id", "scan_date")


@query(f"WITH {_DET}, {_PASS2}, a AS (SELECT DISTINCT receipt_id, text FROM det), b AS (SELECT DISTINCT receipt_id, text FROM p2) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", "items")
def set1_pass_overlap(t):
    d = _detections(t).select("receipt_id", "det_id", "text")
    return layout.pass_overlap(d, d.where("det_id % 5 <> 0").withColumn("text", F.when(F.col("det_id") % 4 == 1, F.concat("text", F.lit("Z"))).otherwise(F.col("text"))))


@query("SELECT p_partkey AS id, len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('ring', 'widget', 'red'))) = 0 AS only_headers FROM part")
def set5_header_words(t):
    return t.raw("part").select(F.col("p_partkey").alias("id"), X.only_header_words(F.col("p_name"), F.array(F.lit("ring"), F.lit("widget"), F.lit("red"))).alias("only_headers"))


@query("SELECT p_size AS id, list_sort(list_filter(['p_name', 'p_price', 'p_size', 'unit'], lambda x: NOT list_contains(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], x))) AS missing FROM (SELECT DISTINCT p_size FROM part) s")
def set6_missing_headers(t):
    missing = sorted(C.missing_headers(t.raw("part"), ("p_name", "p_price", "p_size", "unit")))
    return t.raw("part").select(F.col("p_size").alias("id")).distinct().withColumn("missing", F.array(*[F.lit(x) for x in missing]))


_ROLE = """CASE WHEN regexp_matches(a, '^[A-Za-z][A-Za-z]') AND NOT regexp_matches(b, '^[A-Za-z][A-Za-z]') THEN 1 WHEN regexp_matches(b, '^[A-Za-z][A-Za-z]') AND NOT regexp_matches(a, '^[A-Za-z][A-Za-z]') THEN 2 WHEN regexp_full_match(a, '[A-Za-z]+') THEN 1 WHEN regexp_full_match(b, '[A-Za-z]+') THEN 2 END"""


def _quantity_sql(x: str) -> str:
    """A number, or digits behind letters, in 1..999."""
    word = f"replace(replace(replace(replace(replace(replace(replace({x}, 'I', '1'), 'i', '1'), 'l', '1'), '|', '1'), '!', '1'), 'O', '0'), 'o', '0')"
    return f"CASE WHEN regexp_full_match({x}, '[0-9]+[.]?[0-9]*') THEN TRY_CAST({x} AS DOUBLE) WHEN regexp_full_match({word}, '[0-9]+') AND TRY_CAST({word} AS BIGINT) BETWEEN 1 AND 999 THEN TRY_CAST({word} AS DOUBLE) END"


@query(f"WITH w AS (SELECT id, string_split(text, ' ')[1] AS a, string_split(text, ' ')[2] AS b FROM noisy), z AS (SELECT *, {_ROLE} AS k, {_quantity_sql('a')} AS qa, {_quantity_sql('b')} AS qb FROM w) SELECT id, CASE k WHEN 1 THEN CASE WHEN qb IS NOT NULL THEN upper(a) END WHEN 2 THEN CASE WHEN qa IS NOT NULL THEN upper(b) END END AS code, CASE k WHEN 1 THEN qb WHEN 2 THEN qa END AS quantity FROM z", "noisy")
def str8_roles(t):
    words = F.split("text", " ")
    c, q = X.roles(words[0], words[1])
    return t.noisy.select("id", c.alias("code"), q.alias("quantity"))


_FORMS = [
    "CODE\\s*[-–—]\\s*NUM", "[0-9][0-9]?\\s+CODE\\s+NUM", "[0-9][0-9]?\\s+CODE\\s+ODD", "CODE\\s+NUM", "NUM\\s+CODE", "CODE\\s*[x×]\\s*NUM", "CODE\\s*:\\s*NUM", "CODE\\s*\\(\\s*NUM\\s*\\)", "CODE\\s+ODD",
]


def _forms_sql() -> str:
    fill = lambda p: "(?i)" + p.replace("CODE", "([a-z]{3,6}|[a-z]{2,4}[a-z0-9]{1,3})").replace("NUM", "([0-9]+[.]?[0-9]*)").replace("ODD", "([ilo|!][0-9ilo|!]?[0-9ilo|!]?)")
    one = [f"SELECT id, {k} AS form, regexp_extract(text, '{fill(p)}', 1) AS a, regexp_extract(text, '{fill(p)}', 2) AS b FROM noisy WHERE regexp_matches(text, '{fill(p)}')" for k, p in enumerate(_FORMS)]
    alone = "SELECT id, 9 AS form, text AS a, '1' AS b FROM noisy WHERE regexp_full_match(text, '(?i)[a-z]{2,4}[a-z0-9]{1,3}|[a-z]{3,6}')"
    return " UNION ALL ".join([*one, alone])


@query(
    f"""WITH f AS ({_forms_sql()}), z AS (SELECT *, {_ROLE} AS k, {_quantity_sql('a')} AS qa, {_quantity_sql('b')} AS qb FROM f), g AS (SELECT id, form, upper(CASE k WHEN 1 THEN a ELSE b END) AS code, CASE k WHEN 1 THEN qb WHEN 2 THEN qa END AS q FROM z),
    h AS (SELECT * FROM g WHERE q IS NOT NULL AND code NOT IN ('QT', 'QTS', 'QTY', 'IQT', 'PC', 'PCS', 'NO', 'NOS', 'UNIT', 'UNITS') AND NOT regexp_full_match(code, '[ILO|1][QTF0-9][QTF0-9.]*') QUALIFY row_number() OVER (PARTITION BY id ORDER BY form) = 1)
    SELECT n.id, CASE WHEN code || CAST(q AS INTEGER) IN ('PEPW20', 'ABC4') THEN code || CAST(q AS INTEGER) ELSE code END AS code, CASE WHEN q > 50 OR q <= 0 OR code || CAST(q AS INTEGER) IN ('PEPW20', 'ABC4') THEN 1.0 ELSE q END AS quantity FROM noisy n LEFT JOIN h USING (id)""",
    "noisy",
)
def str4_parse_noisy(t):
    catalog = t.spark.createDataFrame([("PEPW20",), ("ABC4",), ("MNO",)], "product_code string")
    return matching.parse_items(t.noisy, catalog).select("id", "code", "quantity")


def _marks_sql() -> str:
    d = "[IOlio(0-9''}`]"
    marks = ["[Qq][Tt1I]", "&[Tt1]?", "4[Tt1]", "[Qq&][ \"''.)\\]]*$", "[Tt][Tt]?[ .]*$"]
    out = []
    for k, m in enumerate(marks):
        # a run of at most three, or the end of a longer one
        for run in (f"^((?:.*[^IOlio(0-9''}}`])?)({d}{{1,3}}) *{m}", f"^(.*{d})({d}{{3}}) *{m}"):
            lead = f"regexp_extract(text, '{run}', 1)"
            after = f" AND regexp_matches({lead}, '[ –—-]$')" if k == 4 else ""
            out.append(f"SELECT id, {k} AS kind, length({lead}) AS place, regexp_extract(text, '{run}', 2) AS v FROM noisy WHERE regexp_matches(text, '{run}'){after}")
    return " UNION ALL ".join(out)


@query(
    f"""WITH m AS ({_marks_sql()}), v AS (SELECT id, kind, place, TRY_CAST(replace(replace(replace(replace(replace(replace(replace(replace(replace(v, 'I', '1'), 'i', '1'), 'l', '1'), 'O', '0'), 'o', '0'), '(', '1'), '}}', '3'), '`', '1'), '''', '3') AS INTEGER) AS q FROM m),
    b AS (SELECT id, q FROM v WHERE q BETWEEN 1 AND 999 QUALIFY row_number() OVER (PARTITION BY id ORDER BY place DESC, kind) = 1) SELECT id, q FROM noisy LEFT JOIN b USING (id)""",
    "noisy",
)
def str9_marked_quantity(t):
    return t.noisy.select("id", Q.marked_quantity(F.col("text")).alias("q"))


_WORDS = "w AS (SELECT id, text, regexp_split_to_array(text, '\\s+') AS ws FROM noisy)"
_FREE = """f AS (SELECT id, text, ws, TRY_CAST(regexp_extract(text, '[-–—]\\s*([0-9]{1,3})', 1) AS INTEGER) AS dash,
    list_filter(list_transform(flatten(list_transform(list_filter(ws, lambda x: NOT regexp_full_match(x, '[A-Za-z]{2,4}') AND NOT regexp_full_match(x, '[Qq&4][Tt1I]?') AND NOT (length(x) > 2 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))), lambda x: regexp_extract_all(x, '[0-9]+'))), lambda y: TRY_CAST(y AS INTEGER)), lambda n: n BETWEEN 1 AND 999) AS ns,
    list_filter(list_transform(list_filter(ws, lambda x: NOT regexp_full_match(x, '[A-Za-z]{2,4}') AND regexp_full_match(x, '[IlOo|!0-9]*[IlOo|!][IlOo|!0-9]*')), lambda x: TRY_CAST(translate(x, 'IlOo|!', '110011') AS INTEGER)), lambda n: n BETWEEN 1 AND 999) AS ds FROM w),
    c AS (SELECT id, text, ws, CAST(coalesce(CASE WHEN dash BETWEEN 1 AND 999 THEN dash END, list_filter(ns, lambda n: n <= 99)[-1], ns[-1], ds[1], 1) AS DOUBLE) AS q FROM f)"""


@query(f"WITH {_WORDS}, {_FREE} SELECT id, q FROM c", "noisy")
def str10_free_quantity(t):
    return t.noisy.select("id", Q.free_quantity(F.col("text")).alias("q"))


_DASHED = "list_extract(map_extract(MAP {'a': 2, 'A': 2, 'z': 2, 'Z': 2, 'l': 1, 'I': 1, 'i': 1, 's': 5, 'S': 5, 'b': 6, 'B': 8, 'g': 9, 'q': 9, 'T': 7, '''': 3, '`': 1, '}': 3, '{': 1}, body[1]), 1)"


def _decode_sql(x: str) -> str:
    w = f"replace(replace(replace({x}, '.', ''), ',', ''), '_', '')"
    d = f"regexp_extract(translate({w}, 'OoIl|!', '001111'), '^[0-9]+')"
    n = f"CASE WHEN length({w}) <= 6 THEN TRY_CAST({d} AS INTEGER) END"
    return f"CASE WHEN {n} BETWEEN 1 AND 99 THEN {n} WHEN {n} BETWEEN 100 AND 999 THEN coalesce(nullif(TRY_CAST({d}[1:2] AS INTEGER), 0), nullif(TRY_CAST({d}[1:3] AS INTEGER), 0), nullif(TRY_CAST({d}[1:4] AS INTEGER), 0)) END"


@query(
    f"""WITH {_WORDS}, {_FREE}, x AS (SELECT c.id, 'ABC' AS code, c.q AS clear, i, c.ws[i] AS word, list_position(list_transform(c.ws, lambda v: contains(upper(v), 'ABC') OR contains('ABC', upper(v))), true) AS spot FROM c, range(1, 1 + len(c.ws)) r(i)),
    y AS (SELECT *, CASE WHEN spot IS NULL OR i < spot THEN 2 WHEN i > spot THEN 1 END AS side, regexp_replace(word, '^[-–—]+', '') AS body FROM x),
    z AS (SELECT *, CASE WHEN word[1] IN ('-', '–', '—') THEN coalesce(TRY_CAST(nullif(regexp_extract(body, '[0-9]+'), '') AS INTEGER), CASE WHEN regexp_full_match(body[2:], '(?i)[qtfxkpyr}} .''`]*') THEN {_DASHED} END) END AS dashed, {_decode_sql('word')} AS plain,
        CASE WHEN word IN ('V', 'v', 'Z', 'z') THEN 2 WHEN word IN ('S', 's') THEN 5 WHEN word IN ('B', 'b') AND false THEN 8 WHEN word IN ('q', 'g') THEN 9 END AS hand FROM y WHERE side IS NOT NULL),
    b AS (SELECT id, coalesce(CASE WHEN dashed BETWEEN 1 AND 999 THEN dashed END, plain) AS v, side * 10000 + i AS rank FROM z UNION ALL SELECT id, hand, 30000 + i FROM z WHERE side = 1),
    g AS (SELECT id, min_by(v, rank) AS v FROM b WHERE v IS NOT NULL GROUP BY id) SELECT c.id, CASE WHEN c.q <> 1 THEN c.q ELSE CAST(coalesce(g.v, 1) AS DOUBLE) END AS q FROM c LEFT JOIN g USING (id)""",
    "noisy",
)
def str11_quantity_beside_code(t):
    return t.noisy.select("id", Q.quantity_beside(F.col("text"), F.lit("ABC")).alias("q"))


@query(
    f"""WITH d AS (SELECT id, '-' || replace(text, ' ', '') AS frag FROM noisy), e AS (SELECT id, regexp_replace(frag, '^[-–—]+\\s*', '') AS body FROM d)
    SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(body, '[0-9]+'), '') AS INTEGER), CASE WHEN regexp_full_match(body[2:], '(?i)[qtfxkpyr}} .''`]*') THEN {_DASHED} END, {_decode_sql('body')}) AS q FROM e""",
    "noisy",
)
def str13_dash_fragment(t):
    return t.noisy.select("id", X.dash_quantity(F.concat(F.lit("-"), F.regexp_replace("text", " ", ""))).alias("q"))


_SPLIT = """l AS (SELECT a.id AS receipt_id, 1 AS line_no, string_split(a.text || '  mno ' || a.id % 30 || ' ' || upper(a.text) || '|ABC 4', '|') AS ps FROM noisy a), p AS (SELECT receipt_id, line_no, unnest(range(len(ps))) AS part, unnest(ps) AS text FROM l), q AS (SELECT receipt_id, part, text, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS ws FROM p WHERE trim(text) <> ''),
    x AS (SELECT receipt_id, part, i, ws[i] AS w, upper(ws[i]) IN ('ABC', 'MNO', 'PEPW') AS c FROM q, range(1, 1 + len(ws)) r(i)), n AS (SELECT *, greatest(sum(c::INTEGER) OVER (PARTITION BY receipt_id, part ORDER BY i) - 1, 0) AS piece FROM x),
    g AS (SELECT receipt_id, part, piece, string_agg(w, '' ORDER BY i) AS whole, string_agg(w, '' ORDER BY i) FILTER (i > k) AS after FROM (SELECT *, max(CASE WHEN c THEN i END) OVER (PARTITION BY receipt_id, part, piece) AS k FROM n) m GROUP BY ALL),
    h AS (SELECT *, CASE WHEN lead(piece) OVER o IS NOT NULL THEN regexp_extract(coalesce(after, ''), '([0-9]+[ \t]*)$', 1) ELSE '' END AS moved FROM g WINDOW o AS (PARTITION BY receipt_id, part ORDER BY piece)),
    f AS (SELECT receipt_id, part, piece, trim(coalesce(lag(moved) OVER o, '') || left(whole, length(whole) - length(moved)), E' \t') AS text FROM h WINDOW o AS (PARTITION BY receipt_id, part ORDER BY piece))"""


@query(f"WITH {_SPLIT} SELECT receipt_id, 1 AS line_no, CAST(part AS INTEGER) AS part, CAST(piece AS INTEGER) AS piece, text FROM f WHERE text <> ''", "noisy")
def str15_split_lines(t):
    text = F.concat("text", F.lit("  mno "), F.col("id") % 30, F.lit(" "), F.upper("text"), F.lit("|ABC 4"))
    catalog = t.spark.createDataFrame([("ABC",), ("MNO",), ("PEPW",)], "product_code string")
    return matching.split_lines(t.noisy.select(F.col("id").alias("receipt_id"), F.lit(1).alias("line_no"), text.alias("text")), catalog)


@query("SELECT id AS receipt_id, 1 AS line_no, ['PEPW20 5', 'a PEPW1 3', 'TEW20', 'TEW2 1', 'TEW10 x', 'PEPW 30', 'TEW10', 'PEPW20'][id % 8 + 1] AS text FROM noisy", "noisy")
def str1_reglue(t):
    k = F.col("id")
    text = F.element_at(F.array(*[F.lit(x) for x in ("PEPW 20 5", "a PEP W1 3", "TEW2 0", "TEW2 1", "TEW1 0 x", "PEPW 30", "TEW1 0", "PEPW20")]), (k % 8 + 1).cast("int"))
    catalog = t.spark.createDataFrame([("PEPW20",), ("PEPW1",), ("TEW20",), ("TEW10",)], "product_code string")
    return matching.reglue(t.noisy.select(k.alias("receipt_id"), F.lit(1).alias("line_no"), text.alias("text")), catalog)


_READ = ("Total Qty II", "TOTAL: lo", "Total = S", "total qty: 12", "Totol Z z", "Total", "Total x", "Total 0", "sum 5", "qtt 3.5", "Total BG", "subtotal: 7 pcs")


@query(f"""WITH z AS (SELECT p_partkey AS id, [{', '.join(repr(x) for x in _READ)}][p_partkey % {len(_READ)} + 1] AS text FROM part), w AS (SELECT id, trim(regexp_replace(trim(regexp_extract(text, '(?i)(total|totai|tota1|t0tal|totol|toial|to7al|tatal|tolal|totel|totd|qtyt|qiy|qtt)(.*)$', 2), ' :=-'), '(?i)^(qty|quantity|qtv|qly)[ :=-]*', '')) AS rest FROM z),
    d AS (SELECT id, rest, trim(regexp_replace(translate(rest, 'OoIl|!ZzSsGgBTA', '001111225566874'), '[^0-9 .]', '', 'g')) AS dg FROM w) SELECT id, CASE WHEN regexp_full_match(rest, '[0-9]+[.]?[0-9]*') THEN CAST(rest AS DOUBLE) WHEN regexp_full_match(dg, '[0-9]+[.]?[0-9]*') AND CAST(dg AS DOUBLE) BETWEEN 0.000001 AND 99999 THEN CAST(dg AS DOUBLE) END AS n FROM d""")
def str19_recover_digits(t):
    k = F.col("p_partkey")
    return t.raw("part").select(k.alias("id"), X.recover_digits(F.element_at(F.array(*[F.lit(x) for x in _READ]), (k % len(_READ) + 1).cast("int"))).alias("n"))


@query("SELECT p_partkey AS id, upper(replace(w, ' ', '')) AS code, CAST(CASE WHEN q > 50 THEN 1 ELSE q END AS DOUBLE) AS quantity FROM (SELECT p_partkey, p_size AS q, ['a B c', 'P E P W', 'x Y Z', 'M n o P Q r'][p_partkey % 4 + 1] AS w FROM part) z")
def str20_scattered_letters(t):
    k = F.col("p_partkey")
    w = F.element_at(F.array(*[F.lit(x) for x in ("a B c", "P E P W", "x Y Z", "M n o P Q r")]), (k % 4 + 1).cast("int"))
    return t.raw("part").select(k.alias("id"), Q.scattered_item(F.concat(w, F.lit(" "), F.col("p_size"))).alias("i")).select("id", "i.code", "i.quantity")


_DOUBT = """z AS (SELECT receipt_id, pos, CASE WHEN receipt_id % 5 = 1 AND pos = 3 THEN 'P1' WHEN receipt_id % 5 = 4 THEN 'P9999990' ELSE 'P10' END AS code, CASE WHEN receipt_id % 5 IN (0, 1) AND pos > 1 THEN 'ambiguous_oi' ELSE 'exact' END AS mt, CASE WHEN receipt_id % 5 = 2 AND pos = 2 THEN 'p1o 3' WHEN receipt_id % 5 = 3 THEN 'P1O and P10' ELSE 'P10 3' END AS raw FROM items WHERE pos <= 3),
    y AS (SELECT *, left(code, -1) AS s, count(*) OVER (PARTITION BY receipt_id, code) AS n FROM z), x AS (SELECT *, n > 1 AND length(code) > 2 AND s IN (SELECT product_code FROM products) AND NOT EXISTS (SELECT 1 FROM z WHERE z.receipt_id = y.receipt_id AND z.code = y.s) AS able, regexp_matches(upper(raw), s || '[OI]') AND NOT contains(regexp_replace(upper(raw), s || '[OI]', '', 'g'), code) AS misread FROM y),
    w AS (SELECT *, CASE WHEN able AND mt = 'ambiguous_oi' THEN 1 WHEN able AND misread THEN 2 ELSE 9 END AS tier FROM x), v AS (SELECT *, tier < 9 AND row_number() OVER (PARTITION BY receipt_id, code ORDER BY tier, pos) = 1 AS take FROM w)"""


@query(f"WITH {_DOUBT} SELECT receipt_id, pos, CASE WHEN take THEN s ELSE code END AS product_code, CASE WHEN take AND tier = 1 THEN 'oi_resolved' WHEN take THEN 'ocr_variant' ELSE mt END AS match_type, mt = 'ambiguous_oi' AS needs_review FROM v", "items", "products")
def str26_resolve_ambiguous(t):
    k, p = F.col("receipt_id") % 5, F.col("pos")
    d = t.items.where("pos <= 3").select(
        "receipt_id", "pos", F.when((k == 1) & (p == 3), "P1").when(k == 4, "P9999990").otherwise("P10").alias("product_code"), F.when((k < 2) & (p > 1), "ambiguous_oi").otherwise("exact").alias("match_type"),
        F.when((k == 2) & (p == 2), "p1o 3").when(k == 3, "P1O and P10").otherwise("P10 3").alias("raw_text"), F.lit(False).alias("needs_review"),
    )
    return layout.resolve_ambiguous(d, t.products).drop("raw_text")


@query("SELECT a.id AS a, b.id AS b, CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CAST(z[1] <> z[2] AS INTEGER))) AS INTEGER) AS d FROM (SELECT id, list_transform(pixels, lambda x: x > list_avg(pixels)) AS bits FROM hashes WHERE id < 40) a, (SELECT id, list_transform(pixels, lambda x: x > list_avg(pixels)) AS bits FROM hashes WHERE id < 40) b WHERE a.id < b.id", "hashes")
def str31_hamming(t):
    h = t.hashes.where("id < 40").select("id", H.hash_hex(H.average_hash(F.col("pixels"))).alias("h"))
    j = h.select(F.col("id").alias("a"), F.col("h").alias("ha")).join(h.select(F.col("id").alias("b"), F.col("h").alias("hb")), F.col("a") < F.col("b"))
    return j.select("a", "b", H.hamming_hex(F.col("ha"), F.col("hb")).alias("d"))


@query("SELECT id, 'REC-' || strftime(created_at, '%Y%m%d-%H%M%S') || '-' || upper(left(sha256(CAST(id AS VARCHAR)), 12)) AS number FROM receipts", "receipts")
def dat6_receipt_number(t):
    return t.receipts.select("id", D.receipt_number(F.col("created_at"), F.col("id")).alias("number"))


@query("SELECT id, stage, count(*) OVER (PARTITION BY stage) AS per_stage FROM logs", "logs")
def arr2_defaults(t):
    g = t.logs.groupBy("stage").agg(F.count("*").alias("n"))
    m = g.agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("m"))
    return t.logs.crossJoin(F.broadcast(m)).select("id", "stage", F.coalesce(F.try_element_at("m", F.col("stage")), F.lit(0).cast("long")).alias("per_stage"))


@query(f"SELECT time_bucket(INTERVAL 60 MINUTES, ts) AS window_start, status, count(*) AS n, {r('count(*) / 3600.0', 6)} AS per_second FROM logs GROUP BY ALL", "logs")
def stm6_rates_by_label(t):
    return metrics.window_rates(t.logs, "ts", ["status"], 60)


@query("SELECT b.doc_id AS id, a.doc_id AS earlier FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id AND b.doc_id - a.doc_id <= 300")
def stm8_window_duplicates(t):
    return dedup.same_within(t.raw("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), "doc_id"), "h", "doc_id", 300)


@query("SELECT receipt_id, pos, upper(product_code) <> upper(product_code || '') OR pos % 2 > 0.01 AS changed FROM items", "items")
def mth11_change_detection(t):
    c, q = F.col("product_code"), F.col("quantity")
    return t.items.select("receipt_id", "pos", verify.change_detected(c, F.lower(c), q, q + F.col("pos") % 2).alias("changed"))


# ---- totals, batches, snapshots and corrected samples ---------------------------------------------------------

_TOTAL_DET = """det AS (SELECT id AS receipt_id, 1 AS det_id, 10.0 AS x, 100.0 AS y, 'ABC' AS text, 0.9 AS confidence FROM receipts
    UNION ALL SELECT id, 2, 10.0, 400.0, ['Total Qty', 'Total', 'Grand Total', 'Sub Total:', 'Total Items', 'Totol', 'total', 'Sum'][id % 8 + 1], 0.8 FROM receipts
    UNION ALL SELECT id, 3, 200.0, 404.0, ['II', '12', ': 34', 'O5', '', '7 pcs', 'x'][id % 7 + 1], 0.6 FROM receipts
    UNION ALL SELECT id, 4, 10.0, 460.0, ['24', 'thanks', 'Total Qty: 9', '0', 'Tota1 8'][id % 5 + 1], 0.7 FROM receipts WHERE id % 3 > 0
    UNION ALL SELECT id, 5, 10.0, 350.0, ['17', 'MNO 3'][id % 2 + 1], 0.5 FROM receipts)"""


def _total_detections(t):
    k = F.col("id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    rows = [
        (1, 10.0, 100.0, F.lit("ABC"), 0.9), (2, 10.0, 400.0, pick("Total Qty", "Total", "Grand Total", "Sub Total:", "Total Items", "Totol", "total", "Sum"), 0.8),
        (3, 200.0, 404.0, pick("II", "12", ": 34", "O5", "", "7 pcs", "x"), 0.6), (4, 10.0, 460.0, F.when(k % 3 > 0, pick("24", "thanks", "Total Qty: 9", "0", "Tota1 8")), 0.7), (5, 10.0, 350.0, pick("17", "MNO 3"), 0.5),
    ]
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("det_id"), F.lit(x).alias("x"), F.lit(y).alias("y"), text.alias("text"), F.lit(c).alias("confidence")) for i, x, y, text, c in rows]))
    return t.receipts.select(k.alias("receipt_id"), d.alias("d")).select("receipt_id", "d.*").where("text IS NOT NULL")


_W, _Q = "(total|totai|tota1|t0tal|totd)", "(qty|quantity|qtv|qly|qtyt|qiy|qtt)"


def _stated_sql() -> str:
    number = lambda p, g: f"CASE WHEN TRY_CAST(regexp_extract(text, '(?i){p}', {g}) AS DOUBLE) > 0 AND TRY_CAST(regexp_extract(text, '(?i){p}', {g}) AS DOUBLE) <= 99999 THEN TRY_CAST(regexp_extract(text, '(?i){p}', {g}) AS DOUBLE) END"
    sep, n = "[ :=_.-]*", "([0-9]+[.]?[0-9]*)"
    forms = [(f"{_W}{sep}{_Q}{sep}{n}", 3), (f"{_W}[ :=_-]+{n}", 2), (f"sub{sep}total{sep}{n}", 1), (f"sum[ :=_-]+{n}", 1), (f"{_W}.*?{_Q}.*?{n} *$", 3)]
    kw = "(total|totai|tota1|t0tal|totol|toial|to7al|tatal|tolal|totel|totd|qtyt|qiy|qtt)"
    rest = f"regexp_replace(trim(regexp_extract(text, '(?i){kw}(.*)$', 2), ' :=-'), '(?i)^(qty|quantity|qtv|qly)[ :=-]*', '')"
    digits = f"trim(regexp_replace(translate({rest}, 'OoIl|!ZzSsGgBTA', '001111225566874'), '[^0-9 .]', '', 'g'))"
    word = f"regexp_matches(text, '(?i)(^| )[.:=-]*{kw}[.:=-]*( |$)')"
    near = number(f"(total|totai|tota1|t0tal|sub *total|sum) *{_Q}?[ :=-]*{n}", 3)
    tail = f"CASE WHEN {word} THEN coalesce({near}, CASE WHEN regexp_full_match({rest}, '[0-9]+[.]?[0-9]*') THEN TRY_CAST({rest} AS DOUBLE) END, CASE WHEN TRY_CAST({digits} AS DOUBLE) > 0 AND TRY_CAST({digits} AS DOUBLE) <= 99999 THEN TRY_CAST({digits} AS DOUBLE) END) END"
    return f"CASE WHEN NOT regexp_matches(text, '(?i)(total|totd) *(items|count|no|number|products|entries)') AND NOT regexp_matches(text, '(?i)(grand|grrand|grramd|gramd){sep}{_W}') THEN coalesce({', '.join(number(p, g) for p, g in forms)}, {tail}) END"


@query(
    f"""WITH {_TOTAL_DET}, low AS (SELECT *, max(y) OVER (PARTITION BY receipt_id) AS my FROM det), g AS (SELECT *, y - lag(y) OVER (PARTITION BY receipt_id ORDER BY y, x, det_id) AS gap, greatest(15, 0.03 * (max(y) OVER (PARTITION BY receipt_id) - min(y) OVER (PARTITION BY receipt_id))) AS lim FROM low WHERE y >= 0.3 * my),
    l AS (SELECT *, 1 + sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id ORDER BY y, x, det_id) AS line FROM g), j AS (SELECT receipt_id, line, string_agg(text, ' ' ORDER BY x) AS text, avg(confidence) AS c FROM l GROUP BY ALL),
    o AS (SELECT *, {_stated_sql()} AS own, CASE WHEN regexp_full_match(trim(text), '[0-9]+[.]?[0-9]*') AND CAST(trim(text) AS DOUBLE) BETWEEN 0.000001 AND 99999 THEN CAST(trim(text) AS DOUBLE) END AS bare FROM j),
    a AS (SELECT *, lead(bare) OVER w AS nb, lag(bare) OVER w AS pb, lead(text) OVER w AS nt, lag(text) OVER w AS pt, lead(c) OVER w AS nc, lag(c) OVER w AS pc, regexp_matches(text, '(?i){_W}') AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '(?i)(grand|grrand|grramd|gramd)[ :=_.-]*{_W}') AS bareword FROM o WINDOW w AS (PARTITION BY receipt_id ORDER BY line)),
    u AS (SELECT receipt_id, own AS total, text, c, 1 AS tier, -line AS rank FROM a WHERE own IS NOT NULL UNION ALL SELECT receipt_id, coalesce(nb, pb), CASE WHEN nb IS NOT NULL THEN text || ' ' || nt ELSE pt || ' ' || text END, CASE WHEN nb IS NOT NULL THEN (c + nc) / 2 ELSE (c + pc) / 2 END, 2, line FROM a WHERE own IS NULL AND bareword AND coalesce(nb, pb) IS NOT NULL)
    SELECT receipt_id, total, text, {r('c', 4)} AS confidence, tier FROM u QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY tier, rank) = 1""",
    "receipts",
)
def win15_find_total(t):
    return layout.find_total(_total_detections(t))


_OFF = "off AS (SELECT DISTINCT batch_id FROM f WHERE CAST(batch_id[2:] AS INTEGER) % 4 = 0)"


def _cancelled(t):
    return _files(t).select("batch_id").distinct().where("cast(substring(batch_id, 2) as int) % 4 = 0")


@query(
    f"""WITH {_FILES}, {_OFF}, l AS (SELECT batch_id, file_id, max_by(status, (ts, seq)) AS status FROM f GROUP BY ALL), s AS (SELECT batch_id, CASE WHEN batch_id IN (FROM off) AND status IN ('processing', 'pending') THEN 'skipped' ELSE status END AS status FROM l)
    SELECT batch_id, count(*) AS n_files, count(*) FILTER (status = 'done') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, {r("100.0 * count(*) FILTER (status NOT IN ('processing', 'pending')) / count(*)", 1)} AS pct FROM s GROUP BY batch_id"""
)
def stm15_cancelled_progress(t):
    return metrics.progress(_files(t), _cancelled(t))


@query(
    f"""WITH {_FILES}, {_OFF}, l AS (SELECT batch_id, file_id, max_by(status, (ts, seq)) AS status, min(ts) AS a, max(ts) AS b FROM f GROUP BY ALL), g AS (SELECT batch_id, min(a) AS created_at, max(b) AS b, count(*) AS total, count(*) FILTER (status NOT IN ('processing', 'pending')) AS processed, count(*) FILTER (status = 'failed') AS bad, count(*) FILTER (status = 'processing') AS busy FROM l GROUP BY batch_id)
    SELECT batch_id, created_at, CASE WHEN batch_id IN (FROM off) THEN 'cancelled' WHEN bad = total THEN 'failed' WHEN processed = total THEN 'completed' WHEN processed + busy > 0 THEN 'processing' ELSE 'pending' END AS state, processed, total FROM g WHERE b >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2880 MINUTES ORDER BY created_at DESC, batch_id LIMIT 50"""
)
def stm12_batch_states(t):
    return metrics.batch_states(_files(t), _cancelled(t), "2024-01-30 12:00:00", 2880)


@query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00'")
def snk22_kept_days(t):
    return writers.kept_days(t.raw("events").select(F.col("ts").alias("day")), "2024-01-20", 7)


@query("SELECT 'session' AS record, event_type AS session, NULL::VARCHAR AS created_at, count(*) AS n_samples, NULL::VARCHAR AS accuracy FROM events GROUP BY event_type")
def snk21_session_records(t):
    d = t.raw("events").groupBy(F.col("event_type").alias("session")).agg(F.count("*").alias("n_samples"))
    return writers.record(d, "session")


def _corrected(t):
    return t.items.where("receipt_id % 5 = 0").select("receipt_id", "pos", F.when(F.col("pos") % 3 == 0, F.concat("product_code", F.lit("X"))).otherwise(F.lower("product_code")).alias("product_code"), (F.col("quantity") + F.when(F.col("pos") % 4 == 0, 1).otherwise(0)).alias("quantity"))


_FIXED = "z AS (SELECT receipt_id, pos, product_code AS o, quantity AS oq, CASE WHEN pos % 3 = 0 THEN product_code || 'X' ELSE lower(product_code) END AS c, quantity + CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END AS cq FROM items WHERE receipt_id % 5 = 0)"


@query(f"WITH {_FIXED} SELECT receipt_id, pos AS nth, CASE WHEN pos <= 4 THEN o END AS original_code, c AS corrected_code, CASE WHEN pos <= 4 THEN oq END AS original_qty, cq AS corrected_qty FROM z WHERE pos > 4 OR pos % 3 = 0 OR pos % 4 = 0", "items")
def snk27_corrections(t):
    return writers.corrected_sample(t.items.where("pos <= 4"), _corrected(t))[1]


@query(f"WITH {_FIXED} SELECT receipt_id, receipt_id || '.jpg' AS image_file, string_agg(c || ':' || CAST(cq AS INTEGER), ',' ORDER BY pos) AS items, sum(cq) AS total_quantity, 'handwritten' AS receipt_type, '' AS notes FROM z GROUP BY receipt_id", "items")
def snk27_labels(t):
    rows = writers.corrected_sample(t.items, _corrected(t))[0]
    return rows.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat(x["code"], F.lit(":"), x["quantity"].cast("int").cast("string"))), ","))


# ---- files as (file, content), message bodies and the health machine ------------------------------------------


def _json_files(t, name, content):
    return t.raw(name).select(F.concat(F.lit("f"), F.col(t.raw(name).columns[0]).cast("string")).alias("file"), content.alias("content"))


@query("SELECT 'r' || p_partkey AS receipt_id, p_brand || '.jpg' AS image_file, CAST(p_size AS DOUBLE) AS total_quantity, p_brand IN (SELECT p_brand FROM part WHERE p_partkey <= 10) AS image_exists FROM part WHERE p_partkey % 4 > 0")
def src7_label_files(t):
    k = F.col("p_partkey")
    good = F.to_json(F.struct(F.concat(F.lit("r"), k).alias("receipt_id"), F.concat("p_brand", F.lit(".jpg")).alias("image_file"), F.col("p_size").cast("double").alias("total_quantity")))
    files = _json_files(t, "part", F.when(k % 4 == 0, F.concat(F.lit("{broken "), k)).otherwise(good))
    listing = t.raw("part").where("p_partkey <= 10").select(F.concat(F.lit("/a/b/"), "p_brand", F.lit(".jpg")).alias("path"))
    return readers.labels_of(files, listing).select("receipt_id", "image_file", "total_quantity", "image_exists")


@query("SELECT CASE WHEN p_partkey % 5 > 0 THEN 's' || p_partkey END AS session, CASE WHEN p_partkey % 5 > 0 THEN p_size / 100.0e0 END AS f1, 'f' || p_partkey AS file FROM part")
def src8_result_files(t):
    k = F.col("p_partkey")
    good = F.to_json(F.struct(F.concat(F.lit("s"), k).alias("session"), (F.col("p_size") / 100.0).alias("f1")))
    return readers.results_of(_json_files(t, "part", F.when(k % 5 == 0, "[").otherwise(good))).select("session", "f1", "file")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'purchase' THEN 'prebuilt-receipt' ELSE 'prebuilt-read' END AS model, CAST(event_id % 3 + 1 AS INTEGER) AS pages, event_id % 2 = 0 AS success FROM events WHERE user_id % 10 > 0")
def src9_usage_ledgers(t):
    u = t.usage.join(t.raw("events").select(F.col("event_id").alias("call_id"), "user_id"), "call_id")
    call = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "model", "pages", (F.col("call_id") % 2 == 0).alias("success"), F.lit(0.01).alias("cost"))
    days = u.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.struct(F.collect_list(call).alias("calls")).alias("d"))
    ledger = days.groupBy("user_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("day", "d"))).alias("days"))).alias("content"))
    files = ledger.select(F.concat(F.lit("u"), "user_id").alias("file"), F.when(F.col("user_id") % 10 == 0, "{").otherwise(F.col("content")).alias("content"))
    return readers.usage_of(files).select("day", "model", "pages", "success")


@query("SELECT 'ocr_char_subs' AS kind, 'a' || n_nationkey AS ch_from, n_name AS ch_to FROM nation WHERE n_nationkey % 4 > 0 UNION ALL SELECT 'handwriting_subs', 'h', n_name FROM nation WHERE n_nationkey % 4 > 0 AND n_nationkey % 3 = 0")
def src10_rule_files(t):
    k = F.col("n_nationkey")
    hand = F.when(k % 3 == 0, F.create_map(F.lit("h"), F.col("n_name")))
    body = F.to_json(F.struct(F.create_map(F.concat(F.lit("a"), k), F.col("n_name")).alias("ocr_char_subs"), hand.alias("handwriting_subs")))
    return readers.rules_of(_json_files(t, "nation", F.when(k % 4 == 0, "no rules").otherwise(body)))


@query("SELECT 'h' || event_id AS sha256, event_type AS result FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOURS")
def src11_cache_lines(t):
    row = F.to_json(F.struct(F.concat(F.lit("h"), "event_id").alias("sha256"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("cached_at"), F.col("event_type").alias("result")))
    lines = t.raw("events").select(row.alias("value")).union(t.spark.createDataFrame([("{",), ("",)], "value string"))
    return readers.cache_of(lines, "2024-01-20 12:00:00").select("sha256", "result")


@query("SELECT '/in/' || p_partkey || ['.jpg', '.txt', '.PNG', '', '.jpeg.bak', '.webp'][p_partkey % 6 + 1] AS path FROM part WHERE p_partkey % 6 IN (0, 2, 5)")
def src12_picture_listing(t):
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".txt", ".PNG", "", ".jpeg.bak", ".webp")]), (k % 6 + 1).cast("int"))
    return readers.listed_images(t.raw("part").select(F.concat(F.lit("/in/"), k, ending).alias("path")))


@query("SELECT CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'ERROR' ELSE 'UNKNOWN' END AS level, CASE event_id % 3 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'plain ' || event_id ELSE 'odd ' || event_id END AS message, CASE WHEN event_id % 3 = 0 THEN CAST(200 + event_id % 300 AS INTEGER) END AS status FROM events")
def src20_log_lines(t):
    k = F.col("event_id")
    j = F.to_json(F.struct(F.upper("event_type").alias("level"), F.concat(F.lit("m"), k).alias("message"), (F.lit(200) + k % 300).alias("status")))
    line = F.when(k % 3 == 0, j).when(k % 3 == 1, F.concat(F.lit("2024-01-01 10:00:00,123 | ERROR | plain "), k)).otherwise(F.concat(F.lit("odd "), k))
    return stateful.tail_logs(t.raw("events").select(line.alias("value"))).select("level", "message", "status")


_EVAL = """n AS (SELECT seq, client_key, epoch(ts) AS sec, row_number() OVER w AS n, count(*) FILTER (status_code >= 500) OVER f AS e, count(*) OVER f AS k, list(latency_ms) OVER f AS l FROM requests WINDOW w AS (PARTITION BY client_key ORDER BY ts, seq), f AS (PARTITION BY client_key ORDER BY ts, seq ROWS 19 PRECEDING)),
    e AS (SELECT seq, client_key, sec, n // 4 AS j, CASE WHEN e >= k * 0.3e0 OR list_sort(l)[least(CAST(floor(k * 0.95e0) AS INTEGER) + 1, k)] >= 25000 THEN 'critical' WHEN e >= k * 0.1e0 OR list_sort(l)[least(CAST(floor(k * 0.95e0) AS INTEGER) + 1, k)] >= 10000 THEN 'degraded' ELSE 'healthy' END AS target, k FROM n WHERE n % 4 = 0),
    st AS (SELECT DISTINCT client_key, 0::BIGINT AS j, NULL::BIGINT AS seq, 'healthy' AS state, -1e18 AS changed FROM e UNION ALL SELECT e.client_key, e.j, e.seq, CASE WHEN e.k >= 5 AND e.sec - st.changed >= 40000 THEN e.target ELSE st.state END, CASE WHEN e.k >= 5 AND e.sec - st.changed >= 40000 AND e.target <> st.state THEN e.sec ELSE st.changed END FROM st JOIN e ON e.client_key = st.client_key AND e.j = st.j + 1)"""


@query(f"WITH {_EVAL} SELECT seq, client_key, state FROM st WHERE j > 0", "requests")
def stm2_health_machine(t):
    return stateful.health_batch(t.requests, "client_key", every=4, frame=20, cooldown_s=40_000.0)


_SQL["stm2_health_machine"] = _SQL["stm2_health_machine"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'firing' ELSE 'resolved' END AS status, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'high' END AS severity, 's' || event_id AS summary FROM events WHERE event_id % 5 > 0")
def stm14_webhook_alerts(t):
    k = F.col("event_id")
    labels = F.when(k % 3 == 0, F.create_map(F.lit("alertname"), F.col("event_type"))).otherwise(F.create_map(F.lit("alertname"), F.col("event_type"), F.lit("severity"), F.lit("high")))
    alert = F.struct(F.when(k % 4 != 0, F.when(k % 2 == 0, "firing").otherwise("resolved")).alias("status"), labels.alias("labels"), F.create_map(F.lit("summary"), F.concat(F.lit("s"), k)).alias("annotations"))
    body = F.to_json(F.struct(F.lit("firing").alias("status"), F.array(alert).alias("alerts")))
    return stateful.alerts(t.raw("events").select(F.when(k % 5 == 0, "{}").otherwise(body).alias("value"))).select("status", "name", "severity", "summary")


@query(
    """WITH g AS (SELECT receipt_id AS k, count(*) AS n, avg(confidence) AS c FROM items GROUP BY receipt_id), f AS (SELECT *, ['auto', 'local', 'azure', 'speculative', NULL][k % 5 + 1] AS mode, n >= 4 AND c >= CASE WHEN k % 2 = 0 THEN 0.85e0 ELSE 0.88e0 END AND (k % 9) / 10.0e0 >= 0.3e0 AS good, k % 17 = 0 AS cached, k % 13 = 0 AS bad, k % 11 = 0 AS none, k % 7 = 0 AS poor, k % 3 = 0 AS failed FROM g)
    SELECT k AS receipt_id, CASE WHEN mode = 'local' THEN 'local' WHEN mode = 'azure' THEN CASE WHEN cached THEN 'azure-only-cached' ELSE 'azure-only' END WHEN cached THEN 'auto-cached' WHEN mode = 'speculative' THEN CASE WHEN good THEN 'speculative-local-skip' WHEN poor OR none OR failed THEN 'speculative-fallback-local' ELSE 'speculative-azure-direct' END
        WHEN bad THEN 'auto-quality-gate' WHEN none THEN 'auto-local-only' WHEN good THEN 'auto-local-skip' WHEN poor THEN 'auto-usage-limited' WHEN failed THEN 'auto-fallback-local' ELSE 'auto' END AS strategy FROM f""",
    "items",
)
def src21_strategy(t):
    k = F.col("receipt_id")
    g = (i := t.stored_items).groupBy("receipt_id").agg(F.count("*").alias("n_detections"), mean(i, "confidence").alias("calibrated"))
    mode = F.element_at(F.array(F.lit("auto"), F.lit("local"), F.lit("azure"), F.lit("speculative"), F.lit(None)), (k % 5 + 1).cast("int"))
    d = g.select("*", mode.alias("mode"), (k % 2 == 0).alias("is_structured"), (k % 9 / 10.0).alias("catalog_rate"), (k % 17 == 0).alias("cached"), (k % 13 != 0).alias("quality_ok"), (k % 11 != 0).alias("cloud"), (k % 7).alias("budget_left"), (k % 3 != 0).alias("cloud_ok"))
    return verify.strategy(d).select("receipt_id", "strategy")
