"""The engine's tables as views over the driver's star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def half_up(c: Column, places: int) -> Column:
    """Rounding by floor, the same in every engine."""
    return F.floor(c * F.lit(float(10**places)) + F.lit(0.5)) / F.lit(float(10**places))


def mean(df: DataFrame, c: str) -> Column:
    """Mean of a column within a group, in the order of a column _at if the table has one: the last bits of a sum depend on its order, and thresholds on them."""
    if "_at" not in df.columns:
        return F.avg(c)
    xs = F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c).cast("double").alias("v"))))), lambda x: x["v"])
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v), F.size(xs))


#: Beginnings, middles and ends of noisy lines; their numbers have no common divisor.
NOISE = (
    ("ABC", "5", "Io", "MNO", "12.", "x7", "PEPW", "2)", "q", ""),
    ("- 3", "I0", "4", "240", "& 3T", "7qt", "lo", "-axk", "x 4", ": 5", "20"),
    ("", "qt", "9", "-2", "V", "1000", "IOQt"),
)
#: Codes of the tables' catalog, which begin with one letter.
CATALOG_CODE = "P[0-9]{1,9}"


class Tables:
    """Lazily built views; every access is a new scan with its own pruned columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("product_code"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
            F.col("p_brand").alias("unit"), F.col("p_retailprice").alias("unit_price"), (F.col("p_size") % 10 != 0).alias("is_active"),
        )

    @property
    def receipts(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("REC-"), "o_orderkey").alias("receipt_number"), F.to_date("o_orderdate").alias("scan_date"),
            F.concat(F.lit("Store "), "o_custkey").alias("store_name"), F.col("o_totalprice").alias("bill_total"),
            F.col("o_orderstatus").alias("processing_status"), F.col("o_orderdate").alias("created_at"),
        )

    @staticmethod
    def _item_columns() -> dict[str, Column]:
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
        columns = {
            "receipt_id": F.col("l_orderkey"), "pos": F.row_number().over(order), "product_code": F.concat(F.lit("P"), "l_partkey"),
            "quantity": F.col("l_quantity"), "unit_price": F.col("l_extendedprice") / F.col("l_quantity"), "line_total": F.col("l_extendedprice"),
            "confidence": 1 - 5 * F.col("l_discount"), "manually_edited": F.col("l_returnflag") == "R",
        }
        return {name: c.alias(name) for name, c in columns.items()}

    @property
    def items(self) -> DataFrame:
        return self.raw("lineitem").select(*self._item_columns().values())

    @property
    def stored_items(self) -> DataFrame:
        """items without pos, but with their place in the table (_at)."""
        raw = self.raw("lineitem")
        at = F.col("_metadata.row_index")
        at = at if len(raw.inputFiles()) < 2 else F.struct(F.col("_metadata.file_path").alias("file"), at.alias("row"))
        placed = raw.select("*", at.alias("_at"))
        return placed.select(*[c for name, c in self._item_columns().items() if name != "pos"], "_at")

    @property
    def corrections(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("receipt_id"), F.concat(F.lit("C"), F.col("l_partkey") % 50).alias("original_code"),
            F.concat(F.lit("C"), (F.col("l_partkey") + F.col("l_linenumber") % 3) % 50).alias("corrected_code"),
            F.col("l_quantity").alias("original_qty"), (F.col("l_quantity") + F.col("l_linenumber") % 2).alias("corrected_qty"), F.col("l_shipdate").alias("created_at"),
        )

    @property
    def logs(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("receipt_id"), F.col("event_type").alias("stage"),
            F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"), "ts",
        )

    @property
    def requests(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("seq"), "ts", F.concat(F.lit("ip"), "user_id").alias("client_key"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.col("value").alias("latency_ms"),
        )

    @property
    def usage(self) -> DataFrame:
        model = F.when(F.col("event_type") == "purchase", "prebuilt-receipt").otherwise("prebuilt-read")
        return self.raw("events").select(F.col("event_id").alias("call_id"), "ts", model.alias("model"), (F.col("event_id") % 3 + 1).cast("int").alias("pages"))

    @property
    def lines(self) -> DataFrame:
        """Noisy text lines of every receipt's items."""
        t = self.items
        k = F.col("pos") % 5
        q, rate, amount = F.col("quantity").cast("int"), F.floor("unit_price").cast("long"), F.floor("unit_price").cast("long") * F.col("quantity").cast("int")
        text = (
            F.when(k == 0, F.concat_ws("  ", "product_code", q, rate, amount))
            .when(k == 1, F.concat_ws(" - ", "product_code", q))
            .when(k == 2, F.concat(F.col("pos"), F.lit(". "), F.col("product_code"), F.lit(" x "), q))
            .when(k == 3, F.concat(F.col("product_code"), F.lit("   "), q, F.lit(" pcs")))
            .otherwise(F.concat(F.lower("product_code"), F.lit(" "), q))
        )
        return t.select("receipt_id", F.col("pos").alias("line_no"), text.alias("text"), "confidence", (F.lit(40.0) * F.col("pos")).alias("y_center"), "product_code", "quantity")

    @property
    def noisy(self) -> DataFrame:
        """Short lines of misread codes, numbers and marks, in all combinations of NOISE."""
        k = F.col("p_partkey").cast("int")
        part = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k % len(xs) + 1)
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", *[part(xs) for xs in NOISE]).alias("text"))

    @property
    def total_lines(self) -> DataFrame:
        k = F.col("o_orderkey") % 5
        n = F.col("o_orderkey") % 97 + 1
        text = (
            F.when(k == 0, F.concat(F.lit("Total Qty: "), n))
            .when(k == 1, F.concat(F.lit("TOTAL - "), n))
            .when(k == 2, F.concat(F.lit("Total Items: "), n))
            .when(k == 3, F.concat(F.lit("Grand Total Rs. "), F.col("o_orderkey") % 9000 + 100, F.lit(".50")))
            .otherwise(F.concat(F.lit("Tota1 Quantity "), n))
        )
        return self.raw("orders").select(F.col("o_orderkey").alias("receipt_id"), F.lit(99).alias("line_no"), text.alias("text"))

    @property
    def date_lines(self) -> DataFrame:
        k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
        text = (
            F.when(k == 0, F.concat(F.lit("Date: "), F.date_format(d, "dd/MM/yyyy")))
            .when(k == 1, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 2, F.concat(F.lit("Dated "), F.date_format(d, "dd-MM-yyyy")))
            .otherwise(F.concat(F.lit("on "), F.date_format(d, "dd.MM.yyyy"), F.lit(" paid")))
        )
        return self.raw("orders").select(F.col("o_orderkey").alias("receipt_id"), F.lit(1).alias("line_no"), text.alias("text"))

    @property
    def hashes(self) -> DataFrame:
        """64 pixel values of each picture, with a time and a fingerprint."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pixels"), (F.lit(1704067200) + F.col("vec_id") * 60).alias("at_s"), F.concat(F.lit("f"), F.col("vec_id") % 40).alias("fingerprint")
        )


#: The same views as common table expressions; each query takes those it names.
SQL = {
    "products": "SELECT 'P' || p_partkey AS product_code, p_name AS product_name, p_type AS category, p_brand AS unit, p_retailprice AS unit_price, (p_size % 10 <> 0) AS is_active FROM part",
    "receipts": "SELECT o_orderkey AS id, 'REC-' || o_orderkey AS receipt_number, CAST(o_orderdate AS DATE) AS scan_date, 'Store ' || o_custkey AS store_name, o_totalprice AS bill_total, o_orderstatus AS processing_status, o_orderdate AS created_at FROM orders",
    "items": "SELECT l_orderkey AS receipt_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS INTEGER) AS pos, 'P' || l_partkey AS product_code, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total, 1 - 5 * l_discount AS confidence, (l_returnflag = 'R') AS manually_edited FROM lineitem",
    "corrections": "SELECT l_orderkey AS receipt_id, 'C' || (l_partkey % 50) AS original_code, 'C' || ((l_partkey + l_linenumber % 3) % 50) AS corrected_code, l_quantity AS original_qty, l_quantity + l_linenumber % 2 AS corrected_qty, l_shipdate AS created_at FROM lineitem",
    "logs": "SELECT event_id AS id, user_id AS receipt_id, event_type AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS duration_ms, ts FROM events",
    "requests": "SELECT event_id AS seq, ts, 'ip' || user_id AS client_key, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS latency_ms FROM events",
    "usage": "SELECT event_id AS call_id, ts, CASE WHEN event_type = 'purchase' THEN 'prebuilt-receipt' ELSE 'prebuilt-read' END AS model, CAST(event_id % 3 + 1 AS INTEGER) AS pages FROM events",
    "lines": "SELECT receipt_id, pos AS line_no, CASE pos % 5 WHEN 0 THEN product_code || '  ' || CAST(quantity AS INTEGER) || '  ' || CAST(floor(unit_price) AS BIGINT) || '  ' || CAST(floor(unit_price) AS BIGINT) * CAST(quantity AS INTEGER) WHEN 1 THEN product_code || ' - ' || CAST(quantity AS INTEGER) WHEN 2 THEN pos || '. ' || product_code || ' x ' || CAST(quantity AS INTEGER) WHEN 3 THEN product_code || '   ' || CAST(quantity AS INTEGER) || ' pcs' ELSE lower(product_code) || ' ' || CAST(quantity AS INTEGER) END AS text, confidence, 40.0 * pos AS y_center, product_code, quantity FROM items",
    "total_lines": "SELECT o_orderkey AS receipt_id, 99 AS line_no, CASE o_orderkey % 5 WHEN 0 THEN 'Total Qty: ' || (o_orderkey % 97 + 1) WHEN 1 THEN 'TOTAL - ' || (o_orderkey % 97 + 1) WHEN 2 THEN 'Total Items: ' || (o_orderkey % 97 + 1) WHEN 3 THEN 'Grand Total Rs. ' || (o_orderkey % 9000 + 100) || '.50' ELSE 'Tota1 Quantity ' || (o_orderkey % 97 + 1) END AS text FROM orders",
    "date_lines": "SELECT o_orderkey AS receipt_id, 1 AS line_no, CASE o_orderkey % 4 WHEN 0 THEN 'Date: ' || strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'Dated ' || strftime(o_orderdate, '%d-%m-%Y') ELSE 'on ' || strftime(o_orderdate, '%d.%m.%Y') || ' paid' END AS text FROM orders",
    "hashes": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS pixels, 1704067200 + vec_id * 60 AS at_s, 'f' || (vec_id % 40) AS fingerprint FROM embeddings",
}
SQL["noisy"] = "SELECT p_partkey AS id, " + " || ' ' || ".join("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + f"][p_partkey % {len(xs)} + 1]" for xs in NOISE) + " AS text FROM part"
_NEEDS = {"lines": ["items"]}


def with_views(sql: str, *views: str) -> str:
    """A query in front of which the named views are defined."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
