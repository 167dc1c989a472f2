from __future__ import annotations

import itertools
import math
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import dates as D
from tallyweave.functions import match as M
from tallyweave.functions import quantity as QT
from tallyweave.functions import text as X
from tallyweave.operators import catalog as C
from tallyweave.operators import dedup, layout, learn, matching, metrics, verify
from tallyweave.operators import receipts as R
from tallyweave.plans.fixtures import half_up

CATALOG = {"ABC": "a", "TEW1": "t", "TEW10": "t", "PEPW1": "p", "PEPW10": "p", "PEPW20": "p", "XYZ": "x"}


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("code", "want"),
    [("ABC", ("ABC", "exact")), ("abc ", ("ABC", "exact")), ("PEPW1O", ("PEPW10", "ambiguous_oi")), ("TEW2O", ("TEW10", "fuzzy")), ("PEPW2O", ("PEPW20", "exact")), ("TEWI", ("TEW1", "exact")), ("TEW1I", ("TEW1", "exact")), ("A8C", ("ABC", "exact")), ("ZZZZZZ", (None, "unknown"))],
)
def test_code_tiers(code, want):
    assert M.map_code(code, CATALOG) == want


def test_match_codes_equals_function(spark):
    codes = ["ABC", "PEPW1O", "xyz", "QQQQ", "PEPWW20", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    cat = spark.createDataFrame([(c,) for c in CATALOG], "product_code string")
    got = {r[0]: (r[1], r[2]) for r in matching.match_codes(df, cat).collect()}
    assert got == {c: M.map_code(c, CATALOG) if c else (None, "unknown") for c in codes}


def test_dates(spark):
    texts = ["Date: 15/03/2026", "2026-03-15", "15 Mar 2026", "March 15, 2026", "31/02/2026", "no date", "45/13/2026", None]
    assert column(spark, texts, D.find_date) == ["2026-03-15"] * 4 + ["2026-02-31", None, None, None]
    assert column(spark, texts, lambda c: D.find_date(c, True))[4] is None


def test_date_keyword_wins(spark):
    lines = spark.createDataFrame([(1, 1, "01/01/2025"), (1, 2, "Date: 15/03/2026")], "receipt_id long, line_no int, text string")
    assert layout.pick_date(lines).head()["date"] == "2026-03-15"


def items_of(spark, lines):
    return [(r and (r.code, r.quantity)) for r in column(spark, lines, X.parse_item)]


def test_item_lines(spark):
    lines = ["CODE - 3", "hello", "ABC", "ABC x 4", "7 ABC", "ABC: 5", "???", "", None]
    got = [(r and (r.code, r.quantity)) for r in column(spark, lines, lambda c: X.parse_item(X.clean(c)))]
    assert got == [("CODE", 3.0), ("HELLO", 1.0), ("ABC", 1.0), ("ABC", 4.0), ("ABC", 7.0), ("ABC", 5.0), None, None, None]


def test_item_forms_by_rule(spark):
    want = {
        "5 MNO I0": ("MNO", 10.0), "1 ABc 2": ("ABC", 2.0), "ABC I0": ("ABC", 10.0), "ABC lo": ("ABC", 10.0), "GHI (6)": ("GHI", 6.0), "ABC: 2.5": ("ABC", 2.5), "TEW1O 5": ("TEW1O", 5.0), "ABC \u00d7 3": ("ABC", 3.0), "ABC \u2014 3": ("ABC", 3.0),
        "ABC 240": ("ABC", 1.0), "ABC 0": ("ABC", 1.0), "ABC 50": ("ABC", 50.0), "ABC 2.26": ("ABC", 2.3),  # clamped to (0, 50], one place
        "qty 5": None, "iqt 3": None, "pcs 4": None,  # marks aren't codes
        "see ABC 4 here": ("ABC", 4.0),  # found anywhere in the line
        "ABC IO": ("ABC", 10.0), "12 Paint": ("PAINT", 12.0),
    }
    assert dict(zip(want, items_of(spark, list(want)), strict=True)) == want


def test_code_and_number_may_be_one_code(spark):
    lines = spark.createDataFrame([(1, "PEPW 20"), (2, "PEPW 21"), (3, "ABC 2.5"), (4, "TEW1 4"), (5, "?")], "i int, text string")
    catalog = spark.createDataFrame([("PEPW20",), ("PEPW20",), ("TEW14",)], "product_code string")
    got = {r.i: (r.code, r.quantity) for r in matching.parse_items(lines, catalog).collect()}
    assert got == {1: ("PEPW20", 1.0), 2: ("PEPW", 21.0), 3: ("ABC", 2.5), 4: ("TEW1", 4.0), 5: (None, None)}


def test_roles(spark):
    pairs = [("ABC", "3"), ("3", "abc"), ("ABC", "IO"), ("IO", "ABC"), ("3", "4"), ("ABC", "xyz"), ("A1", "2"), ("ABC", "0"), ("ABC", "OO")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "i int, a string, b string")
    c, q = X.roles(F.col("a"), F.col("b"))
    got = [(r[0], r[1]) for r in df.orderBy("i").select(c, q).collect()]
    assert got == [("ABC", 3.0), ("ABC", 3.0), ("ABC", 10.0), (None, None), (None, None), (None, None), (None, None), ("ABC", 0.0), (None, None)]


def test_priced_lines(spark):
    got = column(spark, ["TEW1 3 250 750", "TEW1 3 250 999", "1 TEW1 3 250.00 750.00"], X.parse_priced)
    assert [g and (g.code, g.quantity, g.amount) for g in got] == [("TEW1", 3.0, 750.0), None, ("TEW1", 3.0, 750.0)]


def test_priced_forms_by_rule(spark):
    lines = ["ABC 2 @ 10 20", "ABC 2x10=20", "ABC 0.5 10 5", "ABC 1000 1 1000", "ABC 2 0.5 1", "see TEW1 3 250.00 750.00 there", "ABC 2 10 22.9", "ABC 2 10 23", None]
    got = column(spark, lines, X.parse_priced)
    assert [g and (g.code, g.quantity, g.rate, g.amount) for g in got] == [("ABC", 2.0, 10.0, 20.0), ("ABC", 2.0, 10.0, 20.0), None, None, None, ("TEW1", 3.0, 250.0, 750.0), ("ABC", 2.0, 10.0, 22.9), None, None]
    glued = {"TEW1 1 180 0 3600": "TEW1 1 1800 3600", "TEW1 3 250 750": "TEW1 3 250 750", "3 180 0": "3 180 0", "ABC 32 00": "ABC 3200", "ABC 10 5 20 5": "ABC 105 205"}
    assert dict(zip(glued, column(spark, list(glued), X.glue_numbers), strict=True)) == glued


def test_skipped_lines_by_rule(spark):
    skipped = ["", "  ", "&", "7", " 12 ", "Iqt", "Date: 1", "Thank you", "12/03/24", "10:45 am", "#####", "Items", "Ltewu", "shop", "qly", "(NUMBER ONLY)", "S.No", "Receipt #", "Total Items: 5", "Item Code  Qty", "Total 5", "Bill Total 9", None]
    kept = ["ABC 2", "x", "Paint", "523", "hello", "ABC"]
    assert all(column(spark, skipped, X.is_skipped)) and not any(column(spark, kept, X.is_skipped))


def test_totals(spark):
    lines = ["Total Qty: 11", "Grand Total 25", "Sub Total: 7", "TOTAL = 9", "Sum: 4", "Total 0", "Total Items: 8", "Tota1 Quantity 12"]
    assert column(spark, lines, X.total_value) == [11.0, 25.0, 7.0, 9.0, 4.0, None, None, 12.0]
    assert column(spark, lines, X.is_total)[6] is False


def test_quantities(spark):
    decoded = {"3": 3, "10": 10, "I0": 10, "Io1f": 10, "Iq": 1, "": None, "1234567": None, "abc": None, "|": 1, "!": 1, "S": None, "Z2": None, "123": 12, "1000": None, "0012": 12, "00123": 1, "0": None, "1,0": 10, "x": None, "lO": 10, "999": 99}
    assert dict(zip(decoded, column(spark, list(decoded), X.decode_quantity), strict=True)) == decoded
    dashed = {"-3qt": 3, "-": None, "-aqt": 2, "-5": 5, "-axk": 2, "-gqt": 9, "-b": 6, "-B": 8, "-T": 7, "-'": 3, "-lo": 10, "-o": None, "-zz": None, "-q1240": 1240, "\u2014 7": 7, "zz": None, "-}": 3}
    assert dict(zip(dashed, column(spark, list(dashed), X.dash_quantity), strict=True)) == dashed
    marked = {"3qt of 5 qty": 5, "none": None, "IOqt": 10, "3&T": 3, "3 4T x": 3, "3 4T": 4, "ABC - 7 tt": 7, "ABC 12Q.": 12, "1234qt": 234, "0qt": None, "'qt": 3, "}} Q1": 33, "2 qt 0qt": 2, "": None, None: None, "ABCt": None}
    assert dict(zip(marked, column(spark, list(marked), QT.marked_quantity), strict=True)) == marked
    free = {"CODE - 3": 3.0, "hello": 1.0, "ABC": 1.0, "10 200": 10.0, "200 300": 300.0, "ABC 4": 1.0, "ABC I0": 10.0, "ABC 7qt": 1.0, "x 12.": 12.0, "1000": 1.0, "ABC - 0 5": 5.0}
    assert dict(zip(free, column(spark, list(free), QT.free_quantity), strict=True)) == free
    beside = {"ABC 5": 5.0, "ABC Io1f": 10.0, "Iq ABC": 1.0, "ABC -axk": 2.0, "ABC V": 2.0, "V ABC": 1.0, "ABC q": 9.0, "xyz": 1.0, "ABC": 1.0, "lo ABC": 10.0}
    assert dict(zip(beside, column(spark, list(beside), lambda c: QT.quantity_beside(c, F.lit("abc"))), strict=True)) == beside
    assert column(spark, ["ABC V", "ABC q"], lambda c: QT.quantity_beside(c, F.lit("ABC"), F.array(F.lit("V")))) == [1.0, 9.0]
    lead = {"5 ABC": 1.0, "2 . def": 1.0, "3 GHI 1": 1.0, "7 - 4": 7.0, "6.": 6.0, "ABC": 1.0, "0 x": 1.0, "12 7": 12.0, "3) x - 8": 8.0, "": 1.0, None: 1.0}
    assert dict(zip(lead, column(spark, list(lead), X.stripped_number), strict=True)) == lead
    assert column(spark, ["A B C 2", "ABC 2"], QT.gather_letters) == ["ABC 2", "ABC 2"]


def test_calibration_by_rule(spark):
    want = {"a": 0.54, "AB": 0.72, "[[x": 0.4388, "1234567": 0.7088, "": 0.0, None: 0.0, "IIII": 0.6615, "TEW1": 0.9, "J1L{2": 0.72, "a{b}": 0.4388, "hello world": 0.9, "  ": 0.0, "12345 6": 0.675, "$$$$$": 0.3071}
    got = column(spark, list(want), lambda c: verify.calibrate(c, F.lit(0.9)))
    assert {k: round(v, 4) for k, v in zip(want, got, strict=True)} == want


def test_line_checks_and_quantity_flags(spark):
    rows = [(2.0, 10.0, 20.0), (2.0, 10.0, 20.1), (2.0, 10.0, 20.05), (1.0, 0.0, 5.0), (1.0, 5.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 1.02)]
    df = spark.createDataFrame(rows, "q double, r double, a double")
    got = [x[0] for x in df.select(verify.line_check_parser(F.col("q"), F.col("r"), F.col("a"))).collect()]
    assert got == ["ok", "mismatch", "ok", "trusted", "ok", "ok", "mismatch"]
    qs = spark.createDataFrame([(0.0, 5.0), (101.0, None), (101.0, 5.0), (1000.0, 5.0), (100.0, None), (1.0, None)], "q double, p double")
    got = [tuple(x) for x in qs.select(verify.sane_quantity(F.col("q"), F.col("p")), verify.odd_quantity(F.col("q"))).collect()]
    assert got == [(1.0, True), (1.0, True), (101.0, True), (1.0, True), (100.0, False), (1.0, False)]
    items = spark.createDataFrame([(1, 0.9, 2.0, "exact"), (2, 0.9, 2.0, "fuzzy"), (3, 0.9, 101.0, "exact"), (4, 0.55, 2.0, "exact"), (4, 1.0, 2.0, "exact"), (5, 0.95, 1.0, "exact"), (5, 0.4, 1.0, "exact"), (5, 1.0, 1.0, "exact")], "receipt_id long, confidence double, quantity double, match_type string").withColumns({"unit_price": F.lit(1.0), "line_total": F.col("quantity")})
    assert {r.receipt_id: r.needs_review for r in verify.receipt_flags(items).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_health_limits_count(spark):
    df = spark.createDataFrame([(k, f"2024-01-01 00:00:{k:02d}", "a", 500 if k < 3 else 200, 1.0) for k in range(40)], "seq long, t string, key string, status_code int, latency_ms double").withColumn("ts", F.to_timestamp("t"))
    got = {r.seq: r.state for r in metrics.rolling_health(df, "key").collect()}
    assert (got[3], got[9], got[29], got[30]) == ("healthy", "critical", "degraded", "healthy")  # 3 of 10 and 3 of 30 are the limits themselves
    slow = df.withColumns({"status_code": F.lit(200), "latency_ms": F.when(F.col("seq") == 5, 25_000.0).otherwise(10_000.0)})
    assert {r.seq: r.state for r in metrics.rolling_health(slow, "key").collect()}[5] == "critical"
    assert {r.seq: r.state for r in metrics.rolling_health(slow, "key").collect()}[4] == "degraded"


TOTAL_GOLDEN = [
    ([("Total Qty", 400, 0), ("11", 401, 90)], (11.0, "Total Qty 11", 1)),
    ([("Total Qty II", 400, 0)], (11.0, "Total Qty II", 1)),
    ([("Total Qtyt _", 400, 0), ("24", 450, 0)], (24.0, "Total Qtyt _ 24", 2)),
    ([("24", 350, 0), ("Total", 400, 0)], (24.0, "24 Total", 2)),
    ([("17", 350, 0), ("Total", 400, 0), ("24", 450, 0)], (24.0, "Total 24", 2)),  # the next line before the previous one
    ([("Grand Total 2500", 400, 0)], None),
    ([("Total Items: 5", 400, 0)], None),
    ([("Total 5", 380, 0), ("Sub Total: 9", 440, 0)], (9.0, "Sub Total: 9", 1)),  # the lowest line
    ([("Total Qty_ Total Qty_ 24", 400, 0)], (24.0, "Total Qty_ Total Qty_ 24", 1)),
    ([("Total 0", 400, 0)], (0.0, "Total 0", 1)),  # what follows the word is taken as it is
    ([("Totol O5", 400, 0)], (5.0, "Totol O5", 1)),
    ([("Total 9", 100, 0), ("footer", 990, 0)], None),  # above the lower part
    ([("Sum: 4", 400, 0)], (4.0, "Sum: 4", 1)),
    ([("nothing", 400, 0)], None),
]


def test_totals_from_the_bottom(spark):
    rows = [(k, n, float(x), float(y), text, 0.8) for k, (dets, _) in enumerate(TOTAL_GOLDEN) for n, (text, y, x) in enumerate(dets)]
    d = spark.createDataFrame(rows, "receipt_id long, det_id long, x double, y double, text string, confidence double")
    got = {r.receipt_id: (r.total, r.text, r.tier) for r in layout.find_total(d).collect()}
    assert got == {k: w for k, (_, w) in enumerate(TOTAL_GOLDEN) if w}


def test_dates_by_form(spark):
    rows = [(1, 1, "March 15, 2026"), (1, 2, "16/03/2026"), (2, 1, "2026-03-15"), (2, 2, "Dt 1 Jan 2025"), (3, 1, "on 01/01/2025"), (3, 2, "02/01/2025"), (4, 1, "01/01/1850"), (5, 1, "15-Mar-2026 paid"), (6, 1, "31/13/2026 2026-02-03")]
    lines = spark.createDataFrame(rows, "receipt_id long, line_no int, text string")
    got = {r.receipt_id: r.date for r in layout.pick_date(lines).collect()}
    assert got == {1: "2026-03-16", 2: "2025-01-01", 3: "2025-01-01", 5: "2026-03-15", 6: "2026-02-03"}


def test_similarity_and_alignment(spark):
    df = spark.createDataFrame([("PEPW10", "PEPW1O"), ("ABC", "XYZ"), (None, "A")], "a string, b string")
    got = [r[0] for r in df.select(M.similarity("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "PEPW10", "PEPW1O").ratio(), 0.0, None]
    assert M.align("TEW1", "TEWI") == [("T", "T"), ("E", "E"), ("W", "W"), ("1", "I")]
    assert M.align("AB", "AXB") == [("A", "A"), ("-", "X"), ("B", "B")]


@settings(max_examples=100, deadline=None)
@given(st.text("ABC1", max_size=7), st.text("ABC1", max_size=7))
def test_alignment_keeps_both_strings(a, b):
    z = M.align(a, b)
    assert "".join(x for x, _ in z if x != "-") == a and "".join(y for _, y in z if y != "-") == b


def test_variants_by_rule():
    v = M.variants("P1O")
    assert v[0] == "P1O" and "PIO" in v and "P10" in v and len(v) == len(set(v))
    assert M.variants("") == [""] and M.variants("xy") == ["XY"]
    # all signs; all signs and handwritten letters; one sign; one handwritten letter; all digits; one digit
    assert M.variants("6n") == ["6N", "GN", "GH", "6H"]
    assert M.variants("TEWI") == ["TEWI", "TCMI", "TCWI", "TEMI", "73W1", "7EWI", "T3WI", "TEW1", "73WI", "7EW1", "T3W1"]
    assert M.variants("A_B") == ["A_B", "AB", "OB", "O_B", "4_8", "4_B", "A_8"]
    many = M.variants("IIIIII")  # six places: no pairs
    assert "11IIII" not in many and "111111" in many and "1IIIII" in many
    capped = M.variants("ABGE")  # four places, but pairs only up to fifteen spellings
    assert len(capped) == 15
    assert M.variants("AB", {"A": "X"}, {"B": "9"}, {"AB": "ZZ"})[:2] == ["AB", "ZZ"] and {"XB", "A9"} <= set(M.variants("AB", {"A": "X"}, {"B": "9"}))


def test_merge_duplicates(spark):
    s = "receipt_id long, pos int, product_code string, quantity double, confidence double, unit_price double, line_total double"
    rows = [(1, 1, "ABC", 2.0, 0.90, 0.0, 0.0), (1, 2, "ABC", 3.0, 0.95, 0.0, 0.0), (2, 1, "ABC", 2.0, 0.9, 100.0, 200.0), (2, 2, "ABC", 3.0, 0.9, 0.0, 0.0), (3, 1, "ABC", 1.0, 0.9, 7.0, 8.0)]
    got = {r.receipt_id: r for r in R.merge_duplicates(spark.createDataFrame(rows, s)).collect()}
    assert (got[1].quantity, got[1].confidence, got[1].needs_review) == (5.0, 0.95, True)
    assert (got[2].unit_price, got[2].line_total) == (100.0, 500.0)
    assert (got[3].line_total, got[3].needs_review) == (8.0, False)


def _validated(spark, items, catalog=(), history=()):
    i = spark.createDataFrame(items, "receipt_id long, pos int, product_code string, quantity double, unit_price double, line_total double")
    p = spark.createDataFrame(list(catalog), "product_code string, unit_price double")
    h = spark.createDataFrame(list(history), "product_code string, avg_qty double, max_qty double")
    return verify.validate(i, p, h).orderBy("receipt_id", "pos").collect()


def test_validation_rules(spark):
    rows = _validated(
        spark,
        [(1, 1, "A", 0.0, 5.0, 0.0), (1, 2, "B", 101.0, 0.0, 0.0), (1, 3, "C", 2.0, 0.0, 0.0), (1, 4, "D", 1.0, 60.0, 60.0), (1, 5, "E", 1.0, 5.0, 5.0), (1, 6, "E", 1.0, 5.0, 5.0), (1, 7, "F", 31.0, 1.0, 31.0), (1, 8, "G", 2.0, 10.0, 25.0), (1, 9, "H", 100.0, 0.0, 0.0), (1, 10, "I", 1.0, 50.0, 50.0)],
        [("C", 9.0), ("D", 10.0), ("I", 10.0)],
        [("F", 5.0, 10.0)],
    )
    by = {r.product_code: r for r in rows if not (r.product_code == "E" and r.pos == 6)}
    assert by["A"].warnings == "high:zero_quantity" and by["A"].quantity == 1.0
    assert by["B"].warnings == "medium:suspicious_quantity" and by["H"].warnings == ""
    assert (by["C"].unit_price, by["C"].line_total, by["C"].warnings) == (9.0, 18.0, "")
    assert by["D"].warnings == "medium:price_deviation" and by["I"].warnings == ""  # the limit itself is allowed
    assert by["E"].warnings == "low:duplicate_item"
    assert by["F"].warnings == "medium:quantity_anomaly"
    assert by["G"].warnings == "medium:line_total_mismatch"


def test_dispute_ladder(spark):
    c = spark.createDataFrame([(k, 10.0, ic) for k, ic in [(1, 0.9), (2, 0.9), (3, 0.9), (4, 0.9), (5, 0.7), (6, 0.82), (7, 0.82), (8, 0.8)]], "receipt_id long, computed double, item_conf double")
    s = spark.createDataFrame(
        [(1, 10.0, 0.95, None), (2, 12.0, 0.9, 10.0), (3, 12.0, 0.9, 12.0), (4, 15.0, 0.8, None), (5, 15.0, 0.95, None), (6, 11.0, 0.86, None), (7, 15.0, 0.86, None)],
        "receipt_id long, total double, total_conf double, cloud_total double",
    )
    got = {r.receipt_id: (r.method, r.verified, round(r.confidence, 4), r.trusted_total) for r in verify.verify_totals(c, s).collect()}
    assert got[1] == ("exact", True, 0.95, 10.0) and got[2] == ("cloud_computed", True, 0.95, 10.0) and got[3] == ("cloud_stated", True, 0.85, 12.0)
    assert got[4] == ("items_trusted", True, 0.81, 10.0) and got[5] == ("total_trusted", True, 0.8075, 15.0)
    assert got[6] == ("small_gap", False, 0.602, 10.0) and got[7] == ("unresolved", False, 0.3, 10.0) and got[8][0] == "no_total"


def test_quality_score_bounds(spark):
    s = "avg_confidence double, n_items int, total_status string, math_status string, sharpness double, brightness double, catalog_rate double"
    df = spark.createDataFrame([(1.0, 5, "verified", "ok", 150.0, 100.0, 1.0), (0.0, 0, None, None, None, None, None), (0.5, 1, "mismatch", "bad", 30.0, 210.0, 0.5)], s)
    got = [(r.score, r.grade) for r in verify.quality_score(df).collect()]
    assert got == [(100.0, "A"), (12.0, "D"), (32.0, "D")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=2, max_size=2), st.integers(0, 5))
def test_bands_catch_five_bits(hs, n):
    a = hs[0]
    b = a
    for k in random.Random(hs[1]).sample(range(64), n):
        b ^= 1 << k
    mask = (1 << 64) - 1
    assert any(((a & mask) >> s) & ((1 << w) - 1) == ((b & mask) >> s) & ((1 << w) - 1) for s, w in dedup.BANDS)


def test_rolling_p95_is_not_percentile(spark):
    df = spark.createDataFrame([(k, f"2024-01-01 00:00:{k:02d}", "a", 200, float(k)) for k in range(60)], "seq long, t string, key string, status_code int, latency_ms double").withColumn("ts", F.to_timestamp("t"))
    got = {r.seq: r for r in metrics.rolling_health(df, "key").collect()}
    assert got[59].p95 == sorted(range(10, 60))[int(50 * 0.95)] and got[59].n == 50 and got[0].p95 == 0.0


def test_histogram_quantile_limits(spark):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [("b", 1e9)] * 3, "k string, v double")
    got = {r.k: r.value for r in metrics.histogram_quantile(metrics.histogram(df, "v", ["k"]), 0.5, ["k"]).collect()}
    assert got == {"a": 2.5, "b": 400.0}


def test_gap_lines_and_fragments(spark):
    rows = [(1, 1, 100.0, 10.0, "2", 0.9), (1, 2, 0.0, 12.0, "ABC", 0.8), (1, 3, 0.0, 60.0, "XYZ", 0.9), (1, 4, 50.0, 61.0, "[.", 0.1)]
    d = spark.createDataFrame(rows, "receipt_id long, det_id long, x double, y double, text string, confidence double")
    got = layout.join_fragments(layout.gap_lines(d)).orderBy("line_no").collect()
    assert [(r.text, r.line_no) for r in got] == [("ABC 2", 1), ("XYZ", 2)]


def test_running_mean_takes_shifted_digits(spark):
    rows = [(1, 1, 0.0, 10.0, "ABC"), (1, 2, 300.0, 44.0, "2"), (1, 3, 0.0, 60.0, "XYZ")]
    d = spark.createDataFrame(rows, "receipt_id long, det_id long, x double, y double, text string")
    t = spark.createDataFrame([(1, 30.0)], "receipt_id long, threshold double")
    assert [r.line_no for r in layout.running_mean_lines(d, t).orderBy("det_id").collect()] == [1, 1, 2]


def test_merge_code_lines(spark):
    rows = [(1, 1, "ABC", 10.0), (1, 2, "3", 20.0), (1, 3, "XYZ", 31.0), (1, 4, "Total 3", 50.0)]
    d = spark.createDataFrame(rows, "receipt_id long, line_no int, text string, y_center double")
    assert [r.text for r in layout.merge_code_lines(d).orderBy("line_no").collect()] == ["ABC 3", "XYZ", "Total 3"]


def test_ambiguous_codes_by_rule(spark):
    schema = "receipt_id long, pos int, product_code string, match_type string, raw_text string, needs_review boolean"
    rows = [
        (1, 1, "PEPW10", "exact", "PEPW10", False), (1, 2, "PEPW10", "ambiguous_oi", "PEPW1O", False), (1, 3, "PEPW10", "ambiguous_oi", "PEPW1O", False),
        (2, 1, "PEPW10", "ambiguous_oi", "PEPW1O", False), (2, 2, "PEPW10", "exact", "PEPW10", False), (2, 3, "PEPW1", "exact", "PEPW1", False),  # the shorter code is there
        (3, 1, "PEPW10", "exact", "PEPW10 2", False), (3, 2, "PEPW10", "exact", "pepw1o 3", False), (4, 1, "PEPW20", "ambiguous_oi", "PEPW2O", False), (4, 2, "PEPW20", "exact", "x", False), (5, 1, "PEPW10", "exact", None, None), (5, 2, "PEPW10", None, None, None),
    ]
    got = {(r.receipt_id, r.pos): (r.product_code, r.match_type, r.needs_review) for r in layout.resolve_ambiguous(spark.createDataFrame(rows, schema), spark.createDataFrame([(c,) for c in ("PEPW1", "PEPW10", "PEPW20")], "product_code string")).collect()}
    assert got[1, 1] == ("PEPW10", "exact", False) and got[1, 2] == ("PEPW1", "oi_resolved", True) and got[1, 3] == ("PEPW10", "ambiguous_oi", True)
    assert got[2, 1] == ("PEPW10", "ambiguous_oi", True) and got[3, 1][0] == "PEPW10" and got[3, 2] == ("PEPW1", "ocr_variant", False)
    assert got[4, 1] == ("PEPW20", "ambiguous_oi", True) and got[5, 2] == ("PEPW10", None, False)


def test_orphans_by_rule(spark):
    items = spark.createDataFrame([(1, 1, 1.0, 100.0, False), (1, 2, 1.0, 112.0, False), (1, 3, 4.0, 120.0, False), (2, 1, 1.0, 0.0, False), (3, 1, 1.0, 940.0, False)], "receipt_id long, pos int, quantity double, y double, needs_review boolean")
    numbers = spark.createDataFrame([(1, 106.0, 7.0), (1, 121.0, 1.0), (1, 122.0, 5.0), (1, 119.0, 1000.0), (2, 5.0, 3.0), (3, 1000.0, 8.0)], "receipt_id long, y double, value double")
    got = {(r.receipt_id, r.pos): (r.quantity, r.needs_review) for r in layout.attach_orphans(items, numbers).collect()}
    # 106 is as near to both: the first; 122 is then 10 from the second, over 6 % of 122; a place at 0 is none; 60 of 1000 is the limit itself
    assert got == {(1, 1): (7.0, True), (1, 2): (1.0, False), (1, 3): (4.0, False), (2, 1): (1.0, False), (3, 1): (1.0, False)}


def test_merge_code_lines_by_rule(spark):
    schema = "receipt_id long, line_no int, text string, y_center double, confidence double"
    rows = [
        (1, 1, "2", 10.0, 0.5), (1, 2, "ABC", 20.0, 0.7), (1, 3, "3 250 750", 30.0, 0.9),  # a tie: the previous line
        (2, 1, "ABC", 10.0, 0.8), (2, 2, "XYZ", 20.0, 0.8), (2, 3, "3 250 750", 30.0, 0.6), (2, 4, "7", 40.0, 0.6),
        (3, 1, "7", 10.0, 0.4), (3, 2, "8", 20.0, 0.4), (3, 3, "ABC", 30.0, 0.8), (3, 4, "XYZ", 40.0, 0.8),
    ]
    got = [(r.receipt_id, r.text, round(r.y_center, 3), round(r.confidence, 3)) for r in layout.merge_code_lines(spark.createDataFrame(rows, schema)).orderBy("receipt_id", "line_no").collect()]
    assert got == [(1, "ABC 2", 15.0, 0.6), (1, "3 250 750", 30.0, 0.9), (2, "ABC", 10.0, 0.8), (2, "XYZ 3 250 750", 25.0, 0.7), (2, "7", 40.0, 0.6), (3, "7", 10.0, 0.4), (3, "ABC 8", 25.0, 0.6), (3, "XYZ", 40.0, 0.8)]
    chain = [(1, 1, "ABC", 10.0, 0.8), (1, 2, "5", 11.0, 0.8), (1, 3, "6", 12.0, 0.8), (1, 4, "XYZ", 50.0, 0.8), (1, 5, "7", 51.0, 0.8)]
    assert [r.text for r in layout.merge_code_lines(spark.createDataFrame(chain, schema)).orderBy("line_no").collect()] == ["ABC 5", "6", "XYZ 7"]


def test_reading_order_by_rule(spark):
    schema = "receipt_id long, det_id long, x double, y double, text string, confidence double"
    rows = [
        (1, 1, 0.0, 10.0, "abc", 0.8), (1, 2, 0.0, 40.0, " ABC", 0.9), (1, 3, 0.0, 130.0, "ABC", 0.7),  # bands 0, 1, 2: the third is next to the kept second
        (1, 4, 0.0, 10.0, "1", 0.8), (1, 5, 0.0, 44.0, "1", 0.9), (1, 6, 0.0, 80.0, "1", 0.5),  # 34 px are one, 36 px from the kept one aren't
        (2, 1, 0.0, 10.0, "XYZ", 0.8), (2, 2, 0.0, 200.0, "XYZ", 0.9), (2, 3, 0.0, 10.0, None, 0.9),
    ]
    got = sorted((r.receipt_id, r.det_id) for r in layout.reading_order(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 2), (1, 5), (1, 6), (2, 1), (2, 2), (2, 3)]


def test_echoes_of_other_texts(spark):
    schema = "receipt_id long, det_id long, x double, y double, text string, confidence double"
    rows = [(1, 1, 10.0, 10.0, "TEWA", 0.8), (1, 2, 20.0, 12.0, "TEW4", 0.9), (1, 3, 39.9, 24.0, "q", 0.1), (1, 4, 40.0, 10.0, "far", 0.1), (1, 5, 10.0, 25.0, "low", 0.1)]
    got = sorted(r.det_id for r in layout.drop_echoes(spark.createDataFrame(rows, schema)).collect())
    assert got == [2, 4, 5]


def test_orphans_are_consumed(spark):
    items = spark.createDataFrame([(1, 1, "A", 1.0, 100.0), (1, 2, "B", 1.0, 140.0), (2, 1, "C", 1.0, 5.0)], "receipt_id long, pos int, product_code string, quantity double, y double")
    numbers = spark.createDataFrame([(1, 102.0, 7.0), (1, 1000.0, 9.0)], "receipt_id long, y double, value double")
    got = {(r.receipt_id, r.pos): r.quantity for r in layout.attach_orphans(items, numbers).collect()}
    assert got == {(1, 1): 7.0, (1, 2): 1.0, (2, 1): 1.0}


def test_echoes_and_reading_order(spark):
    rows = [(1, 1, 10.0, 10.0, "ABC", 0.8), (1, 2, 30.0, 12.0, "ABC", 0.9), (1, 3, 200.0, 12.0, "ABC", 0.7)]
    d = spark.createDataFrame(rows, "receipt_id long, det_id long, x double, y double, text string, confidence double")
    assert sorted(r.det_id for r in layout.drop_echoes(d).collect()) == [2, 3]
    assert [r.det_id for r in layout.reading_order(d).collect()] == [2]


def test_pairing_uses_each_once(spark):
    m = spark.createDataFrame([(1, "TEW1"), (1, "TEW4")], "receipt_id long, product_code string")
    e = spark.createDataFrame([(1, "TEWI"), (1, "QQQQQQQ")], "receipt_id long, product_code string")
    assert [(r.missing, r.extra) for r in matching.pair_confusions(m, e).collect()] == [("TEW1", "TEWI")]


def test_correction_map_threshold(spark):
    c = spark.createDataFrame([("A", "B"), ("A", "B"), ("C", "D"), ("E", "E")], "original_code string, corrected_code string")
    assert [(r.original_code, r.corrected_code, r.n) for r in learn.correction_map(c).collect()] == [("A", "B", 2)]
    assert learn.correction_map(c, 1).count() == 2


def test_promotion_uses_group_total(spark):
    pairs = spark.createDataFrame([("0", "O")] * 6 + [("0", "D")] * 4 + [("1", "I")] * 1 + [("5", "S")] * 5 + [("5", "B")] * 5, "ch_from string, ch_to string")
    got = {(r.ch_from, r.ch_to, r.kind) for r in learn.promote_rules(pairs).collect()}
    assert got == {("0", "O", "digit_to_letter")}


def test_products_merge(spark):
    s = "product_code string, product_name string, category string, unit string, unit_price double, is_active boolean"
    old = spark.createDataFrame([("A", "a", "c", "u", 1.0, True), ("B", "b", "c", "u", 2.0, False)], s)
    new = spark.createDataFrame([("a", "x", "c", "u", 9.0, True), ("b", "y", "c", "u", 8.0, True), ("C", "z", "c", "u", 7.0, True)], s)
    got = {r.product_code: (r.product_name, r.is_active) for r in C.add_products(old, new).collect()}
    assert got == {"A": ("a", True), "B": ("y", True), "C": ("z", True)}
    assert [r.product_code for r in C.rejected_products(old, new).collect()] == ["a"]


def test_half_up_is_plain(spark):
    values = [0.125, 2.5, 1e6 + 0.005, 0.0]
    assert column(spark, values, lambda c: half_up(c, 2), "double") == [math.floor(v * 100 + 0.5) / 100 for v in values]


def test_catalog_is_broadcast_only_if_small(spark):
    df = spark.range(10)
    assert "broadcast" in C.small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in C.small(df, 1)._jdf.queryExecution().logical().toString().lower()


def test_grid_and_trend(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1,), (2,), (3,)], "b int")
    want = [p for k, p in enumerate(itertools.product((1, 2), (1, 2, 3))) if k % 4 == 0]
    assert sorted(map(tuple, learn.grid_sample([a, b], 4).collect())) == want


def test_means_follow_the_order_of_the_table(spark, tmp_path):
    from tallyweave.plans.fixtures import Tables

    rng = random.Random(5)
    rows = [(k % 40, k, 1, k, 2.0, 3.0, rng.randint(0, 10) / 100, 0.0, "R", "O", None) for k in range(400)]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    want, plain = {}, {}
    for k in range(40):
        xs = [1 - 5 * r[6] for r in rows if r[0] == k]
        for x in xs:
            want[k] = want.get(k, 0.0) + x
        plain[k] = sum(reversed(xs), 0.0)
    assert want != plain  # the order counts
    for part, a in enumerate(range(0, 400, 100)):  # a group is spread over files
        spark.createDataFrame(rows[a : a + 100], kind).coalesce(1).write.parquet(f"{tmp_path}/{part}")
    (tmp_path / "lineitem.parquet").mkdir()
    for part in range(4):
        next((tmp_path / str(part)).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{part}.parquet")
    items = Tables(spark, str(tmp_path)).stored_items
    for df in (items, items.repartition(7, "product_code")):
        assert {r.receipt_id: r.avg_confidence for r in R.header_rollup(df).collect()} == {k: v / 10 for k, v in want.items()}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_form_is_tried_once_and_only_if_needed(spark):
    lines = spark.range(3).selectExpr("id AS receipt_id", "1 AS line_no", "0.5D AS confidence", "concat('Date 0', id + 1, '/02/2024') AS text")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    assert _plan(layout.pick_date(lines)).count("regexp_extract(") == 12  # three numbers of each of four forms
    assert sorted(r["date"] for r in layout.pick_date(lines).collect()) == ["2024-02-01", "2024-02-02", "2024-02-03"]
    parsed = _plan(matching.parse_lines(lines))
    assert parsed.count(X.TOTAL_LINE) == 1 and "filter(array" not in parsed  # a filter would have the results of all forms
    total = _plan(lines.select(layout.total_of_line(F.col("text"))))
    assert total.count("regexp_extract(") < 20  # each form once, not once for each comparison


def test_numbers_reach_python_once_a_receipt(spark, monkeypatch):
    seen = []
    grouped = layout.by_group_lists
    monkeypatch.setattr(layout, "by_group_lists", lambda df, *a: (seen.append(df), grouped(df, *a))[1])
    items = spark.createDataFrame([(1, p, "A", 1.0, 40.0 * p) for p in range(1, 9)] + [(2, 1, "B", 1.0, 40.0), (3, 1, "C", 2.0, 0.0)], "receipt_id long, pos int, product_code string, quantity double, y double")
    numbers = spark.createDataFrame([(1, 49.0, 5.0), (1, 51.0, 6.0), (1, 49.0, 4.0), (1, 200.0, 1.0), (4, 40.0, 7.0), (2, 41.0, 3.0)], "receipt_id long, y double, value double")
    got = {(r.receipt_id, r.pos): r.quantity for r in layout.attach_orphans(items, numbers).collect()}
    assert got == {(1, p): 4.0 if p == 1 else 1.0 for p in range(1, 9)} | {(2, 1): 3.0, (3, 1): 2.0}
    assert seen[0].count() == 10 + 5  # rows that are items and rows that are numbers, not the numbers with each item
    lines = spark.createDataFrame([(1, 1, "one two", 20.0), (1, 2, "7", 40.0), (2, 1, "ABC", 20.0), (2, 2, "7", 40.0)], "receipt_id long, line_no int, text string, y_center double")
    assert sorted(tuple(r) for r in layout.merge_code_lines(lines).collect()) == [(1, 1, "one two", 20.0), (1, 2, "7", 40.0), (2, 1, "ABC 7", 30.0)]
    assert len(seen) == 2


def test_items_are_compared_by_one_aggregation(spark):
    kind = "receipt_id long, product_code string, quantity double"
    e = spark.createDataFrame([(1, "a", 1.0), (1, " A", 2.0), (1, "B", 1.0), (2, None, 1.0), (None, "C", 1.0), (3, "N", None)], kind)
    d = spark.createDataFrame([(1, "A", 3.0), (1, "X", 1.0), (2, None, 1.0), (None, "C", 1.0), (3, "N", 1.0)], kind)
    got = sorted((tuple(r) for r in learn.compare_items(e, d).collect()), key=str)
    assert got == sorted([(1, "A", 3.0, 3.0, "matched"), (1, "B", 1.0, None, "missing"), (1, "X", None, 1.0, "extra"), (2, None, 1.0, None, "missing"), (2, None, None, 1.0, "extra"), (None, "C", 1.0, None, "missing"), (None, "C", None, 1.0, "extra"), (3, "N", None, 1.0, "extra")], key=str)
    assert "Join" not in _plan(learn.compare_items(e, d))


def test_validation_has_one_window(spark):
    items = spark.createDataFrame([(1, p, c, 1.0, 2.0, 2.0) for p, c in ((3, "A"), (1, "A"), (2, "A"), (4, "B"))], "receipt_id long, pos int, product_code string, quantity double, unit_price double, line_total double")
    out = verify.validate(items, spark.createDataFrame([("A", 2.0)], "product_code string, unit_price double"), learn.quantity_stats(items))
    assert {r.pos: r.warnings for r in out.collect()} == {1: "low:duplicate_item", 2: "", 3: "", 4: ""}
    assert sum(line.lstrip(" +:-").startswith("Window ") for line in _plan(out).splitlines()) == 1


def test_lists_are_sorted_without_a_comparison_function(spark):
    d = spark.createDataFrame([(1, 1, 10.0, 400.0, "Total", 0.5), (1, 2, 90.0, 401.0, "12", 0.5)], "receipt_id long, det_id int, x double, y double, text string, confidence double")
    assert [(r.text, r.total) for r in layout.find_total(d).collect()] == [("Total 12", 12.0)]
    assert "array_sort(" not in _plan(layout.find_total(d))
