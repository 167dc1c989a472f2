"""Detections to text lines and lines to items: window forms where an order suffices, grouped Arrow/pandas where earlier choices change later ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.functions.text import TOTAL_VARIANTS, is_noise_fragment, let, recover_digits
from tallyweave.operators.grouped import by_group, by_group_lists
from tallyweave.operators.catalog import small
from tallyweave.plans.fixtures import half_up


def centre(bbox: Column, axis: int) -> Column:
    """Middle between corners 0 and 2 on an axis; a bad box gives 0."""
    a, b = F.try_element_at(F.try_element_at(bbox, F.lit(1)), F.lit(axis + 1)), F.try_element_at(F.try_element_at(bbox, F.lit(3)), F.lit(axis + 1))
    return F.coalesce((a + b) / 2, F.lit(0.0))


def polygon_box(flat: Column) -> Column:
    """Four-corner box around a flat list x0, y0, x1, y1, ...; fewer than two points give null."""
    xs, ys = F.filter(flat, lambda x, i: i % 2 == 0), F.filter(flat, lambda x, i: i % 2 == 1)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when(F.size(flat) >= 4, F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)))


def gap_lines(detections: DataFrame, floor: float = 15.0, share: float = 0.03) -> DataFrame:
    """Line number of each detection: a new line where the gap to the previous y exceeds max(floor, share of the range)."""
    per = W.partitionBy("receipt_id")
    order = per.orderBy("y", "x", "det_id")
    gap = F.col("y") - F.lag("y").over(order)
    limit = F.greatest(F.lit(floor), (F.max("y").over(per) - F.min("y").over(per)) * share)
    d = detections.withColumn("_new", F.when(gap > limit, 1).otherwise(0))
    return d.withColumn("line_no", (F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")


def without_noise(detections: DataFrame) -> DataFrame:
    """Detections without fragments of bare punctuation."""
    return detections.where(~F.coalesce(is_noise_fragment(F.col("text")), F.lit(True)))


def coordinate_pairs(flat: Column) -> Column:
    """Structs (x, y) of a flat list x0, y0, x1, y1, ...; a last number without a partner is left out."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def choose_pass(detections: DataFrame) -> DataFrame:
    """Per receipt the recognition pass (pass) with most detections, then the higher mean confidence, then the smaller pass."""
    p = detections.groupBy("receipt_id", "pass").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    return p.groupBy("receipt_id").agg(F.min_by(F.struct("pass", "n"), F.struct(-F.col("n"), -F.col("c"), F.col("pass"))).alias("b")).select("receipt_id", "b.pass", "b.n")


def skip_second_pass(detections: DataFrame, catalog: DataFrame, least: int = 4, confidence: float = 0.55) -> DataFrame:
    """Per receipt whether a first pass is good enough: detections that are catalog codes, and mean confidence."""
    known = small(catalog.select(F.col("product_code").alias("_k"), F.lit(1).alias("_one")).distinct())
    g = detections.join(known, F.upper(F.trim("text")) == F.col("_k"), "left").groupBy("receipt_id").agg(F.count("_one").alias("n_codes"), F.avg("confidence").alias("c"))
    return g.select("receipt_id", "n_codes", ((F.col("n_codes") >= least) & (F.col("c") >= confidence)).alias("skip"))


def pass_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Numbers of different (receipt_id, text) that both passes, only the first and only the second have: (part, n)."""
    key = lambda d, n: d.select("receipt_id", "text").distinct().withColumn(n, F.lit(1))
    j = key(first, "_a").join(key(second, "_b"), ["receipt_id", "text"], "full")
    part = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").otherwise("both")
    return j.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def layout_features(detections: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per picture the normalised layout of its detections (receipt_id, det_id, bbox, text): places of expected codes and numbers, line heights, character widths, flags.

    sizes: (receipt_id, width, height); labels: (receipt_id, code) of the expected items. Boxes of fewer than four points, blank texts and pictures without a size count for nothing.
    """
    box = F.col("bbox")
    xs, ys = F.transform(box, lambda q: q[0]), F.transform(box, lambda q: q[1])
    w, h = F.col("width"), F.col("height")
    d = detections.where(F.size("bbox") >= 4).withColumn("t", F.trim("text")).where("t <> ''").join(sizes.where("width > 0 AND height > 0"), "receipt_id")
    d = d.select(
        "receipt_id", "det_id", "t", ((F.array_min(xs) + F.array_max(xs)) / 2 / w).alias("cx"), ((F.array_min(ys) + F.array_max(ys)) / 2 / h).alias("cy"),
        ((F.array_max(ys) - F.array_min(ys)) / h).alias("bh"), ((F.array_max(xs) - F.array_min(xs)) / w).alias("bw"),
    )
    known = labels.select("receipt_id", F.upper(F.trim("code")).alias("_u"), F.lit(True).alias("_code")).distinct()
    d = d.withColumn("_u", F.upper("t")).join(known, ["receipt_id", "_u"], "left").withColumn("number", F.col("t").rlike("^[0-9]+[.]?[0-9]*$"))
    ordered = lambda c, cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("det_id", c.alias("v"))))), lambda v: v["v"])
    return d.groupBy("receipt_id").agg(
        ordered(F.col("cx"), F.col("_code")).alias("code_x"), ordered(F.col("cx"), F.col("number")).alias("qty_x"), ordered(F.col("cy"), F.col("_code")).alias("item_y"),
        ordered(F.col("bh"), F.col("bh") > 0).alias("line_heights"), ordered(F.col("bw") / F.length("t"), F.col("bw") > 0).alias("char_widths"), F.count("*").alias("detection_count"),
        F.bool_or(F.coalesce(F.col("number") & (F.col("t").try_cast("double") > 100), F.lit(False))).alias("has_prices"), F.bool_or(F.col("t").rlike("^[0-9]{1,2}[.]$")).alias("has_line_numbers"),
    )


def join_fragments(detections: DataFrame) -> DataFrame:
    """Text of each line, left to right, with mean confidence and y; fragments of bare punctuation are left out."""
    d = without_noise(detections)
    g = d.groupBy("receipt_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("x", "det_id", "text"))).alias("s"), F.avg("confidence").alias("c"), F.avg("y").alias("y"))
    return g.select("receipt_id", "line_no", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), half_up(F.col("c"), 4).alias("confidence"), half_up(F.col("y"), 2).alias("y_center"))


def line_threshold(detections: DataFrame, structured: bool = False) -> DataFrame:
    """Per receipt: distance that separates lines, lowered where the upper median of gaps over 3 px shows a dense layout."""
    order = W.partitionBy("receipt_id").orderBy("y", "x", "det_id")
    gaps = detections.withColumn("gap", F.lead("y").over(order) - F.col("y"))
    g = gaps.groupBy("receipt_id").agg(F.max("y").alias("max_y"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("gap") > 3, F.col("gap")))).alias("gaps"))
    base = F.least(F.lit(40.0), F.greatest(F.lit(20.0), F.col("max_y") * 0.02)) if structured else F.least(F.lit(55.0), F.greatest(F.lit(30.0), F.col("max_y") * 0.025))
    mid = F.when((F.col("n") >= 6) & (F.size("gaps") > 0), F.element_at("gaps", (F.floor(F.size("gaps") / 2) + 1).cast("int")))
    dense = F.greatest(F.lit(12.0), mid * 0.7)
    return g.select("receipt_id", half_up(F.when((mid < 1.8 * base) & (dense < base), dense).otherwise(base), 4).alias("threshold"))


def top_noise(detections: DataFrame) -> DataFrame:
    """Detections without faint ones (under 0.3) at the top 2 % of the page, unless nothing else is there."""
    w = W.partitionBy("receipt_id")
    noise = (F.col("y") < 0.02 * F.max("y").over(w)) & (F.col("confidence") < 0.3)
    d = detections.withColumn("_noise", noise)
    return d.withColumn("_left", F.count_if(~F.col("_noise")).over(w)).where(~F.col("_noise") | (F.col("_left") == 0)).drop("_noise", "_left")


def bottom_region(detections: DataFrame, share: float = 0.3) -> DataFrame:
    w = W.partitionBy("receipt_id")
    return detections.withColumn("_m", F.max("y").over(w)).where(F.col("y") >= share * F.col("_m")).drop("_m")


def running_mean_lines(detections: DataFrame, thresholds: DataFrame) -> DataFrame:
    """line_no by the mean y of the current line's left-hand members; short numbers of a right column get 1.25 times the distance.

    Each decision depends on the line that earlier ones built, so it runs per receipt.
    """
    d = detections.select("receipt_id", "det_id", "x", "y", "text").join(thresholds, "receipt_id")

    def assign(g: dict[str, list]) -> dict[str, list]:
        xs, ys = g["x"], g["y"]
        least, limit = min(xs), g["threshold"][0]
        edge = least + 0.45 * (max(xs) - least)
        wide = max(xs) - least > 150
        line, out = 1, []
        n_all = n_left = 0
        sum_all = sum_left = 0.0
        for x, y, text in zip(xs, ys, g["text"], strict=True):
            right = False
            if wide and x > edge:
                t = (text or "").strip()
                right = t.isdigit() and len(t) <= 2
            if n_all:
                mean = sum_left / n_left if n_left else sum_all / n_all
                if abs(y - mean) > limit * (1.25 if right else 1.0):
                    line, n_all, n_left, sum_all, sum_left = line + 1, 0, 0, 0.0, 0.0
            n_all, sum_all = n_all + 1, sum_all + y
            if not right:
                n_left, sum_left = n_left + 1, sum_left + y
            out.append(line)
        return {"receipt_id": g["receipt_id"], "det_id": g["det_id"], "line_no": out}

    return by_group_lists(d, ["receipt_id"], ["y", "x", "det_id"], assign, "receipt_id long, det_id long, line_no int")


def merge_code_lines(lines: DataFrame) -> DataFrame:
    """Lines that are a bare code joined with a line next to them that has numbers only, the nearer one and the previous one of equals.

    Passes over the receipt's lines, in which each number line is used once, are repeated until nothing
    changes. A merged line has the mean y and, where the table has it, the mean confidence of both.
    """
    means = [c for c in ("confidence", "y_center") if c in lines.columns]

    def run(g: dict[str, list]) -> dict[str, list]:
        if not any(_CODE_LINE.match(x or "") for x in g["text"]):
            return g
        rows = [dict(zip(g, v, strict=True)) for v in zip(*g.values(), strict=True)]
        changed = True
        while changed:
            changed = False
            out: list[dict] = []
            used: set[int] = set()
            code = [bool(_CODE_LINE.match(r["text"] or "")) for r in rows]
            numbers = [bool(_NUMBER_LINE.match(r["text"] or "")) for r in rows]
            for k, r in enumerate(rows):
                if k in used:
                    continue
                near = [j for j in (k - 1, k + 1) if code[k] and 0 <= j < len(rows) and numbers[j] and j not in used]
                if near:
                    j = min(near, key=lambda j: abs(rows[j]["y_center"] - r["y_center"]))
                    used.update((j, k))
                    out = [x for x in out if x is not rows[j]]
                    r = r | {"text": f"{r['text'].strip()} {rows[j]['text'].strip()}"} | {c: (r[c] + rows[j][c]) / 2 for c in means}
                    changed = True
                out.append(r)
            rows = out
        return {c: [r[c] for r in rows] for c in g}

    return by_group_lists(lines, ["receipt_id"], ["line_no"], run, lines.schema)


_CODE_LINE = re.compile(r"\s*([A-Za-z]{2,4}[A-Za-z0-9]{1,3}|[A-Za-z]{3,6})\s*$")
_NUMBER_LINE = re.compile(r"[\d\s.]+$")


def attach_orphans(items: DataFrame, numbers: DataFrame, share: float = 0.06, default: float = 100.0) -> DataFrame:
    """Quantity of items that have none (1) from the nearest number line nearer than share of the page height, numbers in order of y.

    Numbers are those over 1 and up to 999; of equally near items the first gets one. An item with a quantity takes no other. Without a height, which is the largest y of both,
    the distance is `default`. Places at y 0 are unknown and attract nothing. Where items have needs_review, it is set.
    """
    # one stream: the numbers of a receipt come before its items, each once
    n = numbers.where("value > 1 AND value <= 999 AND y <> 0").select("receipt_id", F.col("y").cast("double").alias("_y"), F.col("value").cast("double").alias("_value"))
    d = items.withColumn("_item", F.lit(True)).unionByName(n.withColumn("_item", F.lit(False)), allowMissingColumns=True)
    columns = items.columns
    review = "needs_review" in columns

    def run(g: dict[str, list]) -> dict[str, list]:
        k = g["_item"].index(True) if True in g["_item"] else len(g["_item"])
        found, out = list(zip(g["_y"][:k], g["_value"][:k], strict=True)), {c: v[k:] for c, v in g.items()}
        ys, quantity = out["y"], out["quantity"]
        top = max([y or 0.0 for y in ys] + [y for y, _ in found])
        limit = top * share if top else default
        free = [i for i, q in enumerate(quantity) if q == 1 and ys[i]]
        for y, value in found:
            near = [(abs(ys[i] - y), i) for i in free if abs(ys[i] - y) < limit]
            if near:
                i = min(near)[1]
                quantity[i] = value
                free.remove(i)  # values are over 1
                if review:
                    out["needs_review"][i] = True
        return {c: out[c] for c in columns}

    return by_group_lists(d, ["receipt_id"], ["_item", "pos", "_y", "_value"], run, items.schema)


def drop_echoes(detections: DataFrame, dx: float = 30.0, dy: float = 15.0) -> DataFrame:
    """Of detections at one place the most confident one, whatever their texts.

    In order of y, each detection takes those after it that lie nearer than dx and dy to it and aren't taken yet; the
    first of equally confident ones stays. Receipts without any such pair bypass Python.
    """

    def run(rows: list[dict]) -> list[dict]:
        keep: list[dict] = []
        taken: set[int] = set()
        for k, r in enumerate(rows):
            if k in taken:
                continue
            best = r
            for j in range(k + 1, len(rows)):
                o = rows[j]
                if o["y"] - r["y"] >= dy:  # in order of y
                    break
                if j not in taken and abs(o["x"] - r["x"]) < dx:
                    taken.add(j)
                    if o["confidence"] > best["confidence"]:
                        best = o
            keep.append(best)
        return keep

    return by_group(detections, ["receipt_id"], ["y", "det_id"], run, detections.schema)


def reading_order(detections: DataFrame, bucket: float = 60.0, short_gap: float = 35.0) -> DataFrame:
    """Detections in which repeats of a text, apart from case, on the same or the next band are one, the most confident.

    A repeat is compared with the last one kept; numbers of one or two digits repeat within short_gap instead.
    Reading order is by y, then det_id. Only texts that a receipt has more than once are looked at in order.
    """
    key = F.upper(F.trim("text"))
    many = F.count("*").over(W.partitionBy("receipt_id", "_key"))
    d = detections.withColumn("_key", key).withColumn("_many", many)

    def run(rows: list[dict]) -> list[dict]:
        short = bool(re.fullmatch(r"\d{1,2}", rows[0]["_key"] or ""))
        kept = rows[:1]
        for r in rows[1:]:
            last = kept[-1]
            again = abs(r["y"] - last["y"]) < short_gap if short else abs(round(r["y"] / bucket) - round(last["y"] / bucket)) <= 1
            if not again:
                kept.append(r)
            elif r["confidence"] > last["confidence"]:
                kept[-1] = r
        return kept

    several = by_group(d.where("_many > 1").drop("_many"), ["receipt_id", "_key"], ["y", "det_id"], run, detections.schema)
    return d.where("_many = 1").select(*detections.columns).unionByName(several)


def vote(first: DataFrame, second: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Two recognition passes by (text, band): agreed ones gain 15 % up to 1, single ones under 0.75 need review, band conflicts lose 5 %."""
    key = [F.upper(F.trim("text")).alias("key"), F.rint(F.col("y") / bucket).cast("long").alias("band")]
    a = first.groupBy("receipt_id", *key).agg(F.max("confidence").alias("ca"))
    b = second.groupBy("receipt_id", *key).agg(F.max("confidence").alias("cb"))
    j = a.join(b, ["receipt_id", "key", "band"], "full")
    both = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    rows = W.partitionBy("receipt_id", "band")
    conflict = ~both & (F.count_if(F.col("ca").isNotNull()).over(rows) > 0) & (F.count_if(F.col("cb").isNotNull()).over(rows) > 0)
    best = F.greatest("ca", "cb")
    conf = F.when(both, F.least(F.lit(1.0), best * 1.15)).when(conflict, best * 0.95).otherwise(best)
    return j.select("receipt_id", "key", "band", half_up(conf, 4).alias("confidence"), F.coalesce(~both & (conflict | (best < 0.75)), F.lit(False)).alias("needs_review"), F.when(both, "agreed").when(conflict, "conflict").otherwise("single").alias("vote"))


def cross_verify(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Confidence of primary texts raised by what another engine read: the same text, shared tokens of at least half, or containment."""
    o = other.select("receipt_id", F.upper(F.trim("text")).alias("o")).distinct()
    per = o.groupBy("receipt_id").agg(F.sort_array(F.collect_list("o")).alias("texts"))
    t = F.upper(F.trim("text"))
    j = primary.join(per, "receipt_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    tokens = F.array_distinct(F.filter(F.split(t, " +"), lambda x: x != ""))
    theirs = F.array_distinct(F.flatten(F.transform("texts", lambda x: F.split(x, " +"))))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, theirs)), F.size(tokens)), F.lit(0.0))
    inside = (F.length(t) >= 4) & F.exists("texts", lambda x: F.contains(x, t) | (F.contains(t, x) & (F.length(x) >= 4)))
    factor = F.when(F.array_contains("texts", t), 1.15).when(share >= 0.5, 1 + 0.15 * share).when(inside, 1.08).otherwise(1.0)
    return j.select("receipt_id", "det_id", "text", half_up(F.least(F.lit(1.0), F.col("confidence") * factor), 4).alias("confidence"))


def word_confidence(lines: DataFrame, words: DataFrame, height: float = 40.0) -> DataFrame:
    """Mean confidence of the words whose centre lies in a line's box, give or take 0.3 of its height; 0.8 without words.

    Lines and words meet on y-bands of `height`, so the range join is an equi-join.
    """
    lo, hi = F.col("y0") - 0.3 * (F.col("y1") - F.col("y0")), F.col("y1") + 0.3 * (F.col("y1") - F.col("y0"))
    banded = lines.select("receipt_id", "line_no", "x0", "x1", lo.alias("lo"), hi.alias("hi")).withColumn("band", F.explode(F.sequence(F.floor(F.col("lo") / height), F.floor(F.col("hi") / height))))
    w = words.select("receipt_id", F.floor(F.col("y") / height).alias("band"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("confidence").alias("wc"))
    hit = banded.join(w, ["receipt_id", "band"]).where("wy BETWEEN lo AND hi AND wx BETWEEN x0 AND x1")
    mean = hit.groupBy("receipt_id", "line_no").agg(F.avg("wc").alias("c"))
    return lines.join(mean, ["receipt_id", "line_no"], "left").select("receipt_id", "line_no", half_up(F.coalesce("c", F.lit(0.8)), 4).alias("confidence"))


def pick_total(lines: DataFrame) -> DataFrame:
    """Per receipt the total value by the most specific pattern, the earliest line on ties."""
    from tallyweave.functions import text as X

    c = lines.where(X.is_total(F.col("text"))).select("receipt_id", "line_no", X.total_rank(F.col("text")).alias("rank"), X.total_value(F.col("text")).alias("value")).where("value IS NOT NULL")
    r = F.row_number().over(W.partitionBy("receipt_id").orderBy("rank", "line_no"))
    return c.withColumn("_r", r).where("_r = 1").drop("_r")


def grand_totals(lines: DataFrame) -> DataFrame:
    """Per receipt the amount of the last line that states a grand total, on itself or as a bare number on the next line: (receipt_id, line_no, value, confidence).

    A number on the next line has the smaller confidence of both.
    """
    from tallyweave.functions import text as X

    w = W.partitionBy("receipt_id").orderBy("line_no")
    bare = F.when(F.col("text").rlike("^\\s*[0-9]+[.]?[0-9]*\\s*$"), F.trim("text").try_cast("double"))
    d = lines.withColumn("_n", bare).withColumn("_next", F.lead("_n").over(w)).withColumn("_c", F.lead("confidence").over(w))
    own = X.grand_total(F.col("text"))
    d = d.where(F.col("text").rlike(X.GRAND_LINE) | F.lit(False)).select("receipt_id", "line_no", F.coalesce(own, F.when(F.col("_next") > 0, F.col("_next"))).alias("value"), F.when(own.isNotNull(), F.col("confidence")).otherwise(F.least("confidence", "_c")).alias("confidence"))
    last = d.where("value IS NOT NULL").groupBy("receipt_id").agg(F.max_by(F.struct("line_no", "value", "confidence"), "line_no").alias("b"))
    return last.select("receipt_id", "b.*")


def neighbour_number(lines: DataFrame) -> DataFrame:
    """Total lines without a number, with the bare number of the next line, else of the previous one."""
    from tallyweave.functions import text as X

    w = W.partitionBy("receipt_id").orderBy("line_no")
    bare = F.when(F.col("text").rlike("^ *[0-9]+([.][0-9]+)? *$"), F.trim("text").try_cast("double"))
    d = lines.withColumn("_n", bare)
    d = d.withColumn("value", F.coalesce(F.lead("_n").over(w), F.lag("_n").over(w)))
    return d.where(X.is_total(F.col("text")) & ~F.col("text").rlike("[0-9]") & F.col("value").isNotNull()).select("receipt_id", "line_no", "value")


def pick_date(lines: DataFrame) -> DataFrame:
    """Per receipt the best date: lines with a keyword first, then by the form of the date, then earlier lines."""
    from tallyweave.functions.dates import date_candidate

    # a generated row: the filter on it isn't pushed below, where it would search again; the shuffle serves the window too, and divides the search
    d = F.explode_outer(F.array(date_candidate(F.col("text")))).alias("d")
    c = lines.repartition("receipt_id").select("receipt_id", "line_no", "text", d).where("d IS NOT NULL").withColumn("p", F.when(F.col("text").rlike("(?i)date|dt"), 2).otherwise(1))
    prio = F.col("p") + 1 / (F.col("d.form") + 1)
    r = F.row_number().over(W.partitionBy("receipt_id").orderBy(prio.desc(), "line_no"))
    return c.withColumn("_r", r).where("_r = 1").select("receipt_id", "line_no", "d.date")


#: Words for a total as they are read, and for a quantity after it.
_TOTAL, _QTY, _SEP = "(?:total|totai|tota1|t0tal|totd)", "(?:qty|quantity|qtv|qly|qtyt|qiy|qtt)", "[\\s:=_.-]*"
_VALUE = "([0-9]+[.]?[0-9]*)"
_TOTAL_FORMS = [f"{_TOTAL}{_SEP}{_QTY}{_SEP}{_VALUE}", f"{_TOTAL}[\\s:=_-]+{_VALUE}", f"sub{_SEP}total{_SEP}{_VALUE}", f"sum[\\s:=_-]+{_VALUE}", f"{_TOTAL}.*?{_QTY}.*?{_VALUE}\\s*$"]
_NO_TOTAL = "(?:total|totd)\\s*(?:items|count|no|number|products|entries)"
_MONEY_TOTAL = f"(?:grr?and|grramd|gramd){_SEP}{_TOTAL}"


def _in_range(c: Column) -> Column:
    return let(c, lambda v: F.when((v > 0) & (v <= 99999), v))


def total_of_line(c: Column) -> Column:
    """Quantity total that a line states: by the first of the forms that gives one, else the number after a total word, else letters there read as digits.

    Lines that count items or state amounts of money give null.
    """
    number = lambda p: _in_range(F.regexp_extract(c, f"(?i){p}", 1).try_cast("double"))
    keyword = c.rlike(f"(?i)(^|\\s)[.:=-]*(?:{TOTAL_VARIANTS})[.:=-]*(\\s|$)")
    near = number(f"(?:total|totai|tota1|t0tal|sub\\s*total|sum)\\s*{_QTY}?[\\s:=-]*{_VALUE}")
    found = F.coalesce(*[number(p) for p in _TOTAL_FORMS], F.when(keyword, F.coalesce(near, recover_digits(c))))
    # every form has one of these words, which most lines lack
    return F.when(c.rlike(f"(?i){_TOTAL}|sum|{TOTAL_VARIANTS}"), F.when(~c.rlike(f"(?i){_NO_TOTAL}") & ~c.rlike(f"(?i){_MONEY_TOTAL}"), found))


def find_total(detections: DataFrame, share: float = 0.3) -> DataFrame:
    """Per receipt the stated quantity total, searched from the bottom: (receipt_id, total, text, confidence, tier).

    Detections (receipt_id, det_id, x, y, text, confidence) of the lower part form lines. The lowest line that states
    a total counts (tier 1). Where none does, it is the topmost line with a total word but no digit beside a line of one
    bare number, the next line before the previous one, with the mean confidence of both (tier 2). Receipts without either have no row.
    """
    d = gap_lines(bottom_region(detections, share))
    g = d.groupBy("receipt_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("x", "y", "det_id", "text"))).alias("s"), F.avg("confidence").alias("c"))
    lines = g.select("receipt_id", "line_no", F.array_join(F.transform("s", lambda v: F.coalesce(v["text"], F.lit(""))), " ").alias("text"), "c")
    t, order = F.col("text"), W.partitionBy("receipt_id").orderBy("line_no")
    bare = _in_range(F.when(t.rlike("^\\s*[0-9]+[.]?[0-9]*\\s*$"), F.trim(t).try_cast("double")))
    rows = lines.withColumns({"own": total_of_line(t), "bare": bare})
    around = {f"{n}_{c}": f(c).over(order) for n, f in (("next", F.lead), ("prev", F.lag)) for c in ("bare", "text", "c")}
    rows = rows.withColumns(around)
    open_word = t.rlike(f"(?i){_TOTAL}") & ~t.rlike("[0-9]") & ~t.rlike(f"(?i){_MONEY_TOTAL}")
    nxt = F.struct(F.col("next_bare").alias("total"), F.concat_ws(" ", "text", "next_text").alias("text"), ((F.col("c") + F.col("next_c")) / 2).alias("c"))
    prv = F.struct(F.col("prev_bare").alias("total"), F.concat_ws(" ", "prev_text", "text").alias("text"), ((F.col("c") + F.col("prev_c")) / 2).alias("c"))
    mine = F.struct(F.col("own").alias("total"), t.alias("text"), F.col("c").alias("c"))
    beside = F.when(open_word, F.when(F.col("next_bare").isNotNull(), nxt).when(F.col("prev_bare").isNotNull(), prv))
    tier = F.when(F.col("own").isNotNull(), 1).when(beside.isNotNull(), 2)
    best = rows.withColumn("tier", tier).where("tier IS NOT NULL").select("receipt_id", "tier", F.when(F.col("tier") == 1, -F.col("line_no")).otherwise(F.col("line_no")).alias("rank"), F.when(F.col("tier") == 1, mine).otherwise(beside).alias("hit"))
    top = best.groupBy("receipt_id").agg(F.min_by(F.struct("tier", "hit"), F.struct("tier", "rank")).alias("b"))
    return top.select("receipt_id", "b.hit.total", "b.hit.text", half_up(F.col("b.hit.c"), 4).alias("confidence"), "b.tier")


def store_name(lines: DataFrame, headers: tuple[str, ...] = ("item", "code", "qty", "rate", "amount", "total", "date", "bill", "no", "receipt")) -> DataFrame:
    """First of the five top lines that looks like a name: letters, no header words only, few digits."""
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    plausible = (F.length(F.trim("text")) >= 4) & F.col("text").rlike("[A-Za-z]{3}") & (F.regexp_count("text", F.lit("[0-9]")) * 3 < F.length("text"))
    plausible = plausible & (F.size(F.array_except(tokens, F.array(*[F.lit(h) for h in headers]))) > 0)
    return lines.where((F.col("line_no") <= 5) & plausible).groupBy("receipt_id").agg(F.min_by(F.trim("text"), "line_no").alias("store_name"))


def resolve_ambiguous(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of a code that a receipt has more than once, one item takes the code without its last character, if that is a code the receipt lacks.

    It is the first item with a doubtful ending (ambiguous_oi), which becomes oi_resolved and is to be reviewed; without one, the first
    whose raw text has the shorter code before an O or I, and the longer one nowhere else, which becomes ocr_variant. Doubtful items that stay are to be reviewed, where
    the table has needs_review. Codes of fewer than three characters stay.
    """
    same = W.partitionBy("receipt_id", "product_code")
    code, doubtful = F.col("product_code"), F.coalesce(F.col("match_type") == "ambiguous_oi", F.lit(False))
    shorter = F.when(F.length(code) >= 3, F.expr("left(product_code, length(product_code) - 1)"))
    d = items.withColumn("_n", F.count("*").over(same)).withColumn("_s", shorter)
    known = small(catalog.select(F.col("product_code").alias("_s"), F.lit(True).alias("_known")).distinct())
    present = items.select("receipt_id", F.col("product_code").alias("_s"), F.lit(True).alias("_present")).distinct()
    d = d.join(known, "_s", "left").join(present, ["receipt_id", "_s"], "left")
    able = (F.col("_n") > 1) & F.col("_known").isNotNull() & F.col("_present").isNull()
    raw = F.upper("raw_text") if "raw_text" in items.columns else F.lit("")
    o, i = F.concat("_s", F.lit("O")), F.concat("_s", F.lit("I"))
    misread = (F.contains(raw, o) | F.contains(raw, i)) & ~F.contains(F.replace(F.replace(raw, o, F.lit("")), i, F.lit("")), code)
    d = d.withColumn("_t", F.when(able & doubtful, 1).when(able & misread, 2))
    d = d.withColumn("_r", F.row_number().over(same.orderBy(F.col("_t").asc_nulls_last(), "pos")))
    swap = F.col("_t").isNotNull() & (F.col("_r") == 1)
    new = {"product_code": F.when(swap, F.col("_s")).otherwise(code), "match_type": F.when(swap, F.when(F.col("_t") == 1, "oi_resolved").otherwise("ocr_variant")).otherwise(F.col("match_type"))}
    if "needs_review" in items.columns:
        new["needs_review"] = F.coalesce("needs_review", F.lit(False)) | doubtful & ~(swap & (F.col("_t") == 2))
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns])
