"""Codes and descriptions against the catalog."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyweave.functions import match as M
from tallyweave.functions import text as X
from tallyweave.operators.catalog import small
from tallyweave.operators.grouped import by_group
from tallyweave.operators.kept import kept


def match_codes(codes: DataFrame, catalog: DataFrame, column: str = "code") -> DataFrame:
    """Rows with matched_code and match_type: exact, ambiguous_oi, fuzzy or unknown.

    Every different code is matched once, by tiers that take what the ones before leave: the code itself; a trailing O or I; the
    first of its spellings that is a code; the most similar code of any spelling; equal letters at equal places. All tiers
    are equi-joins, so neither the codes nor the catalog need to fit in one place.
    """
    cat = catalog.select("product_code").where("product_code IS NOT NULL").distinct()
    row = ["_code", "matched_code", "match_type"]
    left = codes.select(F.upper(F.trim(F.col(column))).alias("_code")).where("_code IS NOT NULL").distinct()
    exact = left.join(small(cat), left["_code"] == cat["product_code"]).select("_code", F.col("product_code").alias("matched_code"), F.lit("exact").alias("match_type"))
    left = left.join(small(cat), left["_code"] == cat["product_code"], "left_anti")
    trailing = trailing_tier(left.select(F.col("_code").alias("code")), cat).where("match_type <> 'none'").select(F.col("code").alias("_code"), "matched_code", "match_type")
    left = left.join(trailing, "_code", "left_anti")
    forms = left.select("_code", F.posexplode(M.variant_list("_code")).alias("_i", "_v"))
    spelt = forms.join(small(cat), forms["_v"] == cat["product_code"]).groupBy("_code").agg(F.min_by("product_code", "_i").alias("matched_code")).withColumn("match_type", F.lit("exact"))
    forms = kept(forms.join(spelt, "_code", "left_anti"))
    like = close_forms(forms, cat).withColumn("match_type", F.lit("fuzzy"))
    placed = same_places(forms.join(like, "_code", "left_anti"), cat).withColumn("match_type", F.lit("fuzzy"))
    table = exact
    for tier in (trailing, spelt, like, placed):
        table = table.unionByName(tier.select(*row))
    j = codes.join(table, F.upper(F.trim(codes[column])) == table["_code"], "left").drop("_code")
    return j.withColumn("match_type", F.coalesce("match_type", F.lit("unknown")))


def close_forms(forms: DataFrame, cat: DataFrame) -> DataFrame:
    """(_code, matched_code): the code most similar to any spelling (_code, _i, _v), among the five closest of each; the earlier spelling, then the closer code wins ties.

    Rounds of falling similarity: a code is done when no pair that a later round finds can be better, or the round went down to the cutoffs of all its spellings.
    """
    pool, todo, out = kept(_spread(cat, "product_code")), kept(forms), []
    lengths = _lengths(pool, "product_code")
    for rho in ROUNDS:
        bound = {n: max(rho, M.cutoff(n)) for n in _lengths(todo, "_v")}
        broad = too_broad(bound, lengths)
        if broad:
            wide = todo.where(F.length("_v").isin(broad)).select("_code").distinct()
            out.append(_most_similar_forms(todo.join(wide, "_code"), cat))
            todo = todo.join(wide, "_code", "left_anti")
        found = close_pairs(_spread(todo, "_v"), pool, "_v", "product_code", bound, lengths).select("*", _once(M.similarity("product_code", "_v"), "ratio"))
        # the ratio isn't symmetric; either is at most twice the common letters in order through all letters, which the rounds go by
        found = kept(found.where(F.col("ratio") >= X.adaptive_cutoff(F.length("_v"))).withColumn("_s", M.similarity("_v", "product_code")))
        sure = found.where(F.col("ratio") >= rho - 1e-9).withColumn("_r", F.row_number().over(W.partitionBy("_v").orderBy(F.desc("ratio"), F.desc("product_code")))).where("_r <= 5")
        best = todo.join(sure, "_v").groupBy("_code").agg(F.min_by("product_code", F.struct(-F.col("_s"), F.col("_i"), F.col("_r"))).alias("matched_code"), F.max("_s").alias("_s"))
        rival = todo.join(found.where(F.col("ratio") < rho - 1e-9), "_v").groupBy("_code").agg(F.max("_s").alias("_t"))
        last = todo.groupBy("_code").agg(F.bool_and((F.length("_v") == 0) | F.length("_v").isin([n for n in bound if M.cutoff(n) >= rho])).alias("_last"))
        d = last.join(best, "_code", "left").join(rival, "_code", "left")
        done = kept(d.where(F.col("_last") | ((F.col("_s") >= rho - 1e-9) & (F.col("_t").isNull() | (F.col("_t") < F.col("_s"))))))
        out.append(done.where("matched_code IS NOT NULL").select("_code", "matched_code"))
        todo = kept(todo.join(done, "_code", "left_anti"))
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def _most_similar_forms(forms: DataFrame, cat: DataFrame) -> DataFrame:
    """close_forms by all pairs over the cutoffs."""
    pairs = similar_pairs(cat, forms.select("_v").distinct(), "product_code", "_v", lambda nx, ny: X.adaptive_cutoff(ny))
    top = pairs.withColumn("_r", F.row_number().over(W.partitionBy("_v").orderBy(F.desc("ratio"), F.desc("product_code")))).where("_r <= 5")
    scored = top.withColumn("_s", M.similarity("_v", "product_code"))
    return forms.join(scored, "_v").groupBy("_code").agg(F.min_by("product_code", F.struct(-F.col("_s"), F.col("_i"), F.col("_r"))).alias("matched_code"))


def same_places(forms: DataFrame, cat: DataFrame, least: float = 0.85) -> DataFrame:
    """(_code, matched_code): the code that has most letters in common with a spelling at equal places, at least two and 85 % of the longer one's; the earlier spelling, then the smaller code wins ties.

    Lengths differ by one at most. Of k + 1 equal parts of two strings with at most k different places, one is the same in both, so the pairs meet on parts.
    """

    def parts(df: DataFrame, c: str) -> DataFrame:
        n = df.select("*", F.explode(F.array(F.length(c), F.length(c) + 1)).alias("_n")).where(F.col("_n") * (1 - least) >= 1)
        pieces = F.floor(F.col("_n") * (1 - least) + 1e-9).cast("int") + 1
        k = n.select("*", pieces.alias("_k"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_p"))
        start = F.floor(F.col("_p") * F.col("_n") / F.col("_k")).cast("int")
        end = F.floor((F.col("_p") + 1) * F.col("_n") / F.col("_k")).cast("int")
        return k.withColumn("_part", F.substring(F.col(c), start + 1, end - start)).drop("_k")

    j = parts(forms, "_v").join(parts(cat, "product_code"), ["_n", "_p", "_part"]).where(F.greatest(F.length("_v"), F.length("product_code")) == F.col("_n"))
    pairs = j.select("_code", "_i", "_v", "product_code", "_n").distinct()
    at = lambda c, i: F.substring(F.col(c), i, F.lit(1))
    same = F.aggregate(F.sequence(F.lit(1), F.least(F.length("_v"), F.length("product_code"))), F.lit(0), lambda acc, i: acc + (at("_v", i) == at("product_code", i)).cast("int"))
    good = pairs.withColumn("_m", same).where((F.col("_m") >= 2) & (F.col("_m") / F.col("_n") >= least))
    return good.groupBy("_code").agg(F.min_by("product_code", F.struct(-(F.col("_m") / F.col("_n")), F.col("_i"), F.col("product_code"))).alias("matched_code"))


def trailing_tier(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The tier of codes with a trailing O or I alone, as joins: (code, matched_code, match_type)."""
    c = codes.select(F.upper(F.trim("code")).alias("code")).where(F.col("code").rlike("^.{3,}[OI]$")).distinct()
    short = F.expr("substring(code, 1, length(code) - 1)")
    long = F.concat(short, F.when(F.col("code").endswith("O"), "0").otherwise("1"))
    s, lo = small(catalog.select(F.col("product_code").alias("_s"))), small(catalog.select(F.col("product_code").alias("_l")))
    j = c.join(s, short == F.col("_s"), "left").join(lo, long == F.col("_l"), "left")
    before = F.expr("substring(code, length(code) - 1, 1)").rlike("[0-9]")
    both = F.col("_s").isNotNull() & F.col("_l").isNotNull()
    return j.select("code", F.when(both, F.when(before, F.col("_l")).otherwise(F.col("_s"))).otherwise(F.coalesce("_l", "_s")).alias("matched_code"), F.when(both, "ambiguous_oi").when(F.coalesce("_l", "_s").isNotNull(), "exact").otherwise("none").alias("match_type"))


def match_descriptions(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, matched_code, match_type) of descriptions: a token that is a code, else a contained product name, else a contained code, else the most similar name, else unmatched.

    Tokens meet the catalog in an equi-join. Of the different texts without a code, all substrings as long as a name meet the different names in
    one (the first word of the name must be a word of the text); of those that are left, all substrings as long as a code meet the codes (the longest code, then the least, wins), and only texts
    without one are compared with all names, at the cutoff for the text's length (the larger name, then the larger code, wins ties).
    """
    t = texts.select("id", F.upper("text").alias("text"))
    tokens = t.select("id", F.explode(F.array_distinct(F.split("text", "[^A-Z0-9]+"))).alias("token"))
    cat = catalog.select("product_code", F.upper("product_name").alias("name"))
    by_code = tokens.join(small(cat), tokens["token"] == cat["product_code"]).groupBy("id").agg(F.min("product_code").alias("code"))
    names = cat.where("name IS NOT NULL").groupBy("name").agg(F.min("product_code").alias("product_code"))
    unknown = t.join(by_code, "id", "left_anti")
    hit = substrings(unknown.select("text").distinct(), names, "name").join(small(names), F.col("_piece") == F.col("name"))
    hit = hit.where(F.array_contains(F.split("text", "[^A-Z0-9]+"), F.element_at(F.split("name", "[^A-Z0-9]+"), 1)))
    named = hit.groupBy("text").agg(F.min(F.struct(-F.length("name"), F.col("product_code"))).alias("_n"))
    by_name = unknown.join(named, "text").groupBy("id").agg(F.min("_n")["product_code"].alias("named"))
    j = t.join(by_code, "id", "left").join(by_name, "id", "left")
    rest = j.where(F.col("code").isNull() & F.col("named").isNull() & (F.trim("text") != "")).select("text").distinct()
    inside = substrings(rest, cat, "product_code", 1).join(small(cat), F.col("_piece") == F.col("product_code")).groupBy("text").agg(F.min_by("product_code", F.struct(-F.length("product_code"), F.col("product_code"))).alias("inside"))
    by_likeness = similar_pairs(cat.where("name IS NOT NULL").groupBy("name").agg(F.max("product_code").alias("_like")), rest.join(inside, "text", "left_anti"), "name", "text", lambda nx, ny: X.adaptive_cutoff(ny))
    like = by_likeness.groupBy("text").agg(F.max_by("_like", F.struct("ratio", "name")).alias("like"))
    out = j.join(inside, "text", "left").join(like, "text", "left")
    # a text that has a code or name of its own isn't among those of `inside` and `like`
    how = F.when(F.col("code").isNotNull(), "exact").when(F.coalesce("named", "inside").isNotNull(), "contains").when(F.col("like").isNotNull(), "fuzzy").otherwise("unmatched")
    return out.select("id", F.coalesce("code", "named", "inside", "like").alias("matched_code"), how.alias("match_type"))


def substrings(texts: DataFrame, words: DataFrame, column: str, least: int = 0) -> DataFrame:
    """(text, _piece): the different substrings of a text that are as long as one of the words, of a few lengths."""
    sizes = sorted(r[0] for r in words.select(F.length(column)).distinct().collect() if r[0] is not None and r[0] >= least)
    parts = [F.when(F.length("text") >= n, F.expr(f"transform(sequence(1, length(text) - {n - 1}), i -> substring(text, i, {n}))")).otherwise(F.array().cast("array<string>")) for n in sizes]
    return texts.select("text", F.explode(F.array_distinct(F.flatten(F.array(*parts))) if sizes else F.array().cast("array<string>")).alias("_piece"))


def catalog_rate(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per receipt: different catalog codes among the lines' tokens, and the share of lines that have one."""
    tokens = lines.select("receipt_id", "line_no", F.explode(F.split(F.upper("text"), "[^A-Z0-9]+")).alias("token")).where("token <> ''")
    hits = tokens.join(small(catalog.select(F.col("product_code").alias("token"))), "token", "left_semi")
    h = hits.groupBy("receipt_id").agg(F.countDistinct("token").alias("n_codes"), F.countDistinct("line_no").alias("n_hit"))
    n = lines.groupBy("receipt_id").agg(F.count("*").alias("n_lines"))
    zero = F.lit(0).cast("long")
    return n.join(h, "receipt_id", "left").select("receipt_id", F.coalesce("n_codes", zero).alias("n_codes"), (F.coalesce("n_hit", zero) / F.col("n_lines")).alias("rate"))


def supplement(cloud: DataFrame, parsed: DataFrame, least: int = 2) -> DataFrame:
    """Cloud items plus parsed ones with other codes, for receipts with fewer than `least` cloud items."""
    few = cloud.groupBy("receipt_id").count().where(F.col("count") >= least).select("receipt_id")
    extra = parsed.join(few, "receipt_id", "left_anti").join(cloud.select("receipt_id", "product_code").distinct(), ["receipt_id", "product_code"], "left_anti")
    return cloud.withColumn("origin", F.lit("cloud")).unionByName(extra.withColumn("origin", F.lit("parser")))


def pair_confusions(missing: DataFrame, extra: DataFrame, limit: int = 3) -> DataFrame:
    """Missing codes paired with extra ones of the same receipt by smallest edit distance up to the limit, each used once."""
    c = missing.select("receipt_id", F.col("product_code").alias("missing")).join(extra.select("receipt_id", F.col("product_code").alias("extra")), "receipt_id")
    c = c.withColumn("distance", F.levenshtein("missing", "extra")).where(F.col("distance") <= limit)

    def run(rows: list[dict]) -> list[dict]:
        seen_m: set[str] = set()
        seen_e: set[str] = set()
        out = []
        for r in rows:
            if r["missing"] not in seen_m and r["extra"] not in seen_e:
                seen_m.add(r["missing"])
                seen_e.add(r["extra"])
                out.append(r)
        return out

    return by_group(c, ["receipt_id"], ["missing", "distance", "extra"], run, "receipt_id long, missing string, extra string, distance int")


def parse_items(lines: DataFrame, catalog: DataFrame, column: str = "text", code: str = X.CODE) -> DataFrame:
    """lines with code and quantity of cleaned two-column lines; nulls where a line has none.

    A code of 2 to 4 letters and a whole number that together are a code of the catalog are that code, with quantity 1.
    """
    d = lines.withColumn("_p", X.parse_raw(F.col(column), code))
    word, qty = F.col("_p.code"), F.col("_p.quantity")
    joined = F.when(word.rlike("^[A-Z]{2,4}$") & (qty == F.floor(qty)), F.concat(word, qty.cast("long").cast("string")))
    known = small(catalog.select(F.col("product_code").alias("_k")).distinct())
    j = d.withColumn("_j", joined).join(known, F.col("_j") == F.col("_k"), "left")
    whole = F.col("_k").isNotNull()
    out = j.withColumn("code", F.when(whole, F.col("_k")).otherwise(word)).withColumn("quantity", F.when(whole, 1.0).otherwise(X.sane_item_quantity(qty)))
    return out.drop("_p", "_j", "_k")


def parse_lines(lines: DataFrame, code: str = X.CODE) -> DataFrame:
    """Items of text lines: four columns first, then two; skipped, total and unreadable lines give nothing. Codes have the given form."""
    d = lines.where(~X.is_skipped(F.col("text")))  # totals too
    # one generated row a line: a filter on the result isn't pushed below, where it would repeat the parsing
    priced = lambda c: X.parse_priced(c) if code == X.CODE else X.parse_priced(c, code)
    parsed = F.array(X.let(X.clean(F.col("text")), lambda t: X.let(X.glue_numbers(t), lambda c: X.let(priced(c), lambda p: F.struct(p.alias("_p"), F.when(p.isNull(), X.parse_item(c, code)).alias("_i"))))))
    d = d.select("receipt_id", "line_no", "confidence", F.inline_outer(parsed))
    return d.where("_p IS NOT NULL OR _i IS NOT NULL").select(
        "receipt_id", F.col("line_no").alias("pos"), F.coalesce("_p.code", "_i.code").alias("product_code"), F.coalesce("_p.quantity", "_i.quantity").alias("quantity"),
        F.coalesce("_p.rate", F.lit(0.0)).alias("unit_price"), F.coalesce("_p.amount", F.lit(0.0)).alias("line_total"), "confidence",
    )


def pipe_parts(lines: DataFrame) -> DataFrame:
    """(receipt_id, line_no, part, text) of lines divided at strokes; blank parts are left out."""
    return lines.select("receipt_id", "line_no", F.posexplode(F.split("text", "[|]")).alias("part", "text")).where(F.trim("text") != "")


def split_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines with several catalog codes divided before each code but the first, together with a number right before it, and lines divided at strokes.

    Runs of letters and digits meet the catalog in an equi-join, so its size doesn't matter. Lines with fewer codes stay whole.
    """
    line = ["_id", "receipt_id", "line_no", "part"]
    pieces = pipe_parts(lines).withColumn("_id", F.monotonically_increasing_id()).select(*line, F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))).alias("_pos", "_w"))
    known = catalog.select(F.upper("product_code").alias("_code")).distinct()
    hits = pieces.withColumn("_u", F.upper("_w")).join(small(known), F.col("_u") == F.col("_code"), "left")
    nth = F.greatest(F.count("_code").over(W.partitionBy("_id").orderBy("_pos")) - 1, F.lit(0)).cast("int")
    # of each stretch from a code to the next, the code and what follows it
    g = hits.withColumn("piece", nth).groupBy(*line, "piece").agg(F.sort_array(F.collect_list(F.struct("_pos", "_w", F.col("_code").isNotNull().alias("_c")))).alias("_t"))
    last = F.array_max(F.transform("_t", lambda x, i: F.when(x["_c"], i)))  # the code's place; the first stretch has words before it
    after = F.concat_ws("", F.transform(F.when(last.isNull(), F.array().cast("array<string>")).otherwise(F.slice("_t._w", last + 2, F.size("_t"))), lambda x: x))
    order = W.partitionBy("_id").orderBy("piece")
    moved = F.regexp_extract(after, "(?s)(?:^|[^0-9])([0-9]+[ \t]*)$", 1)
    d = g.select(*line, "piece", F.concat_ws("", "_t._w").alias("_text"), F.when(F.lead("piece").over(order).isNotNull(), moved).otherwise("").alias("_m"))
    text = F.concat(F.coalesce(F.lag("_m").over(order), F.lit("")), F.expr("left(_text, length(_text) - length(_m))"))
    return d.select("receipt_id", "line_no", "part", "piece", F.regexp_replace(text, "^\\s+|\\s+$", "").alias("text")).where("text <> ''")


def reglue(lines: DataFrame, catalog: DataFrame, key: tuple[str, ...] = ("receipt_id", "line_no"), column: str = "text") -> DataFrame:
    """lines with catalog codes put together that blanks divide, from left to right, each word once.

    Two to four letters and a number, or a letter and a number, that are a code together stay as they are written; letters and digits before one or two
    more digits may also be a spelling of a code, which replaces them.
    """
    keys = list(key)
    words = F.split(F.col(column), " ")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.get(words, i - 1).alias("a"), F.get(words, i).alias("b")))
    short = lambda x: x["a"].rlike("^[A-Za-z]{2,4}$") & x["b"].rlike("^[A-Za-z]?[0-9]{1,3}$")
    tail = lambda x: x["a"].rlike("^[A-Za-z]{2,4}[0-9]{1,2}$") & x["b"].rlike("^[0-9]{1,2}$")
    c = lines.select(*keys, F.explode(F.filter(pairs, lambda x: x["b"].isNotNull() & (short(x) | tail(x)))).alias("x"))
    c = c.select(*keys, "x.i", F.concat("x.a", "x.b").alias("j"), tail(F.col("x")).alias("spell"))
    known = small(catalog.select(F.upper("product_code").alias("_k")).distinct())
    d = c.join(known, F.upper("j") == F.col("_k"), "left")
    rest = d.where("_k IS NULL AND spell").select("j").distinct().select("j", F.posexplode(M.variant_list("j")).alias("n", "v"))
    spelt = rest.join(known, F.col("v") == F.col("_k")).groupBy("j").agg(F.min_by("v", "n").alias("v"))
    hits = d.join(spelt, "j", "left").withColumn("as", F.when(F.col("_k").isNotNull(), F.col("j")).otherwise(F.col("v"))).where("as IS NOT NULL")
    g = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "as"))).alias("_h"))
    # from left to right, a word that is taken isn't taken again
    taken = F.aggregate("_h", F.array().cast("array<struct<i:int,as:string>>"), lambda acc, h: F.when(F.exists(acc, lambda t: t["i"] == h["i"] - 1), acc).otherwise(F.concat(acc, F.array(h))))
    j = lines.join(g.select(*keys, taken.alias("_h")), keys, "left")
    at = lambda i: F.filter("_h", lambda t: t["i"] == i)
    glued = F.transform(words, lambda w, k: F.when(F.size(at(k + 1)) > 0, F.get(at(k + 1), F.lit(0))["as"]).when(F.size(at(k)) > 0, F.lit(None)).otherwise(w))
    return j.withColumn(column, F.when(F.col("_h").isNull(), F.col(column)).otherwise(F.array_join(F.array_compact(glued), " "))).select(*lines.columns)


def _letters(c: str):
    """Each letter with how often it came before: the common elements of two such arrays are the common letters. In one order for all strings, repeated letters first."""
    at = F.split(F.col(c), "")
    return F.array_sort(F.transform(at, lambda x, i: F.concat(F.lpad((F.lit(99999) - F.size(F.filter(F.slice(at, 1, i), lambda y: y == x))).cast("string"), 5, "0"), x)))


def similar_pairs(a: DataFrame, b: DataFrame, x: str, y: str, cut) -> DataFrame:
    """All pairs with similarity `ratio` of x and y at least cut(length of x, length of y).

    2M/T is at most 2 (common letters) / T, so a pair needs o = cut T / 2 common letters. Of n letters in an order that all
    strings share, the first n - o + 1 must then have one in common with those of the partner: pairs meet on
    (both lengths, such a letter), an equi-join that loses none. The bound on all letters is checked before the comparison.
    Lengths that occur are collected, a few numbers.
    """
    sizes = {c: sorted(r[0] for r in d.select(F.length(c)).distinct().collect() if r[0]) for d, c in ((a, x), (b, y))}

    def keyed(d: DataFrame, c: str, other: str, first: bool) -> DataFrame:
        lengths = F.array(*[F.lit(n) for n in sizes[other]]).cast("array<int>")
        r = d.where(F.length(c) > 0).select("*", F.length(c).alias("_n"), _letters(c).alias("_l" + c), F.explode(lengths).alias("_o"))
        nx, ny = ("_n", "_o") if first else ("_o", "_n")
        need = F.greatest(F.ceil((F.col(nx) + F.col(ny)) * (cut(F.col(nx), F.col(ny)) - 1e-9) / 2), F.lit(1)).cast("int")
        r = r.withColumn("_need", need).where(F.col("_need") <= F.least("_n", "_o"))
        out = r.withColumn("_key", F.explode(F.slice("_l" + c, F.lit(1), F.col("_n") - F.col("_need") + 1))).withColumnsRenamed({nx: "_nx", ny: "_ny"})
        return out if first else out.drop("_need")

    left, right = keyed(a, x, y, True), keyed(b, y, x, False)
    j = left.join(right, ["_nx", "_ny", "_key"]).where(F.size(F.array_intersect("_l" + x, "_l" + y)) >= F.col("_need"))
    # a pair meets on each letter of both prefixes: the first one counts
    px, py = F.slice("_l" + x, F.lit(1), F.col("_nx") - F.col("_need") + 1), F.slice("_l" + y, F.lit(1), F.col("_ny") - F.col("_need") + 1)
    j = j.where(F.col("_key") == F.array_min(F.array_intersect(px, py)))
    limit = cut(F.col("_nx"), F.col("_ny"))
    return j.withColumn("ratio", M.similarity(x, y)).where(F.col("ratio") >= limit).drop("_nx", "_ny", "_key", "_need", "_l" + x, "_l" + y)


#: Similarities down to which the rounds of a search go, and strings with letters left out that a string may be known by in one.
ROUNDS, BROADEST = (0.85, 0.8, 0.75, 0.7, 0.65), 300


def _spread(df: DataFrame, c: str) -> DataFrame:
    """The different strings of a column that aren't empty, over all partitions: what comes next is much work on few bytes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(c).where(F.length(c) > 0).distinct().repartition(n, c)


def _once(c: Column, name: str) -> Column:
    """A column of a generated row: a filter on it isn't pushed below, where it would compute it again."""
    return F.explode_outer(F.array(c)).alias(name)


def _lengths(df: DataFrame, c: str) -> list[int]:
    """Lengths that occur, a few numbers."""
    return sorted(r[0] for r in df.select(F.length(c)).distinct().collect() if r[0])


def _common(nq: int, n: int, bound: float) -> int:
    """Letters that strings of two lengths need in common, in order, for a similarity."""
    return max(1, math.ceil((nq + n) * bound / 2 - 1e-9))


def too_broad(bound: dict[int, float], lengths: list[int]) -> list[int]:
    """Lengths of searched strings for which close_pairs would need too many strings with letters left out."""
    common = [(nq, n, _common(nq, n, b)) for nq, b in bound.items() for n in lengths]
    return sorted({nq for nq, n, m in common if m <= min(nq, n) and max(math.comb(nq, m), math.comb(n, m)) > BROADEST})


def without(c: Column, n: int) -> Column:
    """Different strings that c without n of its letters gives."""
    out = F.array(c)
    for _ in range(n):
        less = F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
        out = F.array_distinct(F.flatten(less))
    return out


def close_pairs(a: DataFrame, b: DataFrame, x: str, y: str, bound: dict[int, float], lengths: list[int]) -> DataFrame:
    """Pairs (x, y), each once, in which as many letters are common in order as a similarity of at least bound[length of x] needs: all pairs with it, and few others. lengths: of y.

    Strings of lengths n and m with k such letters are equal after leaving out n - k and m - k of them: pairs meet on what is left, an equi-join whose
    keys are nearly whole strings.
    """
    ways = [(nx, ny, _common(nx, ny, k)) for nx, k in bound.items() for ny in lengths]
    ways = [w for w in ways if w[2] <= min(w[:2])]

    def keyed(d: DataFrame, c: str, mine: int) -> DataFrame:
        table: dict[int, list] = {}
        for w in ways:
            table.setdefault(w[mine], []).append(F.struct(F.lit(w[0]).alias("_nx"), F.lit(w[1]).alias("_ny"), F.lit(w[mine] - w[2]).alias("_d")))
        kind = "array<struct<_nx:int,_ny:int,_d:int>>"
        at = F.lit(None).cast(kind)
        for n, rows in table.items():
            at = F.when(F.length(c) == n, F.array(*rows)).otherwise(at)
        e = d.select(c, F.inline(at))
        keys = F.array().cast("array<string>")
        for n in sorted({w[mine] - w[2] for w in ways}):
            keys = F.when(F.col("_d") == n, without(F.col(c), n)).otherwise(keys)
        return e.select(c, "_nx", "_ny", F.explode(keys).alias("_key"))

    if not ways:
        return a.select(x).crossJoin(b.select(y)).where(F.lit(False))
    # the planner's size estimate knows nothing of the keys of a string: neither side is broadcast
    return keyed(a, x, 0).join(keyed(b, y, 1).hint("merge"), ["_nx", "_ny", "_key"]).select(x, y).distinct()


def best_similar(codes: DataFrame, catalog: DataFrame, n: int = 1, cut: float = 0.65) -> DataFrame:
    """The n most similar catalog codes of each code; ties by the larger code.

    Rounds of falling similarity, as of close_forms: a code is done when it has n.
    """
    pool, todo, out = kept(_spread(catalog, "product_code")), kept(_spread(codes, "code")), []
    best = W.partitionBy("code").orderBy(F.desc("ratio"), F.desc("product_code"))
    top = lambda pairs: pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    lengths = _lengths(pool, "product_code")
    for rho in [*(x for x in ROUNDS if x > cut), cut]:
        bound = dict.fromkeys(_lengths(todo, "code"), rho)
        broad = too_broad(bound, lengths)
        if broad:
            wide = todo.where(F.length("code").isin(broad))
            out.append(top(similar_pairs(wide, pool, "code", "product_code", lambda nx, ny: F.lit(cut))).select("code", "product_code", "ratio"))
            todo = todo.where(~F.length("code").isin(broad))
        found = close_pairs(todo, pool, "code", "product_code", bound, lengths).select("*", _once(M.similarity("code", "product_code"), "ratio"))
        found = kept(top(found.where(F.col("ratio") >= (rho if rho == cut else rho - 1e-9))))
        done = found if rho == cut else found.join(found.where(F.col("_r") == n).select("code"), "code")
        out.append(done.select("code", "product_code", "ratio"))
        todo = kept(todo.join(done, "code", "left_anti"))
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)
