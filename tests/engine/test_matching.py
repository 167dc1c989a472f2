from __future__ import annotations

import random
from difflib import SequenceMatcher

from tallyweave.operators import matching


def _catalog(spark, rows):
    return spark.createDataFrame(rows, "product_code string, product_name string")


def test_best_similar_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("ABC12", k=rng.randint(1, 8)))
    codes, catalog = ["XBCDE17", *{word() for _ in range(60)}], ["ABCDE18", *{word() for _ in range(150)}]
    want = set()
    for c in codes:
        scored = sorted(((SequenceMatcher(None, c, p).ratio(), p) for p in catalog), reverse=True)
        want |= {(c, p, r) for r, p in [x for x in scored if x[0] >= 0.65][:3]}
    got = matching.best_similar(spark.createDataFrame([(c,) for c in [*codes, None]], "code string"), _catalog(spark, [(p, "") for p in catalog]), n=3)
    assert {(r["code"], r["product_code"], r["ratio"]) for r in got.collect()} == want
    assert ("XBCDE17", "ABCDE18") in {x[:2] for x in want}


def test_split_lines_with_a_large_catalog(spark, monkeypatch):
    monkeypatch.setattr(matching, "small", lambda df: df)
    lines = spark.createDataFrame([(1, 1, "AB1 2 cd2 3\tx EF3 | GH4 1"), (1, 1, "AB1 2 cd2 3\tx EF3 | GH4 1"), (2, 1, "one two AB1"), (3, 1, " \t |"), (4, 1, None)], "receipt_id long, line_no long, text string")
    got = sorted(tuple(r) for r in matching.split_lines(lines, _catalog(spark, [(c, "") for c in ("AB1", "CD2", "EF3", "GH4")])).collect())
    assert got == sorted([(1, 1, 0, 0, "AB1"), (1, 1, 0, 1, "2 cd2 3\tx"), (1, 1, 0, 2, "EF3"), (1, 1, 1, 0, "GH4 1")] * 2 + [(2, 1, 0, 0, "one two AB1")])


def test_descriptions_by_contained_code_and_similar_name(spark):
    catalog = _catalog(spark, [("AB1", "Blue paint"), ("AB12", "Yellow brush"), ("ZZ9", "Green ladder"), ("ZZ8", None)])
    texts = [(1, "one AB1 please"), (2, "a yellow brush, new"), (3, "xxAB12yy"), (4, "Gren laddr"), (5, "something else"), (6, "yelow brush"), (7, None), (8, "")]
    got = {tuple(r) for r in matching.match_descriptions(spark.createDataFrame(texts, "id long, text string"), catalog).collect()}
    none = {(k, None, "unmatched") for k in (5, 7, 8)}
    assert got == {(1, "AB1", "exact"), (2, "AB12", "contains"), (3, "AB12", "contains"), (4, "ZZ9", "fuzzy"), (6, "AB12", "fuzzy")} | none


def test_match_codes_against_the_function(spark):
    from tallyweave.functions import match as M

    rng = random.Random(11)
    catalog = sorted({"".join(rng.choices("ABT10", k=rng.randint(3, 9))) for _ in range(70)})
    codes = {"".join(rng.choices("ABT1O0I8", k=rng.randint(2, 9))) for _ in range(90)} | {c[:-1] + "Z" for c in catalog[:20]} | {c + "O" for c in catalog[:10]} | {"", "a"}
    got = {r["code"]: (r["matched_code"], r["match_type"]) for r in matching.match_codes(spark.createDataFrame([(c,) for c in [*codes, None]], "code string"), _catalog(spark, [(c, "") for c in catalog])).collect()}
    known = dict.fromkeys(catalog, "")
    assert got == {c: M.map_code(c, known) for c in codes} | {None: (None, "unknown")}
    assert {"exact", "fuzzy", "unknown"} <= {v[1] for v in got.values()}


def test_same_places_needs_no_similarity(spark):
    forms = spark.createDataFrame([("c", 0, "ABCDEFGH"), ("d", 0, "ABCDEFG"), ("e", 0, "ABCDEF")], "_code string, _i int, _v string")
    cat = spark.createDataFrame([("ABCDEFGX",), ("ABCDEF",), ("ZZCDEFGH",)], "product_code string")
    assert {tuple(r) for r in matching.same_places(forms, cat).collect()} == {("c", "ABCDEFGX"), ("d", "ABCDEFGX")}  # 7 of 8; the spelling of e is too short for another place


def test_split_lines_keeps_numbers_with_the_next_code(spark):
    cases = {"9 10 XYZ RST 6": ["9 10 XYZ", "RST 6"], "ABC 2 XYZ 3": ["ABC", "2 XYZ 3"], "ABC-5 xyz": ["ABC-", "5 xyz"], "ABC qt5  XYZ": ["ABC qt", "5  XYZ"], "ABCXYZ 3": ["ABCXYZ 3"], "only XYZ 4": ["only XYZ 4"], "RST,XYZ": ["RST,", "XYZ"]}
    lines = spark.createDataFrame([(k, 1, x) for k, x in enumerate(cases)], "receipt_id long, line_no int, text string")
    out: dict[int, list] = {}
    for r in sorted(matching.split_lines(lines, _catalog(spark, [(c, "") for c in ("ABC", "XYZ", "RST")])).collect()):
        out.setdefault(r.receipt_id, []).append(r.text)
    assert [out[k] for k in range(len(cases))] == list(cases.values())


def test_reglue_by_rule(spark):
    cases = {"PEPW 20": "PEPW20", "pep w1 3": "pepw1 3", "TEw2 0": "TEw20", "TEW2 9": "TEW2 9", "a PEPW 20 5 x": "a PEPW20 5 x", "PEPW": "PEPW", "": "", "PEPW 20 20": "PEPW20 20", "TEWI 0": "TEWI 0", "TE1 0 0": "TE1 0 0"}
    lines = spark.createDataFrame([(k, 1, x) for k, x in enumerate([*cases, None])], "receipt_id long, line_no int, text string")
    got = {r.receipt_id: r.text for r in matching.reglue(lines, _catalog(spark, [(c, "") for c in ("PEPW20", "PEPW1", "TEW20")])).collect()}
    assert [got[k] for k in range(len(cases) + 1)] == [*cases.values(), None]


def test_close_pairs_are_few_and_whole(spark):
    codes, pool = [f"P{k}x" for k in range(7, 2000, 97)], [f"P{k}" for k in range(2000)]
    c, p = spark.createDataFrame([(x,) for x in codes], "code string"), spark.createDataFrame([(x,) for x in pool], "product_code string")
    got = {tuple(r) for r in matching.close_pairs(c, p, "code", "product_code", {n: 0.8 for n in range(3, 7)}, [2, 3, 4, 5]).collect()}
    assert {(x, y) for x in codes for y in pool if SequenceMatcher(None, x, y).ratio() >= 0.8} <= got
    assert len(got) < 0.05 * len(codes) * len(pool)  # all share letters, so meeting on one compares nearly all pairs


def test_searches_too_broad_for_keys_compare_all_pairs(spark, monkeypatch):
    codes, catalog = ["P12x", "Q123", "PP1234", "ZZZZZZZ"], [(f"P{k}", "") for k in (1, 2, 12, 123, 1234, 12345)]
    df, cat = spark.createDataFrame([(c,) for c in codes], "code string"), _catalog(spark, catalog)

    def both():
        return {tuple(r) for r in matching.best_similar(df, cat, n=2).collect()}, {tuple(r) for r in matching.match_codes(df, cat).collect()}

    narrow = both()
    monkeypatch.setattr(matching, "BROADEST", 4)
    assert matching.too_broad({6: 0.65}, [4, 5]) == [6]
    assert both() == narrow and len(narrow[0]) > 4


def test_names_with_one_first_word_are_compared_with_few_texts(spark):
    catalog = _catalog(spark, [(f"A{k:04}", f"Steel bolt {k:04}") for k in range(1500)] + [("B1", "Steel bolt 0007"), ("A0", "steel"), ("C1", ""), ("C2", None)])
    texts = spark.createDataFrame([(k, f"a steel bolt {k:04}, please") for k in range(1500)] + [(5000, "xsteel"), (5001, "steel?")], "id long, text string")
    out = matching.match_descriptions(texts, catalog)
    got = {r.id: (r.matched_code, r.match_type) for r in out.collect()}
    assert got == {k: (f"A{k:04}", "contains") for k in range(1500)} | {5000: ("A0", "fuzzy"), 5001: ("A0", "contains")}
    names = catalog.selectExpr("upper(product_name) AS name")
    assert matching.substrings(texts.selectExpr("upper(text) AS text").distinct(), names, "name").count() < 40 * 1502  # not 1,500 names a text
