"""Column functions over noisy text lines. All stay in the JVM; patterns avoid look-around, so other engines can run them too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Product codes in two-column lines: 3 to 6 letters, or 2 to 4 letters and up to three letters or digits.
CODE = "[A-Za-z]{3,6}|[A-Za-z]{2,4}[A-Za-z0-9]{1,3}"
#: Code-like words in general; catalogs may have other codes than CODE describes.
WORD_CODE = "[A-Za-z]{1,4}[A-Za-z0-9]{1,6}"
TOTAL_WORD = "(?:tota[li1]|t0tal|totd|toal|tdal|tetal)"
QTY_WORD = "(?:quantity|qty|qtv|qly|qiy|qtt|qtyt)"
GRAND_WORD = "(?:gra[nm]d|grr?amd|grrand)"
SEP = "[\\s:=_.-]*"
NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
_OPEN = "([0-9]+[.]?[0-9]*)"
#: Words of column headers, and what else makes a line a header, a footer or noise.
_COLUMN = "(?:item\\s*code|s[.]?\\s*no|quantity|amount|price|code|item|rate|unit|qty)"
HEADER = "(?i)" + "|".join(
    [
        "^\\s*$", "^\\s*[^\\p{L}\\p{N}\\s]\\s*$", "^\\s*[0-9]{1,2}\\s*$", "^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$", "^[0-9]{1,2}:[0-9]{2}", "^[*_=#-]{3,}$",
        "invoice|date|time|receipt\\s*#", "change|cash|sign|thank", "^(?:qty|quantity|name|code|product|item|sr[.]?\\s*no)", "^lte[a-z]*$", "^(?:unit|price|rate|amount|paid|bill|mart|shop|store|firma)$",
        "^(?:qry|qly|qtv|qty|qix|qtx)$", "[(]\\s*(?:only|number|capitals|block)", "^\\s*s[.]?\\s*no\\b", "^\\s*(?:unit|amt|price|rate|amount|receipt\\s*#?)\\s*$", "prepared\\s*by|total\\s*items", f"^\\s*{_COLUMN}(?:\\s+{_COLUMN})+",
    ]
)
#: Remains of a quantity mark that look like a code.
MARK_LIKE = "^\\s*[IlOo|1][qQtTfF0-9][qQtTfF0-9.]*\\s*$"
TOTAL_LINE = "(?i)tota[li1]|t0tal|totd|totol|toial|tatal|toal|tdal|tetal|sum"
NOT_TOTAL = "(?i)(?:total|totd)\\s*(?:items|count|no|number|products|entries)"
#: Total patterns from the most to the least specific, and what is tried last.
TOTALS = [f"(?i){p}" for p in (f"{TOTAL_WORD}{SEP}{QTY_WORD}{SEP}{_OPEN}", f"{GRAND_WORD}{SEP}{TOTAL_WORD}{SEP}{_OPEN}", f"sub{SEP}total{SEP}{_OPEN}", f"{TOTAL_WORD}[\\s:=_-]+{_OPEN}", f"sum[\\s:=_-]+{_OPEN}", f"{TOTAL_WORD}.*?{QTY_WORD}.*?{_OPEN}\\s*$")]
TOTAL_LAST = f"(?i)(?:tota[li1]|t0tal|totd|sum)\\s*(?:quantity|qty|qtv|qly)?[\\s:=_.-]*{_OPEN}"
GRAND = [f"(?i){p}{SEP}{_OPEN}" for p in (f"{GRAND_WORD}{SEP}{TOTAL_WORD}", f"{TOTAL_WORD}{SEP}am(?:oun)?t", f"bill{SEP}{TOTAL_WORD}", f"net{SEP}{TOTAL_WORD}")]
GRAND_LINE = f"(?i){GRAND_WORD}{SEP}{TOTAL_WORD}|{TOTAL_WORD}{SEP}am(?:oun)?t|bill{SEP}{TOTAL_WORD}|net{SEP}{TOTAL_WORD}"
#: A number whose first digit was read as a letter or a stroke.
MISREAD = "([IlOo|!][0-9IlOo|!]{0,2})"
#: Words that are quantity marks or units, not codes.
NOT_CODES = "(?i)^(qt|qts|qty|iqt|pc|pcs|no|nos|unit|units)$|(?i)^qt[sy]?[.]$|^[IlOo|1][qQtTfF0-9][qQtTfF0-9.]*$"


def item_patterns(code: str = CODE) -> list[str]:
    """Two-column forms in order of priority; the two groups are code and quantity in either order, the last form has a code alone."""
    c, n = f"({code})", "([0-9]+[.]?[0-9]*)"
    forms = [
        f"{c}\\s*[-\u2013\u2014]\\s*{n}", f"[0-9]{{1,2}}\\s+{c}\\s+{n}", f"[0-9]{{1,2}}\\s+{c}\\s+{MISREAD}", f"{c}\\s+{n}", f"{n}\\s+{c}", f"{c}\\s*[xX\u00d7]\\s*{n}",
        f"{c}\\s*:\\s*{n}", f"{c}\\s*[(]\\s*{n}\\s*[)]", f"{c}\\s+{MISREAD}",
    ]
    alone = "([A-Za-z]{2,4}[A-Za-z0-9]{1,3}|[A-Za-z]{3,6})" if code == CODE else c
    return [f"(?i){f}" for f in [*forms, f"^{alone}$"]]


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def clean(c: Column) -> Column:
    """Text without a leading line number, quantity suffixes and noise signs, with single blanks. Strokes stay: they may be letters, or divide items."""
    t = F.regexp_replace(c, "^\\s*[0-9]{1,2}\\s*[.):\u2013\u2014-]\\s*", "")
    t = F.regexp_replace(F.translate(t, "{}[]&$#_=;", ""), "(?i)([0-9]+[.]?[0-9]*)\\s*(?:qt[sy]?[.]?|quantity)", "$1")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def letters(c: Column) -> Column:
    """Digits and signs that stand for letters as letters, upper case; underscores vanish."""
    return F.upper(F.translate(c, "|1!06859()2473_", "IIIOGBSGCJZATE"))


def decode_quantity(c: Column) -> Column:
    """Number at the start of a token where I, l, | and ! may stand for 1 and O for 0, within 1..999; over 99 its shortest prefix of two digits or more that is in 1..99.

    Dots, commas and underscores don't count; tokens that are longer than six characters then, or begin with another letter, are no numbers.
    """
    t = F.trim(F.regexp_replace(c, "[.,_]", ""))
    d = F.regexp_extract(F.translate(t, "OoIl|!", "001111"), "^[0-9]+", 0)
    n = F.when(F.length(t).between(1, 6), d.try_cast("int"))
    prefix = F.when(d.startswith("00"), F.regexp_extract(d, "^0+[1-9]", 0)).otherwise(F.substring(d, 1, 2)).try_cast("int")
    return F.when(n.between(1, 99), n).when(n.between(100, 999), prefix)


#: First letters of a fragment after a dash that are misread digits.
DASH_DIGITS = {"a": 2, "A": 2, "z": 2, "Z": 2, "l": 1, "I": 1, "i": 1, "s": 5, "S": 5, "b": 6, "B": 8, "g": 9, "q": 9, "T": 7, "'": 3, "`": 1, "}": 3, "{": 1}


def dash_quantity(c: Column) -> Column:
    """Quantity of a fragment like "-axk": its first digits; else its first letter, if nothing but remains of a quantity mark follows; else what can be decoded."""
    body = F.regexp_replace(c, "^[-\u2013\u2014]+\\s*", "")
    table = F.create_map(*[F.lit(x) for kv in DASH_DIGITS.items() for x in kv])
    rest = F.substring(body, 2, 1 << 20)
    misread = F.when((rest == "") | rest.rlike("(?i)^[qtfxkpyr}\\s.'`]+$"), F.try_element_at(table, F.substring(body, 1, 1)))
    return F.coalesce(F.regexp_extract(body, "[0-9]+", 0).try_cast("int"), misread, decode_quantity(body))


def is_skipped(c: Column) -> Column:
    """Blank, single signs, bare numbers, remains of quantity marks, headers, footers and totals: lines without an item."""
    return c.isNull() | c.rlike(HEADER) | c.rlike(MARK_LIKE) | is_total(c) | c.rlike(GRAND_LINE)


def is_total(c: Column) -> Column:
    """A line with a total word, unless it counts items."""
    return c.rlike(TOTAL_LINE) & ~c.rlike(NOT_TOTAL)


def total_value(c: Column) -> Column:
    """Value by the first pattern that gives one in (0, 99999]."""
    tries = []
    for p in [*TOTALS, TOTAL_LAST]:
        tries.append(let(extract(c, p).try_cast("double"), lambda v: F.when((v > 0) & (v <= 99999), v)))
    return F.coalesce(*tries)


def total_rank(c: Column) -> Column:
    """Index of the first total pattern that matches, null if none."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(k)) for k, p in enumerate([*TOTALS, TOTAL_LAST])])


def grand_total(c: Column) -> Column:
    """Amount of a grand total line by the first pattern that matches, if it is over 0."""
    v = F.coalesce(*[extract(c, p).try_cast("double") for p in GRAND])
    return F.when(v > 0, v)


def is_code_like(c: Column) -> Column:
    return c.rlike("^[A-Za-z]{2,}")


def as_quantity(c: Column) -> Column:
    """A number, or a word of digits and letters that look like digits, within 1..999; else null."""
    decoded = F.when(c.rlike("^[0-9IilOo|!]+$"), F.translate(c, "IilOo|!", "1110011").try_cast("double"))
    return F.when(c.rlike("^([0-9]+[.]?[0-9]*|[.][0-9]+)$"), c.try_cast("double")).otherwise(F.when(decoded.between(1, 999), decoded))


def roles(a: Column, b: Column) -> tuple[Column, Column]:
    """(code, quantity) of two words in unknown order; both null where the other word of the code is no quantity.

    The word that begins with two letters is the code if only one does; else the first that is all letters.
    """
    ca, cb = is_code_like(a), is_code_like(b)
    letters_only = lambda x: x.rlike("^[A-Za-z]+$")
    first = F.when(ca & ~cb, True).when(cb & ~ca, False).when(letters_only(a), True).when(letters_only(b), False)
    qty = F.when(first, as_quantity(b)).when(~first, as_quantity(a))
    return F.when(qty.isNotNull(), F.upper(F.when(first, a).otherwise(b))), qty


def parse_raw(c: Column, code: str = CODE) -> Column:
    """struct(code, quantity) by the first two-column form that gives both; null if none does. A code alone has quantity 1.

    Keep it as a column of its own before taking fields of it.
    """
    *forms, alone = item_patterns(code)
    known = lambda y: F.when(y["code"].isNotNull() & ~y["code"].rlike(NOT_CODES), y)
    pair = lambda word, qty: F.struct(word.alias("code"), qty.alias("quantity"))

    def item(a: Column, b: Column, turned: bool) -> Column:
        if code == CODE:
            return pair(*roles(a, b))
        # codes that don't begin with two letters: the form alone tells
        return let(as_quantity(a if turned else b), lambda q: pair(F.when(q.isNotNull(), F.upper(b if turned else a)), q))

    def form(p: str, turned: bool) -> Column:
        both = lambda a: let(F.regexp_extract(c, p, 2), lambda b: let(item(a, b, turned), known))
        return let(F.regexp_extract(c, p, 1), lambda a: F.when(a != "", both(a)))

    bare = let(pair(F.nullif(F.upper(F.regexp_extract(c, alone, 1)), F.lit("")), F.lit(1.0)), known)
    return F.coalesce(*[form(p, k == 4) for k, p in enumerate(forms)], bare)  # later forms are tried only if the ones before give nothing


def sane_item_quantity(q: Column) -> Column:
    """Quantity of a two-column line: outside (0, 50] it is 1; to one place."""
    return F.when((q <= 0) | (q > 50), 1.0).otherwise(F.bround(q, 1))


def parse_item(c: Column, code: str = CODE) -> Column:
    """struct(code, quantity) of a cleaned two-column line; null if it has no code. Quantities outside (0, 50] are 1."""
    return let(parse_raw(c, code), lambda p: F.when(p.isNotNull(), F.struct(p["code"].alias("code"), sane_item_quantity(p["quantity"]).alias("quantity"))))


def parse_priced(c: Column, code: str = "[A-Za-z]{2,4}[A-Za-z0-9]{1,3}|[A-Za-z]{3,6}") -> Column:
    """struct(code, quantity, rate, amount) of a four-column line, else null.

    Columns stand apart, or a sign for times before the rate and one for the sum before the amount. Rate and amount are 1 at least, the quantity is in
    1..999, and the amount is within 15 % of quantity times rate; the first form that fits counts.
    """
    n = "([0-9]+[.]?[0-9]*)"
    forms = [f"(?i)({code})\\s+{n}\\s+{n}\\s+{n}", f"(?i)({code})\\s+{n}\\s*[@x\u00d7]\\s*{n}\\s*=?\\s*{n}"]
    number = lambda p, k: F.regexp_extract(c, p, k).try_cast("double")
    groups = lambda p, word: F.struct(F.upper(word).alias("code"), number(p, 2).alias("quantity"), number(p, 3).alias("rate"), number(p, 4).alias("amount"))

    def fits(g: Column) -> Column:
        due = g["quantity"] * g["rate"]
        return (g["rate"] >= 1) & (g["amount"] >= 1) & g["quantity"].between(1, 999) & (F.abs(g["amount"] - due) / F.greatest(due, F.lit(1.0)) < 0.15)

    one = lambda g: F.struct(g["code"].alias("code"), F.bround(g["quantity"], 1).alias("quantity"), g["rate"].alias("rate"), g["amount"].alias("amount"))
    form = lambda p: let(F.regexp_extract(c, p, 1), lambda word: F.when(word != "", let(groups(p, word), lambda g: F.when(fits(g), one(g)))))
    return F.coalesce(*[form(p) for p in forms])  # the second only if the first doesn't fit


def infer_quantity(rate: Column, amount: Column) -> Column:
    """Whole quantity in 1..999 that explains amount / rate to within 0.05, where the rate is 10 at least and at most the amount; else null."""
    q = F.try_divide(amount, rate)
    return F.when((rate >= 10) & (amount >= rate) & q.between(0.8, 999) & (F.abs(q - F.rint(q)) < 0.05), F.rint(q))


def glue_numbers(c: Column, code: str = "[A-Za-z]{2,4}[A-Za-z0-9]{1,3}|[A-Za-z]{3,6}") -> Column:
    """Numbers after a leading code that a blank tore apart ("1 180 0 3600"), glued twice: two digits or more and one or two that follow."""
    lead = f"(?is)^(\\s*(?:{code})\\s+)(.*)$"
    once = lambda x: F.regexp_replace(x, "([0-9]{2,})\\s([0-9]{1,2})(?=\\s|$)", "$1$2")
    tail = F.regexp_extract(c, lead, 2)
    return F.when(c.rlike(lead), F.concat(F.regexp_extract(c, lead, 1), once(once(tail)))).otherwise(c)


def adaptive_cutoff(n: Column) -> Column:
    """Similarity that a code of this length needs."""
    return F.when(n <= 3, 0.88).when(n <= 4, 0.82).when(n <= 6, 0.72).otherwise(0.65)


def positional_overlap(a: Column, b: Column) -> Column:
    """Share of equal characters at equal places; containment gives at least 0.7."""
    n = F.greatest(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + F.when((F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= F.length(a)) & (i <= F.length(b)), 1).otherwise(0))
    share = same / F.greatest(n, F.lit(1))
    return F.when(F.contains(a, b) | F.contains(b, a), F.greatest(share, F.lit(0.7))).otherwise(share)


#: Total words as they are read, in the order in which they are looked for.
TOTAL_VARIANTS = "total|totai|tota1|t0tal|totol|toial|to7al|tatal|tolal|totel|totd|qtyt|qiy|qtt"


def recover_digits(c: Column) -> Column:
    """Number after the first total word, as it stands or, within (0, 99999], with letters read for digits ("Total Qty II" -> 11)."""
    after = F.regexp_extract(c, f"(?is)(?:{TOTAL_VARIANTS})(.*)$", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(after, "^[\\s:=-]+|[\\s:=-]+$", ""), "(?i)^(?:quantity|qty|qtv|qly)[\\s:=-]*", ""))
    digits = lambda b: F.trim(F.regexp_replace(F.translate(b, "OoIl|!ZzSsGgBTA", "001111225566874"), "[^0-9 .]", ""))
    plain = lambda b: F.when(b.rlike("^[0-9]+[.]?[0-9]*$"), b.try_cast("double"))
    misread = lambda d: F.when(d.rlike("^([0-9]+[.]?[0-9]*|[.][0-9]+)$"), d.try_cast("double"))
    within = lambda m: F.when((m > 0) & (m <= 99999), m)
    return let(bare, lambda b: F.coalesce(plain(b), let(digits(b), lambda d: let(misread(d), within))))


def is_noise_fragment(c: Column) -> Column:
    """Fragments without information, such as "[." or "%."."""
    return F.trim(c).rlike("^[\\[(%]?[.]?$|^[\\[(%]\\s*[.]\\s*$")


def only_header_words(c: Column, headers: Column) -> Column:
    """Whether all words of a text are among the headers."""
    return F.size(F.array_except(F.filter(F.split(c, " "), lambda x: x != ""), headers)) == 0


def stripped_number(raw: Column) -> Column:
    """Quantity of a line whose leading number was taken for a line number: a number after a dash, else the leading one if no word follows; 1 otherwise."""
    lead = "^\\s*([0-9]{1,2})\\s*[.):\u2013\u2014-]?\\s*"
    n = F.regexp_extract(raw, lead, 1).try_cast("double")
    rest = F.regexp_replace(raw, lead, "")
    dash = F.regexp_extract(rest, "[-\u2013\u2014]\\s*([0-9]{1,3})", 1).try_cast("double")
    return F.when(n.isNull() | (n < 1), 1.0).otherwise(F.coalesce(dash, F.when(rest.rlike("[A-Za-z]{2}"), 1.0).otherwise(n)))
