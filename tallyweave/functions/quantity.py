"""Quantities and codes in free text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import WORD_CODE, clean, dash_quantity, decode_quantity, parse_item


#: Characters that are digits or are read for digits, and what they stand for.
_DIGITS = "[IOlio(0-9'}`]"
_FROM, _TO = "IilOo('}`", "111001331"
#: What follows a quantity: marks by letter, by ampersand, by a 4 read for Q, a mark alone at the end, or bare t at the end after a blank or dash.
_MARKS = ("[Qq][Tt1I]", "&[Tt1]?", "4[Tt1]", "[Qq&][\\s\"'.)\\]]*$", "[Tt][Tt]?\\s*[.\\s]*$")


def marked_quantity(c: Column) -> Column:
    """Number right before a quantity mark ("3 qty", "IOqt", "3&T"), within 1..999; of several the last counts, of marks at one place the first kind."""
    # up to three characters, as many as there are, not all of them zeros
    number = f"((?=[Oo0]{{0,2}}[Iil(1-9'}}`])(?:(?<!{_DIGITS}){_DIGITS}{{1,3}}|{_DIGITS}{{3}}))"
    found = []
    for k, mark in enumerate(_MARKS):
        before = "(?<=[\\s\u2013\u2014-])" if k == 4 else ""
        p = f"(?s)^(.*){before}{number}\\s*{mark}"
        value = F.translate(F.regexp_extract(c, p, 2), _FROM, _TO).try_cast("int")
        found.append(F.when(c.rlike(p), F.struct(F.length(F.regexp_extract(c, p, 1)).alias("at"), F.lit(-k).alias("kind"), value.alias("n"))))
    return F.array_max(F.array_compact(F.array(*found)))["n"]


def _range(n: Column) -> Column:
    return F.when(n.between(1, 999), n)


def free_quantity(c: Column) -> Column:
    """Number after a dash; else the last number of at most 99 in words that aren't codes or quantity marks, else their last number; else a word of misread digits; else 1.

    All within 1..999. Words of 2 to 4 letters are codes, and so are longer ones with letters and digits.
    """
    dash = _range(F.regexp_extract(c, "[-\u2013\u2014]\\s*([0-9]{1,3})", 1).try_cast("int"))
    words = F.filter(F.split(c, "\\s+"), lambda x: ~x.rlike("^[A-Za-z]{2,4}$"))
    mixed = lambda x: (F.length(x) >= 3) & x.rlike("\\p{L}") & x.rlike("[0-9]")
    plain = F.filter(words, lambda x: x.rlike("[\\p{L}\\p{N}]") & ~x.rlike("^[Qq&4][Tt1I]?$") & ~mixed(x))
    numbers = F.flatten(F.transform(plain, lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1))))
    numbers = F.filter(F.transform(numbers, lambda x: _range(x.try_cast("int"))), lambda x: x.isNotNull())
    misread = F.filter(words, lambda x: x.rlike("^[IlOo|!0-9]+$") & x.rlike("[IlOo|!]"))
    decoded = F.filter(F.transform(misread, lambda x: _range(F.translate(x, "IlOo|!", "110011").try_cast("int"))), lambda x: x.isNotNull())
    small = F.filter(numbers, lambda x: x <= 99)
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    return F.coalesce(dash, last(small), last(numbers), F.try_element_at(decoded, F.lit(1)), F.lit(1)).cast("double")


#: Single letters that are written like digits.
_HAND = {"V": 2, "v": 2, "Z": 2, "z": 2, "S": 5, "s": 5, "B": 8, "b": 8, "q": 9, "g": 9}


def quantity_beside(c: Column, code: Column, initials: Column | None = None) -> Column:
    """A free quantity other than 1; else one decoded from the words after the code, else from those before it, else a single letter after it that is written like a digit; else 1.

    A word is the code if one of both contains the other. initials: first letters of the catalog's codes (array), which are never digits.
    """
    words, code = F.split(c, "\\s+"), F.upper(code)
    at = F.array_position(F.transform(words, lambda x: F.contains(F.upper(x), code) | F.contains(code, F.upper(x))), True).cast("int")
    dashed = lambda x: F.when(x.rlike("^[-\u2013\u2014]"), _range(dash_quantity(x)))
    first = lambda xs, f: F.try_element_at(F.filter(F.transform(xs, f), lambda v: v.isNotNull()), F.lit(1))
    decode = lambda x: F.coalesce(dashed(x), decode_quantity(x))
    after = F.when(at > 0, F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))))
    before = F.when(at > 0, F.slice(words, 1, at - 1)).otherwise(words)
    table = F.create_map(*[F.lit(x) for kv in _HAND.items() for x in kv])
    taken = lambda x: F.array_contains(initials, F.upper(x)) if initials is not None else F.lit(False)
    single = first(after, lambda x: F.when(~F.contains(code, F.upper(x)) & ~taken(x), F.try_element_at(table, x)))
    clear = free_quantity(c)
    return F.coalesce(F.when(clear != 1, clear), first(after, decode), first(before, decode), single, F.lit(1)).cast("double")


def gather_letters(c: Column) -> Column:
    """Single letters that blanks scatter, as one word ("A B C 2" -> "ABC 2")."""
    return F.regexp_replace(c, "(?<![A-Za-z0-9])([A-Za-z]) (?=[A-Za-z](?![A-Za-z0-9]))", "$1")


def scattered_item(c: Column) -> Column:
    return parse_item(clean(gather_letters(c)))


def codes_in(c: Column) -> Column:
    """All code-like words of a line."""
    return F.regexp_extract_all(c, F.lit(f"\\b({WORD_CODE})\\b"), F.lit(1))
