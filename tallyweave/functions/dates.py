"""Dates in text and calendar helpers; "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import let

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def date_candidate(c: Column) -> Column:
    """struct(date, form) of the first form that gives a date: 0 dd/mm/yyyy, 1 yyyy-mm-dd, 2 d Mon yyyy, 3 Mon d, yyyy; null if none does.

    Day, month and year (1900 to 2100) must be in range.
    """
    months = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
    dmy = "([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
    iso = "([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})"
    named = f"(?i)([0-9]{{1,2}})[\\s-]*{months}[\\s,-]*([0-9]{{4}})"
    first = f"(?i){months}[\\s-]*([0-9]{{1,2}})[,\\s]+([0-9]{{4}})"
    table = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, k + 1)])

    def search(c: Column) -> Column:
        part = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
        month = lambda p, k: F.try_element_at(table, F.lower(F.regexp_extract(c, p, k)))
        # what is taken first of a form is a number wherever the form matches
        forms = [(dmy, 3, lambda p: part(p, 2), 1), (iso, 1, lambda p: part(p, 2), 3), (named, 3, lambda p: month(p, 2), 1), (first, 3, lambda p: month(p, 1), 2)]

        def form(k: int, p: str, year: int, m, day: int) -> Column:
            dated = lambda g: F.when(g["m"].between(1, 12) & g["d"].between(1, 31), F.struct(F.format_string("%04d-%02d-%02d", g["y"], g["m"], g["d"]).alias("date"), F.lit(k).alias("form")))
            rest = lambda y: let(F.struct(y.alias("y"), m(p).alias("m"), part(p, day).alias("d")), dated)
            return let(part(p, year), lambda y: F.when(y.between(1900, 2100), rest(y)))

        return F.coalesce(*[form(k, *f) for k, f in enumerate(forms)])  # later forms are tried only if the ones before give nothing

    return let(c, search)


def find_date(c: Column, strict: bool = False) -> Column:
    """ISO date of the first form that fits; strict refuses days that the month doesn't have."""
    out = date_candidate(c)["date"]
    return F.date_format(F.try_to_date(out), "yyyy-MM-dd") if strict else out


def ledger_date(c: Column, as_of: str) -> Column:
    """yyyyMMdd of an ISO date; as_of where it isn't one."""
    return F.date_format(F.coalesce(F.try_to_date(c), F.to_date(F.lit(as_of))), "yyyyMMdd")


def days_left(d: Column) -> Column:
    """Days of the month from d on, with d."""
    return F.datediff(F.last_day(d), d) + 1


def uptime(seconds: Column) -> Column:
    """"2d 3h 4m" without leading zero parts."""
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60)
    return F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm %ds", m, s % 60))


def receipt_number(ts: Column, unique: Column) -> Column:
    """REC-<day>-<time>-<12 hex of the unique value's hash>."""
    return F.concat(F.lit("REC-"), F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), F.upper(F.substring(F.sha2(unique.cast("string"), 256), 1, 12)))
