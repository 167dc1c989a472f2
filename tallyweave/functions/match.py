"""Similarity, variants and alignment: plain functions, and Arrow-batched UDFs over distinct codes."""

from __future__ import annotations

import itertools
import re
from difflib import SequenceMatcher, get_close_matches

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TO_LETTER = dict(zip("|1!06859()2473", "IIIOGBSGCJZATE", strict=True))
TO_DIGIT = dict(zip("ILOZSGBATEDQ", "110256847309", strict=True))
HAND = dict(zip("NLQUWPEARVHMG", "HIGVMRCOPUNWQ", strict=True))


def cutoff(n: int) -> float:
    return 0.88 if n <= 3 else 0.82 if n <= 4 else 0.72 if n <= 6 else 0.65


#: Spellings of a token beyond which no further pairs of digits are tried, and the numbers of digits for which they are.
MOST, PAIRED = 15, (2, 4)


def variants(token: str, learned: dict[str, str] | None = None, learned_digits: dict[str, str] | None = None, corrections: dict[str, str] | None = None) -> list[str]:
    """Spellings a token may stand for, in order, each once.

    The token; all signs as letters; these and all handwritten letters; one sign; one handwritten letter; all letters as digits; one
    letter as a digit; two of them, if two to four may be digits. Then learned letters and digits, one at a time. A learned correction of the whole comes second.
    """
    up = token.upper()

    def changed(table: dict[str, str], text: str, key=lambda c: c) -> list[str]:
        return [(text[:i] + table[key(c)] + text[i + 1 :]).upper() for i, c in enumerate(text) if key(c) in table]

    letters = {**TO_LETTER, "_": ""}
    out = dict.fromkeys([up, *(x for x in ("".join(letters.get(c, c) for c in token).upper(), "".join(letters[c] if c in letters else HAND.get(c.upper(), c) for c in token).upper()) if x)])
    out |= dict.fromkeys(x for x in changed(letters, token) + changed(HAND, token, str.upper) if x)
    out |= dict.fromkeys(["".join(TO_DIGIT.get(c, c) for c in up), *changed(TO_DIGIT, up)])
    places = [i for i, c in enumerate(up) if c in TO_DIGIT]
    if PAIRED[0] <= len(places) <= PAIRED[1]:
        for i, j in itertools.combinations(places, 2):
            pair = up[:i] + TO_DIGIT[up[i]] + up[i + 1 : j] + TO_DIGIT[up[j]] + up[j + 1 :]
            if pair not in out:
                out[pair] = None
                if len(out) >= MOST:
                    break
    out |= dict.fromkeys(x for x in changed(learned or {}, token) + changed(learned_digits or {}, up) if x)
    whole = (corrections or {}).get(up)
    return [up, whole, *list(out)[1:]] if whole and whole not in out else list(out)


def overlap(a: str, b: str) -> tuple[float, int]:
    same = sum(x == y for x, y in zip(a, b, strict=False))
    score = same / max(len(a), len(b), 1)
    return (max(score, 0.7) if a in b or b in a else score), same


def map_code(code: str, catalog: dict[str, str], learned: dict[str, str] | None = None) -> tuple[str | None, str]:
    """(catalog code or None, how): exact, ambiguous_oi, fuzzy or unknown.

    In order: the code itself; a trailing O or I that stands for 0 or 1 or for nothing; a
    substitution variant; the most similar code, where a later one must be strictly better; the best positional overlap.
    """
    code = code.upper().strip()
    if code in catalog:
        return code, "exact"
    if len(code) >= 4 and code[-1] in "OI":
        short, long = code[:-1], code[:-1] + ("0" if code[-1] == "O" else "1")
        if long in catalog and short in catalog:
            return (long if code[-2].isdigit() else short), "ambiguous_oi"
        if long in catalog or short in catalog:
            return (long if long in catalog else short), "exact"
    forms = variants(code, learned)
    for v in forms:
        if v in catalog:
            return v, "exact"
    best, ratio = None, 0.0
    for v in forms:
        for m in get_close_matches(v, catalog, n=5, cutoff=cutoff(len(v))):
            r = SequenceMatcher(None, v, m).ratio()
            if r > ratio:
                best, ratio = m, r
    if best:
        return best, "fuzzy"
    top, same = 0.0, 0
    for v in forms:
        for c in catalog:
            if abs(len(v) - len(c)) <= 1:
                s, n = overlap(v, c)
                if s > top:
                    best, top, same = c, s, n
    return (best, "fuzzy") if best and top >= 0.85 and same >= 2 else (None, "unknown")


def align(a: str, b: str) -> list[tuple[str, str]]:
    """Global alignment (match 2, mismatch -1, gap -1; the diagonal wins ties); "-" marks a gap."""
    n, m = len(a), len(b)
    s = [[-(i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = max(s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 1, s[i][j - 1] - 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and s[i][j] == s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and s[i][j] == s[i - 1][j] - 1:
            i -= 1
            out.append((a[i], "-"))
        else:
            j -= 1
            out.append(("-", b[j]))
    return out[::-1]


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio 2M/T."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def variant_list(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else variants(x))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])))
def alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"a": p, "b": q} for p, q in align(x, y)] for x, y in zip(a, b, strict=True)])


class Alignment:
    """Rows (place, a, b) of the alignment of two strings."""

    def eval(self, a: str, b: str):
        if a is not None and b is not None:
            for k, (x, y) in enumerate(align(a, b)):
                yield k, x, y


class CodeLines:
    """Rows (part, piece, text) of a line divided at strokes and before each code but the first, with a number right before it, for a list of codes."""

    def eval(self, text: str, codes: list):
        known = {c.upper() for c in codes or ()}
        for part, chunk in enumerate((text or "").split("|")):
            spans = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", chunk) if m.group().upper() in known]
            cuts = [0]
            for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
                cuts.append(end + re.search(r"[ \t]*[0-9]*[ \t]*$", chunk[end:start]).start())
            for k, piece in enumerate(x.strip() for x in (chunk[a:b] for a, b in zip(cuts, [*cuts[1:], len(chunk)], strict=True))):
                if piece:
                    yield part, k, piece


def register(spark) -> None:
    """The functions that need a program, as SQL functions and table functions."""
    for name, f in (("similarity", similarity), ("variant_list", variant_list), ("alignment", alignment)):
        spark.udf.register(name, f)
    spark.udtf.register("align_strings", F.udtf(Alignment, returnType="place int, a string, b string"))
    spark.udtf.register("split_codes", F.udtf(CodeLines, returnType="part int, piece int, text string"))
