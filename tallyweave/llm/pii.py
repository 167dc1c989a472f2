"""PII by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Candidates are generous: every e-mail shape, number group, key assignment and key-like
   token, the harmless ones too (versions, years, amounts). They are found around bytes that such a
   span must have (digits, '@', '=', ':'), so most text is never looked at by a regex.
2. Five labelers vote yes, no or nothing on each candidate: a strict regex, a checksum or range,
   a gazetteer of prefixes and domains, the words before it, and its length and variety.
3. Votes of the whole corpus are counted by (kind, vote pattern), a table of a few hundred rows.
   Expectation-maximisation on those counts estimates each labeler's reliability within each
   kind of candidate and gives every pattern a posterior.
4. A logistic regression over shape, kind and context features is trained with the posteriors as
   soft labels, on about MAX_TRAIN candidates chosen by a 64-bit hash, equally many of each kind as far as there are
   so many, and decides about every candidate.

Two scans of the text, nothing but counts and the sample is shuffled.

Result of ``find_pii``: doc_id, start_char, end_char (half open, in characters), kind, probability.
``mask`` replaces the spans by [KIND] and sets n_chars, where the table has it, to the new length.

Defined results: null and empty texts have no spans and stay as they are; a null doc_id is carried
along; repeated rows give repeated spans; overlapping candidates: the leftmost, then the
first of KINDS wins, except that grouped card numbers go before phone numbers; an empty table gives an empty result; other columns are ignored by the search and
kept by the masking.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _text
from tallyweave.llm._ftrl import Ftrl

MAX_TRAIN = 20_000
THRESHOLD = 0.5
BITS = 14
CONTEXT = 48

KINDS = ("EMAIL", "SECRET", "KEY", "IP", "SSN", "IBAN", "PHONE", "CARD", "NUMBER")
#: Every alternative either starts where a run of its own characters starts or has bounded parts, so a search
#: takes time linear in the text even where the text has no blanks.
CANDIDATE = re.compile(
    r"""(?<![^\W_])(?:
     (?<![\w.+-])(?P<EMAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
    |(?P<SECRET>(?<![^\W_][_-])(?:[^\W_]+[_-])*(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|passphrase)\b["']?\s*[=:]\s*["']?[^\s"',;]{4,}["']?)
    |(?P<KEY>\b(?:AKIA[0-9A-Z]{12,}|gh[pousr]_\w{16,}|sk-[\w-]{16,}|xox[abp]-[\w-]{10,}|(?<!-)eyJ[\w-]{10,}\.[\w.-]{10,}|(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{16,})\b(?<![ ]\d{16})(?<!\d{16}))
    |(?P<IBAN>\b[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){3,7}(?:[ ]?[0-9A-Z]{1,3})?\b)
    )|(?=[\d+(])(?:
     (?P<IP>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))
    |(?P<SSN>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<CARD>(?<![\w.])(?:\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w))
    |(?P<PHONE>(?<![\w.])(?!\d{2,3}[ ](?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w))(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{8,15}(?!\w))
    |(?P<CARD_>(?<![\w.])(?!\d{1,3}[ ](?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w))\d(?:[ -]?\d){12,18}(?![\w-]))
    |(?P<NUMBER>\d[\w.,:/-]*)
    )""",
    re.X,
)
STRICT = {
    "EMAIL": re.compile(r"[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    "SECRET": re.compile(r"[^=:]*[=:]\s*[\"']?(?=[^\s\"']*\d)[^\s\"']{8,}[\"']?"),
    "KEY": re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,}|xox[abp]-[\w-]{10,}|eyJ.*|[0-9a-fA-F]{32,}"),
    "IP": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    "SSN": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "IBAN": re.compile(r"[A-Z]{2}\d{2}[ 0-9A-Z]{11,34}"),
    "PHONE": re.compile(r"\+\d[\d ().-]{7,}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"),
    "CARD": re.compile(r"[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[3-6]\d{3}(?:[ -]\d{4}){3}[ -]\d{1,3}|3\d{3}[ -]?\d{6}[ -]?\d{4,5}"),
}
#: Gazetteer: first digits of card issuers, top-level domains, key prefixes, country calling codes.
CARD_PREFIX = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 6011 65 35 30 36 38".split())
DOMAINS = set("com org net edu gov io co info biz us uk de fr es it nl eu ca au jp cn in br ch at be se no dk fi pl pt ru".split())
KEY_PREFIX = ("AKIA", "ghp_", "gho_", "sk-", "xox", "eyJ")
CALLING = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 63 64 65 66 7 81 82 84 86 90 91".split())
IBAN_LANDS = set("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
YES_WORDS = re.compile(r"(?i)\b(e-?mail|mail|contact|phone|tel|call|mobile|fax|ssn|social|card|visa|iban|account|password|passwd|token|secret|key|login|ip|host|address)\W*(?:\w+\W+)?$")
NO_WORDS = re.compile(r"(?i)\b(version|license|licen[cs]e,|v|page|pages|chapter|section|fig|figure|table|vol|no|isbn|doi|in|year|cc|by-nc|apache|python|release)[\s,.:]*$")

_SIGN = np.zeros(256, bool)
_SIGN[list(b"0123456789@=:")] = True


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def votes(kind: str, span: str, before: str) -> tuple[int, ...]:
    """What each labeler says about a candidate: 1 yes, -1 no, 0 nothing."""
    digits = re.sub(r"\D", "", span)
    strict = 1 if kind in STRICT and STRICT[kind].fullmatch(span) else -1
    check = 0
    if kind == "IP":
        check = 1 if all(int(x) <= 255 for x in span.split(".")) and span.split(".")[0] != "0" else -1
    elif kind == "CARD":
        check = 1 if 13 <= len(digits) <= 19 and _luhn(digits) else 0
    elif kind == "IBAN":
        s = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    elif kind == "NUMBER":
        check = -1 if len(digits) <= 6 else 0
    place = 0
    if kind == "EMAIL":
        place = 1 if span.rpartition(".")[2].lower() in DOMAINS else 0
    elif kind == "CARD":
        place = 1 if digits.startswith(CARD_PREFIX) else -1
    elif kind in ("KEY", "SECRET"):
        place = 1 if span.startswith(KEY_PREFIX) or re.match(r"(?i)\W*(?:[^\W_]+[_-])*(pass|pwd|secret|token|api|access)", span) else 0
    elif kind == "PHONE":
        place = 1 if span.startswith("+") and digits.startswith(CALLING) else 0
    elif kind == "IBAN":
        place = 1 if span[:2] in IBAN_LANDS else -1
    elif kind == "IP":
        place = 1 if re.match(r"(10|172|192|\d{2,3})\.", span) else 0
    context = -1 if NO_WORDS.search(before) else 1 if YES_WORDS.search(before) else 0
    variety = len(set(span))
    size = 1 if len(span) >= 10 and variety >= 5 or kind in ("IP", "SSN") and len(span) >= 9 else -1 if len(digits) <= 4 and kind == "NUMBER" else 0
    return strict, check, place, context, size


def _card_length(span: str) -> int:
    """Characters of the card number at the span's start: without its last group, such as a security code, if only the rest passes the checksum."""
    rest = re.sub(r"[ -]\d{1,3}$", "", span)
    good = [_luhn(d) and len(d) >= 13 for d in (re.sub(r"\D", "", x) for x in (span, rest))]
    return len(rest) if good == [False, True] else len(span)


def candidates(text: str, spots: list[int]) -> list[tuple[int, int, str]]:
    """Candidate spans of a text, given the character positions of its digits and signs."""
    out: list[tuple[int, int, str]] = []
    k, done = 0, 0
    while k < len(spots):
        a = max(done, spots[k] - CONTEXT)
        while a > done and not text[a - 1].isspace():
            a -= 1
        b = min(len(text), spots[k] + CONTEXT)
        k += 1
        while True:  # one window for neighbouring spots, cut at white space
            while k < len(spots) and spots[k] < b:
                b = max(b, min(len(text), spots[k] + CONTEXT))
                k += 1
            while b < len(text) and not text[b].isspace():
                b += 1
            if k == len(spots) or spots[k] >= b:
                break
        while m := CANDIDATE.search(text, a, b):
            kind, a = m.lastgroup.rstrip("_"), m.end()
            if kind == "CARD":
                a = m.start() + _card_length(m.group())
            out.append((m.start(), a, kind))
        done = b
    return out


def scan(column: pa.Array):
    """(row, text, candidates) of every text that has any."""
    for a, b in _text.slices(column):
        part = column.slice(a, b - a)
        buf, off = _text.utf8(part)
        at = np.flatnonzero(_SIGN[buf])
        if not len(at):
            continue
        lead = np.cumsum((buf & 0xC0) != 0x80)  # characters up to and with each byte
        row = np.searchsorted(off, at, "right") - 1
        base = np.concatenate([[0], lead])[off]
        spot = lead[at] - 1 - base[row]
        edges = np.flatnonzero(np.diff(row)) + 1
        for rows, spots in zip(np.split(row, edges), np.split(spot, edges), strict=True):
            text = part[int(rows[0])].as_py()
            found = candidates(text, spots.tolist())
            if found:
                yield a + int(rows[0]), text, found


_SHAPE = str.maketrans(dict.fromkeys(string.ascii_lowercase, "a") | dict.fromkeys(string.ascii_uppercase, "A") | dict.fromkeys(string.digits, "d"))


def shape(span: str) -> str:
    return re.sub(r"(.)\1{2,}", r"\1\1+", span.translate(_SHAPE))


def features(kind: str, span: str, before: str, vote: tuple[int, ...]) -> list[str]:
    words = re.findall(r"\w+", before.lower())[-2:]
    form = shape(span)
    out = [f"kind={kind}", f"shape={form}", f"len={min(len(span), 40) // 4}", f"digits={min(20, sum(c.isdigit() for c in span))}", f"head={form[:4]}", f"tail={form[-4:]}"]
    out += [f"{kind}:v{k}={v}" for k, v in enumerate(vote)]
    return out + [f"w={w}" for w in words]


def _bucket(names: list[str]) -> np.ndarray:
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(x) & ((1 << BITS) - 1) for x in names], np.int64))


def expectation_maximisation(table: pd.DataFrame, rounds: int = 50) -> pd.Series:
    """Posterior of each (kind, votes) row from the counts n, by two-class EM within each kind.

    Labelers answer independently given the class; each has, per class, a probability of
    every answer, smoothed by a weak prior that says a labeler is right more often than not.
    """
    out = np.zeros(len(table))
    for _, rows in table.groupby("kind"):
        n = rows["n"].to_numpy(float)
        v = np.stack(rows["votes"].map(list).to_list()) + 1
        total = v.sum(1) - v.shape[1]
        post = 1 / (1 + np.exp(-1.5 * total))
        weak = n.sum() * 0.02 + 1
        prior_yes, prior_no = np.array([0.1, 0.3, 0.6]), np.array([0.6, 0.3, 0.1])
        for _ in range(rounds):
            yes, no = n * post, n * (1 - post)
            rate = (yes.sum() + 1) / (n.sum() + 2)
            log = np.full(len(rows), math.log(rate / (1 - rate)))
            for k in range(v.shape[1]):
                p = np.bincount(v[:, k], yes, 3) + weak * prior_yes
                q = np.bincount(v[:, k], no, 3) + weak * prior_no
                log += np.log(p / p.sum())[v[:, k]] - np.log(q / q.sum())[v[:, k]]
            post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        out[table.index.get_indexer(rows.index)] = post
    return pd.Series(out, table.index)


def _count_votes(batches):
    for batch in batches:
        seen: dict[tuple, int] = {}
        for _, text, found in scan(batch.column("text")):
            for a, b, kind in found:
                key = (kind, *votes(kind, text[a:b], text[max(0, a - CONTEXT) : a]))
                seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([list(k[1:]) for k in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())],
            names=["kind", "votes", "n"],
        )


def _collect_features(rates: dict[str, float]):
    """Features of a share of the candidates of each kind, chosen by a hash of document, place and words."""
    import xxhash

    most = {kind: int(rate * (1 << 64)) for kind, rate in rates.items()}

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            key, kinds, vs, idx = [], [], [], []
            for r, text, found in scan(batch.column("text")):
                for a, b, kind in found:
                    span, before = text[a:b], text[max(0, a - CONTEXT) : a]
                    h = xxhash.xxh64_intdigest(f"{ids[r].as_py()} {a} {before}{span}")
                    if h < most.get(kind, 0):
                        v = votes(kind, span, before)
                        key.append(h)
                        kinds.append(kind)
                        vs.append(v)
                        idx.append(_bucket(features(kind, span, before, v)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(kinds, pa.string()), pa.array(vs, pa.list_(pa.int32())), pa.array(idx, pa.list_(pa.int64()))],
                names=["key", "kind", "votes", "idx"],
            )

    return run


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Weights of the span classifier, from the votes of all candidates of docs."""
    text = docs.select("text").where(F.col("text").isNotNull())
    counts = text.mapInArrow(_count_votes, "kind string, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return np.zeros(1 << BITS, np.float32), -10.0
    counts["votes"] = counts["votes"].map(tuple)
    counts = counts.sort_values(["kind", "votes"]).reset_index(drop=True)
    counts["p"] = expectation_maximisation(counts)
    known = {(k, v): p for k, v, p in zip(counts["kind"], counts["votes"], counts["p"], strict=True)}
    sizes = counts.groupby("kind")["n"].sum()
    rates = {k: min(1.0, max_train / len(sizes) / n) for k, n in sizes.items()}
    chosen = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(_collect_features(rates), "key long, kind string, votes array<int>, idx array<long>")
    rows = chosen.dropDuplicates(["key"]).toArrow()  # a repeated row counts once, so about max_train rows come whatever the corpus
    data = []
    for kind, v, i in zip(rows.column("kind").to_pylist(), rows.column("votes").to_pylist(), rows.column("idx"), strict=True):
        data.append((np.asarray(i.values), known[kind, tuple(v)]))
    data.sort(key=lambda r: (r[0].tobytes(), r[1]))
    data = [(i, np.ones(len(i)), p) for i, p in data]
    weights, bias = Ftrl(1 << BITS, 1, alpha=0.2, l1=0.0, l2=0.1).fit(data, 3).weights()
    return weights[:, 0], float(bias[0])


def accepted(text: str, found: list[tuple[int, int, str]], model: tuple[np.ndarray, float], threshold: float) -> list[tuple[int, int, str, float]]:
    out = []
    for a, b, kind in found:
        span, before = text[a:b], text[max(0, a - CONTEXT) : a]
        s = float(model[0][_bucket(features(kind, span, before, votes(kind, span, before)))].sum()) + model[1]
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
        if p >= threshold:
            out.append((a, b, kind, p))
    return out


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per accepted span."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_train))  # 2**BITS floats

    def run(batches):
        model = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for r, text, found in scan(batch.column("text")):
                rows += [(ids[r].as_py(), *x) for x in accepted(text, found, model, threshold)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.string()), pa.array([x[4] for x in rows], pa.float64())],
                names=["doc_id", "start_char", "end_char", "kind", "probability"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start_char long, end_char long, kind string, probability double")


def mask(docs: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs with every accepted span replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_train))
    names = docs.columns

    def run(batches):
        model = shared.value
        for batch in batches:
            at = names.index("text")
            changed: dict[int, str] = {}
            for r, text, found in scan(batch.column(at)):
                parts, end = [], 0
                for a, b, kind, _ in accepted(text, found, model, threshold):
                    parts += [text[end:a], f"[{kind}]"]
                    end = b
                if end:
                    changed[r] = "".join([*parts, text[end:]])
            columns = list(batch.columns)
            if changed:
                rows = sorted(changed)
                where = np.zeros(batch.num_rows, bool)
                where[rows] = True
                columns[at] = pc.replace_with_mask(columns[at], pa.array(where), pa.array([changed[r] for r in rows], columns[at].type))
                if "n_chars" in names:
                    c = names.index("n_chars")
                    columns[c] = pc.replace_with_mask(columns[c], pa.array(where), pa.array([len(changed[r]) for r in rows], columns[c].type))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
