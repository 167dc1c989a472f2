"""Benchmark decontamination: Wu-Manber multi-pattern search for benchmark passages.

Texts are normalised to lower-case words with one blank between them. The test strings are
all runs of WINDOW consecutive words of every benchmark item; an item with fewer words is
one test string, whole. A block of bytes at the end of the search window is looked up in the
shift table, which says how far no test string can end; where the shift is 0 the block's
hash selects a bucket of test strings, their prefixes are compared, and a direct comparison
of all bytes confirms the occurrence. Many cursors walk through one buffer side by side, so
every table lookup is one vector operation.

Result: one row per document and benchmark item that share a test string.

The tables hold the benchmark only and are broadcast; their size is checked: beyond MAX_TABLE_BYTES of test strings
the benchmark is searched in several parts, each with a scan of its own.

Defined results: null or empty texts contain nothing; items that are null, or without a
word, match nothing; rows with a null doc_id or item_id are searched too and carry the
null; repeated documents and repeated items give one row per pair of ids, and so do several texts of one id, whose
windows count together, each once; an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _text

WINDOW = 13
BLOCK = 8
TABLE_BITS = 18
LANES = 4096
MAX_TABLE_BYTES = 256 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, item_id long, n_windows long, first_word long, last_word long"


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts in them, words' bounds by text): every text as ' w1 w2 ... wn ', a newline between texts."""
    words = _text.Words(column)
    n_words = len(words)
    length = words.ends - words.starts
    has = np.flatnonzero(words.counts > 0)
    extra = np.zeros(n_words, np.int64)  # the leading blank and newline before a text's first word
    if n_words:
        extra[words.first[:-1][has]] = 2
    at = np.cumsum(length + 1 + extra) - length - 1
    total = int(at[-1] + length[-1] + 1) if n_words else 0
    out = np.full(total + BLOCK, 32, np.uint8)
    # move the word bytes: source index of every kept byte is its rank shifted by its word's displacement
    size = int(length.sum())
    if size:
        ramp = np.arange(size) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at, length) + ramp] = words.buf[np.repeat(words.starts, length) + ramp]
        out[at[words.first[:-1][has]] - 2] = 10
    out[total:] = 10
    return out, at, words.first


class WuManber:
    """Search machine for the test strings of one length class."""

    def __init__(self, patterns: list[bytes], owners: list[int]):
        self.patterns, self.owners = patterns, np.asarray(owners, np.int64)
        self.keys = np.array([xxhash.xxh64_intdigest(p) for p in patterns], np.uint64).view(np.int64)
        self.n_words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.m = m = min(map(len, patterns))
        self.block = b = min(BLOCK, m)
        self.mask = np.uint64((1 << (8 * b)) - 1)
        self.bits = TABLE_BITS
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for end in range(b, m + 1):  # blocks that end there leave m - end bytes to go
            h = self._hash(self._value(heads[:, end - b : end]))
            np.minimum.at(self.shift, h, m - end)
        self.suffix = self._value(heads[:, m - b :])
        self.prefix = self._value(heads[:, :b])
        self.order = np.lexsort((self.prefix, self.suffix))
        self.suffix, self.prefix = self.suffix[self.order], self.prefix[self.order]

    def _value(self, blocks: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(blocks), 8), np.uint8)
        wide[:, : self.block] = blocks
        return wide.view("<u8")[:, 0].astype(np.uint64)

    def _hash(self, value: np.ndarray) -> np.ndarray:
        return ((value * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start position, pattern index) of all occurrences; buf ends with BLOCK spare bytes."""
        n = len(buf) - BLOCK
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        b, m = self.block, self.m
        # cursors hold the start of the last block of the search window; each owns a stretch of window ends
        stretch = max(256, -(-n // LANES))
        pos = np.arange(m - b, n - b + 1, stretch)
        stop = np.minimum(pos + stretch, n - b + 1)
        found = []
        while len(pos):
            value = wide[pos] & self.mask
            shift = self.shift[self._hash(value)]
            zero = shift == 0
            if zero.any():
                found.append(np.stack([pos[zero], value[zero].view(np.int64)]))
            pos = pos + np.maximum(shift, 1)
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, value = np.concatenate(found, axis=1)
        value = value.view(np.uint64)
        start = at + b - m
        lo, hi = np.searchsorted(self.suffix, value, "left"), np.searchsorted(self.suffix, value, "right")
        hit = hi > lo
        start, lo, hi = start[hit], lo[hit], hi[hit]
        size = hi - lo
        rows = np.repeat(np.arange(len(start)), size)
        cand = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + lo[rows]
        same = (wide[start[rows]] & self.mask) == self.prefix[cand]
        start, cand = start[rows[same]], self.order[cand[same]]
        raw = memoryview(buf)
        ok = [raw[s : s + len(p := self.patterns[c])] == p for s, c in zip(start.tolist(), cand.tolist(), strict=True)]
        ok = np.asarray(ok, bool)
        return start[ok], cand[ok]


def test_strings(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> tuple[list[bytes], list[int], list[int | None]]:
    """(distinct test string, index of its item) pairs and the items' ids."""
    ids = [i for i, _ in items]
    buf, at, first = normalise(pa.array([t for _, t in items], pa.string()))
    seen: dict[tuple[bytes, int | None], int] = {}
    raw = buf.tobytes()
    for k in range(len(items)):
        a, b = int(first[k]), int(first[k + 1])
        if a == b:
            continue
        for s in range(a, max(a + 1, b - window + 1)):
            e = min(b, s + window) - 1
            text = raw[at[s] - 1 : at[e]] + raw[at[e] : _word_end(raw, int(at[e]))] + b" "
            seen.setdefault((text, ids[k]), k)
    return [p for p, _ in seen], list(seen.values()), ids


def _word_end(raw: bytes, start: int) -> int:
    blank, line = raw.find(b" ", start), raw.find(b"\n", start)
    return min(x for x in (blank, line, len(raw)) if x >= 0)


class Searcher:
    """All test strings, in machines by length: one short string doesn't shorten the others' shifts."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        patterns, owners, self.ids = test_strings(items, window)
        classes: dict[int, list[int]] = {}
        for k, p in enumerate(patterns):
            classes.setdefault(0 if len(p) < 16 else 1 if len(p) < 40 else 2, []).append(k)
        self.machines = [WuManber([patterns[k] for k in ks], [owners[k] for k in ks]) for ks in classes.values()]

    def hits(self, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, index of the item, key of the test string, first word, last word) of all occurrences, as arrays."""
        buf, at, first = normalise(column)
        for machine in self.machines:
            start, cand = machine.search(buf)
            word = np.searchsorted(at, start + 1)
            row = np.searchsorted(first, word, "right") - 1
            word = word - first[row]
            yield row, machine.owners[cand], machine.keys[cand], word, word + machine.n_words[cand] - 1

    def search(self, column: pa.Array) -> dict[tuple[int, int | None], tuple[int, int, int]]:
        """{(row, item id): (test strings found, first word, last word)}"""
        found: dict[tuple[int, int | None], tuple[set[int], int, int]] = {}
        for part in self.hits(column):
            for r, owner, key, a, b in zip(*(x.tolist() for x in part), strict=True):
                seen, lo, hi = found.get((r, self.ids[owner]), (set(), a, b))
                seen.add(key)
                found[r, self.ids[owner]] = (seen, min(a, lo), max(b, hi))
        return {k: (len(s), a, b) for k, (s, a, b) in found.items()}


def _parts(benchmark: DataFrame, window: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in parts whose test strings take at most about MAX_TABLE_BYTES."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = 1 + size * window // MAX_TABLE_BYTES
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        items = [tuple(r) for r in part.collect()]
        if items:
            yield sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def _searchers(benchmark: DataFrame, window: int):
    sc = benchmark.sparkSession.sparkContext
    for items in _parts(benchmark, window):
        shared = sc.broadcast(items)
        yield lambda shared=shared: Searcher(shared.value, window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, number of distinct test strings found, first and last word of their stretch in the text."""
    spark = docs.sparkSession
    out = None
    for make in _searchers(benchmark, window):

        def run(batches, make=make):
            machine = make()
            for batch in batches:
                ids, text = batch.column("doc_id"), batch.column("text")
                items = pa.array(machine.ids, pa.int64())
                for a, b in _text.slices(text):
                    for row, owner, key, lo, hi in machine.hits(text.slice(a, b - a)):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + row)), items.take(pa.array(owner)), pa.array(key), pa.array(lo), pa.array(hi)], names=["doc_id", "item_id", "window", "first_word", "last_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA.replace("n_windows", "window"))
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    # one row per pair; whatever rows, texts and parts a window was found in, it counts once
    return out.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("n_windows"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark passage, with all their columns; no shuffle."""
    for make in _searchers(benchmark, window):

        def run(batches, make=make):
            machine = make()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                text = batch.column("text")
                for a, b in _text.slices(text):
                    for row, *_ in machine.hits(text.slice(a, b - a)):
                        clean[a + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def leaks_sql(window: int = WINDOW) -> str:
    """The same result in DuckDB."""
    words = "list_filter(regexp_split_to_array(lower(text), '[\\x00-/:-@\\[-^`{-\\x7f]+'), lambda x: x <> '')"

    def grams(table: str, key: str) -> str:
        return (
            f"SELECT {key}, i - 1 AS first_word, least(len(w), i + {window} - 1) - 1 AS last_word,"
            f" array_to_string(w[i:i + {window} - 1], ' ') AS gram"
            f" FROM (SELECT {key}, {words} AS w FROM {table}) t, range(1, 1 + greatest(1, len(w) - {window} + 1)) r(i) WHERE len(w) > 0"
        )

    return f"""
    WITH items AS ({grams("benchmark", "item_id")}),
    wanted AS (SELECT DISTINCT item_id, gram, len(string_split(gram, ' ')) AS n FROM items),
    d AS (SELECT doc_id, {words} AS w FROM documents),
    hits AS (
        SELECT d.doc_id, k.item_id, k.gram, i - 1 AS first_word, i - 2 + k.n AS last_word
        FROM (SELECT DISTINCT n FROM wanted) s, d, range(1, 2 + len(w) - s.n) r(i),
             wanted k WHERE k.n = s.n AND k.gram = array_to_string(w[i:i + s.n - 1], ' ')
    )
    SELECT doc_id, item_id, count(DISTINCT gram) AS n_windows, min(first_word) AS first_word, max(last_word) AS last_word
    FROM hits GROUP BY doc_id, item_id
    """
