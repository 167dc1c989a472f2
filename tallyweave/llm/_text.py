"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on whole Arrow string columns at once: texts are laid end to end in
one byte buffer, words are found by comparing neighbouring byte classes, and every word gets
a 64-bit hash from two lookups in a running polynomial sum. No Python loop runs per word.

A *word* is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of
the lower-cased text. A null text is the empty text: it has no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text handled at once; a longer single text gets a chunk of its own.
CHUNK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

WORD = np.zeros(256, bool)
WORD[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz":
    WORD[_c] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        out = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW, _INV = out
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the len+1 offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = 0) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each (CHUNK_BYTES unless given)."""
    limit = limit or CHUNK_BYTES
    if len(column) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


class Words:
    """The words of a column of texts: byte spans, hashes and the text each belongs to."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.buf, self.off = utf8(pc.utf8_lower(column) if lower else column)
        n = len(self.buf)
        self.n_texts = len(self.off) - 1
        word = np.empty(n + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = WORD[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        self.starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
        self.ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
        self.counts = np.diff(np.searchsorted(self.starts, self.off))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums: P[i] covers the first i bytes."""
    power, _ = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    return sums


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of buf[start:end] for every span; equal bytes give equal hashes anywhere."""
    sums = prefix_sums(buf) if sums is None else sums
    _, inverse = _powers(len(buf) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the bounds of each text's run.

    A text with some words but fewer than n has one gram, of all its words. A text without
    words has none.
    """
    if n == 1:
        return mix(h), first
    counts = np.diff(first)
    size = len(h)
    out = np.zeros(size, np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    for k in range(n):
        out *= mult
        out[: size - k] += h[k:] if k else h
    short = np.flatnonzero((counts > 0) & (counts < n))
    for t in short:
        acc = np.uint64(counts[t])
        for x in h[first[t] : first[t + 1]]:
            acc = np.uint64((int(acc) * int(mult) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[first[t]] = acc
    valid = np.ones(size, bool)
    for k in range(1, n):
        at = first[1:][counts >= k] - k  # the k last starts of each text don't reach n words
        valid[at] = False
    valid[first[:-1][counts > 0]] = True
    bounds = np.concatenate([[0], np.cumsum(np.where(counts == 0, 0, np.maximum(1, counts - n + 1)))])
    return mix(out[valid]), bounds


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for every i; empty segments give 0."""
    n = len(bounds) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], axis=0, dtype=np.float64)
    return out


def hash_limit(rate: float) -> int:
    """The limit under which a share `rate` of all 63-bit hashes lies."""
    return min((1 << 63) - 1, int(rate * float(1 << 63)))


def smallest_hashes(df: DataFrame, group: str, sizes: dict, most: dict, columns: list, seed: int = 17) -> DataFrame:
    """At most most[g] rows of each group g, those with the smallest hashes of the columns: the same ones on every run.

    The groups' sizes give a limit below which somewhat more than the wanted rows lie, so only these are
    shuffled and ranked, whatever the size of df. Names in df don't matter; the order of equal hashes doesn't either.
    """
    h = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 1)
    keep = F.lit(False)
    for g, size in sizes.items():
        wanted = most[g] + 6 * math.sqrt(most[g]) + 20
        below = F.lit(True) if wanted >= size else h < F.lit(hash_limit(wanted / size))
        keep = keep | ((F.col(group) == F.lit(g)) & below)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(h))
    limit = F.coalesce(*[F.when(F.col(group) == F.lit(g), F.lit(most[g])) for g in sizes], F.lit(0))
    return df.where(keep).withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
