"""Language identification: softmax regression on TF-IDF character n-grams, FTRL, temperature.

A text becomes counts of its character 1- to MAX_N-grams (lower-cased, white space as one
blank, hashed to 2**BITS buckets), each divided by the number of n-grams and multiplied by the
bucket's inverse document frequency. Document frequencies come from all documents. The
model, one output per language of the lang column, is trained with follow-the-regularised-leader and an
elastic-net penalty on at most MAX_PER_LANG documents of each language, those with the smallest hashes of
doc_id and text. A fifth of the sample is held out to fit one temperature that makes the probabilities honest.

All documents are scored whole: with idf folded into the weights a score is a sum of table
rows, so no per-document vector is built.

Result: doc_id, lang_pred, confidence.

Defined results: a null or empty text, or one of white space only, gets the language "und" with confidence 0.0; so
does every text if no document has both text and language. With a single language every
text gets it with confidence 1.0. A null lang doesn't train; a null doc_id is carried along; repeated rows are
scored each; ties go to the language first in alphabetical order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _text
from tallyweave.llm._ftrl import Ftrl

BITS = 16
MAX_N = 3
MAX_PER_LANG = 1000
EPOCHS = 2
SCALE = 10.0
UNKNOWN = "und"


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, buckets of the n-grams that start at each character, 0 where one would leave its text) and the texts' bounds."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    buf, off = _text.utf8(column)
    lead = (buf & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[off]
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    points[(points <= 32) | (points == 0xA0)] = 32
    out = np.zeros((MAX_N, len(points)), np.uint16)
    acc = np.zeros(len(points), np.uint32)
    last = np.zeros(len(points), bool)  # places from which an n-gram would leave its text
    for n in range(1, MAX_N + 1):
        if len(points) < n:
            break
        acc *= np.uint32(16777619)
        acc[: len(points) - n + 1] += points[n - 1 :]
        h = acc ^ (acc >> np.uint32(15))
        h += np.uint32(n)
        h *= np.uint32(0x9E3779B1)
        out[n - 1] = h >> np.uint32(32 - BITS)
        if n > 1:
            at = bounds[1:] - (n - 1)
            last[at[at >= bounds[:-1]]] = True
        out[n - 1, last] = 0
    blank = np.zeros(len(points), bool)
    blank[1:] = (points[1:] == 32) & (points[:-1] == 32)
    out[:, blank] = 0
    return out, bounds


def _document_frequencies(batches):
    """One table of document frequencies per task, as bytes."""
    total = np.zeros(1 << BITS, np.int64)
    n = 0
    for batch in batches:
        text = batch.column("text")
        for a, b in _text.slices(text):
            grams, bounds = ngrams(text.slice(a, b - a))
            n += b - a
            for t in range(b - a):
                part = grams[:, bounds[t] : bounds[t + 1]].ravel()
                if len(part) > 1 << 13:
                    total[np.flatnonzero(np.bincount(part, minlength=1 << BITS))] += 1
                elif len(part):
                    part = np.sort(part)
                    total[part[np.append(True, part[1:] != part[:-1])]] += 1
    total[0] = n  # bucket 0 holds no n-gram; it carries the number of texts
    if n:
        yield _packed(total)


def _packed(total: np.ndarray) -> pa.RecordBatch:
    """The non-zero entries of a table as one row."""
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=["at", "df"])


def _added(batches) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for at, df in zip(batch.column("at").to_pylist(), batch.column("df").to_pylist(), strict=True):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(df, np.int64)
    return total


def _merge(batches):
    yield _packed(_added(batches))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every bucket over all documents of docs.

    A task's counts are one row; as many tasks as the cluster has cores add these up, then the square root of
    that many, so the driver gets a few dozen tables of at most 12 bytes a bucket, however large the corpus.
    """
    schema = "at binary, df binary"
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select("text").mapInArrow(_document_frequencies, schema)
    for tasks in (cores, math.isqrt(cores)):
        rows = rows.repartition(max(1, tasks)).mapInArrow(_merge, schema)
    df = _added(rows.toArrow().to_batches()).astype(float)
    n = df[0]
    out = np.log((1 + n) / (1 + df)) + 1
    out[0] = 0
    return out


def _sample_rows(idf_shared):
    def run(batches):
        idf = idf_shared.value
        for batch in batches:
            text = batch.column("text")
            idx, val, ok = [], [], []
            for a, b in _text.slices(text):
                grams, bounds = ngrams(text.slice(a, b - a))
                for t in range(b - a):
                    part = grams[:, bounds[t] : bounds[t + 1]].ravel()
                    u, c = np.unique(part[part > 0], return_counts=True)
                    ok.append(len(u) > 0)
                    idx.append(u.astype(np.int32))
                    val.append((c * idf[u] * (SCALE / max(1, c.sum()))).astype(np.float32))
            full = pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "idx", "val"])
            yield full.filter(pa.array(ok, pa.bool_()))

    return run


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.bias, self.temperature = langs, bias, temperature
        self.columns = np.ascontiguousarray(weights.T)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language, -1 for none; probability) of each text."""
        best, sure = np.full(len(column), -1), np.zeros(len(column))
        for a, b in _text.slices(column, 1 << 20):
            part = column.slice(a, b - a)
            grams, bounds = ngrams(part)
            words = _text.segment_sum(np.count_nonzero(grams, axis=0), bounds)
            seen = pc.fill_null(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(part)), 0), False).to_numpy(zero_copy_only=False) & (words > 0)
            if not len(self.langs):
                continue
            total = np.empty((b - a, len(self.langs)))
            for k, w in enumerate(self.columns):  # one language at a time: plain gathers from a table that fits the cache
                places = w[grams[0]]
                for g in grams[1:]:
                    places += w[g]
                total[:, k] = _text.segment_sum(places, bounds)
            logits = (total * (SCALE / np.maximum(1, words))[:, None] + self.bias) / self.temperature
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best[a:b] = np.where(seen, p.argmax(1), -1)
            sure[a:b] = np.where(seen, p.max(1), 0.0)
        return best, sure


def train(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> Model:
    """The calibrated model of docs' languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) < 2:
        return Model(langs, np.zeros((1 << BITS, len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    idf = inverse_frequencies(docs)
    chosen = _text.smallest_hashes(known, "lang", sizes, dict.fromkeys(sizes, max_per_lang), ["doc_id", "text"])
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    rows = chosen.select("lang", "text").mapInArrow(_sample_rows(shared), "lang string, idx array<int>, val array<float>").toArrow()
    place = {lang: k for k, lang in enumerate(langs)}
    data = [(np.asarray(i.values, np.int64), np.asarray(v.values, np.float64), place[y]) for i, v, y in zip(rows.column("idx"), rows.column("val"), rows.column("lang").to_pylist(), strict=True)]
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    data = [data[k] for k in np.random.default_rng(5).permutation(len(data))]
    held, used = data[: len(data) // 5], data[len(data) // 5 :]
    weights, bias = Ftrl(1 << BITS, len(langs), alpha=0.3, l1=0.01, l2=0.01).fit(used, EPOCHS).weights()
    temperature = calibrate(np.array([(weights[i] * v[:, None]).sum(0) + bias for i, v, _ in held]).reshape(-1, len(langs)), np.array([y for *_, y in held], np.int64))
    return Model(langs, (weights * idf[:, None]).astype(np.float32), bias, temperature)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-out rows, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / math.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    a, b, g = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def identify(docs: DataFrame, max_per_lang: int = MAX_PER_LANG) -> DataFrame:
    """doc_id, lang_pred and confidence of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, max_per_lang))  # 2**BITS floats a language

    def run(batches):
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)  # index -1 is the last
        for batch in batches:
            best, sure = model.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "confidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, confidence double")
