"""Quality classifier: hashed word n-gram logistic regression, FTRL-trained.

Features of a text, each a count divided by the number of its tokens: hashed word unigrams
and bigrams (a bigram of one word twice is the single feature "repeat"), and trigrams of
token shapes, where a word's shape is its case pattern and a punctuation run stands for
itself. They go to 2**BITS buckets. A text is scored as the sparse dot product of those counts with the
weights; nothing but the weights is broadcast, and their size doesn't depend on the corpus.

Training uses at most MAX_PER_CLASS labelled documents of each class, those with the smallest hashes of
doc_id. All documents are scored, whole.

Defined results: a null or empty text, or one without any token, has quality 0.0 and isn't
kept; rows with a null doc_id are scored like any other; a repeated row is scored as often
as it occurs; an empty table gives an empty result; if the labels lack one of the two
classes there is nothing to learn from and every text with a token gets quality 1.0. Labels
that are null are ignored; of contradictory labels of one document the lower one counts.
Columns other than doc_id and text are neither needed nor changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import _text
from tallyweave.llm._ftrl import Ftrl

BITS = 18
MAX_PER_CLASS = 3000
THRESHOLD = 0.5
EPOCHS = 4
SCALE = 16.0

_CLASS = np.where(_text.WORD, 1, 2).astype(np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UP = np.zeros(256, np.uint8)
_UP[65:91] = 1
_UP[48:58] = 2
_UP[0xC3] = 3  # lead byte of most accented letters
_MASK = np.uint64((1 << BITS) - 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature occurrence by text: (buckets, bounds of each text, tokens of each text)."""
    raw, off = _text.utf8(column)
    n = len(raw)
    kind = np.zeros(n + 2, np.uint8)
    kind[1:-1] = _CLASS[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    change = (kind[1:] != kind[:-1]) | cut
    starts = np.flatnonzero(change & (kind[1:] > 0))
    ends = np.flatnonzero(change & (kind[:-1] > 0))
    count = np.diff(np.searchsorted(starts, off))
    first = np.concatenate([[0], np.cumsum(count)])
    h = _text.span_hashes(_LOWER[raw], starts, ends)
    is_word = kind[1:][starts] == 1
    second = np.minimum(starts + 1, np.maximum(ends - 1, 0))
    shape = np.where(is_word, _UP[raw[starts]].astype(np.uint64) * np.uint64(4) + _UP[raw[second]].astype(np.uint64) + np.uint64(1), h)
    last = np.zeros(len(h) + 2, bool)
    last[first[1:][count > 0] - 1] = True
    two = np.zeros(len(h), np.uint64)
    three = np.zeros(len(h), np.uint64)
    if len(h):
        two[:-1] = np.where(h[:-1] == h[1:], np.uint64(7), h[:-1] * np.uint64(3) + h[1:])
        three[:-2] = shape[:-2] * np.uint64(31) + shape[1:-1] * np.uint64(17) + shape[2:]
        ended = last[: len(h)]
        two[ended] = 11
        three[ended | last[1 : len(h) + 1]] = 13
    out = np.stack([h, _text.mix(two + np.uint64(1)), _text.mix(three + np.uint64(2))], axis=1)
    return (out & _MASK).astype(np.int32), first, count


def _feature_rows(batches):
    """Training rows: doc_id, label, distinct buckets and their values."""
    for batch in batches:
        text = batch.column("text")
        for a, b in _text.slices(text):
            idx, first, count = features(text.slice(a, b - a))
            i_out, v_out = [], []
            for t in range(b - a):
                u, c = np.unique(idx[first[t] : first[t + 1]], return_counts=True)
                i_out.append(u.astype(np.int32))
                v_out.append((c * (SCALE / max(1, count[t]))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(a, b - a).cast(pa.int32()), pa.array(i_out, pa.list_(pa.int32())), pa.array(v_out, pa.list_(pa.float32()))],
                names=["label", "idx", "val"],
            )


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int | dict[int, int]) -> DataFrame:
    """(text, label) of a bounded, repeatable choice of labelled documents of both classes; equal rows count once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = per_class if isinstance(per_class, dict) else dict.fromkeys(sizes, per_class)
    if not sizes:
        return docs.select("text", F.lit(None).cast("int").alias("label")).limit(0)
    # at most the bound of rows of two integers, whatever the corpus, so broadcasting them is safe
    chosen = F.broadcast(_text.smallest_hashes(known, "label", sizes, most, ["doc_id"]))
    return docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, float] | None:
    """Weights and bias, or None if the labels don't have both classes."""
    rows = labelled_sample(docs, labels, "quality", per_class).mapInArrow(_feature_rows, "label int, idx array<int>, val array<float>").toArrow()
    label = rows.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return None
    data = [(np.asarray(i.values, np.int64), np.asarray(v.values, np.float64), int(y)) for i, v, y in zip(rows.column("idx"), rows.column("val"), label, strict=True)]
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    weights, bias = Ftrl(1 << BITS, 1, alpha=0.5, l1=0.02, l2=0.01).fit(data, EPOCHS).weights()
    return weights[:, 0], float(bias[0])


def scorer(model: tuple[np.ndarray, float] | None):
    """Function from a text column to qualities."""

    def score(column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, b in _text.slices(column):
            idx, first, count = features(column.slice(a, b - a))
            if model is None:
                out[a:b] = count > 0
                continue
            weights, bias = model
            dot = _text.segment_sum(weights[idx].sum(1), first) * SCALE / np.maximum(1, count)
            out[a:b] = np.where(count > 0, 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35))), 0.0)
        return out

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, quality in 0..1 and keep for every document."""
    score = _broadcast_scorer(docs.sparkSession, train(docs, labels, per_class))

    def run(batches):
        f = score()
        for batch in batches:
            q = f(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(q), pa.array(q >= threshold)], names=["doc_id", "quality", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    score = _broadcast_scorer(docs.sparkSession, train(docs, labels, per_class))

    def run(batches):
        f = score()
        for batch in batches:
            yield batch.filter(pa.array(f(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _broadcast_scorer(spark: SparkSession, model):
    """The model is 2**BITS floats: 1 MB, whatever the corpus."""
    shared = spark.sparkContext.broadcast(model)
    return lambda: scorer(shared.value)
