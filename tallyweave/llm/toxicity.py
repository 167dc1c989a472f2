"""Toxicity: a linear-chain conditional random field tags toxic spans of words.

States are clean and toxic. A word's evidence is the sum of hashed features: the word, its first
3, 4 and 5 bytes, and the words before and after. Chains are sentences. Forward-backward gives each word its
marginal probability of being toxic; runs of words over THRESHOLD are the offending spans, and the
document's score is 1 - prod(1 - p) over the spans' words of highest marginal. Everything runs on flat
arrays, many sentences in step.

Labelled tokens come from the document labels, by a test over the words of at most MAX_TOXIC toxic
and MAX_CLEAN clean labelled documents, those with the smallest hashes of doc_id: a word is toxic if the share of toxic
documents among those that contain it is PURITY at least, if that is no accident (a Chernoff
bound, corrected for the number of words tested), and if LEAST toxic documents have it. Copies and near
copies (found by MinHash over word 3-grams) count once in all this, so neither do they carry
the rare words of one toxic document into the lexicon nor can they keep a word out. The field is then fitted to these
documents' sentences: all that have a word which begins like a toxic one, and every CLEAN_SHAREth of the rest.

Result: doc_id, toxicity, starts, ends (character offsets of the offending spans, half open) of
documents whose score reaches THRESHOLD.

Defined results: null and empty texts and texts without a word have no spans and aren't returned; a null
doc_id is carried along; repeated rows are each returned; labels that are null are ignored, of contradictory
ones the lower counts; without labels of both classes, or without any word that passes the
test, nothing is toxic; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import _text, near_text
from tallyweave.llm._cut import cut
from tallyweave.llm.quality import labelled_sample

BITS = 20
MAX_TOXIC = 4000
MAX_CLEAN = 8000
PURITY = 0.8
LEAST = 3
#: Bands, rows and n of the MinHash that joins near copies: 0.98 of the pairs at Jaccard 0.7, 0.05 at 0.3.
COPIES = (22, 5, 3)
#: Of the sentences of a labelled text without a word that begins like a toxic one, every CLEAN_SHAREth trains.
CLEAN_SHARE = 32
THRESHOLD = 0.5
N_FEATURES = 6
_MASK = np.uint64((1 << BITS) - 1)
_END = np.zeros(256, bool)
_END[list(b".!?;\n\r")] = True


class Sentences:
    """Words of a text column, grouped into chains, with their features."""

    def __init__(self, column: pa.Array):
        self.words = w = _text.Words(column)
        n = len(w)
        self.hash = h = w.hashes()
        ends = np.concatenate([[0], np.cumsum(_END[w.buf])])
        text_of = w.text_of
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = (ends[w.starts[1:]] > ends[w.ends[:-1]]) | (text_of[1:] != text_of[:-1])
        self.first = np.append(np.flatnonzero(new), n)
        before = np.concatenate([[np.uint64(1)], h[:-1]]) if n else h
        before = np.where(new, np.uint64(1), before)
        last = np.append(new[1:], True) if n else new
        after = np.concatenate([h[1:], [np.uint64(2)]]) if n else h
        after = np.where(last, np.uint64(2), after)
        sums = _text.prefix_sums(w.buf)
        heads = [_text.span_hashes(w.buf, w.starts, np.minimum(w.ends, w.starts + k), sums) for k in (3, 4, 5)]
        self.head = heads[1]
        parts = [h, *heads, before, after]
        self.features = np.stack([(_text.mix(x + np.uint64(7 * k)) & _MASK).astype(np.int32) for k, x in enumerate(parts)], axis=1) if n else np.zeros((0, N_FEATURES), np.int32)
        self.before, self.after = before, after


def marginals(evidence: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word and the expected transitions of every chain step.

    evidence: log-odds of toxic of each word; first: bounds of the chains; trans: 2 x 2 log weights.
    Chains are sorted by length and advance together; each step renormalises, so nothing underflows.
    """
    n = len(evidence)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    e = np.exp(np.clip(evidence, -30, 30))
    t = np.exp(trans)
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # chains that reach each step
    for k in range(steps):
        at = start[: live[k]] + k
        if k == 0:
            a0, a1 = np.ones(len(at)), e[at]
        else:
            p = alpha[at - 1]
            a0 = p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0]
            a1 = (p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1]) * e[at]
        total = a0 + a1
        alpha[at, 0], alpha[at, 1] = a0 / total, a1 / total
    for k in range(steps - 2, -1, -1):
        at = start[: live[k + 1]] + k
        b = beta[at + 1]
        x1 = b[:, 1] * e[at + 1]
        b0 = t[0, 0] * b[:, 0] + t[0, 1] * x1
        b1 = t[1, 0] * b[:, 0] + t[1, 1] * x1
        total = b0 + b1
        beta[at, 0], beta[at, 1] = b0 / total, b1 / total
    both = alpha * beta
    p = both[:, 1] / both.sum(1) if n else np.zeros(0)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * t[None] * np.stack([beta[at, 0], beta[at, 1] * e[at]], axis=1)[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p, pair


class Crf:
    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans = weights, bias, trans

    def evidence(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1) + self.bias

    def tag(self, s: Sentences) -> np.ndarray:
        return marginals(self.evidence(s.features).astype(np.float64), s.first, self.trans)[0]


def gradient(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, w: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the chains' log-likelihood: (features that occur, their parts, parts of bias and transitions); labels minus marginals."""
    y = labels.astype(int)
    p, pair = marginals(w[features].sum(1) + other[0], bounds, other[1:].reshape(2, 2))
    d = y - p
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    k = np.flatnonzero(inner)
    seen = np.bincount(y[k - 1] * 2 + y[k], minlength=4).reshape(2, 2)
    rows, back = np.unique(features.ravel(), return_inverse=True)
    return rows, np.bincount(back.ravel(), np.repeat(d, features.shape[1]), len(rows)), np.concatenate([[d.sum()], (seen - pair.sum(0)).ravel()])


def fit_crf(features: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.5, l2: float = 1e-5) -> Crf:
    """Maximum likelihood by AdaGrad over batches of chains."""
    rng = np.random.default_rng(3)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    other, other2 = np.array([-2.0, 0, 0, 0, 0]), np.full(5, 1e-8)  # bias and transitions
    n_chains = len(first) - 1
    for _ in range(epochs):
        order = rng.permutation(n_chains)
        for i in range(0, n_chains, batch):
            chains = order[i : i + batch]
            size = first[chains + 1] - first[chains]
            bounds = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(first[chains] - bounds[:-1], size) + np.arange(bounds[-1])
            rows, gw, g = gradient(features[at], bounds, labels[at], w, other)
            g, gw = g / len(chains), gw / len(chains) - l2 * w[rows]
            other2 += g * g
            other += rate * g / np.sqrt(other2)
            g2[rows] += gw * gw
            w[rows] += rate * gw / np.sqrt(g2[rows])
    return Crf(w.astype(np.float32), float(other[0]), other[1:].reshape(2, 2))


def _families(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the sample's texts that have a word, and the group of copies and near copies of each."""
    rows = near_text.signatures(sample.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"]), *COPIES).select("doc_id", "bands").toArrow().sort_by("doc_id")
    keys = rows.column("doc_id").to_numpy()
    parent = np.arange(len(keys))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    seen: dict[int, int] = {}
    for k, bands in enumerate(rows.column("bands").to_pylist()):
        for x in bands:
            parent[root(k)] = root(seen.setdefault(x, k))
    return keys, np.array([root(k) for k in range(len(keys))], np.int64)


def _word_rows(keys: np.ndarray, family: np.ndarray):
    """Words of the texts of each label and family."""

    def run(batches):
        for batch in batches:
            for a, b in _text.slices(batch.column("text")):
                s = Sentences(batch.column("text").slice(a, b - a))
                if not len(s.words):
                    continue
                label, key = (batch.column(c).slice(a, b - a).to_numpy() for c in ("label", "key"))
                of = family[np.minimum(np.searchsorted(keys, key), len(keys) - 1)][s.words.text_of]
                t = pd.DataFrame({"word": s.hash.view(np.int64), "head": s.head.view(np.int64), "label": label[s.words.text_of].astype("int64"), "family": of}).drop_duplicates(["word", "label", "family"])
                yield pa.RecordBatch.from_pandas(t, preserve_index=False)

    return run


def toxic_words(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that the labels show to be toxic, and of their first 4 bytes."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sample = sample.where(F.col("text").isNotNull()).withColumn("key", F.xxhash64("text"))
    keys, family = _families(sample)
    if not len(keys):
        return none
    known = sample.select("key", "label").distinct().toArrow()  # at most the sample's rows, two integers each
    key, label = known.column("key").to_numpy(), known.column("label").to_numpy()
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    sizes = {x: len(np.unique(family[at[(label == x) & (keys[at] == key)]])) for x in (0, 1)}
    if not sizes[1] or not sizes[0]:
        return none
    share = sizes[1] / (sizes[0] + sizes[1])
    rows = sample.mapInArrow(_word_rows(keys, family), "word long, head long, label long, family long").groupBy("word", "label", "family").agg(F.min("head").alias("head"))
    words = rows.groupBy("word").agg(F.min("head").alias("head"), F.sum("label").alias("toxic"), F.count("*").alias("docs"))
    p = F.col("toxic") / F.col("docs")
    q = F.lit(share)
    bound = F.col("docs") * (p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0))
    # the share among equally many toxic and clean documents, so that the sample's mixture doesn't matter
    pure = F.col("toxic") / sizes[1] / (F.col("toxic") / sizes[1] + (F.col("docs") - F.col("toxic")) / sizes[0])
    likely = words.where(F.col("toxic") >= LEAST).withColumn("pure", pure).where(F.col("pure") >= PURITY)
    n_words = words.count()
    chosen = likely.where(bound > F.log(F.lit(100.0 * max(1, n_words)))).select("word", "head").toArrow()
    return tuple(np.unique(chosen.column(c).to_numpy().view(np.uint64)) for c in ("word", "head"))


def _training_chains(lexicon: np.ndarray, heads: np.ndarray, clean_share: int):
    """Chains with a toxic word or one that begins like one, and every clean_shareth chain of each text."""

    def run(batches):
        for batch in batches:
            f_out, y_out = [], []
            for a, b in _text.slices(batch.column("text")):
                s = Sentences(batch.column("text").slice(a, b - a))
                y = np.isin(s.hash, lexicon) & (batch.column("label").slice(a, b - a).to_numpy()[s.words.text_of] == 1)
                alike = np.isin(s.head, heads)
                chain = np.arange(len(s.first) - 1)
                chain -= np.searchsorted(s.first[:-1], s.words.first[s.words.text_of[s.first[:-1]]])  # number within its text
                for c in range(len(s.first) - 1):
                    lo, hi = int(s.first[c]), int(s.first[c + 1])
                    if alike[lo:hi].any() or chain[c] % clean_share == 0:
                        f_out.append(s.features[lo:hi].ravel())
                        y_out.append(y[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(f_out, pa.list_(pa.int32())), pa.array(y_out, pa.list_(pa.bool_()))], names=["f", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, clean_share: int = CLEAN_SHARE) -> Crf | None:
    """The tagger, or None if the labels teach nothing."""
    per = {1: max_toxic, 0: max_clean}
    sample = cut(labelled_sample(docs, labels, "toxic", per))  # read several times, and bounded
    lexicon, heads = toxic_words(sample)
    if not len(lexicon):
        return None
    rows = sample.mapInArrow(_training_chains(lexicon, heads, clean_share), "f array<int>, y array<boolean>").toArrow()
    chains = sorted(zip(rows.column("f").to_numpy(), rows.column("y").to_numpy(), strict=True), key=lambda r: (len(r[1]), r[0].tobytes()))
    first = np.concatenate([[0], np.cumsum([len(y) for _, y in chains])])
    return fit_crf(np.concatenate([f for f, _ in chains]).reshape(-1, N_FEATURES), first, np.concatenate([y for _, y in chains]).astype(bool))


def spans(s: Sentences, p: np.ndarray, threshold: float) -> dict[int, tuple[float, list[int], list[int]]]:
    """{text: (score, span starts, span ends)} in characters, of texts with a word over the threshold."""
    hot = np.flatnonzero(p >= threshold)
    if not len(hot):
        return {}
    w = s.words
    lead = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    row = np.searchsorted(w.first, hot, "right") - 1
    chain = np.searchsorted(s.first, hot, "right")
    fresh = np.ones(len(hot), bool)
    fresh[1:] = (hot[1:] != hot[:-1] + 1) | (chain[1:] != chain[:-1])
    out: dict[int, tuple[float, list[int], list[int]]] = {}
    begin = np.flatnonzero(fresh)
    for a, b in zip(begin, np.append(begin[1:], len(hot)), strict=True):
        r = int(row[a])
        base = lead[w.off[r]]
        score, starts, ends = out.get(r, (0.0, [], []))
        starts.append(int(lead[w.starts[hot[a]]] - base))
        ends.append(int(lead[w.ends[hot[b - 1]]] - base))
        out[r] = (1 - (1 - score) * (1 - float(p[hot[a:b]].max())), starts, ends)
    return out


SCHEMA = "doc_id long, toxicity double, starts array<int>, ends array<int>"


def find_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """Documents with toxic spans: score and character offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_toxic, max_clean))  # 2**BITS floats

    def run(batches):
        model = shared.value
        for batch in batches:
            ids, text, rows = batch.column("doc_id"), batch.column("text"), []
            for a, b in _text.slices(text):
                if model is None:
                    break
                s = Sentences(text.slice(a, b - a))
                for r, (score, starts, ends) in spans(s, model.tag(s), threshold).items():
                    rows.append((ids[a + r].as_py(), score, starts, ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.float64()), pa.array([x[2] for x in rows], pa.list_(pa.int32())), pa.array([x[3] for x in rows], pa.list_(pa.int32()))],
                names=["doc_id", "toxicity", "starts", "ends"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
