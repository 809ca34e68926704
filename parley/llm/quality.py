"""Operator 10: document quality by a linear-chain conditional random field.

Every line of a text is labelled good or bad.  A line's features are shares of
character classes, word statistics and repetition, of its own and of the line
before and after it; the chain's transition weights couple neighbouring
labels.  A document's quality is the length-weighted mean of its lines'
forward-backward marginals of ``good``.

The model is fitted by gradient descent on the conditional likelihood of a
sample of labelled documents, each with all its lines, which carry its label.
The sample is drawn from the given documents in the order of the hashes of
their ids: ``TRAIN_DOCS`` at most, and while their texts and features take no
more than ``TRAIN_BYTES`` together; a document that takes more than a 16th of
that by itself is not drawn.  That bounded sample is the only thing the driver
sees; scoring reads every line of every text, in array operations over batches.

Only the text enters a score.  Defined results: null and empty texts are one
empty line and get the model's score for it; labels that are null are left
out, of repeated labels the least counts; with no label of a given document every
score is 0.5 and ``keep_good`` keeps all rows.  Repeated rows get their own rows, an empty table an empty result.  Extra
columns pass through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_if_null, text_slices

TRAIN_DOCS = 2000
TRAIN_BYTES = 1 << 26
ROUNDS = 150
RATE = 0.08
PENALTY = 1e-4
GOOD = 0.7
#: Bytes of text worked on at once.
CHUNK_BYTES = 1 << 18

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _SIGN, _HIGH, _BAR = range(9)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT),
                      (b" \t\r\x0b\x0c\n", _SPACE), (b".,;:'\"()-?", _STOP), (b"!", _MARK), (b"|", _BAR)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = _HIGH
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Own features of a line; with the neighbours' three times as many and a constant.
OWN = 15
FEATURES = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines of each text) of all lines of all texts in turn."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    n, length = len(starts), (ends - starts).astype(np.float64)
    line = np.repeat(np.arange(n), ends - starts + 1)
    kind = _CLASS[data]
    shares = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float64)
    shares[:, _SPACE] -= 1  # the line's end
    shares /= np.maximum(length, 1)[:, None]
    # Words: runs of anything but spaces; a hash from prefix sums tells repeated neighbours.
    inside = kind != _SPACE
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.full(len(data) + 1, _ODD)
    power[0] = 1
    np.cumprod(power, out=power)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
    of = line[begin]
    words = np.bincount(of, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    size = end - begin
    raw = prefix[end] - prefix[begin]
    # Equal words: hash of the first times the power of their distance is the hash of the second.
    same = np.zeros(len(begin), dtype=bool)
    if len(begin) > 1:
        same[1:] = (raw[:-1] * power[begin[1:] - begin[:-1]] == raw[1:]) & (size[:-1] == size[1:]) & (of[:-1] == of[1:])
    odd_end = np.isin(kind[end - 1], (_SIGN, _MARK, _BAR)) if len(end) else np.zeros(0, bool)
    capital = np.isin(kind[begin], (_UPPER,)) if len(begin) else np.zeros(0, bool)
    own = np.empty((n, OWN))
    own[:, :9] = shares
    own[:, 9] = np.bincount(of, weights=same, minlength=n) / some
    own[:, 10] = np.bincount(of, weights=odd_end, minlength=n) / some
    own[:, 11] = np.bincount(of, weights=capital, minlength=n) / some
    own[:, 12] = np.minimum(np.bincount(of, weights=size, minlength=n) / some / 10, 3)
    own[:, 13] = np.log1p(length) / 5
    own[:, 14] = words > 0
    features = np.zeros((n, FEATURES), dtype=np.float64)
    features[:, :OWN] = own
    firsts = np.cumsum(counts) - counts
    after = np.ones(n, dtype=bool)
    after[firsts] = False
    at = np.flatnonzero(after)
    features[at, OWN:2 * OWN] = own[at - 1]
    features[at - 1, 2 * OWN:3 * OWN] = own[at]
    features[:, -1] = 1
    return features, length, counts


def marginals(score: np.ndarray, transition: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """P(good) of each line; ``score`` is the log odds of good.  With ``pairs`` also the
    log likelihoods' parts for training: (marginals, log Z by text, expected transitions)."""
    order = np.argsort(-counts, kind="stable")
    firsts = (np.cumsum(counts) - counts)[order]
    left = counts[order]
    most = int(left[0]) if len(left) else 0
    alive = np.searchsorted(-left, -np.arange(most), side="left")  # texts with more than t lines
    emit = np.stack([np.zeros_like(score), score], axis=1)
    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    for t in range(most):
        at = firsts[:alive[t]] + t
        if t == 0:
            forward[at] = emit[at]
        else:
            before = forward[at - 1]
            forward[at] = emit[at] + np.logaddexp(before[:, :1] + transition[0], before[:, 1:] + transition[1])
    for t in range(most - 2, -1, -1):
        at = firsts[:alive[t + 1]] + t
        ahead = backward[at + 1] + emit[at + 1]
        backward[at] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
    total = forward + backward
    logz = np.logaddexp(total[:, 0], total[:, 1])
    good = np.exp(total[:, 1] - logz)
    if not pairs:
        return good
    ends = firsts + left - 1
    expected = np.zeros((2, 2))
    inner = np.ones(len(score), dtype=bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] = np.exp(forward[at - 1, a] + transition[a, b] + emit[at, b] + backward[at, b] - logz[at]).sum()
    return good, logz[ends], expected


class LineField:
    """Weights of the chain: ``weights`` on a line's standardised features, ``transition`` between labels."""

    def __init__(self, weights=None, transition=None, mean=None, scale=None):
        self.fitted = weights is not None
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.transition = np.zeros((2, 2)) if transition is None else transition
        self.mean = np.zeros(FEATURES) if mean is None else mean
        self.scale = np.ones(FEATURES) if scale is None else scale

    def fit(self, features: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> LineField:
        """``labels`` by line; full-batch gradient ascent with Adam's step sizes."""
        if len(labels) == 0:
            return self
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0)
        self.mean[-1], self.scale[self.scale < 1e-9] = 0, 1
        x = (features - self.mean) / self.scale
        firsts = np.cumsum(counts) - counts
        inner = np.ones(len(labels), dtype=bool)
        inner[firsts] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[at - 1], labels[at]), 1)
        theta = np.zeros(FEATURES + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, ROUNDS + 1):
            good, _, expected = marginals(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2), counts, True)
            slope = np.concatenate((x.T @ (labels - good), (seen - expected).ravel())) / len(labels) - PENALTY * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
            theta += RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        self.weights, self.transition = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        self.fitted = True
        return self

    def quality(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        if not texts:
            return np.zeros(0)
        features, length, counts = line_features(texts)
        good = marginals((features - self.mean) / self.scale @ self.weights, self.transition, counts)
        text = np.repeat(np.arange(len(counts)), counts)
        weight = length + 1
        return np.bincount(text, weights=good * weight) / np.bincount(text, weights=weight)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> LineField:
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(
        F.min(label_col).alias("__label")).join(docs.select(id_col).distinct(), id_col, "left_semi")
    chosen = F.broadcast(known.orderBy(F.xxhash64(id_col), id_col).limit(train_docs).withColumnRenamed(id_col, "__id"))
    texts = docs.select(F.col(id_col).alias("__id"), empty_if_null(text_col).alias("__text"))
    lines = 1 + F.char_length("__text") - F.char_length(F.translate("__text", "\n", ""))
    taken = (texts.join(chosen, "__id").select("__id", (F.octet_length("__text") + lines.cast("long") * (4 * FEATURES)).alias("__takes"))
             .groupBy("__id").agg(F.max("__takes").alias("__takes")).filter(F.col("__takes") <= train_bytes // 16))
    in_order = Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0)  # train_docs rows at most
    fits = taken.withColumn("__sum", F.sum("__takes").over(in_order)).filter(F.col("__sum") <= train_bytes).select("__id")
    # A repeated id's first text in order: the sample stays bounded by its ids.
    rows = (texts.join(F.broadcast(fits), "__id").join(chosen, "__id").select("__id", "__label", F.col("__text").cast("binary").alias("__text"))
            .groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(0).to_pylist()):
                features = line_features([text])[0]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, 1), pa.array([len(features)]), pa.array(
                    [features.astype(np.float32).tobytes()], pa.binary())], names=["label", "lines", "features"])

    sample = rows.select("__text", F.col("__label").cast("int")).mapInArrow(
        run, "label int, lines long, features binary").collect()
    if not sample:
        return LineField()
    sample.sort(key=lambda r: (r.label, bytes(r.features)))  # sums in one order, whatever order the rows came in
    features = np.frombuffer(b"".join(bytes(r.features) for r in sample), dtype=np.float32).reshape(-1, FEATURES).astype(np.float64)
    counts = np.array([r.lines for r in sample])
    return LineField().fit(features, np.repeat([int(r.label > 0) for r in sample], counts), counts)


def score(docs: DataFrame, model: LineField, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the quality of each text as ``out_col``; a column of that name
    is an error, as Spark would not tell the two apart."""
    if out_col in docs.columns:
        raise ValueError(f"the table has a column {out_col}; name another out_col")
    from pyspark import cloudpickle
    weights = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    kind = docs.select("*").schema.add(out_col, "double")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        own = pickle.loads(weights.value)
        for batch in text_slices(batches, at, CHUNK_BYTES):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.quality(texts))],
                                             names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, kind)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = GOOD, **columns) -> DataFrame:
    """``docs`` without the documents that score below ``least``."""
    model = train(docs, labels, **columns)
    if not model.fitted:
        return docs
    scored = score(docs, model, columns.get("text_col", "text"), "__quality")
    return scored.filter(F.col("__quality") >= least).drop("__quality")
