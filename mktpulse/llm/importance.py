"""Quality classifier by importance resampling.

Two generative models over the same hashed n-gram features: the target (labelled
good and not toxic) and the raw text (all documents). A document's importance
weight is the ratio of its probabilities under them; documents are drawn without
replacement by Gumbel top-k (log weight plus Gumbel noise, the k largest).

Features: words, word beginnings, and trigrams of word shapes (so case, digits and marks
count), hashed into ``BUCKETS``. A feature's ratio is smoothed towards 1 by
``PRIOR`` raw counts, but by no fewer than make ``PRIOR_TARGET`` expected target counts: where few documents are
target documents, a feature without a target count is no evidence until the target should have shown it some
13 times (2 (e^2 - 1)). The document's own occurrences are left out of both
models, so that labelled and unlabelled documents are scored alike. Only ratios
below ``exp(CUT)`` count: what the target has at its usual rate says nothing,
and sums over it would only measure length.

Sizes: the raw model is counted over all documents; the target ids are all of
the labelled ones, at most ``MAX_TARGET`` (those with the smallest hash of the id), which bounds
what is broadcast; the model has ``BUCKETS`` entries whatever the input.

Defined results: NULL and empty texts have no features (weight 1); without
target documents every weight is 1; rows that repeat get the same noise;
documents tied with the k-th key are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import prepare, stored, texts

BUCKETS = 1 << 20
PRIOR, PRIOR_TARGET, CUT = 10.0, 2.0, -2.0
MAX_TARGET = 200_000
#: Log weights are divided by this before the noise is added: the lower, the closer to a plain cut.
TEMPERATURE = 0.2
#: Share of the target documents that the sample size is set to keep.
KEEP = 0.995
MAX_WORDS = 200_000
_WORD = re.compile(r"\w+|[^\w\s]+")
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)


def shape(word: str) -> str:
    if word.isalpha():
        if word.islower():
            return "x"
        if word.isupper():
            return "X"
        return "Xx" if word[1:].islower() else "xX"
    return "9" if word.isdigit() else word


class _Words(dict):
    """word -> three 64-bit hashes: the word, its beginning, its shape."""

    def __missing__(self, word: str) -> bytes:
        from xxhash import xxh3_64_intdigest as h

        if len(self) >= MAX_WORDS:
            self.clear()
        start = h("b" + word[:5]) if word.isalpha() and len(word) > 5 else 0
        got = np.array([h("w" + word), start, h("s" + shape(word))], np.uint64).tobytes()
        if len(word) <= 48:
            self[word] = got
        return got


_words = _Words()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's features and how often each occurs."""
    found = _WORD.findall(text)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, found)), np.uint64).reshape(-1, 3)
    parts = [h[:, 0], h[:, 1][h[:, 1] != 0]]
    s = h[:, 2]
    if len(s) > 2:
        t = s[:-2] * np.uint64(_MUL[0]) + s[1:-1] * np.uint64(_MUL[1]) + s[2:]
        parts.append((t ^ (t >> np.uint64(29))) * np.uint64(_MUL[2]))
    return np.unique((np.concatenate(parts) >> np.uint64(44)).astype(np.int64), return_counts=True)


def targets(labels: DataFrame) -> DataFrame:
    """doc_id: the ids labelled good and never bad or toxic, each once."""
    return (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
            .where("q = 1 AND t = 0").select("doc_id"))


def target_ids(labels: DataFrame, most: int = MAX_TARGET) -> list[int]:
    """The ids of ``targets``; at most ``most``, those with the smallest hash."""
    return [r.doc_id for r in targets(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


class Model:
    """Counts per bucket under the raw text and the target."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, prior: float = PRIOR, cut: float = CUT):
        self.raw, self.target, self.prior, self.cut = raw, target, prior, cut
        self.rate = float(target.sum()) / max(1.0, float(raw.sum()))

    def log_weight(self, text: str, in_target: bool) -> float:
        if not self.rate:
            return 0.0
        at, n = features(text)
        own = n if in_target else 0
        a = max(self.prior, PRIOR_TARGET / self.rate)
        # repeated rows of one target id may count more often than the id: never below zero
        t, r = np.maximum(self.target[at] - own, 0), np.maximum(self.raw[at] - n, 0)
        ratio = np.log((t + a * self.rate) / ((r + a) * self.rate))
        return float((n * ratio)[ratio < self.cut].sum())


def fit(docs: DataFrame, target: list[int]) -> Model:
    """Count both models in one pass over all documents; tasks send one row per bucket they met."""
    spark = prepare(docs.sparkSession)
    ids = spark.sparkContext.broadcast(frozenset(target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                for doc, text in zip(*(c.to_pylist() for c in b.slice(i, 1000).columns)):
                    at, n = features(text)
                    raw[at] += n
                    if doc in ids.value:
                        good[at] += n
        met = np.flatnonzero(raw)
        for i in range(0, len(met), 100_000):
            m = met[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(raw[m]), pa.array(good[m])], names=["bucket", "raw", "target"])

    got = (texts(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
           .mapInArrow(run, "bucket bigint, raw bigint, target bigint")
           .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())  # at most BUCKETS rows
    raw, good = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    raw[got["bucket"].to_numpy()] = got["raw"].to_numpy()
    good[got["bucket"].to_numpy()] = got["target"].to_numpy()
    return Model(raw, good)


def score(docs: DataFrame, model: Model, target: list[int], temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, _h (hash of the text), log_weight, key (with Gumbel noise), in_target. No shuffle."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model, frozenset(target)))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"),
                      F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                doc, text = part.column(0).to_pylist(), part.column(2).to_pylist()
                known = [d in ids for d in doc]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([m.log_weight(t, k) for t, k in zip(text, known)], pa.float64()),
                     pa.array(known, pa.bool_())], names=["doc_id", "_h", "log_weight", "in_target"])

    scored = src.mapInArrow(run, "doc_id bigint, _h bigint, log_weight double, in_target boolean")
    # the same document draws the same noise in every run
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), "doc_id", "_h"), 11) + 0.5) / 2.0 ** 53
    return scored.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(u)))


def kth_largest(scores: DataFrame, k: int, column: str = "key") -> float | None:
    """The k-th largest value of a double column, exactly, by histograms of its bits from the top.

    Each of the four passes brings at most 65,536 counts to the driver.
    """
    import struct

    def to_int(batches):  # bits of a double as an integer of the same order
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype("<f8").view("<u8")
            v = np.where(v >> np.uint64(63), ~v, v | np.uint64(1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array((v >> np.uint64(s)).astype(np.int64) & 0xFFFF) for s in (48, 32, 16, 0)],
                                             names=["a", "b", "c", "d"])

    rows = stored(scores.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
                  .mapInArrow(to_int, "a bigint, b bigint, c bigint, d bigint"), "top-k")
    value, left = 0, k
    for name in "abcd":
        counts = sorted(((r[name], r["n"]) for r in rows.groupBy(name).agg(F.count("*").alias("n")).collect()), reverse=True)
        for part, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return None  # fewer than k values
        value = value << 16 | part
        rows = rows.where(F.col(name) == part)
    raw = value & ((1 << 63) - 1) if value >> 63 else ~value & ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", raw))[0]


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, k: int | None = None) -> DataFrame:
    """doc_id, _h, log_weight, key, kept for every document: kept are the ``k`` with the largest keys.

    ``k`` is, unless given, the number of documents whose key is at least that of the lowest ``1 - keep`` of the
    target documents.
    """
    target = target_ids(labels)
    model = fit(docs, target)
    scores = stored(score(docs, model, target), "importance")
    if k is None:
        low = scores.where("in_target").agg(F.percentile("key", F.lit(1 - keep))).first()[0]  # over at most MAX_TARGET ids
        k = scores.where(F.lit(True) if low is None else F.col("key") >= low).count()
    cut = kth_largest(scores, k) if k else float("inf")
    kept = F.lit(True) if cut is None else F.col("key") >= F.lit(cut)
    return scores.select("doc_id", "_h", "log_weight", "key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the sample keeps."""
    gone = (resample(docs, labels, **how).where(~F.col("kept"))
            .select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k")).distinct())
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["_id"]) & (h == gone["_k"]), "left_anti")
