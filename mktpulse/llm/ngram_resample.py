"""Target-distribution importance resampling over n-gram spans.

Every text is normalised as bytes: A-Z become a-z, every run of separators one space. An overlapped regex
scan with boundary lookarounds then yields the span of each run of n words directly, from which its bucket is
counted: the CRC-32 of the span's bytes modulo the number of buckets. Two distributions over the buckets, that
of the target texts and that of all documents, give each bucket a gain; a document's weight is its features'
mean gain; Gumbel noise drawn from the document's id makes the highest scores a sample without replacement.

What grows: texts are scanned once, in place; a document's buckets go to the shared folder, two bytes a feature
(four above 65,536 buckets). Only counts per bucket meet the driver. Scores are ranked over range partitions of
narrow rows, each position being the partition's offset plus the place in it; nothing is grouped by a key, so
no key can be hot.

Defined results: NULL and texts without words have no features (weight 0); rows that repeat are documents of
their own; ties go to the smaller doc_id, NULL ids last, then to the smaller weight; a NULL id is written as no
characters when its noise is drawn. Without target texts all gains rest on the raw counts alone; without
documents the result is empty. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import prepare, running, stored

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"


def _fold() -> bytes:
    """Byte table: letters and digits of ASCII in lower case, bytes of other characters as they are, the rest a space."""
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


FOLD = _fold()


def normalised(text: bytes) -> bytes:
    """The words of a text in lower case (A-Z only), single spaces between them."""
    return b" ".join(text.translate(FOLD).split())


def span_pattern(n: int):
    """Spans of ``n`` consecutive words in a normalised text; to be searched with overlaps."""
    import regex

    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def span_buckets(text: bytes, patterns, buckets: int) -> np.ndarray:
    """The bucket of every span of a normalised text, repeats included."""
    crc = zlib.crc32
    spans = chain.from_iterable(p.finditer(text, overlapped=True) for p in patterns)
    return np.fromiter((crc(m.group()) for m in spans), np.uint32) % np.uint32(buckets)


def featurised(docs: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary, little-endian) of every row: runs of ``least`` to ``most`` words."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [span_pattern(n) for n in range(least, most + 1)]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                words, found = [], []
                for text in part.column(1):
                    t = normalised(text.as_py())
                    words.append(t.count(b" ") + 1 if t else 0)
                    found.append(span_buckets(t, patterns, buckets).astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words, pa.int64()),
                     pa.array([len(f) // int(kind[-1]) for f in found], pa.int64()), pa.array(found, pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. A task sends one row for each bucket it met."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for found in b.column(0):
                n += np.bincount(np.frombuffer(found.as_buffer(), kind), minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n[met], pa.int64())], names=["bucket", "n"])

    got = features.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()  # at most one row per bucket
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the ratio of the two smoothed shares)."""
    s, t, m = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the features' gains (0 without features)."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (np.frombuffer(x.as_buffer(), kind) for x in b.column(3))
            weights = [int(gains[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weights, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return (features.select("doc_id", "n_words", "n_features", "buckets")
            .mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"))


def noise(seed: str):
    """floor(1000 Gumbel) of a document, from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs``.

    ``target`` has the texts (column text) of the distribution to come near. Of the rows with at least
    ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn; rank is their place, others have NULL.
    """
    if least < 1 or most < least or buckets < 1:
        raise ValueError("1 <= least <= most and 1 <= buckets are needed")
    prepare(docs.sparkSession)
    features = stored(featurised(docs, least, most, buckets), "spans")
    wanted = featurised(target.select(F.lit(None).alias("doc_id"), "text"), least, most, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = (weighed(features, gains).withColumn("score", F.col("weight") + noise(seed))
              .withColumn("_in", F.col("n_words") >= min_words).withColumn("_row", F.monotonically_increasing_id()))
    scored = stored(scored, "scores")
    drawn = scored.where("_in").count() * percent // 100
    ranked = running(scored, [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features", "_row"])
    rank = F.when(F.col("_in") & (F.col("_place") <= drawn), F.col("_place"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
