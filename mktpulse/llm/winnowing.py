"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed (polynomial hash, 32 bits kept after
mixing); of each window of ``w`` consecutive hashes the smallest is chosen, the
rightmost of equals, and kept once with its position. Two texts that share
``w + k - 1`` consecutive code points share a chosen hash; no run shorter than
``k`` is ever matched.

Defined results: a text shorter than ``k`` is hashed as one run; a text with
fewer than ``w`` runs is one window; the empty (or NULL) text has no hashes.
Likeness is the Jaccard similarity of the sets of hashes; of two texts
without hashes it is 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import list_array, partitions, prepare, texts

K, W = 16, 49  # a shared run of 64 code points is always found
_BASE, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def run_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of ``k`` (at most ``len(points)``) code points, built by doubling."""
    k = min(k, len(points))
    part, span = points.astype(np.uint64) + np.uint64(1), 1
    whole, size = None, 0
    while k:
        if k & 1:
            if whole is None:
                whole, size = part, span
            else:  # `part` in front of `whole`
                n = len(whole) - span
                whole = part[:n] * np.uint64(pow(_BASE, size, _MASK + 1)) + whole[span:]
                size += span
        k >>= 1
        if k:
            part = part[:-span] * np.uint64(pow(_BASE, span, _MASK + 1)) + part[span:]
            span *= 2
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(_MIX)
    return whole >> np.uint64(32)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions (code points), in order of position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h = run_hashes(points, k)
    # smallest hash first, then the largest position
    low = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w, span = min(w, len(low)), 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:span - w], low[w - span:])
    # the chosen position never moves back, so equal choices are neighbours
    low = low[np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))]
    return (low >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``hashes`` array<bigint>, ``positions`` array<bigint> of every whole text. No shuffle."""
    prepare(docs.sparkSession)
    src = texts(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = [winnow(t, k, w) for t in part.column(1).to_pylist()]
                sizes = [len(h) for h, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(np.concatenate([h for h, _ in got]).astype(np.int64), sizes, pa.int64()),
                     list_array(np.concatenate([p for _, p in got]), sizes, pa.int64())],
                    names=[id_col, "hashes", "positions"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, "
                               "hashes array<bigint>, positions array<bigint>")


def deal_with_successor(docs: DataFrame) -> DataFrame:
    """Rows (_part, _guest, doc_id, text) in partitions sorted by descending doc_id, each followed by the
    first row of the next partition as a guest (after the last: of the first).

    Ranges are cut at approximate quantiles of doc_id, one value per partition; the driver holds those
    and the first doc_id of each partition. Rows of one doc_id are ordered by text, NULL ids come last.
    """
    spark = prepare(docs.sparkSession)
    n = partitions(spark)
    src = texts(docs, F.col("doc_id").cast("bigint").alias("doc_id"))
    cuts = src.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = np.array(sorted(set(cuts)))
    nulls = len(cuts) + 1

    def part_of(ids: pa.Array) -> np.ndarray:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        part = len(cuts) - np.searchsorted(cuts, values, "right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), nulls, part).astype(np.int32)

    def first_ids(batches):
        for b in batches:
            p = part_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(p), b.column(0)], names=["_part", "doc_id"])

    heads = {r["_part"]: r["first"] for r in
             src.select("doc_id").mapInArrow(first_ids, "_part int, doc_id bigint")
             .groupBy("_part").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(heads)
    goes_to = {p: order[i - 1] for i, p in enumerate(order)}  # a partition's first row is the guest of the one before

    def deal(batches):
        for b in batches:
            p = part_of(b.column(0))
            ids = b.column(0).to_pylist()
            guests = [i for i, (part, d) in enumerate(zip(p, ids)) if heads[int(part)] == d]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.zeros(len(p), bool)), b.column(0), b.column(1)],
                                             names=["_part", "_guest", "doc_id", "text"])
            if guests:
                g = b.take(pa.array(guests))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([goes_to[int(p[i])] for i in guests], pa.int32()), pa.array([True] * len(guests)),
                     g.column(0), g.column(1)], names=["_part", "_guest", "doc_id", "text"])

    dealt = src.mapInArrow(deal, "_part int, _guest boolean, doc_id bigint, text string")
    return (dealt.repartitionById(nulls + 1, F.col("_part"))
            .sortWithinPartitions("_guest", F.col("doc_id").desc_nulls_last(), "text"))


def edited(text: str, following: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many of ``following``."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def fingerprint_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness.

    The edited text ends in the beginning of the next document by descending doc_id (after the last: the
    first). doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hashes in order of position,
    8 hexadecimal digits each), near_edited, near_next. One shuffle of the texts; tasks hold two documents.
    """
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in (
        "edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def row(now, following):
            doc, text, (h, hashes) = now
            new = edited(text, following[1])
            g, _ = (h, None) if new == text else winnow(new, k, w)
            out.append((doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                        h.astype(">u4").tobytes().hex(), g.astype(">u4").tobytes().hex(),
                        likeness(hashes, frozenset(g.tolist())), likeness(hashes, following[2][1])))

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
            out.clear()
            return got

        before = None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for guest, doc, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    h, _ = winnow(text, k, w)
                    now = (doc, text, (h, frozenset(h.tolist())))
                    if before is not None:
                        row(before, now)
                    before = None if guest else now
                    if guest:
                        break  # the first guest follows the last row
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    return deal_with_successor(docs).mapInArrow(run, schema)
