"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends behind a byte
where the top bits of the hash are zero (after ``MIN_CHUNK`` bytes, at
``MAX_CHUNK`` at the latest). The hash sees the last 16 bytes only, so after an
insertion the chunk ends fall into step again and the chunks of a shared
passage are the same wherever it stands.

Chunks are compared by 128-bit digest. The first occurrence (smallest doc_id,
then place) of a digest stays. A later one is a repeat; it is removed if it lies
in a run of consecutive repeats of at least ``MIN_RUN`` bytes, or if the whole text is one run (an exact copy, however
short), so chance repeats of a short chunk (a common word or two) leave a text alone.

Scale: a chunk is 24 bytes in the shuffle, its text stays where it is. Digests
are counted with a map-side combine; the rows that repeat find their first
occurrence through ``lookup_hot``, so a passage in a third of all documents
does not meet in one task; only repeats travel back to the documents.

Defined results: NULL and empty texts have no chunks; a whole text that occurs under an earlier doc_id is emptied; rows
with the same doc_id (or NULL) and text are one document: none of them is a repeat of another, and what is
removed from one is removed from all; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import list_array, lookup_hot, prepare, stored, texts

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 16, 5, 256
MIN_RUN = 100

#: Bytes the rolling hash sees, which is also its width in bits.
WINDOW = 16
#: The gear table: a 16-bit value per byte, from a rule (SHA-256 of the byte).
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:2], "little") for b in range(256)], np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash behind every byte: sum over the last ``WINDOW`` bytes of gear[byte] << age, by doubling."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        shifted = h[:-span] << np.uint16(span) if len(h) > span else h[:0]
        h = h.copy()
        h[span:] += shifted
        span *= 2
    return h


def chunk_ends(text: bytes, least: int = MIN_CHUNK, bits: int = MEAN_BITS, most: int = MAX_CHUNK) -> list[int]:
    """End offsets of the chunks (bytes; never inside a UTF-8 character)."""
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, np.uint8)
    cut = np.flatnonzero(gear_hashes(data) >> np.uint16(WINDOW - bits) == 0) + 1
    if len(cut) and n > int(cut[-1]):
        cut = cut[(data[np.minimum(cut, n - 1)] & 0xC0) != 0x80]
    elif len(cut):
        cut = cut[(cut == n) | ((data[np.minimum(cut, n - 1)] & 0xC0) != 0x80)]
    ends, start = [], 0
    for c in cut.tolist():
        while c - start > most:  # no cut in reach: by length, moved behind the character
            start += most
            while start < n and text[start] & 0xC0 == 0x80:
                start += 1
            ends.append(start)
        if c - start >= least:
            ends.append(c)
            start = c
    while n - start > most:
        start += most
        while start < n and text[start] & 0xC0 == 0x80:
            start += 1
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str, **how) -> list[bytes]:
    raw, start, out = text.encode("utf-8", "surrogatepass"), 0, []
    for end in chunk_ends(raw, **how):
        out.append(raw[start:end])
        start = end
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_h``, a hash of the text: (doc_id, _h) names a document."""
    return docs.withColumn("_h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def chunk_rows(docs: DataFrame, **how) -> DataFrame:
    """digest, doc_id, _h, start, end (byte offsets) of every chunk of every whole text. No shuffle."""
    src = texts(keyed(docs), "doc_id", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                digests, starts, ends, counts = [], [], [], []
                for text in part.column(2).to_pylist():
                    raw = text.encode("utf-8", "surrogatepass")
                    cut = chunk_ends(raw, **how)
                    first = [0, *cut[:-1]] if cut else []
                    digests.extend([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(first, cut)])
                    starts.extend(first)
                    ends.extend(cut)
                    counts.append(len(cut))
                n = len(digests)
                flat = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(b"".join(digests))])
                rows = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [flat, part.column(0).take(rows), part.column(1).take(rows), pa.array(starts, pa.int32()),
                     pa.array(ends, pa.int32())], names=["digest", "doc_id", "_h", "start", "end"])

    return src.mapInArrow(run, f"digest binary, doc_id {src.schema['doc_id'].dataType.simpleString()}, _h bigint, "
                               "start int, end int")


def repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, _h, chunks (sorted array of start, end): chunks that occur earlier, by document.

    Only documents that have such chunks. "Earlier" orders by doc_id (NULL first), text hash, place.
    """
    rows = chunk_rows(docs, **how)
    place = F.struct("doc_id", "_h", "start")
    # the same document twice (same doc_id and text) is not a repeat of itself: count places, not rows
    first = stored(rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"),
                                              F.count("*").alias("n"))
                   .where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "chunk-repeats")
    total = first.agg(F.sum("n")).first()[0] or 0
    found = lookup_hot(rows, first, "digest", total)
    later = found.where(F.col("first").isNotNull() & ~(
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("_h") == F.col("first._h")) & (F.col("start") == F.col("first.start"))))
    return later.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("chunks"))


def runs(chunks_, least: int = MIN_RUN) -> list[tuple[int, int]]:
    """Runs of consecutive chunks of at least ``least`` bytes, from sorted (start, end) pairs."""
    out = []
    for s, e in chunks_:
        if out and out[-1][1] == s:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= least]


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN, **how) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, plus ``_removed`` (array of start, end in bytes
    of the old text) and ``_before`` (length of the old text in code points). One row per row of ``docs``."""
    prepare(docs.sparkSession)
    have = keyed(docs)
    marks = repeats(docs, **how).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k"), "chunks")
    cols = docs.columns
    joined = have.join(marks, have["doc_id"].eqNullSafe(marks["_id"]) & (have["_h"] == marks["_k"]), "left")
    row = joined.select(*[have[c] for c in cols], F.col("chunks").alias("_removed"))
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                new, gone, before = [], [], []
                for text, marked in zip(part.column(at).to_pylist(), part.column(len(cols)).to_pylist()):
                    before.append(len(text or ""))
                    raw = text.encode("utf-8", "surrogatepass") if marked else b""
                    every = runs([(c["start"], c["end"]) for c in marked or ()], 1)
                    cut = [(s, e) for s, e in every if e - s >= min(min_run, len(raw))]
                    if cut:
                        keep, last = [], 0
                        for s, e in cut:
                            keep.append(raw[last:s])
                            last = e
                        text = b"".join([*keep, raw[last:]]).decode("utf-8", "surrogatepass")
                    new.append(text)
                    gone.append([{"start": s, "end": e} for s, e in cut])
                arrays = [part.column(k) for k in range(len(cols))]
                arrays[at] = pa.array(new, pa.string())
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone, kind), pa.array(before, pa.int64())],
                                                 names=[*cols, "_removed", "_before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return row.mapInArrow(run, schema + ", _removed array<struct<start:int,end:int>>, _before bigint")
