"""Line dedup: which lines of a document stay, as a compressed bitmap per document.

Every document leaves one row for each distinct key among its lines: a 128-bit hash of the key, the document and
the places of the lines. The rows are range-partitioned and sorted by hash, document and place, so the
occurrences of a key are neighbours and a key with a third of all rows is cut into as many partitions as it
needs. Each partition is streamed once: a run of a hash is judged as soon as it has been seen in ``min_docs``
documents, and at most that many of its rows are held. Runs at the two ends of a partition may go on in the next
one; what they leave open (at most ``2 min_docs`` rows a partition) is settled by a small aggregation. Only places of
dropped lines go back to their documents, where they become the bitmap; texts take no part in the range shuffle.

A key is the line without ``[ \\t-\\r]`` at its ends, A-Z in lower case; lines whose key is shorter than
``min_length`` code points always stay.

Defined results: a NULL or empty text is one empty line; a document is a row, also where its doc_id is NULL or
repeated; rows with the same doc_id and text are treated alike (with ``keep_first`` the first of them keeps its
lines for all of them); empty tables give empty results. Columns other than doc_id and text are carried along
untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mktpulse.llm.common import partitions, prepare, stored

MIN_DOCS, MIN_LENGTH = 10, 1
SPACE = b" \t\n\x0b\x0c\r"
#: What a streamed row says: its places go (1), all of them but the first go (2), a neighbouring partition may
#: hold more of the key (3), the key is known to have been met often enough (4).
DROP, DROP_LATER, OPEN, REACHED = 1, 2, 3, 4


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def n_points(utf8: bytes) -> int:
    """Code points of UTF-8 text: bytes that do not continue one."""
    return len(utf8) - sum(0x80 <= b < 0xC0 for b in utf8) if not utf8.isascii() else len(utf8)


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_rows(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """k1, k2 (hash of the key), doc_id, doc_hash, n_lines, first, places: one row per document and distinct key."""
    fields = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("doc_hash", pa.int64()),
                        ("n_lines", pa.int32()), ("first", pa.int32()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        def flush():
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            n = np.array([len(p) for p in places], np.int32)
            row = np.array(of, np.int64)
            got = pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0]), pa.array(k[:, 1]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)),
                 pa.array(lines, pa.int32()), pa.array([p[0] for p in places], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                                          pa.array(np.concatenate([np.array(p, np.int32) for p in places])))], schema=fields)
            for x in (keys, of, lines, places):
                x.clear()
            return got

        for b in batches:
            keys, of, lines, places = [], [], [], []
            for at, text in enumerate(b.column(2)):
                met: dict[bytes, list[int]] = {}
                split = text.as_py().split(b"\n")
                for i, line in enumerate(split):
                    key = line_key(line)
                    if key and (min_length < 2 or n_points(key) >= min_length):
                        met.setdefault(digest(key), []).append(i)
                keys += met
                places += met.values()
                of += [at] * len(met)
                lines += [len(split)] * len(met)
                if len(keys) >= 50_000:
                    yield flush()
            if keys:
                yield flush()

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("doc_hash"),
                      F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return src.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, doc_hash bigint, n_lines int, first int, places array<int>")


def _judge(min_docs: int, keep_first: bool):
    """Streams the sorted rows of one partition: rows with what they say in ``state``; rows of which nothing goes are left out."""

    def tagged(rows: pa.RecordBatch, states) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.broadcast_to(np.asarray(states, np.int32), rows.num_rows))],
                                          names=[*rows.schema.names, "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the unfinished run while they are fewer than min_docs
        key, seen, head, at_start = None, 0, None, True  # the unfinished run: hash, rows, first document, begins the partition
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b, seen, held = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0], 0, None
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1])
            lengths = np.diff(np.append(starts, b.num_rows))
            goes_on = key == (k1[0], k2[0])
            at_start = at_start and (goes_on or key is None)
            before = np.zeros(len(starts), np.int64)  # rows of a run that went through already
            before[0] = seen if goes_on else 0
            total = lengths + before
            many = np.repeat(total >= min_docs, lengths)
            begins = np.zeros(b.num_rows, bool)  # rows of the run at the start of the partition: one before may have its key
            begins[:lengths[0]] = at_start
            states = np.where(many, DROP, np.where(begins, OPEN, 0))
            if keep_first:
                doc = b.column(2).fill_null(-1).to_numpy(), b.column(2).is_null().to_numpy(zero_copy_only=False), b.column(3).to_numpy()
                heads = [np.repeat(c[starts], lengths) for c in doc]
                if before[0]:
                    for c, value in zip(heads, head):
                        c[:lengths[0]] = value
                of_head = np.logical_and.reduce([c == h for c, h in zip(doc, heads)])
                head = [c[-1] for c in heads]
                states[of_head & many] = DROP_LATER
                states[of_head & begins] = OPEN
            crossed = (total >= min_docs) & (before < min_docs)
            for i in {0, len(starts) - 1}:  # the partitions beside this one have to know
                if crossed[i] and (i or at_start or len(starts) == 1):
                    yield tagged(b.slice(starts[i] + lengths[i] - 1, 1), REACHED)
            if total[-1] < min_docs:
                held = b.slice(starts[-1])
                states[starts[-1]:] = 0
            key, seen = (k1[-1], k2[-1]), int(total[-1])
            at_start = at_start and len(starts) == 1
            says = states > 0
            if says.any():
                yield tagged(b.filter(pa.array(says)), states[says])
        if held is not None:
            yield tagged(held, OPEN)

    return run


def dropped_places(rows: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """doc_id, doc_hash, n_lines, places: the places of lines that go, from ``line_rows`` written before.

    A line goes if its key is in at least ``min_docs`` documents; with ``keep_first`` the first occurrence (by
    doc_id, hash of the text, place) stays.
    """
    names = ["k1", "k2", "doc_id", "doc_hash", "n_lines", "first", "places"]
    order = ["k1", "k2", F.asc_nulls_first("doc_id"), "doc_hash", "first"]
    # rows that repeat are told apart by where they are stored, so that any number of them can be cut
    placed = rows.select(*names).withColumn("_row", F.monotonically_increasing_id())
    sorted_ = (placed.repartitionByRange(partitions(rows.sparkSession), *order, "_row")
               .sortWithinPartitions(*order, "_row").drop("_row"))
    schema = "k1 bigint, k2 bigint, doc_id bigint, doc_hash bigint, n_lines int, first int, places array<int>, state int"
    judged = stored(sorted_.mapInArrow(_judge(min_docs, keep_first), schema), "judged-lines")
    left = judged.where(F.col("state") >= OPEN)  # a few rows per partition
    met = left.groupBy("k1", "k2").agg(
        F.sum(F.when(F.col("state") == OPEN, 1).otherwise(min_docs)).alias("_n"),
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "doc_hash")).alias("_first"))
    is_first = (F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_first.doc_hash") == F.col("doc_hash"))
                if keep_first else F.lit(False))
    settled = (left.where(F.col("state") == OPEN).join(met.where(F.col("_n") >= min_docs), ["k1", "k2"])
               .withColumn("state", F.when(is_first, DROP_LATER).otherwise(DROP)))
    gone = judged.where(F.col("state") < OPEN).select(*names, "state").unionByName(settled.select(*names, "state"))
    places = F.when(F.col("state") == DROP_LATER, F.expr("slice(places, 2, size(places))")).otherwise(F.col("places"))
    return gone.select("doc_id", "doc_hash", "n_lines", places.alias("places")).where(F.size("places") > 0)


def packed(gone: np.ndarray, n: int) -> bytes:
    """The bitmap of a document of ``n`` lines without those at ``gone``, deflated."""
    keep = np.ones(n, np.uint8)
    keep[gone] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpacked(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, doc_hash, copies, n_lines, n_dropped, keep: a row for each (doc_id, hash of the text) that loses lines.

    ``keep`` is the deflated bitmap of the lines that stay (see ``unpacked``); ``copies`` counts the rows of ``docs``.
    """
    prepare(docs.sparkSession)
    rows = stored(line_rows(docs, min_length), "lines")
    # rows that repeat bring the same places: the set is combined before the shuffle, whatever their number
    per_doc = (dropped_places(rows, min_docs, keep_first).groupBy("doc_id", "doc_hash", "n_lines")
               .agg(F.collect_set("places").alias("places"), F.count("*").alias("n")))
    per_doc = per_doc.withColumn("copies", F.ceil(F.col("n") / F.size("places")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, gone = [], []
            for n, places in zip(b.column(3).to_pylist(), b.column(4)):
                flat = places.values.flatten().to_numpy()
                gone.append(len(flat))
                maps.append(packed(flat, n))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(gone, pa.int32()), pa.array(maps, pa.binary())],
                                             names=["doc_id", "doc_hash", "copies", "n_lines", "n_dropped", "keep"])

    return (per_doc.select("doc_id", "doc_hash", "copies", "n_lines", "places")
            .mapInArrow(run, "doc_id bigint, doc_hash bigint, copies bigint, n_lines int, n_dropped int, keep binary"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, keep_first: bool = False) -> DataFrame:
    """The rows of ``docs``, text without the lines that go (``\\n`` between the others), with _n_lines, _n_dropped and _keep.

    _keep is the bitmap, NULL where all lines stay. Columns of ``docs`` with these three names are replaced.
    """
    bitmaps = stored(keep_bitmaps(docs, min_docs, min_length, keep_first), "bitmaps")
    # a (doc_id, text) that repeats in over a thousandth of these rows is looked up by broadcast: fewer than 1000 of them
    hot_at = max(100, (bitmaps.agg(F.sum("copies")).first()[0] or 0) // 1000)
    value = F.struct("n_dropped", "keep")
    hot = bitmaps.where(F.col("copies") > hot_at).select(F.col("doc_id").alias("_hi"), F.col("doc_hash").alias("_hh"), value.alias("_hot"))
    cold = bitmaps.where(F.col("copies") <= hot_at).select(
        F.col("doc_id").alias("_ci"), F.col("doc_hash").alias("_ch"), F.lit(0).alias("_cd"), value.alias("_cold"))
    added = ["_n_lines", "_n_dropped", "_keep"]
    names = [c for c in docs.columns if c not in added]
    # numbered names inside, so that no column of the caller's clashes
    d = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)],
                    docs["doc_id"].cast("bigint").alias("_id"), text_hash().alias("_h"))
    d = d.join(F.broadcast(hot), F.col("_id").eqNullSafe(F.col("_hi")) & (F.col("_h") == F.col("_hh")), "left")
    # rows of hot texts are dealt by where they were read: rows that repeat share every hash
    d = d.withColumn("_d", F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
                     .otherwise(0).cast("int"))
    d = d.join(cold, F.col("_id").eqNullSafe(F.col("_ci")) & (F.col("_h") == F.col("_ch")) & (F.col("_d") == F.col("_cd")), "left")
    d = d.select(*[f"c{i}" for i in range(len(names))], F.coalesce("_hot", "_cold")["keep"].alias("keep"))
    at, keep_at = names.index("text"), len(names)
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(names, d.schema)] + [
        T.StructField("_n_lines", T.IntegerType()), T.StructField("_n_dropped", T.IntegerType()),
        T.StructField("_keep", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                new, lines, dropped = [], [], []
                for text, keep in zip(part.column(at).to_pylist(), part.column(keep_at).to_pylist()):
                    n = text.count("\n") + 1 if text else 1
                    lines.append(n)
                    dropped.append(0)
                    if keep is not None:
                        stays = unpacked(keep, n)
                        text = "\n".join(compress(text.split("\n"), stays))
                        dropped[-1] = n - int(stays.sum())
                    new.append(text)
                cols = part.columns
                yield pa.RecordBatch.from_arrays(
                    [*cols[:at], pa.array(new, cols[at].type), *cols[at + 1:keep_at],
                     pa.array(lines, pa.int32()), pa.array(dropped, pa.int32()), cols[keep_at]], names=[*names, *added])

    return d.mapInArrow(run, schema)
