"""WARC archives: writing with payload deduplication, and reading by verified record boundaries.

Writing: the record with the smallest page_id of those with an equal payload
(of at least ``min_bytes``) is a response, the others are revisit records that
refer to it. Tasks write one archive each (records are gzip members of their own,
or plain), named by task attempt; the manifest lists the archives of
successful attempts.

Reading: an archive is cut into byte ranges. In its range a task looks for the
record magic; every hit that parses as a record is a candidate with its
successor (the offset behind it). Magic inside payloads gives false
candidates, so none is trusted: a chain from the start of the file decides.
Within a range, pointer jumping (each pointer replaced by its target's
pointer, twice the distance each round) takes every candidate to the first
offset of its chain beyond the range. Between ranges only the offsets that
chains arrive at matter; pointer jumping over these few rows, as
DataFrame joins, marks the ones reachable from offset 0 in a number of rounds that is
the logarithm of the ranges of a file. Each range is then read from its
verified entry, along the chain.

Defined results: a NULL html is an empty payload; rows with the same page_id
and payload that are the smallest are all responses; a NULL page_id is never
the smallest while there is another; a chain that does not end at the end of its file raises an error (a
damaged file is not read in part).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mktpulse.llm.common import lookup_hot, open_fs, partitions, prepare, shared_folder, stored

MAGIC = b"WARC/1.0\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)
_FIELD = re.compile(rb"[^\s:]+:")
#: First read of a header; a longer one is read on in steps.
HEADER_STEP = 1 << 14


# -- records ------------------------------------------------------------------
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record with its trailing line ends; a revisit has no payload, but states its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url or "about:blank")
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {safe}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of the record that ``data`` starts with, None if it is none."""
    if not data.startswith(MAGIC):
        return None
    end = data.find(b"\r\n\r\n")
    length = _LENGTH.search(data, 0, end + 2) if end > 0 else None
    if not length:
        return None
    stop = end + 4 + int(length[1])
    if data[stop:stop + 4] != b"\r\n\r\n":
        return None
    fields = {}
    for line in data[len(MAGIC):end].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields, data[end + 4:stop]


class Archive:
    """Byte window on an open file: records at any offset, whatever the range."""

    def __init__(self, source, gz: bool):
        self.source, self.gz, self.size = source, gz, source.size()
        self.at, self.data = 0, b""

    def bytes(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.size)
        if start < self.at or stop > self.at + len(self.data):
            self.source.seek(start)
            self.at, self.data = start, self.source.read(max(stop - start, min(1 << 20, self.size - start)))
        return self.data[start - self.at:stop - self.at]

    def successor(self, offset: int) -> int | None:
        """Offset behind the record at ``offset``; None if there is no record."""
        got = self.record(offset, body=False)
        return got and got[0]

    def record(self, offset: int, body: bool = True):
        """(successor, fields, block) of the record at ``offset``; None if there is none."""
        if self.gz:
            z, out, pos = zlib.decompressobj(31), [], offset
            try:
                while not z.eof:
                    piece = self.bytes(pos, pos + (1 << 16))
                    if not piece:
                        return None
                    out.append(z.decompress(piece))
                    pos += len(piece)
                    if len(out) == 1 and not out[0].startswith(MAGIC[:len(out[0])]):
                        return None
            except zlib.error:
                return None
            got = parse(b"".join(out))
            return got and (pos - len(z.unused_data), *got)
        step = HEADER_STEP
        while True:
            head = self.bytes(offset, offset + step)
            # a record's first line after the magic is a field; text after a magic in a payload seldom looks like one
            if not head.startswith(MAGIC) or not _FIELD.match(head, len(MAGIC)):
                return None
            end = head.find(b"\r\n\r\n")
            if end > 0 or len(head) < step:
                break
            step *= 4
        length = _LENGTH.search(head, 0, end + 2) if end > 0 else None
        if not length:
            return None
        stop = offset + end + 4 + int(length[1]) + 4
        if stop > self.size or self.bytes(stop - 4, stop) != b"\r\n\r\n":
            return None
        if not body:
            return (stop,)
        got = parse(self.bytes(offset, stop))
        return got and (stop, *got)

    def candidates(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets in [start, stop) where a record could begin, and their successors."""
        magic = GZIP_MAGIC if self.gz else MAGIC
        self.source.seek(start)
        data = self.source.read(min(stop + len(magic) - 1, self.size) - start)
        hits = [start + m.start() for m in re.finditer(b"(?=" + re.escape(magic) + b")", data)]
        self.at, self.data = start, data
        found = [(o, s) for o in hits if (s := self.successor(o))]
        offs, succ = zip(*found) if found else ((), ())
        return np.array(offs, np.int64), np.array(succ, np.int64)


def exits(offsets: np.ndarray, successors: np.ndarray, stop: int) -> np.ndarray:
    """Where each candidate's chain first lands at or beyond ``stop``, by pointer jumping; -1: at no candidate."""
    n = len(offsets)
    if not n:
        return successors
    at = np.minimum(np.searchsorted(offsets, successors), n - 1)
    inside = successors < stop
    # nodes 0..n-1 the candidates, n+i the landing of candidate i, 2n a dead end
    target = np.where(~inside, n + np.arange(n), np.where(offsets[at] == successors, at, 2 * n))
    jump = np.concatenate([target, np.arange(n, 2 * n + 1)])
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            break
        jump = twice
    ends = np.concatenate([successors, [-1]])
    return ends[jump[:n] - n]


# -- writing --------------------------------------------------------------------
def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (never NULL), revisit, refers_to. The payload is compared by SHA-256 and length."""
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    size = F.octet_length("html")
    p = p.withColumn("_key", F.when(size >= min_bytes, F.unhex(F.sha2(F.col("html").cast("binary"), 256))))
    first = (p.where("_key IS NOT NULL").groupBy("_key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1"))
    first = stored(first, "warc-equal-payloads")
    total = first.agg(F.sum("n")).first()[0] or 0
    j = lookup_hot(p, first, "_key", total)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, gz: bool = True) -> DataFrame:
    """Write one archive per task into ``folder``; returns the manifest: path, size, records."""
    prepare(pages.sparkSession)
    rows = decide(pages, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, out, size, n = TaskContext.get(), None, 0, 0
        path = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc" + ".gz" * gz
        for b in batches:
            for i in range(0, b.num_rows, 200):
                for page_id, url, html, revisit, refers in zip(*(c.to_pylist() for c in b.slice(i, 200).columns)):
                    if out is None:
                        fs, p = open_fs(path)
                        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(p, compression=None)
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers, revisit)
                    data = gzip_member(data) if gz else data
                    out.write(data)
                    size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [n]})

    return stored(rows.mapInArrow(run, "path string, size bigint, records bigint"), "warc-manifest")


# -- reading --------------------------------------------------------------------
def ranges(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """path, start, stop of the byte ranges of each file (path, size)."""
    start = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes).cast("bigint")))
    r = files.where("size > 0").select("path", "size", start.alias("start"))
    return r.withColumn("stop", F.least(F.col("start") + range_bytes, "size"))


def entries(files: DataFrame, gz: bool, range_bytes: int = RANGE) -> DataFrame:
    """path, start, stop, entry: for each range that a verified chain enters, the first record boundary in it.

    Also a row with start -1 per file whose chain breaks off before the end of the file.
    """
    spark = files.sparkSession
    split = ranges(files, range_bytes).repartition(partitions(spark), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as source:
                    offs, succ = Archive(source, gz).candidates(start, stop)
                yield pa.RecordBatch.from_pydict(
                    {"path": pa.array([path] * len(offs), pa.string()), "offset": pa.array(offs), "successor": pa.array(succ),
                     "exit": pa.array(exits(offs, succ, stop))})

    # one row per candidate, checked by chain below; written once, for it is read every round
    found = stored(split.mapInArrow(run, "path string, offset bigint, successor bigint, exit bigint"), "warc-candidates")
    # only offsets that some chain lands on, and the start of each file, can be an entry
    landing = found.select("path", F.col("exit").alias("offset")).union(
        files.where("size > 0").select("path", F.lit(0).cast("bigint"))).distinct()
    node = stored(found.join(landing, ["path", "offset"]).select("path", "offset", "exit"), "warc-landings")
    most = files.agg(F.max("size")).first()[0] or 0
    rounds = ceil(log2(max(1, ceil(most / range_bytes)))) + 1
    reached, jump = node.where("offset = 0").select("path", "offset"), node
    for k in range(rounds):
        step = reached.join(jump, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = stored(reached.union(step).distinct(), "warc-reached")
        if k < rounds - 1:
            far = jump.select("path", F.col("offset").alias("exit"), F.col("exit").alias("_far"))
            jump = stored(jump.join(far, ["path", "exit"]).select("path", "offset", F.col("_far").alias("exit")), "warc-jump")
    known = reached.where("offset >= 0").join(files.select("path", "size"), "path")
    at = F.floor(F.col("offset") / range_bytes) * range_bytes
    good = known.where("offset < size").join(node.select("path", "offset"), ["path", "offset"], "left_semi").select(
        "path", at.alias("start"), F.least(at + range_bytes, "size").alias("stop"), F.col("offset").alias("entry"))
    ended = known.where("offset = size").select("path")
    broken = files.where("size > 0").join(ended, "path", "left_anti").select(
        "path", F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("stop"), F.lit(-1).cast("bigint").alias("entry"))
    return stored(good.union(broken), "warc-entries")


_FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, path string, offset bigint"


def read_warc(files: DataFrame, gz: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The records of archives (path, size), by verified boundaries.

    page_id, payload_bytes, payload_digest, record_type, refers_to, path, offset. A response's length and digest are computed
    from the payload read, and must agree with its header.
    """
    spark = prepare(files.sparkSession)
    ranges_ = entries(files, gz, range_bytes)
    if bad := ranges_.where("start < 0").select("path").limit(5).collect():
        raise ValueError(f"record chain breaks off before the end of {[r.path for r in bad]}")

    def number(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for path, stop, entry in zip(*(c.to_pylist() for c in b.columns)):
                fs, p = open_fs(path)
                rows = []
                with fs.open_input_file(p) as source:
                    a, offset = Archive(source, gz), entry
                    while offset < stop:
                        after, f, block = a.record(offset)
                        revisit = f["warc-type"] == "revisit"
                        digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                        if not revisit:
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            if (len(payload), payload_digest(payload)) != (size, digest):
                                raise ValueError(f"payload of {f['warc-record-id']} does not agree with its digest")
                        rows.append((number(f["warc-record-id"]), size, digest, f["warc-type"],
                                     number(f.get("warc-refers-to")), path, offset))
                        offset = after
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return (ranges_.where("start >= 0").repartition(partitions(spark), "path", "start").select("path", "stop", "entry")
            .mapInArrow(run, _FIELDS))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, gz: bool = True) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back: one row per page."""
    files = write_warc(pages, shared_folder(spark, "warc"), min_bytes, gz)
    return read_warc(files, gz).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
