"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents. Every id takes the minimum
number of bits of the vocabulary; ids are packed in blocks of ``BLOCK`` ids,
each starting on a byte, and the offset of every block is in the footer, so a
range of ids is read by touching only its blocks, each unpacked by one
vectorised numpy call.

Layout, little-endian: magic (8 bytes); the blocks; footer: document ids
(int64, with a presence byte each), document starts (uint64, one more than
documents), block offsets (uint64, one more than blocks); trailer: documents,
ids, blocks (uint64 each), bits and block size (uint32 each), footer offset
(uint64), magic.

Files are written by tasks into the shared folder under a name of their own
per attempt; only files of successful attempts are in the manifest (one row
per file), so a lost executor leaves at most an unlisted file behind.

Defined results: a NULL or empty text has the end id alone; NULL doc_ids come first, rows of one doc_id by text,
rows that repeat are documents of their own; an empty table writes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mktpulse.llm.common import open_fs, partitions, prepare, shared_folder, stored, texts

MAGIC = b"IDPACK01"
BLOCK = 65_536
_TRAILER = struct.Struct("<QQQIIQ8s")
#: The id appended to each document.
END_ID = 1
#: Entries of each generation of a worker's table of pieces, and the longest piece it keeps.
MAX_WORDS, MAX_WORD_CHARS = 300_000, 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- bit packing ------------------------------------------------------------
def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary`` (at least 1)."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` (below 2**bits) as a bit stream, lowest bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    rows = np.zeros((count, 32), np.uint8)
    rows[:, :bits] = flat
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Appends documents to one file; holds one block of ids and the footer in memory."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.docs, self.starts, self.offsets = [], [0], [len(MAGIC)]
        self.open_ids: list[np.ndarray] = []
        self.open_count = self.n_ids = 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} takes more than {self.bits} bits")
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.open_ids.append(ids)
        self.open_count += len(ids)
        if self.open_count >= self.block:
            flat = np.concatenate(self.open_ids)
            whole = len(flat) - len(flat) % self.block
            for at in range(0, whole, self.block):
                self._put(flat[at:at + self.block])
            self.open_ids, self.open_count = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.open_count:
            self._put(np.concatenate(self.open_ids))
        self.sink.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        for values, kind in (([d or 0 for d in self.docs], "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(_TRAILER.pack(len(self.docs), self.n_ids, len(self.offsets) - 1, self.bits, self.block,
                                      self.offsets[-1], MAGIC))
        self.sink.close()


class Reader:
    """Random access to one file: any range of ids, any document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _TRAILER.size)
        n, self.n_ids, blocks, self.bits, self.block, footer, magic = _TRAILER.unpack(source.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        source.seek(footer)
        there = np.frombuffer(source.read(n), np.uint8)
        ids = np.frombuffer(source.read(8 * n), "<i8")
        self.docs = [int(d) if t else None for d, t in zip(ids, there)]
        self.starts = np.frombuffer(source.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of this file; reads only their blocks, in one piece."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            at, to = (int(self.offsets[k] - self.offsets[first]) for k in (b, b + 1))
            parts.append(unpack(data[at:to], min(self.block, self.n_ids - b * self.block), self.bits))
        flat = np.concatenate(parts)
        return flat[start - first * self.block:stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# -- tokenizing -------------------------------------------------------------
#: What the vocabulary file does to a text before merging (fixed values of the file format).
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Letters, numbers and white space up to U+017F, after lower-casing. Characters beyond it, those whose lower case
#: or white-space property engines could read differently, and what may be an added token are left to the library.
_LETTERS, _NUMBERS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\f\r"
_OTHER = re.compile("[\x0b\x1c-\x1f\x85\xa0\u0130\u0180-\U0010ffff]|<\\|")
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Characters of a text cut into pieces at once.
_STRETCH = 1 << 20


class _Table(dict):
    """piece -> its ids as bytes; two generations of at most MAX_WORDS pieces, long ones never kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece) or self.encode(piece)
        if len(piece) <= MAX_WORD_CHARS:
            if len(self) >= MAX_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


def _stretches(text: str) -> Iterator[str]:
    """The text in stretches that end before a space."""
    at = 0
    while len(text) - at > _STRETCH:
        to = text.find(" ", at + _STRETCH)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


class WordTokenizer:
    """The tokenizers library's ids, its merges asked once per distinct piece.

    The vocabulary file cuts a normalised text into pieces (words, digits, runs of marks) and merges within a
    piece only. Texts of Latin letters are cut here by the same pattern, and a piece that is not in the table goes to
    the library's merge model alone. Any other text, and every text of a file that normalises or cuts otherwise, is
    encoded by the library as a whole.
    """

    def __init__(self, file: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        self.by_piece = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.table = _Table(self._piece)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = self.to_bytes(piece)[0][0]  # the file's letters for bytes
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        plain = [self.by_piece and not _OTHER.search(t) for t in batch]
        others = [t for t, p in zip(batch, plain) if not p]
        encoded = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False)) if others else iter(())
        return [self._pieces(t) if p else np.array(next(encoded).ids, "<u4") for t, p in zip(batch, plain)]

    def _pieces(self, text: str) -> np.ndarray:
        ids = [b"".join(map(self.table.__getitem__, _PIECE.findall(part.lower()))) for part in _stretches(text)]
        return np.frombuffer(b"".join(ids), "<u4")


@lru_cache(maxsize=1)
def _tokenizer(file: str) -> WordTokenizer:
    return WordTokenizer(file)


# -- Spark ------------------------------------------------------------------
def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                      block: int = BLOCK) -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending doc_id order into ``folder``.

    Documents are range-partitioned by doc_id (NULL ids first; rows of one id
    ordered by text), one file per partition. Returns the manifest, one row per
    file in order: shard, path, n_docs, n_ids, base (ids of all files before it).
    """
    spark = prepare(docs.sparkSession)
    file = tokenizer or default_tokenizer()
    src = texts(docs, "doc_id").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = _tokenizer(file)
        ctx = TaskContext.get()
        out, path = None, f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.ids"
        end = np.array([end_id], "<u4")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                if out is None:
                    fs, p = open_fs(path)
                    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                    out = Writer(fs.open_output_stream(p, compression=None), bits_for(max(t.vocabulary, end_id + 1)), block)
                for doc, ids in zip(part.column(0).to_pylist(), t.encode_batch(part.column(1).to_pylist())):
                    out.add(doc, np.concatenate([ids, end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [ctx.partitionId()], "path": [path],
                                              "n_docs": [len(out.docs)], "n_ids": [out.n_ids]})

    listed = stored(src.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint"), "token-manifest")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return listed.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files.

    Files are read in pieces of a few documents, a range of blocks each.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as source:
                    r = Reader(source)
                    k = 0
                    while k < len(r.docs):
                        # documents that begin within the next 16 blocks, or one long document
                        to = max(k + 1, int(np.searchsorted(r.starts, r.starts[k] + 16 * r.block, "right")) - 1)
                        to = min(to, len(r.docs))
                        flat, at = r.ids(int(r.starts[k]), int(r.starts[to])), r.starts[k]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(r.docs[k:to], pa.int64()), pa.array(r.starts[k:to] + base, pa.int64()),
                            pa.array(np.diff(r.starts[k:to + 1]), pa.int64()),
                            pa.array([zlib.crc32(flat[s - at:e - at].tobytes()) for s, e in
                                      zip(r.starts[k:to], r.starts[k + 1:to + 1])], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        k = to

    spark = manifest.sparkSession
    return (manifest.repartitionByRange(partitions(spark), "shard").select("path", "base")
            .mapInArrow(run, schema))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the files of ``docs`` to the shared folder, read them back: one row per document."""
    return read_token_files(write_token_files(docs, shared_folder(spark, "token-files")))
