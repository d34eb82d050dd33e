"""SentencePiece BPE encoding and decoding with a last-token table per prefix.

BPE restricted to a prefix of a text gives the prefix of the encoding, as long
as it ends where a token ends. So every prefix of a segment has exactly one
last token. Scanning left to right, an automaton over the vocabulary reports
the pieces that end at the current position; the one last token is the piece
that can stand behind the last token of the prefix before it, i.e. the two
pieces joined encode to exactly these two pieces. The test for a pair depends
on the pair alone and is kept. The ids are then read off backwards. The work
is linear in the text (a piece has at most 16 characters here), with no merge
queue over long texts.

Pieces carry the space mark only in front, so merges never cross from another
character to a space mark: the text falls into segments that encode
independently (this is derived from the vocabulary, not assumed). Segments
repeat a lot, so each worker keeps a bounded table of encoded segments.

Defined results: NULL and empty texts have no ids and decode to the empty
text; a literal space mark in a text is encoded as a space, as the library
does; characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import list_array, prepare, texts

SPACE = "▁"
#: SentencePiece's piece types (fixed values of its model format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of each generation of a worker's segment table.
MAX_SEGMENTS = 400_000
#: In place of a last token: none (a character outside the vocabulary), and the empty prefix. Ids of the
#: unknown and a control piece, which no merge yields.
UNKNOWN_CHAR, START = 0, 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Encoder and decoder for one BPE model file."""

    def __init__(self, model_file: str, max_segments: int = MAX_SEGMENTS):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(model_file, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != 2 or kinds & {USER_DEFINED, UNUSED} or spec.precompiled_charsmap \
                or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces \
                or not m.trainer_spec.byte_fallback or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback")
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.piece = [p.piece for p in m.pieces]
        self.length = [len(p) for p in self.piece]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id) or " " in "".join(self.id) or len(self.piece) >> 20 \
                or {UNKNOWN_CHAR, START} & set(self.id.values()):
            raise ValueError("a piece holds a space mark behind another character, or its id is out of the fixed range")
        #: what an id contributes to the decoded bytes
        self.out = [b"" if p.type == CONTROL else m.trainer_spec.unk_surface.encode() if p.type == UNKNOWN
                    else bytes([self.byte_of[i]]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode()
                    for i, p in enumerate(m.pieces)]
        in_pieces = {c for p in self.id if len(p) > 1 for c in p}
        #: characters no longer piece holds; cutting around them keeps segments short
        alone = "".join(c for c in "\n\t\r" if c not in in_pieces)
        self.cut = re.compile(f" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else ""))
        self.automaton = self._automaton()
        self.pairs = _Pairs(self)
        self.segments = _Segments(self, max_segments)

    # -- vocabulary -------------------------------------------------------
    def merge(self, s: str) -> list[str]:
        """BPE by its definition: merge the best pair, leftmost first, until none is a piece."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merge(piece) == [piece]:  # others never appear in an encoding
                a.add_word(piece.replace(SPACE, " "), i)
        a.make_automaton()
        return a

    # -- encoding ---------------------------------------------------------
    def segment_ids(self, segment: str) -> bytes:
        """Ids of one segment; a character outside the vocabulary is never part of a merge."""
        n = len(segment)
        last = [UNKNOWN_CHAR] * n  # last token of the prefix that ends with each character
        last.append(START)  # so last[-1] stands for the empty prefix
        fits = self.pairs
        for end, piece in self.automaton.iter(segment):
            if not last[end] and fits[last[end - self.length[piece]] << 20 | piece]:
                last[end] = piece
        ids, i = [], n - 1
        while i >= 0:
            if piece := last[i]:
                ids.append(piece)
                i -= self.length[piece]
            else:
                ids.extend(self.byte_id[b] for b in reversed(segment[i].encode()))
                i -= 1
        ids.reverse()
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit integers. Segments hold spaces where the model has space marks."""
        if not text:
            return b""
        return b"".join(map(self.segments.__getitem__, self.cut.findall(" " + text.replace(SPACE, " "))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    # -- decoding ---------------------------------------------------------
    def decode(self, ids) -> str:
        if not len(ids):
            return ""
        out = self.out
        try:
            text = b"".join([out[i] for i in ids]).decode() if b"" not in map(out.__getitem__, set(ids)) else self._decode_bytes(ids)
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        first = next((i for i in ids if out[i]), ids[0])  # control ids leave nothing behind
        return text[1:] if self.piece[first].startswith(SPACE) else text

    def _decode_bytes(self, ids) -> str:
        """Runs of byte pieces that are not UTF-8: one replacement character for each byte that fits nowhere."""
        text, run = [], bytearray()

        def flush():
            i = 0
            while i < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        text.append(bytes(run[i:i + size]).decode())
                        i += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                flush()
                text.append(self.out[i].decode())
        flush()
        return "".join(text)


class _Pairs(dict):
    """(left id << 20 | right id) -> do the two pieces, joined, encode to exactly these two?"""

    def __init__(self, model: PieceModel, most: int = 1_000_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, pair: int) -> bool:
        left, right = pair >> 20, pair & 0xFFFFF
        if left in (UNKNOWN_CHAR, START):
            ok = True
        else:
            a, b = self.model.piece[left], self.model.piece[right]
            ok = self.model.merge(a + b) == [a, b]
        if len(self) >= self.most:
            self.clear()
        self[pair] = ok
        return ok


class _Segments(dict):
    """Encoded segments in two generations: what is used again outlives the emptying of the table."""

    def __init__(self, model: PieceModel, most: int):
        super().__init__()
        self.model, self.most, self.old = model, most, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            ids = self.model.segment_ids(segment)
        if len(segment) <= 48:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[segment] = ids
        return ids


@lru_cache(maxsize=1)
def _model(model_file: str) -> PieceModel:
    return PieceModel(model_file)


def encode_decode(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` array<int> and ``decoded`` string of every whole text. No shuffle."""
    path = model_file or default_model()
    prepare(docs.sparkSession)
    src = texts(docs, id_col)
    id_type = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):  # small result batches: ids take more room than texts
                part = b.slice(at, 500)
                ids = [np.frombuffer(m.encode_bytes(t), "<i4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(np.concatenate(ids), [len(x) for x in ids], pa.int32()),
                     pa.array([m.decode(x.tolist()) for x in ids], pa.string())], names=[id_col, "ids", "decoded"])

    return src.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    e = encode_decode(docs, model_file)
    return e.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
