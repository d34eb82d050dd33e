"""Bit packing round trips, random access, and the files against the library's own encoding."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF001
from llm.conftest import ODD_TEXTS
from mktpulse.llm import token_files as tf


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 2 ** bits, n, dtype=np.uint64).astype("<u4")
        data = tf.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (tf.unpack(data, n, bits) == ids).all()


def test_bits_for():
    assert [tf.bits_for(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype("<u4") for n in (0, 3, 700, 1, 0, 64, 129)]
    sink = pa.BufferOutputStream()
    class Keep:
        write = staticmethod(sink.write)
        close = staticmethod(lambda: None)
    w = tf.Writer(Keep, tf.bits_for(5000), block=64)
    for i, d in enumerate(docs):
        w.add(i if i else None, d)
    w.close()
    r = tf.Reader(pa.BufferReader(sink.getvalue()))
    assert r.bits == 13 and r.docs == [None, 1, 2, 3, 4, 5, 6]
    flat = np.concatenate(docs)
    for a, b in ((0, len(flat)), (63, 65), (64, 128), (5, 5), (700, 897)):
        assert (r.ids(a, b) == flat[a:b]).all()
    assert all((r.document(k) == d).all() for k, d in enumerate(docs))
    with pytest.raises(ValueError):
        w.add(9, np.array([1 << 13], "<u4"))
    with pytest.raises(ValueError):
        tf.Reader(pa.BufferReader(b"x" * 100))


def _brute(pairs):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tf.default_tokenizer()), 0, []
    for d, text in sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_files_match_the_library(spark, make_docs):
    pairs = [(i * 5 % 37, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    assert _got(tf.token_files(spark, make_docs(pairs))) == _brute(pairs)


def test_files_of_the_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert _got(tf.token_files(spark, docs)) == _brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark, make_docs):
    assert tf.token_files(spark, make_docs([])).collect() == []


def test_pieces_equal_the_library():
    """Random strings of Latin letters, marks, numbers, white space, apostrophes and what only the library may read."""
    import random

    from tokenizers import Tokenizer

    file = tf.default_tokenizer()
    lib, mine = Tokenizer.from_file(file), tf.WordTokenizer(file)
    assert mine.by_piece
    rnd = random.Random(3)
    pieces = ["'", "'s", "'LL", "'re", "don't", "Straße", "É", "ǅ", "ÿ", "÷", "×", "²", "½", "9", "007", "ª", "µ", "º", " ", "  ", "\t", "\n", "\r\n",
              "\x0c", "\x0b", "\x85", "\xa0", "\xad", "\x00", "\x1d", "\x7f", "İ", "é", "Σ", "ς", "日本", "<|endoftext|>", "<|", "...", "!?'", "a'b'c",
              "ɏ", "ɐ", "​", "😀", "word", "Word", "WORD", "¿", "«", "_", "-", "x" * 60]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(4000)]
    texts += ["".join(chr(rnd.randrange(rnd.choice([0x80, 0x180, 0x250]))) for _ in range(30)) for _ in range(2000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = mine.encode_batch(texts)
    assert [g.tolist() for g in got] == want
    assert sum(not tf._OTHER.search(t) for t in texts) > 1000


def test_a_long_text_and_a_small_table(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tf, "_STRETCH", 50)
    monkeypatch.setattr(tf, "MAX_WORDS", 20)
    file = tf.default_tokenizer()
    text = " ".join("Word%d's end." % (i % 70) for i in range(3000)) + "y" * 500
    mine = tf.WordTokenizer(file)
    assert mine.encode_batch([text])[0].tolist() == Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids
    assert len(mine.table) <= 20 and len(mine.table.old) <= 20
