"""Encoding and decoding against the library, text by text and id sequence by id sequence."""

from __future__ import annotations

import hashlib
import random

import pytest

from conftest import SF001
from llm.conftest import ODD_TEXTS
from mktpulse.llm import sentencepiece_bpe as sb


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return sb.PieceModel(sb.default_model(), max_segments=200), sentencepiece.SentencePieceProcessor(model_file=sb.default_model())


def test_encode_as_the_library(both):
    mine, lib = both
    rnd = random.Random(1)
    many = [t or "" for t in ODD_TEXTS] + ["".join(rnd.choice("abc  the\n▁é日😀.,!0<>") for _ in range(rnd.randint(0, 60)))
                                          for _ in range(2000)]
    for t in many:
        assert mine.encode(t) == lib.encode(t), t


def test_decode_as_the_library(both):
    mine, lib = both
    rnd = random.Random(2)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(3, 258), rnd.randint(259, 31999)])
               for _ in range(rnd.randint(0, 6))]
        assert mine.decode(ids) == lib.decode(ids), ids


def _brute(lib, pairs):
    out = []
    for d, t in pairs:
        ids = lib.encode(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests(spark, make_docs, both):
    pairs = list(enumerate(ODD_TEXTS)) + [(None, "no id"), (1, "again")]
    assert sorted((tuple(r) for r in sb.token_digests(make_docs(pairs)).collect()), key=str) == _brute(both[1], pairs)
    assert sb.token_digests(make_docs([])).collect() == []


def test_digests_of_the_table(spark, both):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted((tuple(r) for r in sb.token_digests(docs).collect()), key=str)
    assert got == _brute(both[1], [(r.doc_id, r.text) for r in docs.collect()])
