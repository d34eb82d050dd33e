"""Chunk boundaries by definition, shift resistance, and removal against a plain loop."""

from __future__ import annotations

import random

from conftest import SF001
from llm.conftest import ODD_TEXTS
from mktpulse.llm import cdc_dedup as cd


def test_gear_hash_by_definition():
    rnd = random.Random(0)
    for n in (0, 1, 5, 31, 32, 33, 200):
        data = bytes(rnd.randrange(256) for _ in range(n))
        h, want = 0, []
        for c in data:
            h = ((h << 1) + int(cd.GEAR[c])) & 0xFFFF
            want.append(h)
        import numpy as np

        assert cd.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == want


def test_chunks_cover_the_text_in_whole_characters():
    rnd = random.Random(1)
    for t in [x or "" for x in ODD_TEXTS] + ["é日😀" * 400, "".join(rnd.choice("ab é日") for _ in range(3000))]:
        parts = cd.chunks(t)
        assert b"".join(parts).decode() == t
        assert all(p.decode() for p in parts)
        assert all(len(p) <= cd.MAX_CHUNK + 3 for p in parts) and all(len(p) >= cd.MIN_CHUNK for p in parts[:-1])


def test_chunks_fall_into_step_after_an_insertion():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    moved = "some words in front " + text
    a, b = cd.chunks(text), set(cd.chunks(moved))
    assert sum(len(c) for c in a if c in b) > 0.9 * len(text.encode())


def _brute(pairs, least=cd.MIN_RUN):
    """pairs of different (doc_id, text); removal by a scan in order of doc_id."""
    seen, out = set(), {}
    first = {}
    for d, t in pairs:
        pos = 0
        for c in cd.chunks(t or ""):
            key = (d is not None, d or 0)
            first.setdefault(c, []).append((key, t or "", pos))
            pos += len(c)
    for d, t in pairs:
        pos, marked = 0, []
        for c in cd.chunks(t or ""):
            here = ((d is not None, d or 0), t or "", pos)
            if here != min(first[c], key=lambda x: (x[0], x[2])):
                marked.append((pos, pos + len(c)))
            pos += len(c)
        raw, last, keep = (t or "").encode(), 0, b""
        for s, e in cd.runs(marked, min(least, len(raw))):
            keep, last = keep + raw[last:s], e
        out[d] = (keep + raw[last:]).decode()
    return out


def test_removal(spark, make_docs):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    pairs = [(i, " ".join(word() for _ in range(rnd.randint(0, 80))) + (" " + passage + " " if i % 3 == 0 else "")
              + " ".join(word() for _ in range(rnd.randint(0, 80)))) for i in range(40)]
    pairs += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id " + passage), (200, pairs[1][1])]
    docs = make_docs(pairs).selectExpr("*", "'z' AS digest", "7 AS start")
    got = {r.doc_id: r for r in cd.dedup_substrings(docs).collect()}
    want = _brute(pairs)
    assert {d: r.text or "" for d, r in got.items()} == want
    assert got[200].text == ""
    # a passage of 60 words is caught in all documents but the first, the rest of the text stays
    assert got[None].text == pairs[[p[0] for p in pairs].index(None)][1]
    for i in range(0, 40, 3):
        assert len(got[i].text) < len(pairs[i][1]) - 150
    for i in range(0, 40):
        if i % 3:
            assert got[i].text == pairs[i][1]
    assert got[5].digest == "z" and got[5]._before == len(pairs[5][1])


def test_same_document_twice_is_kept(spark, make_docs):
    t = "one two three four five six " * 10
    got = [r.text for r in cd.dedup_substrings(make_docs([(1, t), (1, t)])).collect()]
    assert len(got) == 2 and got[0] == got[1]


def test_short_copies_are_emptied(spark, make_docs):
    pairs = [(1, "Yes."), (2, "Yes."), (3, "Yes. But"), (4, "ü"), (5, "ü"), (None, "first of all"), (6, "first of all")]
    got = {r.doc_id: r.text for r in cd.dedup_substrings(make_docs(pairs)).collect()}
    assert got == {1: "Yes.", 2: "", 3: "Yes. But", 4: "ü", 5: "", None: "first of all", 6: ""}


def test_table_and_empty(spark, make_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in cd.dedup_substrings(docs).collect()}
    assert got == _brute(pairs)
    assert cd.dedup_substrings(make_docs([])).collect() == []


def test_passages_are_caught_wherever_they_stand():
    """A passage of 50 words between different texts is found in every later text, and for the most part cut out."""
    rnd, shares = random.Random(9), []
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    for _ in range(60):
        passage = " ".join(word() for _ in range(50))
        a, b = (" ".join(word() for _ in range(rnd.randint(0, 60))) + " " + passage + " " + " ".join(word() for _ in range(30))
                for _ in range(2))
        first, pos, marked = set(cd.chunks(a)), 0, []
        for c in cd.chunks(b):
            if c in first:
                marked.append((pos, pos + len(c)))
            pos += len(c)
        shares.append(sum(e - s for s, e in cd.runs(marked)) / len(passage))
    assert min(shares) > 0 and sum(shares) / len(shares) > 0.7
