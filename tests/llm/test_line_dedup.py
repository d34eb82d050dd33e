"""Dropped lines against a plain computation; runs across partitions and batches; bitmaps."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD_TEXTS
from mktpulse.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def _brute(rows, min_docs=10, min_length=1, keep_first=False):
    """(doc_id, text left, lines, dropped) of each row; rows with the same id and text are treated alike."""
    met = defaultdict(list)
    for at, (_, t) in enumerate(rows):
        for k in {_key(x) for x in (t or "").split("\n")}:
            met[k].append(at)
    bad = {k for k, v in met.items() if len(k) >= min_length and len(v) >= min_docs}
    hash_of = {}
    out = []
    if keep_first:
        hash_of = {(d, t): h for d, t, h in rows_hash(rows)}
    order = lambda r: (r[0] is not None, r[0] or 0, hash_of.get((r[0], r[1] or "")))
    first = {k: min((rows[i] for i in met[k]), key=order) for k in bad} if keep_first else {}
    for d, t in rows:
        lines, left, seen = (t or "").split("\n"), [], set()
        for x in lines:
            k = _key(x)
            if k not in bad or (keep_first and k not in seen and order(first[k]) == order((d, t))):
                left.append(x)
            seen.add(k)
        out.append((d, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return out


_HASHES = {}


def rows_hash(rows):
    spark = _HASHES["spark"]
    df = spark.createDataFrame([(d, t or "") for d, t in rows], "doc_id bigint, text string")
    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]


def _check(spark, make_docs, rows, **how):
    _HASHES["spark"] = spark
    got = ld.dedup_lines(make_docs(rows), **how)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_n_lines", "_n_dropped", "_keep"]
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    have = sorted([(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in got.collect()], key=key)
    assert have == sorted(_brute(rows, **how), key=key)


def _made(n, seed, common=6):
    rnd = random.Random(seed)
    pool = ["Line %d of all" % i for i in range(common)] + ["", "  ", "\t"]
    rows = []
    for i in range(n):
        lines = [rnd.choice(pool) if rnd.random() < 0.5 else "own %d %d" % (i // 3, rnd.randint(0, 4)) for _ in range(rnd.randint(0, 9))]
        rows.append((i, "\n".join(rnd.choice([x, " " + x, x.upper() + "\r"]) for x in lines)))
    return rows


ODD = [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "Line 0 of all\nx"), (None, "Line 0 of all\nx"), (5, "Line 1 of all\nL"),
                                                          (5, "other"), (6, "\n\n"), (7, "É\né\nLine 2 of all")]


@pytest.mark.parametrize("how", [{}, {"min_docs": 2}, {"min_docs": 3, "min_length": 8}, {"min_docs": 2, "keep_first": True},
                                 {"min_docs": 1, "keep_first": True}, {"min_docs": 1}])
def test_against_plain(spark, make_docs, how):
    _check(spark, make_docs, _made(120, 3) + ODD, **how)


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("how", [{"min_docs": 4}, {"min_docs": 25}, {"min_docs": 4, "keep_first": True}])
def test_runs_across_batches_and_partitions(spark, make_docs, size, how):
    """A key in every document, others in a few; 8 range partitions, batches down to one row."""
    rows = [(i, "everywhere\n%s\nown %d" % ("in %d" % (i % 9), i)) for i in range(90)] + [(200 + i, "only\nthese") for i in range(25)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        _check(spark, make_docs, rows, **how)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("keep_first", [False, True])
def test_rows_that_repeat(spark, make_docs, keep_first):
    """300 equal rows without id are 300 documents, more than the limit for a hot text."""
    rows = [(None, "a b\nc\na b")] * 300 + [(i, "c\nd %d" % i) for i in range(5)] + [(99, None)] * 12
    _check(spark, make_docs, rows, min_docs=200, keep_first=keep_first)


def test_long_texts_and_empty_table(spark, make_docs):
    long = "\n".join("line %d" % (i % 7000) for i in range(60_000))
    _check(spark, make_docs, [(i, long) for i in range(2)] + [(3, "line 5\nx"), (4, "y" * 2_000_000)], min_docs=3)
    assert ld.dedup_lines(make_docs([])).collect() == []
    assert ld.keep_bitmaps(make_docs([])).collect() == []


def test_bitmaps(spark, make_docs):
    rows = [(i, "%s\nown %d\nfoot" % ("head", i)) for i in range(12)]
    got = ld.keep_bitmaps(make_docs(rows), min_docs=10).collect()
    assert len(got) == 12
    for r in got:
        assert (r.n_lines, r.n_dropped, r.copies) == (3, 2, 1)
        assert ld.unpacked(r.keep, 3).tolist() == [False, True, False]
    for n in (1, 8, 9, 1000):
        gone = np.arange(0, n, 3)
        assert np.flatnonzero(~ld.unpacked(ld.packed(gone, n), n)).tolist() == gone.tolist()


def test_clashing_columns(spark, make_docs):
    docs = make_docs([(i, "same\nown %d" % i) for i in range(11)]).selectExpr(
        "*", "1 AS keep", "2 AS c0", "'x' AS _id", "3 AS k1", "4 AS state", "5 AS `a.b`", "6 AS _n_lines")
    got = ld.dedup_lines(docs).collect()
    assert {(r.text[:3], r.keep, r.c0, r._id, r.k1, r["a.b"], r._n_lines, r._n_dropped) for r in got} == {("own", 1, 2, "x", 3, 5, 2, 1)}
