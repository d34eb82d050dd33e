"""Spans against a plain split, the whole operator against a plain computation."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import pytest

from llm.conftest import ODD_TEXTS
from mktpulse.llm import ngram_resample as nr

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def _grams(text, least, most, buckets):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def _brute(rows, target, least=1, most=1, buckets=nr.BUCKETS, min_words=nr.MIN_WORDS, percent=nr.PERCENT, seed=nr.SEED):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(_grams(x, least, most, buckets))
    for x in target:
        t.update(_grams(x, least, most, buckets))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for d, x in rows:
        g = _grams(x, least, most, buckets)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(_words(x)), len(g), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None])
    drawn = [r for r in out if r[1] >= min_words]
    drawn.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for i, r in enumerate(drawn[:percent * len(drawn) // 100]):
        r[5] = i + 1
    return out


def _key(r):
    return [(x is None, x or 0) for x in r]


def _check(spark, make_docs, rows, target, **how):
    got = nr.resample(make_docs(rows), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), **how)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(list, got.collect()), key=_key) == sorted(_brute(rows, target, **how), key=_key)


@pytest.mark.parametrize("text", [t or "" for t in ODD_TEXTS] + ["É Straße ÀB 9z_a-b", "a  b\x7fc `d` {e}", "\x85 x", "x"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_spans(text, n):
    got = [m.group().decode() for m in nr.span_pattern(n).finditer(nr.normalised(text.encode()), overlapped=True)]
    w = _words(text)
    assert got == [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("how", [{}, {"least": 1, "most": 3, "buckets": 97, "percent": 50, "min_words": 2},
                                 {"least": 2, "most": 2, "buckets": 100_003, "percent": 100, "seed": "x"}])
def test_whole_operator(spark, make_docs, how):
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(50)] + ["É", "straße", "Ab-c"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 5, 19, 20, 21, 60])))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id " * 30)] * 2 + [(7, "same id " * 12)] * 3 + [(9, "w1 " * 25)]
    _check(spark, make_docs, rows, ["w1 w2 w3 É", None, "", "w1 w2 Straße", "only here"], **how)


def test_no_target_and_no_documents(spark, make_docs):
    _check(spark, make_docs, [(i, "some words " * (i + 5)) for i in range(20)], [])
    _check(spark, make_docs, [], ["a b"])


def test_copies_of_one_row_rank_apart(spark, make_docs):
    rows = [(1, "a b c d " * 6)] * 300 + [(i, "e f g h " * 6) for i in range(2, 30)]
    _check(spark, make_docs, rows, ["a b c d"], percent=100)


def test_clashing_columns(spark, make_docs):
    docs = make_docs([(1, "a " * 30), (2, "b " * 30)]).selectExpr("*", "1 AS n_words", "'x' AS rank", "true AS _in", "2 AS position", "3 AS buckets")
    assert nr.resample(docs, docs, percent=50).where("rank = 1").count() == 1


def test_bad_parameters(make_docs):
    with pytest.raises(ValueError):
        nr.resample(make_docs([]), make_docs([]), least=2, most=1)
