"""Losses against a plain model, and held-out direction."""

from __future__ import annotations

import random
from collections import Counter
from math import log

import pytest

from conftest import SF01
from llm.conftest import ODD_TEXTS
from mktpulse.llm import lm_scoring as lm


def _brute(pairs, target):
    def toks(t):
        s = [lm.START] * (lm.ORDER - 1) + [ord(c) for c in t or ""] + [lm.END]
        return [(tuple(s[i:i + lm.ORDER - 1]), s[i + lm.ORDER - 1]) for i in range(len(s) - lm.ORDER + 1)]

    counts = {}
    for model in "tb":
        g, c, s = Counter(), Counter(), Counter()
        for d, t in pairs:
            if model == "b" or d in target:
                for ctx, k in toks(t):
                    g[ctx, k] += 1
                    c[ctx] += 1
                    s[k] += 1
        counts[model] = g, c, s
    v = len(counts["b"][2])

    def loss(model, ctx, k, own_g, own_c):
        g, c, s = counts[model]
        alone = (s[k] + 1) / (sum(s.values()) + v)
        return -log((max(g[ctx, k] - own_g, 0) + lm.PRIOR * alone) / (max(c[ctx] - own_c, 0) + lm.PRIOR))

    out = []
    for d, t in pairs:
        g = toks(t)
        own, own_c = Counter(g), Counter(c for c, _ in g)
        a, b = (sum(loss(m, c, k, *((own[c, k], own_c[c]) if m == "b" or d in target else (0, 0))) for c, k in g) / len(g) for m in "tb")
        out.append((d, len(g), a, b, a - b))
    return out


def _key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2])


def test_losses(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lm, "PART", 9000)
    monkeypatch.setattr(lm, "SLICE", 500)
    rnd = random.Random(0)
    pairs = [(i, "".join(rnd.choice("abc dé") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    pairs += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (5, "again"), (5, "again")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 60, 2)] + [(None, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    target = set(lm.target_ids(labels))
    docs = make_docs(pairs).selectExpr("*", "1 AS part", "2 AS ctx")
    got = sorted((tuple(r) for r in lm.score(docs, labels).collect()), key=_key)
    want = sorted(_brute(pairs, target), key=_key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)


def test_empty_tables(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert lm.score(make_docs([]), labels).collect() == []
    got = lm.score(make_docs([(1, "ab"), (2, None)]), labels).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3]


def test_junk_is_further_from_the_target(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.difference for r in lm.score(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = labels.collect()
    good = sorted(got[r.doc_id] for r in rows if r.quality and not r.toxic)
    junk = sorted(got[r.doc_id] for r in rows if not r.quality)
    assert good[len(good) // 2] < junk[len(junk) // 2]


def test_every_target_document_counts(spark, make_docs, monkeypatch):
    """Neither a bound on ids nor the order of their hashes leaves a labelled document out."""
    monkeypatch.setattr(lm, "PART", 2000)
    monkeypatch.setattr(lm.target_ids, "__defaults__", (3,))
    rnd = random.Random(2)
    pairs = [(i, "".join(rnd.choice("abcd ") for _ in range(40))) for i in range(120)] + [(7, "an id again"), (None, "no id")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(7, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = sorted((tuple(r) for r in lm.score(make_docs(pairs), labels).collect()), key=_key)
    want = sorted(_brute(pairs, {*range(0, 120, 2), 7}), key=_key)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)
