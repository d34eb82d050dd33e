"""Weights against a plain computation, exact top-k, and held-out accuracy."""

from __future__ import annotations

import random
from collections import Counter
from math import log

import pytest

from conftest import SF01
from llm.conftest import ODD_TEXTS
from mktpulse.llm import importance as im


def _brute(pairs, target):
    count = lambda t: Counter(dict(zip(*(x.tolist() for x in im.features(t or "")))))
    raw, good = Counter(), Counter()
    for d, t in pairs:
        raw += count(t)
        if d in target:
            good += count(t)
    rate = sum(good.values()) / sum(raw.values())
    out = []
    for d, t in pairs:
        s = 0.0
        for f, n in count(t).items():
            g = good[f] - (n if d in target else 0)
            w = log((max(g, 0) + im.PRIOR * rate) / (raw[f] - n + im.PRIOR) / rate)
            s += n * w if w < im.CUT else 0.0
        out.append((d, s))
    return out


def _made(n=600, seed=0):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(20, 80))]
        kind = rnd.random()
        if kind < 0.15:
            text = [w.upper() + "!!" for w in text]
        elif kind < 0.3:
            text[::7] = ["idiotic"] * len(text[::7])
        rows.append((i, " ".join(text)))
        if i % 2:
            labels.append((i, int(kind >= 0.15), int(0.15 <= kind < 0.3)))
    bad = {i for i, t in rows if "!!" in t or "idiotic" in t}
    return rows, labels, bad


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_weights(spark, make_docs):
    rows, labels, _ = _made(200)
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id")]
    labels += [(3, 0, 0), (None, 1, 0), (5, None, None), (99_999, 1, 0)]
    docs, lab = make_docs(rows).selectExpr("*", "1 AS key", "true AS kept"), _labels(spark, labels)
    target = set(im.target_ids(lab))
    assert target == {d for d, _, _ in labels if d is not None
                      and all(q == 1 and t == 0 for e, q, t in labels if e == d)}
    got = {(r.doc_id, i): r.log_weight for i, r in enumerate(sorted(im.resample(docs, lab).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}
    want = sorted(_brute(rows, target), key=lambda r: (r[0] is None, r[0] or 0))
    for (d, _), (e, s) in zip(got, want):
        assert d == e
    assert list(got.values()) == pytest.approx([s for _, s in want], rel=1e-4, abs=1e-4)


def test_held_out_documents(spark, make_docs):
    rows, labels, bad = _made(1200)
    labelled = {d for d, _, _ in labels}
    kept = {r.doc_id for r in im.keep_good(make_docs(rows), _labels(spark, labels)).collect()}
    held = [d for d, _ in rows if d not in labelled]
    assert sum(d in kept for d in held if d not in bad) >= 0.97 * sum(d not in bad for d in held)
    assert sum(d in kept for d in held if d in bad) <= 0.03 * sum(d in bad for d in held)


def test_labelled_rows_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in im.resample(docs, labels).collect()}
    assert len(got) == docs.count()
    rows = labels.collect()
    good = [got[r.doc_id] for r in rows if r.quality and not r.toxic]
    assert sum(good) >= 0.97 * len(good)


def test_kth_largest_is_exact(spark):
    rnd = random.Random(1)
    v = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e9), 0.0, -1.5, 1e-300]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "key double")
    for k in (1, 2, 250, 499, 500):
        assert im.kth_largest(df, k) == sorted(v, reverse=True)[k - 1]
    assert im.kth_largest(df, 501) is None


def test_top_k_and_no_labels(spark, make_docs):
    rows, labels, _ = _made(100)
    got = im.resample(make_docs(rows), _labels(spark, labels), k=40).collect()
    top = sorted((r.key for r in got), reverse=True)[:40]
    assert sorted((r.key for r in got if r.kept), reverse=True) == top
    assert all(r.kept for r in im.resample(make_docs(rows), _labels(spark, [])).collect())
    assert im.resample(make_docs([]), _labels(spark, labels)).collect() == []


def test_few_targets_do_not_make_copies_bad(spark, make_docs):
    """At a low sampling rate the words of a clean document with copies are no evidence of badness; junk still is."""
    rnd = random.Random(4)
    vocab = ["w%d" % i for i in range(200)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(15)) + (" idiotic" * 3 if i % 5 == 0 else "")) for i in range(3000)]
    groups = [(3000 + i, " ".join(f"own{i % 20}x{k}" for k in range(15))) for i in range(20 * 150)]
    labels = _labels(spark, [(d, int("idiotic" not in t), 0) for d, t in rows + groups])
    docs, target = make_docs(rows + groups), im.target_ids(labels, 60)
    model = im.fit(docs, target)
    hit = {(d - 3000) % 20 for d in target if d >= 3000}
    assert len(target) == 60 and len(hit) < 20 and model.rate < 0.02
    got = {r.doc_id: r.log_weight for r in im.score(docs, model, target).collect()}
    assert all(got[d] == 0 for d, _ in groups)
    assert all((got[d] < 0) == ("idiotic" in t) for d, t in rows)
