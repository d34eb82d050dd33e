"""Targets against a plain loop, the schedule against its definition, the mixture against both."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import ceil

import pytest

from conftest import SF001
from llm.conftest import DOCS, ODD_TEXTS
from mktpulse.llm import mixing as mx


def _sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """sizes: source -> words. Shares by weight, what is above the limit shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    t = {s: 0.0 for s in names}
    free, left = set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= most * sizes[s]]
        if not over:
            t.update({s: left * w[s] / total for s in free})
            break
        for s in over:
            t[s] = float(most * sizes[s])
        left -= sum(t[s] for s in over)
        free -= set(over)
    return t


def _check(spark, rows, docs, block):
    got = [r.asDict() for r in mx.Mixture(docs, block=block).taken().collect()]
    again = [r.asDict() for r in mx.Mixture(docs.repartition(3), block=block).taken().collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(again, key=key)
    size_of = defaultdict(int)
    for _, t, s in rows:
        size_of[s] += _sizes(t)
    want = _targets(size_of)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter(
        (d, _sizes(t), size_of[s]) for d, t, s in rows)
    by_source = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert {round(r["target"], 6) for r in got} == {round(want[s], 6) for _, _, s in rows}
    for (size, target), taken in by_source.items():
        alike = sum(size_of[x] == size and round(v, 6) == target for x, v in want.items())  # sources of one size and target
        assert abs(taken - alike * target) <= 6 * block * alike, (size, target, taken)


def test_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    _check(spark, [(r.doc_id, r.text, r.source) for r in docs.collect()], docs, 16)


def test_odd_rows(spark):
    rows = [(i, t, (None, "a", "b", "")[i % 4]) for i, t in enumerate(ODD_TEXTS)] + [
        (50, "twice here", "a"), (50, "twice here", "a"), (51, None, "a"), (51, None, "a"), (None, "no id", "b"),
        (60, None, "empty source")]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS).selectExpr("*", "1 AS size", "2 AS slot")
    _check(spark, rows, docs.drop("size", "slot"), 1)
    assert mx.Mixture(docs, block=1).taken().count() == len(rows)


def test_empty_tables(spark, make_docs):
    assert mx.Mixture(make_docs([])).taken().collect() == []
    assert [tuple(r)[1:] for r in mx.Mixture(make_docs([(1, None)])).taken().collect()] == [(0, 0, 0.0, 0)]


def test_schedule_by_definition(spark):
    sources = spark.createDataFrame([("a", 1000, 1500.0), ("b", 70, 140.0), (None, 333, 100.0), ("z", 0, 0.0)],
                                    "_source string, source_size bigint, target double")
    got = sorted(mx.schedule(sources, block=10).collect())
    order, total = [("a", 1500.0, 100), ("b", 140.0, 7), (None, 100.0, 34)], 1740.0
    seen, want = Counter(), []
    for i in range(ceil(total / 10)):
        u, acc = (i + 0.5) * mx.GOLDEN % 1.0, 0.0
        for s, t, blocks in order:
            acc += t / total
            if u < acc:
                break
        r = seen[s]
        seen[s] += 1
        if r // blocks < 2:
            want.append((i, s, r, r % blocks, r // blocks))
    assert [tuple(r) for r in got] == want


def test_many_sources(spark):
    """3,000 sources of a few words each beside one of a third of all words; a word per block."""
    rows = [(i, "w " * (i % 5), f"site{i // 2:05d}") for i in range(6000)] + [(9000 + i, "big " * 60, "all") for i in range(100)]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)
    _check(spark, rows, docs, 1)


def test_targets_with_many_limits(spark):
    """Sources of sizes over nine orders of magnitude: the rate found at once equals the rounds of resharing."""
    sizes = {f"s{i:03d}": int(1.2 ** i) for i in range(100)}
    df = spark.createDataFrame(list(sizes.items()), "_source string, source_size bigint")
    for share in (0.0, 0.2, 1.5, 1.999, 3.0):
        got = {r._source: r.target for r in mx.targets(mx.source_weights(df), share).collect()}
        want = _targets(sizes, share)
        assert got == pytest.approx(want, rel=1e-12)


def test_running_totals(spark):
    from mktpulse.llm.common import running

    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "id * 2 AS v", "cast(id AS decimal(10,2)) / 4 AS w").repartition(5)
    got = sorted((r._place, r.id, r.v_before, float(r.w_before)) for r in running(df, ["g", "id"], ["v", "w"]).collect())
    order = sorted(range(1000), key=lambda i: (i % 7, i))
    assert got == [(k + 1, i, 2 * sum(order[:k]), sum(order[:k]) / 4) for k, i in enumerate(order)]


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mx.Mixture(docs, block=32).taken().collect()}
    out = mx.mixed_documents(docs, block=32)
    assert out.schema.names == docs.schema.names
    words = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    cut = 0
    for r in out.collect():
        words[r.doc_id] += _sizes(r.text)
        assert r.n_chars == len(r.text)
        cut += r.text != texts[r.doc_id]
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert cut <= 40  # one document at the end of each source's epoch


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), ("a b c", 2), ("\x0b\x0cq\t", 1), ("x\x1cy", 1)])
def test_words(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(mx.words(df["text"])).first()[0] == n
