"""Records, false magics inside payloads, damaged files, and the round trip against a plain loop."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from conftest import SF001
from mktpulse.llm import warc as wa

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType())])


def _brute(pages, least=0):
    first, out = {}, []
    for p, _, h in pages:
        h = (h or "").encode()
        if len(h) >= least and p is not None:
            first[h] = min(p, first.get(h, p))
    for p, _, h in pages:
        h = (h or "").encode()
        to = first.get(h) if len(h) >= least else None
        again = to is not None and p != to
        out.append((p, len(h), wa.payload_digest(h), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _fake(n):
    """A whole record as payload, so its magic and length agree."""
    return wa.record(10_000 + n, "http://fake", b"inner " * n, None, False).decode()


ODD = [(1, None, None), (2, "", ""), (3, "http://a b/\n", "same"), (4, "u", "same"), (9, "u", "same"), (9, "u", "same"),
       (5, "u", "é" * 3000), (6, "u", _fake(3)), (7, "u", _fake(40) + "tail"), (8, "u", "WARC/1.0\r\nContent-Length: 4\r\n\r\nab"),
       (10, "u", "\r\n\r\n" + _fake(1) * 5), (11, "u", "x" * 200_000), (None, "u", "no id"), (None, "u", "same"), (3, "u", "same")]


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("range_bytes", [200, 4096, wa.RANGE])
def test_round_trip_with_false_magics(spark, tmp_path, gz, range_bytes):
    pages = spark.createDataFrame(ODD, PAGES).coalesce(1)
    files = wa.write_warc(pages, f"file://{tmp_path}", gz=gz)
    got = wa.read_warc(files, gz, range_bytes)
    assert _got(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == _brute(ODD)


def test_false_candidates_are_seen_and_rejected(spark, tmp_path):
    pages = spark.createDataFrame(ODD, PAGES)
    files = wa.write_warc(pages, f"file://{tmp_path}", gz=False).collect()
    seen = 0
    for f in files:
        fs, p = wa.open_fs(f.path)
        with fs.open_input_file(p) as source:
            seen += len(wa.Archive(source, False).candidates(0, f.size)[0])
    assert seen > len(ODD)  # records within payloads are candidates, but no chain reaches them


def test_exits_by_following_pointers():
    rnd = random.Random(0)
    for _ in range(200):
        offs = np.array(sorted(rnd.sample(range(100), rnd.randint(0, 30))), np.int64)
        succ = np.array([o + rnd.randint(1, 25) for o in offs], np.int64)
        want, nxt = [], dict(zip(offs.tolist(), succ.tolist()))
        for o in offs.tolist():
            while o < 100 and o in nxt:
                o = nxt[o]
            want.append(o if o >= 100 else -1)
        assert wa.exits(offs, succ, 100).tolist() == want


def test_damaged_file_is_an_error(spark, tmp_path):
    path = tmp_path / "cut.warc"
    data = wa.record(1, "u", b"a" * 50, None, False) + wa.record(2, "u", b"b" * 50, None, False)
    path.write_bytes(data[:-60])
    files = spark.createDataFrame([(str(path), len(data) - 60)], "path string, size bigint")
    with pytest.raises(ValueError, match="breaks off"):
        wa.read_warc(files, gz=False, range_bytes=64)


def test_min_bytes_and_table(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert _got(wa.round_trip(spark, pages)) == _brute(rows)
    odd = spark.createDataFrame(ODD, PAGES).selectExpr("*", "1 AS first", "2 AS n")
    assert _got(wa.round_trip(spark, odd, min_bytes=5)) == _brute(ODD, 5)


def test_empty_table(spark):
    assert wa.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("gz", [True, False])
def test_long_urls(spark, gz):
    """Headers of any length: urls of 100 KB and 3 MB between ordinary pages, magic in payloads."""
    magic = wa.MAGIC.decode() + "WARC-Type: response\r\n"
    rows = [(1, "http://a/" + "x" * 100_000, "one"), (2, "http://b/", "two " + magic), (3, "http://c/?" + "y\x01 " * 1_000_000, "one"),
            (4, None, magic * 50), (5, "http://d/", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = {r.page_id: r for r in wa.round_trip(spark, df, gz=gz).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert (got[3].record_type, got[3].refers_to) == ("revisit", 1) and got[4].payload_bytes == len(magic) * 50
