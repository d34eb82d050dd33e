"""Audits and digests against exhaustive search with whole strings."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache
from itertools import pairwise

import pytest

from mktpulse.llm import conversation_repair as cr
from mktpulse.llm.queries import op13_conversation_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _damage(rows):
    out = []
    for c, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _repair(rows):
    """The contract by search over whole audits: (gaps, ..., audit, sha256, repaired rows) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def follows(so_far, x):  # whether so_far + x can still become (s?(ua)+)?
        return (x == "s" and so_far == "") or (x == "u" and so_far in ("", "s", "a")) or (x == "a" and so_far == "u")

    @cache
    def best(i, last, inserted):
        """Least (cost, audit) from row i on, where the repaired rows end in ``last``."""
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            ways += [(5 + c, "I" + a) for x in "ua" if follows(last, x) for c, a in [best(i, x, inserted + 1)]]
        if i < len(rows):
            c, a = best(i + 1, last, 0)
            ways.append((2 + c, "D" + a))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                if rows[i][1][:1] and follows(last, rows[i][1][0]):
                    c, a = best(i + 1, rows[i][1][0], 0)
                    ways.append((c + more, "K" + a))
                ways += [(1 + more + c, "R" + a) for x in "ua" if follows(last, x) for c, a in [best(i + 1, x, 0)]]
        return min(ways, default=(10 ** 9, ""))

    for i in range(len(rows), -1, -1):  # from the end, so that the search does not go deep
        for last in ("", "s", "u", "a"):
            best(i, last, 0)
    cost, audit = best(0, "", 0)
    done, i, last = [], 0, ""
    for e in audit:
        if e == "I":
            role, text, turn = ("assistant" if last == "u" else "user"), "", None
        else:
            turn, role, text = rows[i]
            i += 1
            if e == "D":
                continue
            if e == "R":
                role = "assistant" if last == "u" else "user"
        last = role[0]
        done.append((turn, role, text, e))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in done).encode()).hexdigest()
    return (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, sha), done


def _by_conv(rows, every):
    groups = {c: [] for c, *_ in every}
    for c, *row in rows:
        groups[c].append(tuple(row))
    return groups


def _made(n, seed, longest=9):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Ends. \t\n", None, "É.", "half\x0b", "."]
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            normal = rnd.random() < 0.6
            rows.append((c, rnd.choice([t, t, t, t, t + 2, None]),
                         ("user", "assistant")[t % 2] if normal else rnd.choice(roles),
                         f"Turn {t}." if normal else rnd.choice(texts)))
    return rows


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_undamaged(spark, seed):
    rows = _made(250, seed) + [(None, 1, "user", "a."), (None, None, "assistant", "b"), (2 ** 60 + 1, 2 ** 60 + 1, "user", "x."), (2 ** 60 + 2, 1, "user", "y.")]
    spaced = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert _got(cr.repair(_table(spark, rows))) == {c: _repair(g)[0] for c, g in _by_conv(spaced, rows).items()}


def test_damaged(spark):
    rows = _made(400, 9) + [(None, None, None, None), (None, 3, "user", "x.")]
    got = cr.repaired(cr.judged(cr.damaged(_table(spark, rows))))
    assert _got(got) == {c: _repair(g)[0] for c, g in _by_conv(_damage(rows), rows).items()}
    assert any(r.audit == "" and r.cost == 0 for r in got.collect())


def test_the_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(op13_conversation_repair(spark, sf)) == {c: _repair(g)[0] for c, g in _by_conv(_damage(rows), rows).items()}


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_a_giant_conversation_spills_and_crosses_batches(spark, limit):
    rnd = random.Random(limit)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["A.", f"B{t}!", "c", "D?", ""])) for t in range(400)]
    rows += [(c, t, "user", "x.") for c in (0, 2) for t in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = _got(cr.repair(_table(spark, rows), limit))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: _repair(g)[0] for c, g in _by_conv(rows, rows).items()}


def test_repaired_rows(spark):
    rows = _made(150, 4) + [(None, 1, "assistant", "a.")]
    table = cr.damaged(_table(spark, rows))
    audits = cr.repaired(cr.judged(table)).select("conv_id", "audit")
    got = defaultdict(list)
    for r in sorted(cr.repaired_rows(table, audits).collect(), key=lambda r: r.place):
        got[r.conv_id].append((r.turn, r.role, r.text, r.edit))
    want = {c: _repair(g)[1] for c, g in _by_conv(_damage(rows), rows).items()}
    assert dict(got) == {c: w for c, w in want.items() if w}


def test_empty_table_long_text_and_clashing_columns(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 200_000), (1, 2, "assistant", "y!")]
    table = _table(spark, rows).selectExpr("*", "1 AS gone", "2 AS fault", "'z' AS _nth", "3 AS _copy", "4 AS no_turn")
    assert _got(cr.repair(table)) == {1: _repair([r[1:] for r in rows])[0]}
    assert cr.repaired(cr.judged(cr.damaged(table))).count() == 1
