"""Multi-touch attribution: the scan against a brute-force pair join.

The brute force is the reference's definition, spelled out in pandas: join
every order with every touch of the same user at or before it, then last /
first click by (event_ts, source, campaign), linear 1/n shares, and decay
weights exp(-k * minutes) normalised per order (relative to the latest touch,
D9). The scan must agree on hand-made edge cases, random histories and a hot
user spread over many range partitions.
"""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest

from conftest import SF01, rows, ts
from mktpulse.operators import attribution as A

WEB = "user_id string, event_ts timestamp, source string, campaign string"
ORD = "order_id string, user_id string, order_ts timestamp, revenue decimal(18,2)"
K = 0.00048


def _key(v):
    return (0,) if v is None else (1, v)


def brute(touches: list[tuple], orders: list[tuple], k: float = K, lookback: dt.timedelta | None = None) -> dict:
    out: dict = {}

    def acc(pair, field, v):
        rec = out.setdefault(pair, {"orders": set(), "revenue_last_click": 0.0, "revenue_first_click": 0.0,
                                    "revenue_linear": 0.0, "revenue_time_decay": 0.0})
        if field == "orders":
            rec["orders"].add(v)
        else:
            rec[field] += v

    by_user: dict = {}
    for t in touches:
        if t[0] is not None and t[1] is not None:
            by_user.setdefault(t[0], []).append(t)
    for oid, user, ots, rev in orders:
        if user is None or ots is None:
            continue
        cand = [t for t in by_user.get(user, []) if t[1] <= ots and (lookback is None or t[1] >= ots - lookback)]
        if not cand:
            continue
        r = float(rev)
        tkey = lambda t: (t[1], _key(t[2]), _key(t[3]))
        last = max(cand, key=tkey)
        first = min(cand, key=tkey)
        acc((last[2], last[3]), "orders", oid)
        acc((last[2], last[3]), "revenue_last_click", r)
        acc((first[2], first[3]), "revenue_first_click", r)
        osec = math.floor(ots.timestamp())
        mins = [(osec - math.floor(t[1].timestamp())) / 60.0 for t in cand]
        m0 = min(mins)
        w = [math.exp(-k * (m - m0)) for m in mins]
        sw = sum(w)
        for t, wi in zip(cand, w):
            acc((t[2], t[3]), "revenue_linear", r / len(cand))
            acc((t[2], t[3]), "revenue_time_decay", r * wi / sw)
        for t in cand:  # every touched pair exists, even with zero credit
            acc((t[2], t[3]), "revenue_linear", 0.0)
    for rec in out.values():
        rec["orders"] = len(rec["orders"])
    return out


def run_scan(spark, touches, orders, segment_seconds=3600, hot=20, **kw):
    """By default users with more than a twentieth of the rows go the heavy way, all others the light one."""
    w = spark.createDataFrame(touches, WEB)
    o = spark.createDataFrame(orders, ORD)
    got = rows(A.attribution_models(w, o, segment_seconds=segment_seconds, hot=hot, **kw))
    return {(r["channel"], r["campaign"]): r for r in got}


def assert_same(got: dict, exp: dict, tol=1e-6):
    assert set(got) == set(exp), (set(got) ^ set(exp))
    for pair, e in exp.items():
        g = got[pair]
        assert g["orders"] == e["orders"], pair
        for f in ("revenue_last_click", "revenue_first_click", "revenue_linear", "revenue_time_decay"):
            assert abs(g[f] - e[f]) <= tol * max(1.0, abs(e[f])), (pair, f, g[f], e[f])


def test_edge_cases(spark):
    touches = [
        ("u1", ts("2024-01-01 10:00:00"), "Meta", "A"),
        ("u1", ts("2024-01-01 10:00:00"), "Google", "B"),   # tie with the touch above (D7)
        ("u1", ts("2024-01-01 12:00:00"), "Email", "C"),    # after the order: not in its path
        ("u2", ts("2020-01-01 00:00:00"), "Meta", "A"),     # four years old only (D9)
        ("u2", ts("2020-01-02 00:00:00"), "Google", "A"),
        ("u4", ts("2024-01-05 00:00:00"), "Meta", "Z"),     # touch but never an order
        (None, ts("2024-01-01 00:00:00"), "Meta", "A"),     # NULL user never joins
        ("u5", ts("2024-01-01 00:00:00"), None, "N"),       # NULL channel is a pair of its own
    ]
    orders = [
        ("o1", "u1", ts("2024-01-01 11:00:00"), Decimal("100.00")),
        ("o2", "u2", ts("2024-01-03 00:00:00"), Decimal("40.00")),
        ("o3", "u3", ts("2024-01-03 00:00:00"), Decimal("7.00")),   # no touch at all: dropped
        ("o4", "u1", ts("2024-01-01 10:00:00"), Decimal("10.00")),  # touch at the same instant counts
        ("o5", "u5", ts("2024-01-02 00:00:00"), Decimal("0.00")),   # zero revenue still makes a pair
    ]
    got = run_scan(spark, touches, orders)
    exp = brute(touches, orders)
    assert_same(got, exp)
    assert ("Meta", "Z") not in got
    # the tie goes to the larger (source, campaign) for last click, the smaller for first
    assert got[("Meta", "A")]["orders"] == 2 and got[("Google", "B")]["revenue_first_click"] == 110.0


def test_require_last_click(spark):
    touches = [("u1", ts("2024-01-01 10:00:00"), "Meta", "A"), ("u1", ts("2024-01-01 11:00:00"), "Google", "B")]
    orders = [("o1", "u1", ts("2024-01-01 12:00:00"), Decimal("10.00"))]
    assert set(run_scan(spark, touches, orders)) == {("Meta", "A"), ("Google", "B")}
    assert set(run_scan(spark, touches, orders, require_last_click=True)) == {("Google", "B")}


def _random_history(seed: int, users: int, touches_per_user: int, orders_per_user: int, days: int = 40):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    srcs, camps = ["Meta", "Google", "Email", None], ["A", "B", "C"]
    touches, orders = [], []
    for u in range(users):
        uid = f"u{u}"
        nt = int(rng.integers(0, touches_per_user + 1))
        for _ in range(nt):
            sec = int(rng.integers(0, days * 86400))
            micro = int(rng.integers(0, 3)) * 250000
            touches.append((uid, base + dt.timedelta(seconds=sec, microseconds=micro),
                            srcs[int(rng.integers(0, 4))], camps[int(rng.integers(0, 3))]))
        for j in range(int(rng.integers(0, orders_per_user + 1))):
            sec = int(rng.integers(0, days * 86400))
            cents = int(rng.integers(-500, 50000))
            orders.append((f"o{u}-{j}", uid, base + dt.timedelta(seconds=sec), Decimal(cents) / 100))
    # a few exact ties between touches and orders
    for i in range(0, len(orders), 7):
        oid, uid, ots, rev = orders[i]
        touches.append((uid, ots, "Meta", "A"))
    return touches, orders


@pytest.mark.parametrize("seed,segment,hot", [(1, 3600, 1000), (2, 60, 25), (3, 86_400, 0), (4, 400 * 86_400, 1000), (5, 3600, 0)])
def test_random_histories(spark, seed, segment, hot):
    touches, orders = _random_history(seed, users=25, touches_per_user=30, orders_per_user=6)
    assert_same(run_scan(spark, touches, orders, segment, hot), brute(touches, orders))


def test_no_result_change_by_the_split(spark):
    """Whoever is heavy, the numbers are the same."""
    touches, orders = _random_history(51, users=20, touches_per_user=25, orders_per_user=5, days=900)
    want = run_scan(spark, touches, orders, hot=0)
    for hot in (12, 20, 1000):
        assert_same(run_scan(spark, touches, orders, hot=hot), want, 1e-9)


def test_touches_of_users_without_orders_are_left_out_early(spark):
    """2 % of the users order: about 2 % of the touches pass the filter, and none of a buyer's is lost."""
    base = dt.datetime(2024, 1, 1)
    touches = [(f"u{u}", base + dt.timedelta(hours=h), "Meta", "A") for u in range(2000) for h in range(10)]
    orders = [(f"o{u}", f"u{u}", base + dt.timedelta(days=1), Decimal("1.00")) for u in range(0, 2000, 50)]
    w, o = spark.createDataFrame(touches, WEB), spark.createDataFrame(orders, ORD)
    left = A.of_buyers(w, o)
    assert left.columns == w.columns
    passed = [r.user_id for r in left.select("user_id").collect()]
    assert {f"u{u}" for u in range(0, 2000, 50)} <= set(passed) and 400 <= len(passed) <= 440
    # a filter far too small for its buyers lets others pass and changes nothing else
    small = A.of_buyers(w, o, words=2)
    assert small.join(left, w.columns, "left_anti").count() == small.count() - 400
    plan = A.attribution_models(w, o)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bit_or") >= 1


def test_the_light_way_has_four_windows_and_one_exchange(spark):
    touches, orders = _random_history(13, users=5, touches_per_user=5, orders_per_user=2)
    tl = A.timeline(spark.createDataFrame(touches, WEB), spark.createDataFrame(orders, ORD))
    plan = A._light(tl, A._Decay(K, 3600))._jdf.queryExecution().executedPlan().toString()
    import re
    nodes = re.findall(r"^[\s:+\-*()\d]*(Window|Exchange)\b", plan, re.M)
    assert nodes.count("Window") <= 4 and nodes.count("Exchange") == 1, plan


def test_hot_user_across_segments(spark):
    """One user holds most rows; its hours are segments of their own, stitched by the carries."""
    touches, orders = _random_history(7, users=6, touches_per_user=20, orders_per_user=3)
    hot_t, hot_o = _random_history(8, users=1, touches_per_user=2500, orders_per_user=1, days=90)
    rng = np.random.default_rng(9)
    base = dt.datetime(2024, 1, 1)
    hot_o = [(f"h{j}", "u0", base + dt.timedelta(seconds=int(rng.integers(0, 90 * 86400))),
              Decimal(int(rng.integers(100, 90000))) / 100) for j in range(300)]
    hot_t = [("u0",) + t[1:] for t in hot_t]
    touches = [t for t in touches if t[0] != "u0"] + hot_t
    orders = [o for o in orders if o[1] != "u0"] + hot_o
    assert_same(run_scan(spark, touches, orders, hot=3), brute(touches, orders))


def test_heavy_users(spark):
    rows_ = spark.createDataFrame([(u,) for u, n in (("a", 50), ("b", 30), ("c", 10), ("d", 10)) for _ in range(n)], "user_id string")
    heavy = lambda hot: {r.user_id for r in A.heavy_users(rows_, hot).collect()}
    assert [heavy(h) for h in (0, 1, 2, 3, 4, 10, 11)] == [set(), set(), set(), {"a"}, {"a", "b"}, {"a", "b"}, {"a", "b", "c", "d"}]
    assert A.heavy_users(rows_.limit(0)).collect() == []


def test_models_sum_to_attributed_revenue(spark):
    touches, orders = _random_history(11, users=30, touches_per_user=10, orders_per_user=4)
    got = run_scan(spark, touches, orders)
    attributed = sum(float(o[3]) for o in orders
                     if any(t[0] == o[1] and t[1] <= o[2] for t in touches))
    for f in ("revenue_last_click", "revenue_first_click", "revenue_linear", "revenue_time_decay"):
        assert abs(sum(r[f] for r in got.values()) - attributed) < 1e-4, f


def test_plan_has_no_pair_join(spark):
    touches, orders = _random_history(12, users=5, touches_per_user=5, orders_per_user=2)
    w = spark.createDataFrame(touches, WEB)
    o = spark.createDataFrame(orders, ORD)
    plan = A.attribution_models(w, o)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Arrow"):
        assert bad not in plan
    # shuffle joins meet a segment's rows with its carry, on (user, segment); the hot users and the filter are broadcast
    import re
    assert all("user_id" in j and "seg" in j for j in re.findall(r"SortMergeJoin \[[^\]]*\]", plan))
    assert all("user_id" in j or "_word" in j for j in re.findall(r"BroadcastHashJoin \[[^\]]*\]", plan))


def test_last_touch_and_order_campaign(spark):
    web = spark.createDataFrame([
        ("u1", ts("2024-01-01 10:00:00"), "Meta", "A"),
        ("u1", ts("2024-01-05 10:00:00"), "Meta", "B"),   # after the order: still wins (D20)
        ("u1", ts("2024-01-06 10:00:00"), "Meta", None),  # NULL campaign skipped
        ("u2", ts("2024-01-01 10:00:00"), "Meta", "C"),
        ("u2", ts("2024-01-01 10:00:00"), "Meta", "D"),   # tie -> larger campaign
    ], WEB)
    od = spark.createDataFrame([
        ("o1", "u1", ts("2024-01-02 00:00:00"), Decimal("10.00"), "Z"),
        ("o2", "u2", ts("2024-01-02 00:00:00"), Decimal("5.00"), "Z"),
        ("o3", "u9", ts("2024-01-02 00:00:00"), Decimal("1.00"), "Z"),  # no web events: own campaign
    ], ORD + ", campaign string")
    lt = {r["campaign"]: r for r in rows(A.last_touch_attribution(web, od))}
    assert lt["B"]["revenue"] == 10.0 and lt["D"]["revenue"] == 5.0 and lt["Z"]["buyers"] == 1
    oc = rows(A.order_campaign_credit(od))
    assert oc == [{"campaign": "Z", "revenue": 16.0, "orders": 3, "buyers": 3}]
    with pytest.raises(ValueError):
        A.attribution(web, od, "nope")


@pytest.mark.parametrize("hot", [0, 1000])
@pytest.mark.parametrize("k", [K, 0.0, 0.05])
def test_long_spans(spark, k, hot):
    """Histories of many years cross several reference blocks; a strong decay makes the blocks short."""
    touches, orders = _random_history(21, users=40, touches_per_user=25, orders_per_user=5)
    base = dt.datetime(2015, 1, 1)
    for u in range(40, 60):
        uid = f"u{u}"
        touches += [(uid, base + dt.timedelta(days=30 * j, seconds=u), "Email", "B") for j in range(0, 120, 7)]
        touches += [(uid, base + dt.timedelta(days=3000), "Meta", "A")]
        orders += [(f"L{u}-{j}", uid, base + dt.timedelta(days=30 * j + 3), Decimal("12.34")) for j in range(1, 120, 9)]
    assert_same(run_scan(spark, touches, orders, k=k, hot=hot), brute(touches, orders, k))


def test_money_below_a_cent(spark):
    w = spark.createDataFrame([("u1", ts("2024-01-01 10:00:00"), "Meta", "A")], WEB)
    o = spark.createDataFrame([(f"o{i}", "u1", ts("2024-01-02 10:00:00"), 0.004) for i in range(1000)],
                              "order_id string, user_id string, order_ts timestamp, revenue double")
    r = rows(A.attribution_models(w, o))[0]
    for f in ("revenue_last_click", "revenue_first_click", "revenue_linear", "revenue_time_decay"):
        assert r[f] == pytest.approx(4.0, rel=1e-12), f


def test_empty_inputs_and_null_revenue(spark):
    empty = run_scan(spark, [], [])
    assert empty == {}
    only_touches = run_scan(spark, [("u1", ts("2024-01-01 10:00:00"), "Meta", "A")], [])
    assert only_touches == {}
    touches = [("u1", ts("2024-01-01 10:00:00"), "Meta", "A")]
    orders = [("o1", "u1", ts("2024-01-02 10:00:00"), None), ("o2", "u1", ts("2024-01-03 10:00:00"), Decimal("5.00"))]
    got = run_scan(spark, touches, orders)
    assert got[("Meta", "A")]["orders"] == 2  # a NULL-revenue order still has a last click
    assert got[("Meta", "A")]["revenue_linear"] == 5.0 and got[("Meta", "A")]["revenue_time_decay"] == 5.0


def brute_by_order_id(touches, orders, k=K):
    """The reference's shape literally: pairs of every order row with earlier
    touches, windows partitioned by order_id (so rows sharing an id share one
    window)."""
    pairs: dict = {}
    for oid, user, ots, rev in orders:
        for t in touches:
            if user is not None and t[0] == user and t[1] is not None and t[1] <= ots:
                pairs.setdefault(oid, []).append((t, ots, float(rev)))
    out: dict = {}

    def acc(pair, field, v):
        rec = out.setdefault(pair, {"orders": set(), "revenue_last_click": 0.0, "revenue_first_click": 0.0,
                                    "revenue_linear": 0.0, "revenue_time_decay": 0.0})
        if field == "orders":
            rec["orders"].add(v)
        else:
            rec[field] += v

    for oid, ps in pairs.items():
        key = lambda p: (p[0][1], _key(p[0][2]), _key(p[0][3]))
        last, first = max(ps, key=key), min(ps, key=key)
        acc((last[0][2], last[0][3]), "orders", oid)
        acc((last[0][2], last[0][3]), "revenue_last_click", last[2])
        acc((first[0][2], first[0][3]), "revenue_first_click", first[2])
        mins = [(math.floor(o.timestamp()) - math.floor(t[1].timestamp())) / 60.0 for t, o, _ in ps]
        w = [math.exp(-k * (m - min(mins))) for m in mins]
        for (t, _, r), wi in zip(ps, w):
            acc((t[2], t[3]), "revenue_linear", r / len(ps))
            acc((t[2], t[3]), "revenue_time_decay", r * wi / sum(w))
    for rec in out.values():
        rec["orders"] = len(rec["orders"])
    return out


@pytest.mark.parametrize("k", [K, 0.0, 0.05])
@pytest.mark.parametrize("days", [0.01, 1, 7, 400])
def test_lookback(spark, days, k):
    """Paths of a limited age against the pair join; both ends of the limit count."""
    touches, orders = _random_history(61, users=12, touches_per_user=40, orders_per_user=8)
    back = dt.timedelta(days=days)
    for i, (_, uid, ots, _) in enumerate(orders[::3]):
        touches.append((uid, ots - back, "Edge", "in"))
        touches.append((uid, ots - back - dt.timedelta(microseconds=1), "Edge", f"out{i}"))
    orders += orders[::5]  # exact duplicates
    seen = list(dict.fromkeys(orders))
    assert_same(run_scan(spark, touches, orders, k=k, lookback_days=days), brute(touches, seen, k, back))


@pytest.mark.parametrize("base", [dt.datetime(1969, 12, 20), dt.datetime(2024, 1, 1)])
@pytest.mark.parametrize("days", [2, 7, 30, 90])
def test_lookback_from_few_rows(spark, days, base):
    """Paths that decay by less than a block, also by much (90 days: exp(-62)) and across 1970, where stretches must not merge."""
    touches, orders = _random_history(71, users=15, touches_per_user=40, orders_per_user=8)
    move = base - dt.datetime(2024, 1, 1)
    touches, orders = [(u, t + move, *x) for u, t, *x in touches], [(i, u, t + move, r) for i, u, t, r in orders]
    back = dt.timedelta(days=days)
    for i, (_, uid, ots, _) in enumerate(orders[::3]):
        touches += [(uid, ots - back, "Edge", "in"), (uid, ots - back - dt.timedelta(microseconds=1), "Edge", f"out{i}")]
    assert_same(run_scan(spark, touches, orders + orders[::4], lookback_days=days), brute(touches, orders, lookback=back), 1e-9)


@pytest.mark.parametrize("days,k,sorts", [(7, K, 1), (60, K, 2), (7, 0.0, 1)])
def test_lookback_sorts_once(spark, days, k, sorts):
    """Every sort holds its task's rows: the windows of a lookback share one, a second is for a strong decay only."""
    import re
    touches, orders = _random_history(15, users=4, touches_per_user=5, orders_per_user=2)
    w, o = spark.createDataFrame(touches, WEB), spark.createDataFrame(orders, ORD)
    plan = A.attribution_models(w, o, k=k, lookback_days=days)._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^[\s:+\-*()\d]*(Sort|Exchange hashpartitioning\(user_id)", plan, re.M)
    assert (nodes.count("Sort"), len(nodes) - nodes.count("Sort")) == (sorts, 1), plan


def test_no_frame_looks_ahead(spark):
    """Spark sums a frame that ends in the future anew for every row: none may be in the plan, but whole partitions."""
    touches, orders = _random_history(14, users=4, touches_per_user=5, orders_per_user=2)
    w, o = spark.createDataFrame(touches, WEB), spark.createDataFrame(orders, ORD)
    import re
    for df in (A.attribution_models(w, o, hot=4), A.attribution_models(w, o, lookback_days=3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        frames = set(re.findall(r"specifiedwindowframe\(([^)]*\(?\)?[^)]*)\)", plan))
        assert frames
        for f in frames:
            assert "unboundedfollowing" not in f or "unboundedpreceding" in f, f


def test_exact_duplicate_order_rows(spark):
    touches, orders = _random_history(31, users=12, touches_per_user=15, orders_per_user=4)
    dup = orders[::3]  # every third order row appears twice, identically
    both = orders + dup
    got = run_scan(spark, touches, both)
    assert_same(got, brute_by_order_id(touches, both))
    assert_same(got, brute(touches, orders))  # ... which equals the data without the copies


def test_latest_touch_before_the_order(spark):
    """D20's useful variant against a plain loop: the latest touch at or before each order."""
    touches, orders = _random_history(41, users=15, touches_per_user=12, orders_per_user=6)
    touches += [("u0", ts("2024-01-05 10:00:00"), "Meta", None), (None, ts("2024-01-05 10:00:00"), "Meta", "A")]
    orders = [o + ("own",) for o in orders] + [("ox", None, ts("2024-01-09 00:00:00"), Decimal("1.50"), "own"),
                                              ("oy", "nobody", ts("2024-01-09 00:00:00"), Decimal("2.50"), "own")]
    want: dict = {}
    for oid, user, ots, rev, own in orders:
        cand = [(t[1], t[3]) for t in touches if user is not None and t[0] == user and t[1] <= ots and t[3] is not None]
        rec = want.setdefault(max(cand)[1] if cand else own, [0, set(), set()])
        rec[0] += rev
        rec[1].add(oid)
        rec[2] |= {user} - {None}
    got = {r["campaign"]: r for r in rows(A.last_touch_attribution(
        spark.createDataFrame(touches, WEB), spark.createDataFrame(orders, ORD + ", campaign string"), before_order=True))}
    assert set(got) == set(want)
    for c, (rev, ids, users) in want.items():
        assert got[c]["revenue"] == pytest.approx(float(rev)) and got[c]["orders"] == len(ids) and got[c]["buyers"] == len(users)


def test_rows_sharing_an_order_id(spark):
    """Rows of one order id that differ stay separate orders; the id counts once."""
    touches = [("u1", ts("2024-01-01 10:00:00"), "Meta", "A")]
    orders = [("o1", "u1", ts("2024-01-02 10:00:00"), Decimal("10.00")), ("o1", "u1", ts("2024-01-02 10:00:00"), Decimal("30.00"))]
    got = run_scan(spark, touches, orders)[("Meta", "A")]
    assert got["orders"] == 1
    assert all(got[f] == pytest.approx(40.0) for f in ("revenue_last_click", "revenue_first_click", "revenue_linear", "revenue_time_decay"))
