"""Attribution.

Multi-touch models (A1-A6) without the all-pairs join
--------------------------------------------------------
The reference joins every order with every earlier touch of the same user and
then runs four window passes over the pairs. The pair count is quadratic in a
user's history, so one heavy user (a bot, a shared device id) can dominate
the job. Every model only needs running quantities along one user's merged
timeline of touches and orders (touches sort before an order at the same
instant, since ``event_ts <= order_ts`` counts):

* last click  -- the latest touch at or before the order (ties broken by
  ``(event_ts, source, campaign)``, D7);
* first click -- the user's first touch, if it precedes the order;
* linear      -- touch i receives ``sum_{orders o after i} revenue_o / n(o)``,
  where ``n(o)`` is the running touch count;
* time decay  -- touch i receives ``sum_o revenue_o * w_io / sum_j w_jo`` with
  ``w = exp(-k * minutes before order)``. Shares do not change if every
  weight is divided by the weight of the order's latest touch (D9).

Reduction. Touches of users without an order earn nothing. Before anything is
shuffled they go by a filter of the buyers: three bits of a user's hash in one
of ``FILTER_WORDS`` 64-bit words, built by a map-side-combined ``bit_or``, at
most that many rows however many buyers there are, so its broadcast is bounded.
A touch that passes by chance earns nothing either; beyond some ten million buyers
the filter lets more and more touches through, but never loses one.

Light users, with at most one part in ``hot`` of the rows each: one exchange by
user, windows over the user's timeline for counts and credits, and windows over
(user, reference block) for the decayed weights.

Heavy users have more than one part in ``hot`` of the rows, so there are fewer than ``hot`` (their ids are broadcast): no
task holds one of them. Their timeline is cut into segments (user, hour):

1. every segment's touches are summed up (count, decayed weight, first and
   last touch): a plain aggregate, combined map-side;
2. windows over a user's segments -- one row per active hour, not per event --
   carry the totals of earlier segments into each segment;
3. within a segment, windows give each order its touch count and weight sum
   and each touch the credits of the segment's later orders; the segment
   leaves one row per (source, campaign) and the sums of its orders;
4. windows over the segments carry the orders' sums back to earlier touches.

Both ways are always planned; there is no switch by size.

Exponents never leave the range of a double: weights are kept relative to the
start of a reference block of time, chosen so that its length decays by
``exp(-250)``. What lies so far before a user's latest touch that its weight is below
``exp(-50)`` of that touch's (2e-22, less than the last place of a double) may be
left out; an order whose latest touch is older than that is referred to the block of that touch.

No Python, no driver state, no checkpoint: Catalyst plans the whole operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.contracts import DECAY_PER_MINUTE
from mktpulse.functions.ratios import money
from mktpulse.operators.joins import DEFAULT_HOT, lookup_join

SEGMENT_SECONDS = 3600
#: 64-bit words of the filter of buyers: bounds its broadcast to some 40 MB.
FILTER_WORDS = 1 << 20
#: A reference block decays by exp(-_BLOCK_DECAY); without decay all time is one block (seconds).
_BLOCK_DECAY, _ALL_TIME = 250.0, 1 << 40
#: A touch in this last part of a block also counts in the next one: there it weighs exp(-50) and more.
_NEXT_BLOCK = 0.2
#: Up to this decay a sum after a row may be the whole sum less the one so far: it loses four to five places of a double's 16.
_MILD_DECAY = 10.0


def timeline(touches: DataFrame, orders: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """Touches (kind 0) and orders (kind 1) of non-NULL users: user_id, seg, sec, t_us, kind, src, camp, oid, rev."""
    t = touches.filter(F.col("user_id").isNotNull() & F.col("event_ts").isNotNull()).select(
        "user_id", F.unix_micros(F.col("event_ts").cast("timestamp")).alias("t_us"), F.lit(0).alias("kind"),
        F.col("source").alias("src"), F.col("campaign").alias("camp"), F.lit(None).cast("string").alias("oid"),
        money(F.lit(None)).alias("rev"))
    o = orders.filter(F.col("user_id").isNotNull() & F.col("order_ts").isNotNull()).select(
        "user_id", F.unix_micros(F.col("order_ts").cast("timestamp")).alias("t_us"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("camp"),
        F.col("order_id").cast("string").alias("oid"), money("revenue").alias("rev"))
    sec = F.floor(F.col("t_us") / 1_000_000)  # whole seconds, as the reference's minutes are built from
    return (t.unionByName(o).withColumn("sec", sec)
            .withColumn("seg", F.floor(F.col("sec") / segment_seconds)))


class _Decay:
    """Exponents relative to reference blocks, in seconds."""

    def __init__(self, k: float, segment_seconds: int):
        self.k, self.segment = k / 60.0, segment_seconds
        longest = min(_ALL_TIME, _BLOCK_DECAY / self.k) if k > 0 else _ALL_TIME
        self.block = max(1, int(longest) // segment_seconds) * segment_seconds
        self.next = -self.k * self.block

    def start(self, seg: str = "seg") -> Column:
        return F.col(seg) * self.segment

    def of(self, sec) -> Column:
        return F.floor(sec / self.block)

    def within(self, sec) -> Column:
        """Exponent of ``sec`` relative to the start of its block."""
        return self.k * (sec - F.floor(sec / self.block) * self.block)


def _carried(tl: DataFrame, d: _Decay) -> DataFrame:
    """Steps 1-2: per (user, seg) what the user's earlier segments hold.

    n_c touches; last_c (l: second, e: weight of all of them relative to it, src, camp); first_c (src, camp);
    last_sec: second of the segment's own last touch.
    """
    touch = F.col("kind") == 0
    s = tl.groupBy("user_id", "seg").agg(
        F.count(F.when(touch, 1)).alias("n"),
        F.sum(F.when(touch, F.exp(d.k * (F.col("sec") - d.start())))).alias("w"),
        F.max(F.when(touch, F.struct("t_us", "src", "camp", "sec"))).alias("last"),
        F.min(F.when(touch, F.struct("t_us", "src", "camp"))).alias("first"))
    s = s.withColumn("b", d.of(d.start())).withColumn("wb", F.col("w") * F.exp(d.within(d.start())))
    user = Window.partitionBy("user_id")
    so_far = Window.partitionBy("user_id", "b").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    before = user.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    back = d.k * (F.col("last.sec") - F.col("b") * d.block)
    s = s.withColumns({"here": F.sum("wb").over(so_far), "prev": F.sum("wb").over(user.orderBy("b").rangeBetween(-1, -1))})
    s = s.withColumn("state", F.when(F.col("n") > 0, F.struct(
        F.col("last.sec").alias("l"),
        (F.col("here") * F.exp(-back) + F.coalesce("prev", F.lit(0.0)) * F.exp(d.next - back)).alias("e"),
        F.col("last.src").alias("src"), F.col("last.camp").alias("camp"))))
    return s.select("user_id", "seg", F.col("last.sec").alias("last_sec"),
                    F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_c"),
                    F.last("state", ignorenulls=True).over(before).alias("last_c"),
                    F.first(F.when(F.col("n") > 0, F.struct("first.src", "first.camp")), ignorenulls=True).over(before)
                    .alias("first_c"))


def _segments(tl: DataFrame, d: _Decay) -> DataFrame:
    """Step 3: one row per (user, seg): credits per (source, campaign) within it, and the sums of its orders."""
    j = tl.join(_carried(tl, d), ["user_id", "seg"])
    w = Window.partitionBy("user_id", "seg").orderBy(
        "t_us", "kind", F.col("src").asc_nulls_first(), F.col("camp").asc_nulls_first(), F.col("oid").asc_nulls_first(),
        F.col("rev").asc_nulls_first())
    # backwards in time: a frame that looks ahead would be summed anew for every row
    after = Window.partitionBy("user_id", "seg").orderBy(
        F.desc("t_us"), F.desc("kind"), F.col("src").desc_nulls_last(), F.col("camp").desc_nulls_last(),
        F.col("oid").desc_nulls_last(), F.col("rev").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    touch = F.col("kind") == 0
    pair = F.when(touch, F.struct("src", "camp"))
    # exact duplicate order rows are one order, as the reference's per-order window makes them; they are neighbours
    again = ((F.lag("kind").over(w) == 1) & (F.lag("t_us").over(w) == F.col("t_us"))
             & F.lag("oid").over(w).eqNullSafe(F.col("oid")) & F.lag("rev").over(w).eqNullSafe(F.col("rev")))
    j = j.withColumns({
        "rel": F.exp(d.k * (F.col("sec") - d.start())),
        "n_l": F.count(F.when(touch, 1)).over(upto),
        "last_l": F.last(pair, ignorenulls=True).over(upto),
        "first_l": F.first(pair, ignorenulls=True).over(upto),
        "again": F.coalesce(again, F.lit(False))})
    j = j.withColumn("w_l", F.sum(F.when(touch, F.col("rel"))).over(upto))
    n = F.col("n_c") + F.col("n_l")
    counted = ~touch & ~F.col("again") & (n > 0)
    r = F.coalesce(F.col("rev").cast("double"), F.lit(0.0))
    local = F.col("n_l") > 0
    old = F.coalesce(F.col("last_c.e") * F.exp(d.k * (F.col("last_c.l") - d.start())), F.lit(0.0))
    j = j.withColumns({
        "v": F.when(counted, r / n),
        "a1": F.when(counted & local, r / (F.col("w_l") + old)),  # relative to the start of the segment
        "a0": F.when(counted & ~local, r / F.col("last_c.e")),    # relative to the last earlier touch
        "counted": counted})
    j = j.withColumns({
        "v_after": F.coalesce(F.sum("v").over(after), F.lit(0.0)),
        "a_after": F.coalesce(F.sum("a1").over(after), F.lit(0.0)),
        "n_after": F.count(F.when(F.col("counted"), 1)).over(after)})
    zero, no_money = F.lit(0.0), money(F.lit(0))
    rev = F.coalesce("rev", no_money)
    blank = {"lin": zero, "dec": zero, "rel": zero, "n": F.lit(0), "hit": F.lit(0), "lc": no_money, "fc": no_money,
             "oid": F.lit(None).cast("string"), "x": zero, "a0": zero, "a1": zero, "cnt": F.lit(0)}

    def part(of: Column, **values):
        return F.struct(of["src"].alias("src"), of["camp"].alias("camp"),
                        *[F.coalesce(values.get(c, b), b).alias(c) for c, b in blank.items()])

    own = F.struct("src", "camp")
    last = F.coalesce(F.col("last_l"), F.struct("last_c.src", "last_c.camp"))
    first = F.coalesce(F.col("first_c"), F.col("first_l"))
    parts = F.when(touch, F.array(part(own, lin=F.col("v_after"), dec=F.col("rel") * F.col("a_after"), rel=F.col("rel"),
                                       n=F.lit(1), hit=(F.col("n_after") > 0).cast("int"))))
    parts = parts.when(F.col("counted"), F.array(
        part(last, lc=rev, oid=F.col("oid"), x=F.col("v"), a0=F.col("a0"), a1=F.col("a1"), cnt=F.lit(1)), part(first, fc=rev)))
    j = j.select("user_id", "seg", "last_sec", F.col("last_c.l").alias("l_c"), F.explode(parts).alias("p"))
    sums = ["lin", "dec", "rel", "n", "hit", "lc", "fc", "x", "a0", "a1", "cnt"]
    g = j.groupBy("user_id", "seg", F.col("p.src").alias("src"), F.col("p.camp").alias("camp")).agg(
        *[F.sum(f"p.{c}").alias(c) for c in sums], F.collect_set("p.oid").alias("oids"),
        F.max("last_sec").alias("last_sec"), F.max("l_c").alias("l_c"))
    return g.groupBy("user_id", "seg").agg(
        *[F.sum(c).alias(c) for c in ("x", "a0", "a1", "cnt")], F.max("last_sec").alias("last_sec"), F.max("l_c").alias("l_c"),
        F.collect_list(F.struct("src", "camp", "lin", "dec", "rel", "n", "hit", "lc", "fc", "oids")).alias("pairs"))


def _credited(segments: DataFrame, d: _Decay) -> DataFrame:
    """Step 4: (source, campaign) parts with the credits of later segments' orders added."""
    nothing = F.lit(None)
    old, start, own = F.col("l_c"), d.start(), F.col("last_sec")
    rows = F.array(  # the orders' sums by the block of their reference, and one row that asks for later ones
        F.struct(F.lit(0).alias("what"), d.of(old).alias("tb"), (F.col("a0") * F.exp(-d.within(old))).alias("val")),
        F.struct(F.lit(1).alias("what"), d.of(start).alias("tb"), (F.col("a1") * F.exp(-d.within(start))).alias("val")),
        F.struct(F.lit(2).alias("what"), d.of(own).alias("tb"), nothing.cast("double").alias("val")))
    s = segments.withColumn("r", F.explode(rows)).select(
        "user_id", "seg", "r.*", "last_sec", F.when(F.col("r.what") == 1, F.col("x")).alias("x"),
        F.when(F.col("r.what") == 1, F.col("cnt")).alias("cnt"), F.when(F.col("r.what") == 2, F.col("pairs")).alias("pairs"))
    user = Window.partitionBy("user_id")
    # later segments, read backwards in time
    later = user.orderBy(F.desc("seg")).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("user_id", "tb").orderBy(F.desc("seg")).rangeBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"same": F.sum("val").over(same), "next": F.sum("val").over(user.orderBy("tb").rangeBetween(1, 1)),
                       "x_later": F.coalesce(F.sum("x").over(later), F.lit(0.0)),
                       "cnt_later": F.coalesce(F.sum("cnt").over(later), F.lit(0))})
    zero = F.lit(0.0)
    back = F.exp(d.within(own)) * (F.coalesce("same", zero) + F.exp(F.lit(d.next)) * F.coalesce("next", zero))
    s = (s.filter("what = 2").withColumn("back", F.coalesce(back * F.exp(-d.k * (own - start)), zero))
         .withColumn("p", F.explode("pairs")))
    return s.select(F.col("p.src").alias("channel"), F.col("p.camp").alias("campaign"),
                    (F.col("p.lin") + F.col("p.n") * F.col("x_later")).alias("lin"),
                    (F.col("p.dec") + F.col("p.rel") * F.col("back")).alias("dec"),
                    F.col("p.lc").alias("lc"), F.col("p.fc").alias("fc"),
                    ((F.col("p.hit") > 0) | ((F.col("p.n") > 0) & (F.col("cnt_later") > 0))).alias("hit"), F.col("p.oids").alias("oids"))


def of_buyers(touches: DataFrame, orders: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The touches of users with an order, and a few of others: what passes the filter of the buyers' hashes."""
    h = F.xxhash64("user_id")
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(user_id), {s}) & 63 AS int))") for s in (40, 46, 52)]
    key = [F.pmod(h, F.lit(words)).alias("_word"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("_bits")]
    buyers = (orders.filter(F.col("user_id").isNotNull() & F.col("order_ts").isNotNull()).select(*key)
              .groupBy("_word").agg(F.bit_or("_bits").alias("_set")))
    t = touches.filter(F.col("user_id").isNotNull() & F.col("event_ts").isNotNull()).select("*", *key)
    return (t.join(F.broadcast(buyers), "_word").filter(F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits"))
            .select(*touches.columns))


def _light(tl: DataFrame, d: _Decay, lookback: int | None = None) -> DataFrame:
    """(source, campaign) parts of users whose timeline fits a task: channel, campaign, lin, dec, lc, fc, hit, oid.

    Rows of a timeline by ``kind``: 0 touch, 1 order, -1 a touch that only weighs (in the block after its own); with a
    ``lookback`` (microseconds; ``_recent`` takes those that decay by less than a block) also 2, a touch that leaves the path,
    and -2, the start of an order's path. What follows a row is read from windows backwards in time, never from frames that
    look ahead.
    """
    is_touch, is_order = F.col("kind") == 0, F.col("kind") == 1
    # the end of a block counts in the next block too
    late = (F.col("sec") - d.of(F.col("sec")) * d.block) >= (1 - _NEXT_BLOCK) * d.block

    def row(kind: int, shift: int, at=F.col("t_us")):
        return F.struct(F.lit(kind).alias("kind"), F.lit(shift).alias("shift"), at.alias("at"))

    mine, next_block = [row(0, 0)], [row(-1, 1)]
    keys, events = ["user_id"], [row(1, 0)]
    if lookback is not None:
        # stretches as long as the lookback: an order's path lies in its own and the one before, so a touch goes to its own
        # and the next one, and every stretch stands for itself
        gone, start = F.col("t_us") + lookback, F.col("t_us") - lookback
        mine, next_block = [*mine, row(2, 0, gone)], [*next_block, row(2, 1, gone)]
        events.append(row(-2, 0, start))
        stretch = F.expr(f"t_us div {lookback}")
        tl = tl.withColumn("stretch", F.explode(F.when(is_touch, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
        keys.append("stretch")
    tl = tl.withColumn("e", F.explode(F.when(is_touch & late, F.array(*mine, *next_block)).when(is_touch, F.array(*mine))
                                      .otherwise(F.array(*events))))
    tl = (tl.withColumns({"own": F.when(is_touch, d.of(F.col("sec")) + F.col("e.shift")), "order_us": F.col("t_us")})
          .withColumns({"rel": F.exp(d.k * (F.col("sec") - F.col("own") * d.block)), "kind": F.col("e.kind"), "t_us": F.col("e.at"),
                        # +1 enters the path, -1 leaves it; rows that only weigh do not count
                        "sign": F.when(F.col("e.kind") == 2, -1).otherwise(1),
                        "n_sign": F.when(F.col("own").isNotNull() & (F.col("e.shift") == 0), F.when(F.col("e.kind") == 2, -1).otherwise(1))}))
    touch, order, probe = F.col("kind") == 0, F.col("kind") == 1, F.col("kind") == -2
    names = ["t_us", "kind", "src", "camp", "oid", "rev"]
    forward = [F.col(c).asc_nulls_first() for c in names]
    user = Window.partitionBy(*keys).orderBy(*forward)
    upto, whole = user.rowsBetween(Window.unboundedPreceding, 0), user.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = F.when(touch, F.struct("src", "camp"))
    # exact duplicate order rows are one order; they are neighbours
    again = ((F.lag("kind").over(user) == F.col("kind")) & (F.lag("t_us").over(user) == F.col("t_us"))
             & F.lag("oid").over(user).eqNullSafe(F.col("oid")) & F.lag("rev").over(user).eqNullSafe(F.col("rev")))
    j = tl.withColumns({"n": F.coalesce(F.sum("n_sign").over(upto), F.lit(0)), "last": F.last(pair, ignorenulls=True).over(upto),
                        "first": F.first(pair, ignorenulls=True).over(upto), "again": F.coalesce(again, F.lit(False)),
                        # an order belongs to the block of its latest touch
                        "blk": F.coalesce("own", F.last(F.when(touch, F.col("own")), ignorenulls=True).over(upto))})
    r = F.coalesce(F.col("rev").cast("double"), F.lit(0.0))
    counted = order & ~F.col("again") & (F.col("n") > 0)
    j = j.withColumns({"counted": counted, "v": F.when(counted, r / F.col("n"))})
    # orders after a row: all of them less those so far
    orders_after = F.count(F.when(F.col("counted"), 1)).over(whole) - F.count(F.when(F.col("counted"), 1)).over(upto)
    v_after = F.coalesce(F.sum("v").over(whole), F.lit(0.0)) - F.coalesce(F.sum("v").over(upto), F.lit(0.0))
    j = j.withColumns({"after": orders_after, "lin": F.col("n_sign") * F.when(orders_after > 0, v_after).otherwise(0.0)})
    block = [*keys, "blk"]
    so_far = Window.partitionBy(*block).orderBy(*forward).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("a", F.when(F.col("counted"), r / F.sum(F.col("sign") * F.col("rel")).over(so_far)))
    # weights fall with time: their sum after a row has to be summed from the end
    backward = [F.col(c).desc_nulls_last() for c in names]
    after = Window.partitionBy(*block).orderBy(*backward).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("dec", F.col("sign") * F.col("rel") * F.coalesce(F.sum("a").over(after), F.lit(0.0)))
    first = F.col("first")
    if lookback is not None:
        # a path begins with the next touch after its start, unless that is later than the order
        next_ = Window.partitionBy(*keys).orderBy(*backward).rowsBetween(Window.unboundedPreceding, 0)
        j = j.withColumn("next", F.last(F.when(touch, F.struct("t_us", "src", "camp")), ignorenulls=True).over(next_))
    zero, rev = F.lit(0.0), F.coalesce("rev", money(F.lit(0)))

    def part(of, lin=zero, dec=zero, lc=None, fc=None, seen=F.lit(0), oid=None):
        none = money(F.lit(None))
        return F.struct(of["src"].alias("channel"), of["camp"].alias("campaign"), lin.alias("lin"), dec.alias("dec"),
                        (none if lc is None else lc).alias("lc"), (none if fc is None else fc).alias("fc"),
                        seen.cast("bigint").alias("seen"), (F.lit(None).cast("string") if oid is None else oid).alias("oid"))

    # a touch coming counts the orders after it, one that leaves takes back those after that
    credit = part(F.struct("src", "camp"), lin=F.coalesce("lin", zero), dec=F.col("dec"),
                  seen=F.coalesce(F.col("n_sign") * F.col("after"), F.lit(0)))
    last_click = part(F.col("last"), lc=rev, oid=F.col("oid"))
    clicks = F.array(last_click, part(first, fc=rev)) if lookback is None else F.array(last_click)
    parts = F.when(F.col("counted"), clicks).when(F.col("own").isNotNull() & ((F.col("after") > 0) | (F.col("dec") != 0)), F.array(credit))
    if lookback is not None:
        parts = parts.when(probe & ~F.col("again") & (F.col("next.t_us") <= F.col("order_us")), F.array(part(F.col("next"), fc=rev)))
    return j.select(F.explode(parts).alias("p")).select("p.*")


def _recent(tl: DataFrame, d: _Decay, lookback: int) -> DataFrame:
    """The same parts for paths of at most ``lookback`` (microseconds) that decay by less than a block.

    Stretches of time are as long as the lookback. An order's path is what its own stretch has had so far, and of the stretch
    before what is not yet too old. So a touch is two rows: one that comes in its own stretch (kind 0) and, a lookback later, one
    that leaves the next (kind 2); an order is one (kind 1). Touches that have not left are all that leave later. Weights are relative
    to the stretch's start. All windows read one sort, and the sorted rows are kept narrow; only a strong decay takes a second.
    """
    stretch = F.expr(f"(t_us - pmod(t_us, {lookback})) div {lookback}")  # div alone rounds times before 1970 up
    pair = F.struct("src", "camp")
    none = F.lit(None)

    def row(kind: int, later: int = 0, comes: Column = none, leaves: Column = none):
        return F.struct(F.lit(kind).alias("kind"), (stretch + later).alias("stretch"), (F.col("t_us") + later * lookback).alias("t_us"),
                        comes.cast("struct<src: string, camp: string>").alias("comes"),
                        leaves.cast("struct<src: string, camp: string>").alias("leaves"))

    rows = F.when(F.col("kind") == 0, F.array(row(0, comes=pair), row(2, 1, leaves=pair))).otherwise(F.array(row(1)))
    tl = tl.select("user_id", "sec", "oid", "rev", F.explode(rows).alias("e")).select("user_id", "sec", "oid", "rev", "e.*")
    rel = F.exp(d.k * (F.col("sec") - F.floor(F.col("stretch") * lookback / 1_000_000)))
    tl = tl.select("user_id", "stretch", "t_us", "kind", "comes", "leaves", "oid", "rev",
                   F.when(F.col("kind") == 0, rel).alias("w_comes"), F.when(F.col("kind") == 2, rel).alias("w_leaves"))
    keys, names = ["user_id", "stretch"], ["t_us", "kind", "comes", "leaves", "oid", "rev"]
    stretches = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in names])
    upto = stretches.rowsBetween(Window.unboundedPreceding, 0)
    whole = stretches.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def after(c: str) -> Column:
        return F.coalesce(F.sum(c).over(whole), F.lit(0.0)) - F.coalesce(F.sum(c).over(upto), F.lit(0.0))

    # exact duplicate order rows are one order; they are neighbours
    again = ((F.lag("kind").over(stretches) == 1) & (F.lag("t_us").over(stretches) == F.col("t_us"))
             & F.lag("oid").over(stretches).eqNullSafe(F.col("oid")) & F.lag("rev").over(stretches).eqNullSafe(F.col("rev")))
    left = F.count("leaves").over(whole) - F.count("leaves").over(upto)
    # what is yet to leave is the latest, and so the heaviest, of the stretch before: nothing is lost by taking the rest away
    w = F.coalesce(F.sum("w_comes").over(upto), F.lit(0.0)) + F.when(left > 0, after("w_leaves")).otherwise(0.0)
    by = ", ".join(f"{c} ASC NULLS FIRST" for c in names)
    oldest = F.expr(f"lead(leaves, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY {by})")
    order = (F.col("kind") == 1) & ~F.coalesce(again, F.lit(False))
    j = tl.withColumns({"n": F.when(order, F.count("comes").over(upto) + left), "w": w,
                        "last": F.coalesce(F.last("comes", ignorenulls=True).over(upto), F.last("leaves", ignorenulls=True).over(whole)),
                        "first": F.coalesce(oldest, F.first("comes", ignorenulls=True).over(upto))})
    r = F.coalesce(F.col("rev").cast("double"), F.lit(0.0))
    counted = F.col("n") > 0
    j = j.withColumns({"hit": F.when(counted, F.lit(1)), "v": F.when(counted, r / F.col("n")), "a": F.when(counted, r / F.col("w"))})
    # a touch earns from its own stretch's orders after it, and from the next one's until it leaves
    comes, hits = F.col("kind") == 0, F.count("hit").over(upto)
    j = j.withColumns({"seen": F.when(comes, F.count("hit").over(whole) - hits).otherwise(hits),
                       "lin": F.when(comes, after("v")).otherwise(F.sum("v").over(upto)), "a_upto": F.sum("a").over(upto)})
    if d.k * lookback / 1_000_000 <= _MILD_DECAY:
        j = j.withColumn("a_after", after("a"))
    else:  # later orders' shares are too small beside the earlier ones': summed from the end
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in names])
        j = j.withColumn("a_after", F.sum("a").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    no_money = money(F.lit(None))

    def part(of: Column, lin=F.lit(0.0), dec=F.lit(0.0), lc=no_money, fc=no_money, seen=F.lit(0), oid=none):
        return F.struct(of["src"].alias("channel"), of["camp"].alias("campaign"), lin.alias("lin"), dec.alias("dec"), lc.alias("lc"),
                        fc.alias("fc"), seen.cast("bigint").alias("seen"), oid.cast("string").alias("oid"))

    rev = F.coalesce("rev", money(F.lit(0)))
    dec = F.when(comes, F.col("w_comes") * F.col("a_after")).otherwise(F.col("w_leaves") * F.col("a_upto"))
    credit = part(F.coalesce("comes", "leaves"), lin=F.col("lin"), dec=dec, seen=F.col("seen"))
    parts = F.when(F.col("kind") == 1, F.when(counted, F.array(part(F.col("last"), lc=rev, oid=F.col("oid")), part(F.col("first"), fc=rev))))
    parts = parts.when(F.col("seen") > 0, F.array(credit))
    return j.select(F.explode(parts).alias("p")).select("p.*")


def _heavy(tl: DataFrame, d: _Decay) -> DataFrame:
    """The same parts of users that no task could hold, by segments."""
    parts = _credited(_segments(tl, d), d)
    # order ids are counted across users and segments: a row for each beside the row of sums
    names = (("lin", "double"), ("dec", "double"), ("lc", "decimal(38,8)"), ("fc", "decimal(38,8)"), ("seen", "bigint"))
    parts = parts.withColumn("seen", F.col("hit").cast("bigint"))
    blank = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in names])
    sums = F.struct(*[F.col(c).cast(t).alias(c) for c, t in names])
    rows = F.concat(F.array(F.struct(sums.alias("s"), F.lit(None).cast("string").alias("oid"))),
                    F.transform("oids", lambda o: F.struct(blank.alias("s"), o.alias("oid"))))
    return parts.select("channel", "campaign", F.explode(rows).alias("r")).select("channel", "campaign", "r.s.*", "r.oid")


def heavy_users(tl: DataFrame, hot: int = DEFAULT_HOT) -> DataFrame:
    """user_id of those with more than one part in ``hot`` of the rows: fewer than ``hot``, whatever the data."""
    counts = tl.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") * hot > counts.agg(F.sum("_rows")).scalar()).select("user_id")


def attribution_models(touches: DataFrame, orders: DataFrame, k: float = DECAY_PER_MINUTE,
                       require_last_click: bool = False, segment_seconds: int = SEGMENT_SECONDS,
                       hot: int = DEFAULT_HOT, lookback_days: float | None = None) -> DataFrame:
    """``mart_attribution_summary``.

    One row per (channel, campaign) of the touches (the web event's
    ``source`` and ``campaign``) credited by any model; each model's revenue
    sums to the revenue of orders with at least one earlier touch (D8).
    ``require_last_click=True`` keeps only pairs with last-click credit, as
    the reference's left join does. A task holds the timeline of a user with at most one part in ``hot`` of the rows, or
    the events of a heavier one in ``segment_seconds``.

    ``lookback_days``: only touches at most so long before an order are in its path (both ends count). Paths are then
    short, and every user's timeline is cut into stretches of that length, a task holding two of them: two rows a touch in one
    sort (two sorts beyond exp(-10) over the lookback). Where a lookback decays by more than a block, the light users' windows
    do it, with four rows a touch and more sorts.
    """
    if segment_seconds < 1 or hot < 0:
        raise ValueError("segment_seconds must be positive, hot not negative")
    if lookback_days is not None and lookback_days * 86_400 < 1:
        raise ValueError("the lookback must be a second at least")
    orders = orders.select("order_id", "user_id", "order_ts", "revenue")
    touches = of_buyers(touches.select("user_id", "event_ts", "source", "campaign"), orders)
    tl = timeline(touches, orders, segment_seconds)
    d = _Decay(k, segment_seconds)
    if lookback_days is not None:
        lookback = round(lookback_days * 86_400_000_000)
        way = _recent if 0 <= d.k * lookback / 1_000_000 <= _BLOCK_DECAY else _light
        parts = way(tl, d, lookback)
    else:
        heavy = F.broadcast(heavy_users(tl, hot))  # fewer than ``hot`` rows
        parts = _light(tl.join(heavy, "user_id", "left_anti"), d).unionByName(
            _heavy(tl.join(heavy, "user_id", "left_semi"), d))
    # distinct order ids in two steps: rows without an id are combined before the shuffle
    sums = ["lin", "dec", "lc", "fc"]
    by_id = parts.groupBy("channel", "campaign", "oid").agg(*[F.sum(c).alias(c) for c in (*sums, "seen")])
    out = (by_id.groupBy("channel", "campaign")
           .agg(F.count("oid").alias("orders"),
                F.coalesce(F.sum("lc").cast("double"), F.lit(0.0)).alias("revenue_last_click"),
                F.coalesce(F.sum("fc").cast("double"), F.lit(0.0)).alias("revenue_first_click"),
                F.coalesce(F.sum("lin"), F.lit(0.0)).alias("revenue_linear"),
                F.coalesce(F.sum("dec"), F.lit(0.0)).alias("revenue_time_decay"),
                F.sum("seen").alias("_seen")))
    out = out.filter((F.col("orders") > 0) | (F.col("_seen") > 0)).drop("_seen")
    if require_last_click:
        out = out.filter(F.col("orders") > 0)
    return out


# ---------------------------------------------------------------- A7-A9
def last_touch_attribution(web: DataFrame, orders: DataFrame, before_order: bool = False, hot: int = DEFAULT_HOT) -> DataFrame:
    """Each user's latest non-NULL campaign (by full event time, then
    campaign; touches after the order count too, D20) takes the user's
    orders; users without web events keep the order's own campaign. Revenue,
    distinct orders and buyers per campaign, largest revenue first.

    The latest touch is a ``max_by`` aggregate (map-side partial, so a heavy
    user is combined before the shuffle). Orders meet it through
    ``joins.lookup_join``: users with a heavy share of the orders take the
    broadcast path, so no join task holds one user's orders.

    ``before_order=True`` credits the latest touch at or before each order
    instead (the useful variant of D20), from the segments of the multi-touch
    timeline.
    """
    if before_order:
        return _credit_by_campaign(_last_before(web, orders))
    last = (web.filter(F.col("campaign").isNotNull())
            .groupBy("user_id")
            .agg(F.max_by("campaign", F.struct("event_ts", "campaign")).alias("campaign_lt")))
    att = lookup_join(orders, last, "user_id", "left", hot)
    return _credit_by_campaign(att.withColumn("campaign", F.coalesce("campaign_lt", "campaign")))


def _last_before(web: DataFrame, orders: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """Orders (order_id, user_id, campaign, revenue) with the campaign of the user's latest touch at or before
    them, by event time and campaign; their own campaign where there is none."""
    t = web.filter(F.col("campaign").isNotNull() & F.col("user_id").isNotNull() & F.col("event_ts").isNotNull()).select(
        "user_id", F.col("event_ts").alias("ts"), F.lit(0).alias("kind"), F.col("campaign").alias("touch"),
        F.lit(None).cast("string").alias("order_id"), F.lit(None).cast("string").alias("campaign"), money(F.lit(None)).alias("revenue"))
    o = orders.select("user_id", F.col("order_ts").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("touch"),
                      F.col("order_id").cast("string").alias("order_id"), "campaign", money("revenue").alias("revenue"))
    rows = t.unionByName(o).withColumn("seg", F.floor(F.unix_timestamp("ts") / segment_seconds))
    last = rows.filter("kind = 0").groupBy("user_id", "seg").agg(F.max(F.struct("ts", "touch")).alias("m"))
    # one row per user and active hour; the carry also reaches hours that hold orders only
    hours = rows.filter("kind = 1").groupBy("user_id", "seg").agg(F.lit(None).cast(last.schema["m"].dataType).alias("m"))
    earlier = Window.partitionBy("user_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = (last.unionByName(hours).groupBy("user_id", "seg").agg(F.max("m").alias("m"))
             .select(F.col("user_id").alias("_u"), F.col("seg").alias("_s"),
                     F.last("m.touch", ignorenulls=True).over(earlier).alias("carry")))
    upto = (Window.partitionBy("user_id", "seg").orderBy("ts", "kind", F.col("touch").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    j = rows.join(carry, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("seg").eqNullSafe(F.col("_s")), "left")
    here = F.when(F.col("user_id").isNotNull() & F.col("ts").isNotNull(),
                  F.coalesce(F.last("touch", ignorenulls=True).over(upto), F.col("carry")))
    return (j.withColumn("here", here).filter("kind = 1")
            .select("order_id", "user_id", F.coalesce("here", "campaign").alias("campaign"), "revenue"))


def order_campaign_credit(orders: DataFrame) -> DataFrame:
    """Credit by the order's own campaign (the reference's "linear" fallback)."""
    return _credit_by_campaign(orders)


def _credit_by_campaign(df: DataFrame) -> DataFrame:
    return (df.groupBy("campaign")
            .agg(F.sum(money("revenue")).cast("double").alias("revenue"),
                 F.countDistinct("order_id").alias("orders"),
                 F.countDistinct("user_id").alias("buyers"))
            .orderBy(F.desc("revenue"), F.asc_nulls_last("campaign")))


def attribution(web: DataFrame, orders: DataFrame, model: str = "last_touch") -> DataFrame:
    """The dashboard's model selector."""
    if model == "last_touch":
        return last_touch_attribution(web, orders)
    if model == "order_campaign":
        return order_campaign_credit(orders)
    raise ValueError(f"unknown attribution model {model!r}")


__all__ = ["attribution_models", "last_touch_attribution", "order_campaign_credit", "attribution", "timeline"]
