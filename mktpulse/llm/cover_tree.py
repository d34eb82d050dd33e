"""Exact top-k inner products by dual-tree search over cover trees.

Components are quantised to integers (``floor(scale * x)``), scores are integer inner products.
Queries and candidates fall into blocks. Every block gets a cover tree, built once and written with its rows. The
levels come from a farthest-first traversal: level ``i`` holds the points that were picked while some point was farther than
``2^i`` from all picked ones. So a level contains the one above it (nesting), its points are more than ``2^i`` apart
(separation), and every point of the block lies within ``2^i`` of one of them (covering); a point's parent is the nearest
point of the level above its own. The traversal ends at one centre per ``leaf`` rows; the rows hang below their nearest centre.

A task gets the trees of one pair of blocks and walks them together. A node has a centre ``c`` and a
covering radius ``r`` (the largest distance of a point below it), so no score between two nodes
exceeds ``<c, c'> + |c| r' + |c'| r + r r'``. A pair of nodes is dropped when this
is below the worst k-th score among the queries of its query node; equal
scores are never dropped (ties go to the smaller id). A first pass meets every block of queries with one block of
candidates; its k-th scores are where the search of all other blocks begins. The k best of each block meet in a last shuffle.

Candidates are dealt by a hash of the row, so copies of one vector or id are spread; a
block of copies is a leaf of radius 0. The query set is stated by the caller;
each candidate is sent once per block of queries.

Scores are exact: doubles hold them while the largest possible one is below 2^53; a pair of blocks that could
exceed it is compared in whole numbers of any length, without pruning. A score beyond a long is reported as the nearest long; the order
is that of the exact scores.

Defined results: vectors that are NULL or hold NULL or non-finite components
take no part; only vectors of the same length are compared; the empty vector
scores 0; rows with the query's own id are no candidates of it; rows that repeat an id
are candidates of their own, and one query.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.llm.common import prepare, stored

SCALE, K = 256, 5
#: The largest long, and the digits of the largest score of doubles (vectors of up to 10^9 components).
LONG, WIDEST = (1 << 63) - 1, 640
#: Rows of a leaf (compared at once); a query leaf is small, so that its covering radius is too.
LEAF, QUERY_LEAF = 256, 8
MIN_BLOCK, MAX_BLOCK, QUERY_BLOCK = 2048, 65_536, 4096


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children", "worst")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -np.inf  # of a query node: the lowest k-th score below it


def cover(points: np.ndarray, most: int):
    """(picked, parent, level, owner): the levels of a cover tree over the rows of ``points``.

    ``picked`` are rows in the order of the farthest-first traversal, at most ``most``; ``parent`` (a place in
    ``picked``; its own for the root) and ``level`` are theirs; ``owner`` is the place of every row's nearest picked one.
    """
    near = np.sqrt(((points - points[0]) ** 2).sum(1))
    owner, above = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    top = int(np.ceil(np.log2(near.max()))) if near.max() > 0 else 0
    picked, parent, level, i = [0], [0], [top], top
    while len(picked) < most:
        far = int(near.argmax())
        if near[far] == 0.0:
            break
        while near[far] <= 2.0 ** i:  # the level is complete: its nearest points are the parents of the next ones
            i, above = i - 1, owner.copy()
        picked.append(far)
        parent.append(int(above[far]))
        level.append(i)
        d = np.sqrt(((points - points[far]) ** 2).sum(1))
        closer = d < near
        owner[closer] = len(picked) - 1
        near = np.where(closer, d, near)
    return np.array(picked), np.array(parent), np.array(level), owner


def nodes(points: np.ndarray, picked, parent, level, owner) -> Node:
    """The tree of the levels of ``cover``: a node for every point of every level, chains of single children left out."""
    rows_of = [np.flatnonzero(owner == c) for c in range(len(picked))]

    def made(c: int, parts: list[Node], rows: np.ndarray) -> Node:
        if len(parts) == 1:
            return parts[0]
        centre = points[picked[c]]
        radius = float(np.sqrt(((points[rows] - centre) ** 2).sum(1).max())) if len(rows) else 0.0
        return Node(centre, radius, rows, tuple(parts))

    # bottom up: at each level the points that end there go below their parents
    tree = {c: made(c, [], rows_of[c]) for c in range(len(picked))}
    for at in sorted(set(level.tolist())):
        below: dict[int, list[int]] = {}
        for c in np.flatnonzero(level == at):
            if c:
                below.setdefault(int(parent[c]), []).append(int(c))
        for c, children in below.items():
            parts = [tree[x] for x in (c, *children) if len(tree[x].rows)]
            tree[c] = made(c, parts, np.concatenate([x.rows for x in parts]))
    return tree[0]


def build(points: np.ndarray, leaf: int = LEAF) -> Node:
    return nodes(points, *cover(points, max(1, len(points) // leaf)))


def bound(q: Node, d: Node) -> float:
    ub = float(q.centre @ d.centre) + q.norm * d.radius + d.norm * q.radius + q.radius * d.radius
    return ub + 1e-9 * (abs(ub) + 1.0)  # rounding must not cut an equal score


class Search:
    """The k best candidates of every query of one pair of blocks."""

    def __init__(self, query_ids, queries, ids, points, k: int, query_tree: Node, tree: Node, low=None):
        """``low``: a score that each query's k-th is known to reach."""
        self.qid, self.q, self.id, self.p, self.k = query_ids, queries, ids, points, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (-score, id), sorted
        self.kth = np.full(len(query_ids), -np.inf) if low is None else np.array(low, np.float64)
        self.pairs = 0
        self.begin(query_tree)
        self.visit(query_tree, tree)

    def begin(self, q: Node) -> None:
        for c in q.children:
            self.begin(c)
        q.worst = float(self.kth[q.rows].min())

    @classmethod
    def exact(cls, query_ids, queries, ids, points, k: int) -> Search:
        """The same search over whole numbers of any length (object arrays), pair by pair, in slices of the candidates."""
        self = cls.__new__(cls)
        self.qid, self.q, self.id, self.p, self.k = query_ids, queries, ids, points, k
        self.best, self.pairs = [], 0
        for i, row in zip(query_ids, queries):
            best: list[tuple[int, int]] = []
            for at in range(0, len(ids), LEAF):
                scores = points[at:at + LEAF] @ row if len(row) else np.zeros(len(ids[at:at + LEAF]), object)
                best = sorted(best + [(-s, int(j)) for s, j in zip(scores, ids[at:at + LEAF]) if j != i])[:k]
            self.best.append(best)
        return self

    def visit(self, q: Node, d: Node) -> None:
        if bound(q, d) < q.worst:
            return
        if not q.children and not d.children:
            self.compare(q, d)
        elif q.children and (not d.children or q.radius >= d.radius):
            for c in q.children:
                self.visit(c, d)
            q.worst = min(c.worst for c in q.children)
        else:
            for c in sorted(d.children, key=lambda c: -float(q.centre @ c.centre)):  # likely the best first
                self.visit(q, c)

    def compare(self, q: Node, d: Node) -> None:
        self.pairs += len(q.rows) * len(d.rows)
        scores = self.q[q.rows] @ self.p[d.rows].T  # whole numbers, exact below 2**53
        ids = self.id[d.rows]
        good = (scores >= self.kth[q.rows][:, None]) & (ids[None, :] != self.qid[q.rows][:, None])
        for i in np.flatnonzero(good.any(1)):
            row = int(q.rows[i])
            at = np.flatnonzero(good[i])
            if len(at) > self.k:  # the k best of these; ties by id
                at = at[np.lexsort((ids[at], -scores[i, at]))[:self.k]]
            best = sorted(self.best[row] + [(-int(s), int(j)) for s, j in zip(scores[i, at], ids[at])])[:self.k]
            self.best[row] = best
            if len(best) == self.k:
                self.kth[row] = -best[-1][0]
        q.worst = float(self.kth[q.rows].min())


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id, _v array<double>; only vectors without NULL or non-finite components. ``whole`` makes them integers."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok)
            .select(F.col(id_col).cast("bigint").alias("_id"),
                    v.alias("_v")))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): float64 while every possible score is exact in it, else whole numbers of any length."""
    with np.errstate(over="ignore"):
        m = np.floor(vectors * scale)
    # no score between any two of these vectors exceeds this
    if m.size == 0 or m.shape[1] * float(np.abs(m).max()) ** 2 < 2.0 ** 53:
        return m
    exact = [[floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in row] for row in vectors.tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def digits(score: int) -> str | None:
    """For scores that no long holds: text that sorts as they do; they are equal as longs, so it decides between them."""
    if -LONG - 1 < score < LONG:
        return None
    n = str(abs(score)).zfill(WIDEST)
    return "1" + n if score >= 0 else "0" + n.translate(str.maketrans("0123456789", "9876543210"))


#: Of every row its vector and where it stands in its block's tree; of picked rows also the place, parent and level.
_TREE = "_dim int, _b bigint, _id bigint, _v array<double>, owner int, place int, parent int, level int"


def planted(vectors: DataFrame, blocks: int, deal, leaf: int, scale: int) -> DataFrame:
    """``vectors`` (_id, _v, _dim) dealt into blocks by the hash ``deal``, with the cover tree of their block."""

    def plant(t: pa.Table) -> pa.Table:
        dim, n = t["_dim"][0].as_py(), t.num_rows
        m = whole(t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim), scale)
        picked, parent, level, owner = cover(m, max(1, n // leaf)) if m.dtype != object else ([0], [0], [0], np.zeros(n))
        place, up, at = (np.full(n, -1, np.int32) for _ in range(3))
        place[picked], up[picked], at[picked] = np.arange(len(picked)), parent, level
        return pa.table({"_dim": t["_dim"], "_b": t["_b"], "_id": t["_id"], "_v": t["_v"], "owner": pa.array(owner.astype(np.int32)),
                         "place": place, "parent": up, "level": at})

    dealt = vectors.withColumn("_b", F.pmod(deal, F.lit(blocks)))
    return stored(dealt.select("_id", "_v", "_dim", "_b").groupBy("_b", "_dim").applyInArrow(plant, _TREE), "cover-trees")


def _restored(t: pa.Table, points: np.ndarray) -> Node:
    place, parent, level, owner = (t[c].to_numpy() for c in ("place", "parent", "level", "owner"))
    rows = np.flatnonzero(place >= 0)
    rows = rows[np.argsort(place[rows])]
    return nodes(points, rows, parent[rows], level[rows], owner)


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query over all vectors.

    ``is_query`` is a condition on ``_id``. ``block``: candidates per block, by default a 64th of all
    within fixed bounds.
    """
    spark = prepare(vectors.sparkSession)
    v = stored(quantised(vectors, id_col, vector_col), "vectors").withColumn("_dim", F.size("_v"))
    n = v.count()
    q = v.where(is_query).dropDuplicates(["_id", "_v"])
    block = block or min(MAX_BLOCK, max(MIN_BLOCK, ceil(n / 64)))
    data_blocks, query_blocks = max(1, ceil(n / block)), max(1, ceil(q.count() / QUERY_BLOCK))
    # rows are told apart by where they are stored: copies of a row are spread over the blocks
    data = planted(v, data_blocks, F.xxhash64(F.lit("block"), "_id", F.monotonically_increasing_id()), LEAF, scale)
    asked = planted(q, query_blocks, F.xxhash64(F.lit("block"), "_id"), QUERY_LEAF, scale)
    cols = [F.col(c) for c in ("_dim", "_id", "_v", "owner", "place", "parent", "level")]
    every = lambda blocks: F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))

    def pairs(low: DataFrame | None) -> DataFrame:
        """Both sides of every pair of blocks to be searched: the first pass without ``low``, all others with it."""
        home = F.pmod(F.col("_q"), F.lit(data_blocks))  # the block of candidates that a block of queries meets first
        # each candidate once per block of queries, each query once per block of candidates
        left = data.select(*cols, F.lit(False).alias("_query"), F.lit(None).cast("bigint").alias("_low"), F.col("_b").alias("_d"),
                           F.explode(every(query_blocks)).alias("_q"))
        known = asked if low is None else asked.join(low, ["_id", "_dim"], "left")
        none = F.lit(None).cast("bigint")
        right = known.select(*cols, F.lit(True).alias("_query"), (none if low is None else F.col("_low")).alias("_low"),
                             F.explode(every(data_blocks)).alias("_d"), F.col("_b").alias("_q"))
        both = left.unionByName(right)
        return both.where(F.col("_d") == home) if low is None else both.where(F.col("_d") != home)

    def search(t: pa.Table) -> pa.Table:
        dim, out = t["_dim"][0].as_py(), []
        parts = [t.filter(pc.equal(t["_query"], want)) for want in (True, False)]
        if all(p.num_rows for p in parts):
            ids = [p["_id"].to_numpy() for p in parts]
            m = whole(t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim), scale)
            asks = t["_query"].to_numpy()
            points = [np.ascontiguousarray(m[asks]), np.ascontiguousarray(m[~asks])]
            if m.dtype == object:
                s = Search.exact(ids[0], points[0], ids[1], points[1], k)
            else:
                low = np.array([-np.inf if x is None else x for x in parts[0]["_low"].to_pylist()])
                s = Search(ids[0], points[0], ids[1], points[1], k, *(_restored(p, x) for p, x in zip(parts, points)), low)
            out = [(int(i), j, -s_) for i, best in zip(s.qid, s.best) for s_, j in best]
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "_dim": pa.array([dim] * len(a), pa.int32()), "vec_id": pa.array(b, pa.int64()),
                         "score": pa.array([min(max(x, -LONG - 1), LONG) for x in c], pa.int64()),
                         "_digits": pa.array([digits(x) for x in c], pa.string())})

    def searched(low: DataFrame | None) -> DataFrame:
        return pairs(low).groupBy("_d", "_q", "_dim").applyInArrow(
            search, "query_id bigint, _dim int, vec_id bigint, score bigint, _digits string")

    found = searched(None)
    if data_blocks > 1:
        found = stored(found, "first-pass")
        # an id with several vectors is several queries of one name: no common bound
        several = q.groupBy("_id", "_dim").agg(F.count("*").alias("_n")).where("_n = 1")
        low = (found.groupBy("query_id", "_dim").agg(F.count("*").alias("_found"), F.min("score").alias("_low")).where(F.col("_found") == k)
               .select(F.col("query_id").alias("_id"), "_dim", "_low").join(several, ["_id", "_dim"], "left_semi"))
        found = found.unionByName(searched(low))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_digits").desc_nulls_last(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
