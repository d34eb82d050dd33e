"""N-gram Jaccard join: MinHash LSH forest and exact verification.

Texts are sets of shingles (five consecutive words, lower case; a shorter text
is one shingle). Two documents are linked if the Jaccard similarity of their
sets is at least ``THRESHOLD``.

1. Documents with the same words are one text; only different texts go on.
2. A text has a path of ``DEPTH`` min-hashes (``BITS`` bits each) in every one of ``TREES`` prefix tries. The rows (trie, path,
   text) are range-partitioned and sorted: that is the forest. A node of a trie at some depth is a run of rows with a common
   prefix; each row names the first row of its run at every depth (a star, never all pairs), and runs that go on in the next partition are
   tied through its first row.
3. The join begins at full depth: texts that share a node are candidates, and are verified. The similarities found tell how
   many links there are and, each being found at a depth with a known probability, how many are missed there. The prefixes are
   shortened to the greatest depth at which all links, and ``WARY`` more of exactly the threshold, are expected to be found to the share ``RECALL``, and
   the candidates of that depth are verified; again until no shorter prefix is called for. No prefix gets shorter than where a
   link of exactly the threshold is found with that probability (``working_depth``).
4. Components of the candidates' ties are cells. A cell holds every candidate pair of its texts and
   is verified exactly: all similarities within it from the shingle sets. A cell of more
   than ``CELL`` texts is cut into blocks, and each pair of blocks is a group of its own, so
   no task holds more than two blocks. Only counts and a spanning tree of the links leave a group.
5. Components of the verified links are the classes.

Links are counted, not listed; copies are counted with their text.

Defined results: texts without words are one text, linked to nothing; NULL text
is the empty text; a NULL doc_id never names a class while there is another; rows that repeat are copies; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.llm.common import list_array, lookup_hot, partitions, prepare, stored
from mktpulse.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 10, 0.999
#: Bits of a min-hash in a path: a path is one long.
BITS = 6
#: Links of exactly the threshold that are taken to be there besides those found, and steps of the similarities' histogram.
WARY, STEPS = 10, 200
#: Texts of a block; a group of the verification has at most two.
CELL = 64


def found_with(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two texts share a node at ``depth`` in some trie."""
    one = similarity + (1 - similarity) / (1 << BITS)
    return 1 - (1 - one ** depth) ** trees


def working_depth(trees: int = TREES, deepest: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The greatest depth at which a pair of exactly ``threshold`` is found with probability ``recall``."""
    return next((d for d in range(deepest, 1, -1) if 1 - (1 - threshold ** d) ** trees >= recall), 1)


def shortened(links: dict[float, int], depth: int, least: int, trees: int = TREES, threshold: float = THRESHOLD,
              recall: float = RECALL) -> int:
    """The depth to go to, from the similarities of the links found at ``depth`` (similarity -> links): the greatest at
    which the share ``recall`` of all links is expected."""
    there = {s: n / found_with(s, depth, trees) for s, n in links.items()}
    there[threshold] = there.get(threshold, 0) + WARY
    for d in range(depth, least, -1):
        if sum(n * found_with(s, d, trees) for s, n in there.items()) >= recall * sum(there.values()):
            return d
    return least


class _Words(dict):
    def __missing__(self, w: str) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= 400_000:
            self.clear()
        h = self[w] = xxh3_64_intdigest(w)
        return h


_words = _Words()


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ w[k:len(w) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return (rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32))


def signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Min-hashes of a set; long sets are taken in pieces of bounded size."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at:at + 2048]
        np.minimum(out, (mul[:, None] * part[None, :] + add[:, None]).min(1), out=out)
    return out


def paths(sig: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The text's path in every trie: ``BITS`` bits of each min-hash, the first one highest."""
    bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64).reshape(trees, depth)
    return (bits << (BITS * np.arange(depth - 1, -1, -1))).sum(1)


def signed(docs: DataFrame, trees: int, depth: int, words: int = WORDS) -> DataFrame:
    """doc_id, _h, _text (digest of the words), paths (one per trie; none without words). No shuffle."""
    if BITS * depth > 62:
        raise ValueError(f"a path takes at most {62 // BITS} min-hashes")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"),
                      F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = permutations(trees * depth)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                digests, ways = [], []
                for text in part.column(2).to_pylist():
                    digests.append(hashlib.blake2b(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    s = shingles(text, words)
                    ways.append(paths(signature(s, mul, add), trees, depth) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.binary()),
                     list_array(np.concatenate(ways), [len(k) for k in ways], pa.int64())], names=["doc_id", "_h", "_text", "paths"])

    return src.mapInArrow(run, "doc_id bigint, _h bigint, _text binary, paths array<bigint>")


class Forest:
    """The sorted tries of ``nodes`` (node, paths), for ties at any depth from ``least`` to ``deepest``."""

    def __init__(self, nodes: DataFrame, deepest: int, least: int):
        self.deepest, self.least = deepest, least
        shifts = [BITS * (deepest - d) for d in range(least, deepest + 1)]
        order = ["tree", "path", "node"]
        rows = nodes.select("node", F.posexplode("paths").alias("tree", "path"))
        dealt = rows.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, before, firsts = TaskContext.get().partitionId(), None, None  # the row before, and its runs' first rows

            def edge(kind, node, tree, path):
                return pa.RecordBatch.from_arrays(
                    [pa.array([node], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([part], pa.int32()),
                     pa.array([kind], pa.int32()), pa.array([tree], pa.int32()), pa.array([path], pa.int64())], names=names)

            names = ["node", "hubs", "part", "edge", "tree", "path"]
            for b in batches:
                if not b.num_rows:
                    continue
                node, tree, path = (b.column(c).to_numpy() for c in names[:1] + names[4:])
                if before is None:
                    yield edge(1, node[0], tree[0], path[0])
                hubs = np.empty((len(node), len(shifts)), np.int64)
                for j, shift in enumerate(shifts):
                    key = path >> shift
                    new = np.append(True, (key[1:] != key[:-1]) | (tree[1:] != tree[:-1]))
                    new[0] = before is None or before[1] != tree[0] or before[2] >> shift != key[0]
                    at = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
                    hubs[:, j] = np.where(at >= 0, node[at], 0 if firsts is None else firsts[j])
                before, firsts = (node[-1], tree[-1], path[-1]), hubs[-1]
                tied = hubs[:, 0] != node
                n = int(tied.sum())
                if n:
                    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[tied]), list_array(hubs[tied].ravel(), [len(shifts)] * n, pa.int64()),
                         pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), *none], names=names)
            if before is not None:
                yield edge(2, *before)

        self.rows = stored(dealt.mapInArrow(run, "node bigint, hubs array<bigint>, part int, edge int, tree int, path bigint"), "forest")

    def ties(self, depth: int) -> DataFrame:
        """a, b: texts tied to the first of their run, at ``depth``."""
        inside = self.rows.where("edge = 0").select(F.col("node").alias("a"), F.col("hubs")[depth - self.least].alias("b"))
        # two rows per partition: the last row of one and the first of the next
        before = F.lag(F.struct("node", "tree", "path")).over(Window.orderBy("part", "edge"))
        shift = BITS * (self.deepest - depth)
        prefix = lambda c: F.shiftright(c, shift)
        across = (self.rows.where("edge > 0").withColumn("p", before).where("edge = 1 AND p.tree = tree")
                  .where(prefix(F.col("p.path")) == prefix(F.col("path"))).select(F.col("node").alias("a"), F.col("p.node").alias("b")))
        return inside.unionByName(across).where("a <> b")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by slices of the shared vocabulary."""
    both = np.concatenate([*a, *b])
    vocab, inverse = np.unique(both, return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    total = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, len(vocab), 8192):
        lo, hi = np.searchsorted(inverse, (at, at + 8192))
        m = np.zeros((len(a) + len(b), min(8192, len(vocab) - at)), np.float32)
        m[owner[lo:hi], inverse[lo:hi] - at] = 1.0
        total += m[:len(a)] @ m[len(a):].T
    return total


def similarities(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all pairs of two lists of sets."""
    both = overlaps(a, b)
    return both / (np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both)


def _spanning(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """(i, root of i) for the i of the components of ``pairs`` that are not their root."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def verify(cells: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, cell: int = CELL) -> DataFrame:
    """node, links, other from (cell, node, text, size): links of the node found in one group, and a node of its
    linked component (itself if there is none). And a row without a node for each group, whose ``found`` counts its links by
    similarity, in ``STEPS`` steps."""
    blocks = F.ceil(F.col("size") / cell).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = (cells.withColumn("_blocks", blocks).withColumn("_mine", mine)
             .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .select("cell", F.least("_mine", "_with").alias("i"), F.greatest("_mine", "_with").alias("j"), "_mine", "node", "text"))

    def group(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        seen = dict(zip(t["node"].to_pylist(), zip(t["_mine"].to_pylist(), t["text"].to_pylist())))  # repeated rows fall together
        nodes = sorted(seen, key=lambda n: (seen[n][0], n))
        sets = [shingles(seen[n][1], words) for n in nodes]
        cut = sum(seen[n][0] == i for n in nodes)
        links, pairs, alike = np.zeros(len(nodes), np.int64), np.zeros((0, 2), np.int64), np.zeros(0)
        if i == j:
            alike = similarities(sets, sets)
            np.fill_diagonal(alike, 0.0)
            ok = alike >= threshold - 1e-9
            links, pairs, alike = ok.sum(1), np.argwhere(np.triu(ok)), alike[np.triu(ok)]
        elif 0 < cut < len(nodes):
            alike = similarities(sets[:cut], sets[cut:])
            ok = alike >= threshold - 1e-9
            links, pairs, alike = np.concatenate([ok.sum(1), ok.sum(0)]), np.argwhere(ok) + [0, cut], alike[ok]
        other = {k: r for k, r in _spanning(len(nodes), pairs)}
        keep = [k for k in range(len(nodes)) if links[k]]
        steps = np.bincount((alike * STEPS + 1e-6).astype(np.int64), minlength=STEPS + 1).tolist() if len(alike) else None
        return pa.table({"node": pa.array([None, *(nodes[k] for k in keep)], pa.int64()),
                         "links": pa.array([None, *(int(links[k]) for k in keep)], pa.int64()),
                         "other": pa.array([None, *(nodes[other.get(k, k)] for k in keep)], pa.int64()),
                         "found": pa.array([steps, *[None] * len(keep)], pa.list_(pa.int64()))})

    return dealt.groupBy("cell", "i", "j").applyInArrow(group, "node bigint, links bigint, other bigint, found array<bigint>")


def candidate_cells(docs: DataFrame, nodes: DataFrame, ties: DataFrame) -> DataFrame:
    """cell, node, size, text: the components of the ties, with the text of every node."""
    cells = components(ties)
    sizes = stored(cells.groupBy("root").agg(F.count("*").alias("n")), "jaccard-sizes")
    in_cells = lookup_hot(cells, sizes, "root", cells.count()).select("node", F.col("root").alias("cell"), F.col("n").alias("size"))
    pick = in_cells.join(nodes.select("node", "rep", "rep_h"), "node")
    text = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("_k", F.xxhash64("text"))
    return text.join(pick, text["_id"].eqNullSafe(pick["rep"]) & (text["_k"] == pick["rep_h"])).select("cell", "node", "size", "text")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES,
                    deepest: int = DEPTH, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """Per document: doc_id, _h (hash of its text), class_id (smallest doc_id of its class), class_h (smallest _h that
    comes with it), text_id (smallest doc_id with its words), copies (documents with its words), links (other texts
    it is linked to). class_id and class_h name the first document of the class: a doc_id may be NULL or repeat."""
    prepare(docs.sparkSession)
    least = working_depth(trees, deepest, threshold, recall)
    own = stored(signed(docs, trees, deepest, words), "jaccard-signed")
    nodes = stored(own.groupBy("_text").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h")).alias("first"),
                                            F.count("*").alias("n"), F.any_value("paths").alias("paths"))
                   .select("_text", F.col("first.doc_id").alias("rep"), F.col("first._h").alias("rep_h"), "n", "paths",
                           F.monotonically_increasing_id().alias("node")), "jaccard-texts")
    forest, depth = Forest(nodes, deepest, least), deepest
    while True:
        found = stored(verify(candidate_cells(docs, nodes, forest.ties(depth)), threshold, words, cell), "jaccard-links")
        at = found.where("node IS NULL").select(F.posexplode("found").alias("step", "n")).groupBy("step").agg(F.sum("n").alias("n"))
        shorter = shortened({r["step"] / STEPS: r["n"] for r in at.collect() if r["n"]}, depth, least, trees, threshold, recall)
        if shorter == depth:
            break
        depth = shorter
    found = found.where("node IS NOT NULL")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    full = (nodes.drop("paths").join(links, "node", "left").join(label, "node", "left")
            .select("_text", "rep", "rep_h", "n", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
                    F.coalesce("root", "node").alias("root")))
    full = stored(full, "jaccard-labelled")
    ids = full.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "rep_h")).alias("first"), F.count("*").alias("n"))
    ids = stored(ids.select("root", F.col("first.rep").alias("class_id"), F.col("first.rep_h").alias("class_h"), "n"), "jaccard-classes")
    named = lookup_hot(full.withColumnRenamed("n", "copies"), ids, "root", ids.agg(F.sum("n")).first()[0] or 0)
    named = named.select("_text", F.col("copies").alias("n"), "class_id", "class_h", F.col("rep").alias("text_id"), "links")
    named = stored(named, "jaccard-named")
    out = lookup_hot(own.select("doc_id", "_h", "_text"), named, "_text", own.count())
    return out.select("doc_id", "_h", "class_id", "class_h", "text_id", F.col("n").alias("copies"), "links")


def one_per_class(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` but for those that are not the first document of their class (smallest doc_id, NULL last,
    then smallest hash of the text).

    Rows that repeat the first document (same doc_id and text) are repeats too: the one with the smallest other
    columns stays. Other texts under its doc_id, or under NULL, are documents of their own classes.
    """
    c = jaccard_classes(docs, **how)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_h") == F.col("class_h"))
    gone = c.where(~first).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_k")).distinct()
    cols, h = docs.columns, F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    left = docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["_id"]) & (h == gone["_k"]), "left_anti")
    # equal (doc_id, text) are in one class, so numbering them leaves one row per class
    order = [F.col(f.name) for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    same = Window.partitionBy("doc_id", "_same").orderBy(*order)
    return (left.withColumn("_same", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
            .withColumn("_nth", F.row_number().over(same)).where("_nth = 1").select(*cols))
