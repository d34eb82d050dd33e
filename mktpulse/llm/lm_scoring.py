"""Language-model scoring by cross-entropy difference.

Two character n-gram models of one order, smoothing and vocabulary: the target
(labelled good and not toxic) and the background (all documents). A token is a
code point or the end of the text; its probability given the ``ORDER - 1`` tokens before it
is the count ratio with ``PRIOR`` pseudo counts of the model's own single-token
distribution. Every token has a loss under both models; a document's score is the
mean of the differences (target minus background, lower is closer to the target).

A document's own n-grams are left out of both models when it is scored (the single-token distributions, which only
smooth, are those of all documents), so that labelled and unlabelled documents are scored alike.

The n-gram table grows with the corpus and is never broadcast or collected:
documents fall into parts of bounded text, a part's distinct n-grams and contexts are its
rows in the counting shuffle, and the same rows fetch the counts back, so the traffic
is distinct n-grams per part, not tokens. A frequent n-gram is one row per part, combined before the shuffle. Parts are
dealt one to a task and streamed: the counts first, then the texts in batches. All target documents count, however many: their ids are
joined to the parts that hold them, and a part is sent its own. Only single-token counts (at most one
row per Unicode code point) are sent to all tasks.

Defined results: NULL and empty texts have the end token alone; without target
documents the target model is the uniform one, without documents the result is empty; rows that
repeat are scored each, and each leaves out one occurrence of itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import prepare, stored
from mktpulse.llm.importance import target_ids, targets  # noqa: F401 (target_ids: the tests' small id lists)

ORDER, PRIOR = 5, 5.0
#: Code points of a part on average, and of a slice counted or scored at once.
PART, SLICE = 16_000_000, 1_000_000
START, END = 0x110000, 0x110001
#: The token of a row that counts a context.
CONTEXT = -1
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str, order: int = ORDER) -> np.ndarray:
    """Start marks, code points, end mark."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate([np.full(order - 1, START, np.uint32), points, np.array([END], np.uint32)])


def grams(t: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of the context of every token, and the token."""
    n = len(t) - order + 1
    h = np.zeros(n, np.uint64)
    for k in range(order - 1):
        h = (h ^ t[k:k + n]) * _MUL
        h ^= h >> np.uint64(32)
    return h.astype(np.int64), t[order - 1:].astype(np.int64)


def gram_key(ctx: np.ndarray, tok: np.ndarray) -> np.ndarray:
    """One 64-bit hash of context and token; within a part it tells n-grams apart."""
    h = (ctx.view(np.uint64) ^ (tok.view(np.uint64) + np.uint64(2)) * _MIX) * _MUL
    return (h ^ (h >> np.uint64(29))).view(np.int64)


class _Counts:
    """Distinct n-grams of a part with their counts in (all, target), a slice at a time."""

    def __init__(self):
        self.done, self.open_, self.size = [], [], 0

    def add(self, ctx, tok, inside: bool) -> None:
        self.open_.append((ctx, tok, np.ones(len(ctx), np.int64), np.full(len(ctx), inside, np.int64)))
        self.size += len(ctx)
        if self.size >= SLICE:
            self._close()

    def _close(self) -> None:
        self.done.append(self._merged(self.open_))
        self.open_, self.size = [], 0
        if len(self.done) == 8:
            self.done = [self._merged(self.done)]

    @staticmethod
    def _merged(parts):
        import pandas as pd

        ctx, tok, b, t = (np.concatenate(c) for c in zip(*parts))
        codes, keys = pd.factorize(gram_key(ctx, tok))
        at = np.empty(len(keys), np.int64)
        at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return ctx[at], tok[at], *(np.bincount(codes, n).astype(np.int64) for n in (b, t))

    def rows(self):
        """ctx, tok, b, t: every n-gram, and every context as a row with the token ``CONTEXT``."""
        if self.open_:
            self._close()
        if not self.done:
            return None
        ctx, tok, b, t = self._merged(self.done)
        whole = self._merged([(ctx, np.full(len(ctx), CONTEXT, np.int64), b, t)])
        return [np.concatenate(c) for c in zip((ctx, tok, b, t), whole)]


class _Table:
    """A part's n-grams with their counts, for scoring slices of its texts."""

    def __init__(self, ctx, tok, b, t, alone: np.ndarray, prior: float):
        import pandas as pd

        whole = tok == CONTEXT
        self.index = pd.Index(gram_key(ctx[~whole], tok[~whole]))
        # (background, target) counts of each n-gram and of its context; where the context stands
        self.context_of = pd.Index(ctx[whole]).get_indexer(ctx[~whole])
        self.n = [c[~whole].astype(np.float64) for c in (b, t)]
        self.m = [c[whole].astype(np.float64) for c in (b, t)]
        self.alone, self.prior = alone, prior
        self.met = [np.zeros(len(self.index), np.int64), np.zeros(int(whole.sum()), np.int64)]

    def _own(self, of: np.ndarray, met: np.ndarray, lengths) -> np.ndarray:
        """For every token: how often its document has the same n-gram or context."""
        out, at = np.empty(len(of), np.int64), 0
        for n in lengths:
            mine = of[at:at + n]
            np.add.at(met, mine, 1)
            out[at:at + n] = met[mine]
            met[mine] = 0
            at += n
        return out

    def losses(self, grams_, inside: list[bool]):
        """Tokens of each document, and its mean loss under the target and the background."""
        lengths = [len(g[0]) for g in grams_]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        ctx, tok = (np.concatenate(c) for c in zip(*grams_))
        g = self.index.get_indexer(gram_key(ctx, tok))
        c = self.context_of[g]
        own_g, own_c = self._own(g, self.met[0], lengths), self._own(c, self.met[1], lengths)
        sums = []
        for i in (1, 0):
            if i:
                known = np.array(inside)[doc]
                left_g, left_c = own_g * known, own_c * known
            else:
                left_g, left_c = own_g, own_c
            # rows that repeat an id may hold more than the target counted: never below zero
            n, m = np.maximum(self.n[i][g] - left_g, 0), np.maximum(self.m[i][c] - left_c, 0)
            sums.append(np.bincount(doc, np.log((m + self.prior) / (n + self.prior * self.alone[tok, i]))) / lengths)
        return np.array(lengths, np.int64), *sums


def _dealt(first: DataFrame, then: DataFrame, parts: int) -> DataFrame:
    """Rows of both, a partition to each part, those of ``first`` before the texts."""
    cols = {f.name: f.dataType for f in (*first.schema, *then.schema)}

    def full(df: DataFrame, kind: int) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in cols.items()])

    return full(first, 0).unionByName(full(then, 1)).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference of every whole text (nats per token)."""
    spark = prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    size = src.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n_parts = max(1, ceil(size / PART))
    src = src.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int"))

    # the target ids among a part's documents; an id that repeats has at most one row per part
    good = targets(labels).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    inside = src.select("part", "doc_id").distinct().join(good, "doc_id", "left_semi").select("part", "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, part = set(), _Counts(), None
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                for kind, p, d, t in zip(*(b.slice(i, 1000).column(c).to_pylist() for c in ("kind", "part", "doc_id", "text"))):
                    part = p
                    if kind:
                        counts.add(*grams(tokens(t, order), order), d in ids)
                    else:
                        ids.add(d)
        rows = counts.rows()
        if rows is not None:
            for i in range(0, len(rows[0]), 100_000):
                ctx, tok, n, m = (c[i:i + 100_000] for c in rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ctx), part, np.int32)), *map(pa.array, (ctx, tok, n, m))],
                                                 names=["part", "ctx", "tok", "b", "t"])

    met = stored(_dealt(inside, src, n_parts).mapInArrow(count, "part int, ctx bigint, tok bigint, b bigint, t bigint"), "lm-counts")
    # one table of all n-grams and contexts
    table = met.groupBy("ctx", "tok").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    single = (met.where(F.col("tok") != CONTEXT).groupBy("tok").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
              .toArrow())  # at most one row per code point
    at = single["tok"].to_numpy()
    alone = np.zeros((END + 1, 2), np.float64)  # smoothing: (background, target) share of each token
    for i, c in enumerate("bt"):
        n = single[c].to_numpy().astype(np.float64)
        alone[at, i] = (n + 1) / max(n.sum() + len(at), 1)
    met_alone = spark.sparkContext.broadcast((at, alone[at]))
    # an n-gram has at most one row per part on this side
    answer = met.select("part", "ctx", "tok").join(table, ["ctx", "tok"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shares = met_alone.value
        alone = np.zeros((END + 1, 2))
        alone[at] = shares
        rows, ids, table = [], set(), None
        docs, open_, size = [], [], 0

        def flush():
            nonlocal size
            n, t, b = table.losses(open_, [d in ids for d in docs])
            got = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *map(pa.array, (n, t, b, t - b))],
                                             names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])
            docs.clear(), open_.clear()
            size = 0
            return got

        for batch in batches:
            first = int((batch.column("kind").to_numpy() == 0).sum())
            if first:
                head = batch.slice(0, first)
                counted = pc.is_valid(head.column("ctx"))
                ids.update(head.filter(pc.invert(counted)).column("doc_id").to_pylist())
                counts = head.filter(counted)
                rows.append([counts.column(c).to_numpy() for c in ("ctx", "tok", "b", "t")])
            for i in range(first, batch.num_rows, 1000):
                if table is None:
                    table = _Table(*(np.concatenate(c) for c in zip(*rows)), alone, prior)
                    rows.clear()
                part = batch.slice(i, 1000)
                for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    docs.append(d)
                    open_.append(grams(tokens(text, order), order))
                    size += len(open_[-1][0])
                    if size >= SLICE:
                        yield flush()
        if docs:
            yield flush()

    none = F.lit(None).cast("bigint")
    first = answer.select("part", "ctx", "tok", "b", "t", none.alias("doc_id")).unionByName(
        inside.select("part", *[none.alias(c) for c in ("ctx", "tok", "b", "t")], "doc_id"))
    return _dealt(first, src, n_parts).mapInArrow(
        apply, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, difference double")
