"""Mixing sources to target weights by a low-discrepancy schedule.

* Size of a document: its words. A source's target is its weight's share of the
  mixture; no target is above ``most`` times its source, and what that frees is
  shared again by weight until no target is above.
* Each source's documents are shuffled by a hash and laid end to end; the
  stream of words is cut into blocks of ``block`` words (the last is shorter)
  that can be taken up to ``most`` times (once an epoch).
* The schedule has one slot per block of the mixture. Slot ``i`` is the
  golden-ratio point ``frac((i + 1/2) * phi)``; mapped through the cumulative targets
  it names a source, so every stretch of the schedule has nearly the target
  proportions. The slot's rank among its source's slots names the block:
  ``rank mod blocks`` in epoch ``rank div blocks``.

Everything is DataFrame code, and the sources are a table of any length: what needs them in order (code point order for
the default weights, cumulative targets) are running totals over range partitions, slots meet their source by an as-of
window within stretches of the unit interval, and documents find their source's target by a join that takes frequent sources
out. The offsets of a source's documents come from sums per hash bucket and a window within a bucket, so a
source with a third of all rows is spread over as many tasks as it has buckets.

Defined results: NULL text has size 0; the NULL source is a source of its own and
comes last; rows that repeat are separate documents; documents of size 0 take
0; a source of size 0 has target 0.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.llm.common import lookup_hot, prepare, running, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words of a block: the mixture misses a target by a few blocks at most.
BLOCK = 128
#: Documents a bucket of the shuffled order holds on average.
PER_BUCKET = 256
GOLDEN = 0.6180339887498949
#: Slots whose ranks are counted together.
STRETCH = 65_536
#: Slots of a stretch of the unit interval on average, and the most such stretches.
PER_CELL, MAX_CELLS = 4096, 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_weights(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row per source (_source, source_size, ...) with its weight, repeating in code point order, NULL last."""
    at = (F.col("_place") - 1) % len(weights)
    placed = running(sizes, [F.col("_source").asc_nulls_last()])
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double")).drop("_place")


def targets(weighted: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target``: shares by weight of ``share`` times all sizes, none above ``most`` times its source's.

    A source is at its limit if the rate (words per unit of weight) reaches its limit over its weight. In the order of
    that ratio, the sources before one leave it a rate; the first source that this does not fill sets the rate of all
    that follow. One running total; three sums reach the driver.
    """
    rows = weighted.withColumn("_full", F.col("source_size") * float(most)).withColumn("_ratio", F.col("_full") / F.col("weight"))
    sums = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight = share * (sums["size"] or 0), sums["weight"] or 0.0
    by = running(rows, ["_ratio", F.col("_source").asc_nulls_last()], ["_full", "weight"])
    # sizes and weights are whole numbers: these sums do not depend on how they are added up
    rate = F.greatest(F.lit(0.0), F.lit(total) - F.col("_full_before")) / (F.lit(weight) - F.col("weight_before"))
    first = by.where(F.col("_full") > F.col("weight") * rate).agg(F.min_by(rate, "_place")).first()[0]
    target = F.col("_full") if first is None else F.least(F.col("_full"), F.col("weight") * first)
    return rows.withColumn("target", target).drop("_full", "_ratio")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, _source, size, _order: the shuffled place of each document."""
    return docs.select("doc_id", F.col("source").alias("_source"), words(F.col("text")).alias("size"),
                       place(F.col("doc_id"), F.col("text")).alias("_order"))


def place(doc_id: Column, text: Column) -> Column:
    """Place of a document in the shuffled order of its source."""
    return F.xxhash64(F.lit("mix"), doc_id, F.coalesce(text, F.lit("")))


def streams(docs: DataFrame) -> DataFrame:
    """Adds ``start``: words of the source in front of the document in its shuffled order."""
    n = docs.agg(F.count("*")).first()[0]
    buckets = max(1, ceil(n / PER_BUCKET))
    # the top bits of the hash, so that buckets follow the order
    docs = docs.withColumn("_bucket", F.floor((F.col("_order") / 2.0 ** 64 + 0.5) * buckets))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (docs.groupBy("_source", "_bucket").agg(F.sum("size").alias("_n"))
            .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_base"))
    within = (Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = docs.withColumn("_local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # both sides are dealt by source and bucket already; a bucket holds few rows, whatever its source
    return (local.join(base, local["_source"].eqNullSafe(base["_s"]) & (local["_bucket"] == base["_b"]))
            .select("doc_id", "_source", "size", "_order", (F.col("_local") + F.col("_base")).alias("start")))


def schedule(sources: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """slot, _source, rank, block, epoch: the mixture as a sequence of blocks of words.

    ``sources`` has _source, source_size, target. The unit interval is cut into stretches of some slots; a source is a row in
    every stretch that its part of the cumulative targets touches (at most stretches plus sources rows), and a slot's
    source is the last one that starts at or before its point. The rank of a slot among its source's slots is a count
    over stretches of slots and one within the stretch.
    """
    spark = sources.sparkSession
    # nine decimals and no rounding in their sums: the same edges in every run
    exact = sources.where("target > 0").withColumn("_t", F.col("target").cast("decimal(28,9)"))
    total = float(exact.agg(F.sum("_t")).first()[0] or 0)
    slots = ceil(total / block)
    cells = min(max(1, ceil(slots / PER_CELL)), MAX_CELLS)
    edge = running(exact, [F.col("_source").asc_nulls_last()], ["_t"])
    low = F.col("_t_before").cast("double") / (total or 1.0)
    high = (F.col("_t_before") + F.col("_t")).cast("double") / (total or 1.0)
    last = F.lit(cells - 1).cast("bigint")
    cell = lambda x: F.least(F.floor(x * cells).cast("bigint"), last)
    held = F.struct(F.col("_place").alias("at"), F.col("_source").alias("source"), F.ceil(F.col("source_size") / block).alias("blocks"))
    starts = edge.select(F.explode(F.sequence(cell(low), cell(high))).alias("_cell"), low.alias("_u"), F.lit(None).cast("bigint").alias("slot"),
                         F.col("_place"), held.alias("_s"))
    i = spark.range(0, slots, 1, max(1, ceil(slots / STRETCH))).withColumnRenamed("id", "slot")
    # frac((i + 1/2) * phi), the product split so that large slot numbers keep their fraction
    high_part, low_part = F.floor(F.col("slot") / 2.0 ** 20), F.col("slot") % (1 << 20)
    product = high_part * F.lit(GOLDEN * 2 ** 20 % 1.0) + (low_part + 0.5) * F.lit(GOLDEN)
    i = i.withColumn("_u", product - F.floor(product))
    i = i.select(cell(F.col("_u")).alias("_cell"), "_u", "slot", F.lit(None).cast("bigint").alias("_place"),
                 F.lit(None).cast(starts.schema["_s"].dataType).alias("_s"))
    # a source that starts at a slot's very point holds it: sources first
    so_far = (Window.partitionBy("_cell").orderBy("_u", F.col("slot").asc_nulls_first(), "_place")
              .rowsBetween(Window.unboundedPreceding, 0))
    i = (starts.unionByName(i).withColumn("_s", F.last("_s", ignorenulls=True).over(so_far)).where("slot IS NOT NULL")
         .select("slot", F.col("_s.at").alias("_at"), F.col("_s.source").alias("_source"), F.col("_s.blocks").alias("_blocks"),
                 F.floor(F.col("slot") / STRETCH).alias("_stretch")))
    before = Window.partitionBy("_at").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = (i.groupBy("_at", "_stretch").agg(F.count("*").alias("_n"))
            .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    within = Window.partitionBy("_at", "_stretch").orderBy("slot")
    return (i.withColumn("_r", F.row_number().over(within) - 1).join(base, ["_at", "_stretch"])
            .withColumn("rank", F.col("_r") + F.col("_base"))
            .select("slot", "_source", "rank", (F.col("rank") % F.col("_blocks")).alias("block"),
                    F.floor(F.col("rank") / F.col("_blocks")).alias("epoch"))
            .where(F.col("epoch") < most))  # rounding may deal a source a slot more than its limit


class Mixture:
    """The mixture of ``docs`` (doc_id, source, text)."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK):
        prepare(docs.sparkSession)
        #: doc_id, _source, size, _order, start; source and start name a document of size above 0
        self.documents = stored(streams(stored(sized(docs), "mix-sizes")), "mix-streams")
        per_source = stored(self.documents.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
        #: _source, source_size, n (documents), weight, target
        self.sources = stored(targets(source_weights(per_source, weights), share, most), "mix-targets")
        #: slot, _source, rank, block, epoch
        self.schedule = schedule(self.sources, block, most)
        self.block = block

    def pieces(self) -> DataFrame:
        """Each document's share of each block it touches; a document of size 0 has one row without a block."""
        d, b = self.documents, self.block
        end = F.col("start") + F.col("size")
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
        return (d.withColumn("_block", F.explode_outer(blocks))
                .withColumn("first_word", F.greatest(F.col("start"), F.col("_block") * b) - F.col("start"))
                .withColumn("last_word", F.least(end, (F.col("_block") + 1) * b) - F.col("start")))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken (words the mixture takes, repeats counted), one row per document."""
        times = self.schedule.groupBy(F.col("_source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("_times"))
        p = self.pieces()
        words_ = (F.col("last_word") - F.col("first_word")) * F.col("_times")
        per_doc = (p.join(times, p["_source"].eqNullSafe(times["_s"]) & (p["_block"] == times["_b"]), "left")
                   .groupBy("doc_id", "_source", "_order", "size", "start")
                   .agg(F.coalesce(F.sum(words_), F.lit(0)).alias("taken"), F.sum(F.lit(1)).alias("_rows")))
        # documents of size 0 that repeat fall into one group: one row each
        copies = F.when(F.col("size") == 0, F.col("_rows")).otherwise(1)
        per_doc = per_doc.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        name = F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("none")).alias("_name")
        s = self.sources.select(name, "n", "source_size", "target")
        total = self.sources.agg(F.sum("n")).first()[0] or 0
        facts = per_doc.select("doc_id", "size", "taken", "start", "_copy", name)
        return lookup_hot(facts, s, "_name", total).select("doc_id", "size", "source_size", "target", "taken")

    def spans(self) -> DataFrame:
        """slot, epoch, _source, start, doc_id, first_word, last_word: what each slot takes (words from 0, last excluded)."""
        p = self.pieces()
        b = self.schedule.select(F.col("_source").alias("_s"), F.col("block").alias("_b"), "slot", "epoch")
        return (p.join(b, p["_source"].eqNullSafe(b["_s"]) & (p["_block"] == b["_b"]))
                .select("slot", "epoch", "_source", "start", "doc_id", "_order", "size", "first_word", "last_word"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture: a row for each epoch that takes words of a document.

    Columns of ``docs``; ``text`` is whole where the epoch takes all words, else the words taken joined by
    single spaces (at the end of a source's last epoch); n_chars follows the text.
    """
    m = Mixture(docs, **how)
    # a document's blocks are neighbours, and an epoch takes blocks in order: its words are one stretch
    parts = (m.spans().groupBy("_source", "start", "doc_id", "_order", "size", "epoch")
             .agg(F.min("first_word").alias("_first"), F.max("last_word").alias("_last"))
             .select("doc_id", "_order", "start", "size", "epoch", "_first", "_last"))
    # rows that repeat have the same id and hash: number them on both sides
    same = Window.partitionBy("doc_id", "_order")
    parts = (parts.withColumn("_copy", F.dense_rank().over(same.orderBy("start")))
             .select(F.col("doc_id").alias("_id"), F.col("_order").alias("_o"), "_copy", "size", "_first", "_last"))
    keyed = docs.withColumn("_order", place(F.col("doc_id"), F.col("text")))
    keyed = keyed.withColumn("_copy", F.row_number().over(same.orderBy("_order")))
    j = keyed.join(parts, keyed["doc_id"].eqNullSafe(parts["_id"]) & (keyed["_order"] == parts["_o"])
                   & (keyed["_copy"] == parts["_copy"]))
    whole = (F.col("_first") == 0) & (F.col("_last") == F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("_first") + 1).cast("int"),
                               (F.col("_last") - F.col("_first")).cast("int")), " ")
    out = {c: keyed[c] for c in docs.columns}
    out["text"] = F.when(whole, keyed["text"]).otherwise(cut)
    if "n_chars" in out:
        out["n_chars"] = F.length(out["text"]).cast("bigint")
    return j.select(*[c.alias(name) for name, c in out.items()])
