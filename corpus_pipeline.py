"""Corpus pipeline: five stages of the corpus operators, each applied to all that its predecessor kept.

A stage takes documents (doc_id, text, lang, source, n_chars and any other columns) and returns
documents; the last returns tokens. ``run`` writes every stage's result to the shared
folder before the next begins, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mktpulse.llm import cdc_dedup, importance, lsh_forest, mixing, sentencepiece_bpe
from mktpulse.llm.common import prepare, read_table, stored


def quality(spark, docs, sf_dir):
    """Quality classifier: documents that the importance sample does not draw go."""
    return importance.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """N-gram Jaccard join: one document of each class stays, that with the smallest doc_id."""
    return lsh_forest.one_per_class(docs)


def substrings(spark, docs, sf_dir):
    """Substring dedup: later occurrences of repeated passages are cut out; a document with nothing left goes."""
    d = cdc_dedup.dedup_substrings(docs)
    left = F.length(F.coalesce(F.col("text"), F.lit("")))
    return (d.where((left > 0) | (F.col("_before") == 0))
            .withColumn("n_chars", left.cast("bigint")).select(*docs.columns))


def mix(spark, docs, sf_dir):
    """Mixing sources to target weights: a row for each epoch that takes words of a document."""
    return mixing.mixed_documents(docs)


def tokenize(spark, docs, sf_dir):
    """SentencePiece encoding and decoding: token count, digests of the ids and of the decoded text."""
    return sentencepiece_bpe.token_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mix),
    ("SentencePiece", tokenize),
]

#: No SQL has the hashed models, min-hashes, chunk ends and subword merges of these stages; the
#: tests compare each stage's operator with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{at + 1}")
    return docs
