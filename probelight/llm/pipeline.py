"""A corpus from raw documents to token ids, stage by stage; each stage's output is written and read again.

Cases, by stage. Null doc_ids, sources and texts: scored (a null text like an empty one), kept apart from all groups,
left as they are by redaction, mixed as a source of their own, and tokenised to nothing. Empty texts likewise. Texts
of any length are read whole by every stage. Repeated rows: one stays after near-dedup; rows of one doc_id with
different texts stay each. Columns beyond those of documents come through the first four stages under any names. An
empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, mixing, near_dup, pii, quality
from .common import Scratch, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs, words=5, share=0.8)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in global hash order."""
    return mixing.poisson_mix(docs).drop(*mixing.ADDED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes decoded from them, for every copy."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(docs, ranks), ranks)


STAGES = [
    ("quality", good_documents),
    ("near-dedup", without_near_duplicates),
    ("pii", redacted),
    ("mixing", mixed),
    ("bpe", tokens),
]

# Fitted models, minhashing and tokenisation have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept; the table before goes when a stage has been written."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
