"""The training-data pipeline: toxicity filter, near duplicates, benchmark decontamination, PII surrogates, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last return
the columns of documents. Every stage's decision takes effect: toxic documents, all but the first of each group of near
duplicates and documents that leak a benchmark item go; personal data are replaced; the rest becomes token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, decontaminate, jaccard, pii, queries, toxicity
from folioframe.llm.runtime import persisted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: Pieces that a worker of the last stage keeps; small, as the workers outlive the stage.
CACHED_PIECES = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic."""
    scored = toxicity.score(docs, queries.toxic_chain(spark, docs, sf_dir), keep=COLUMNS)
    return scored.where(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of smallest doc_id, and those without words; see jaccard.first_of_groups."""
    return jaccard.first_of_groups(docs.select(*COLUMNS), k=SHINGLE_WORDS, num=SIMILARITY_PERCENT, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars counts the new text."""
    done = pii.replace(docs, queries.PII_KEY, keep=("doc_id", "lang", "source", "n_chars"))
    done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))
    return done.select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of a round trip."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), digests=True, cache=CACHED_PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", replace_pii),
    ("tokens", to_tokens),
]

#: Classifiers and approximate matching are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = persisted(docs, name)
    return docs
