"""The corpus pipeline: quality, near duplicates, test items, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. `run` writes each stage's result to the shared folder and reads it again, so that lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisloom.llm import decontaminate, pieces, pii, quality, simhash
from axisloom.llm.common import saved, table
from axisloom.llm.queries import PIECES


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rows that score under 0.3 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the row of the smallest doc_id of each group stays."""
    return simhash.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: what a text shares with test items is cut out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: entities become surrogates."""
    return pii.replaced(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: token ids in place of the text."""
    out = pieces.encoded(docs, pieces.Vocabulary.read(PIECES()))
    return out.select("doc_id", "lang", "source", "n_chars", "ids")


STAGES = [("quality", good), ("near_dedup", different), ("decontamination", unseen), ("pii", anonymous), ("pieces", tokens)]

#: Quality scores, verified near duplicates, Feistel permutations and Viterbi have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
