"""The training-corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setphrase.llm import exact_dedup, langid, mixing, packing, simhash
from setphrase.llm.common import crc32_of_id, fresh, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is recognised; those without any letter go."""
    model = langid.train(docs, F.pmod(crc32_of_id("doc_id"), F.lit(4)) != 2)
    pred, score = fresh(docs.columns, "lang_pred", "score")
    found = langid.identify(docs, model, pred_col=pred, score_col=score)
    return found.where(F.col(pred) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near-duplicates, the smallest id of each group stays."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the tempered shares of sources, languages and kinds of content."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences of at most 2048 tokens."""
    return packing.pack(docs, size=2048, end_id=0)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Kernels, SimHash and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them lies in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
