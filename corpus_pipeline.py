"""A training corpus in five stages: quality rules, exact and near dedup, mixing to source weights, byte-level BPE.

Every stage takes (spark, docs, folder of the tables) and works on all rows that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import byte_bpe, exact_dedup, minhash, mixing, quality_rules
from sievewright.llm.common import cut, discard, passing, table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.rules_stage(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], ids=True).drop("decoded")


STAGES = [
    ("quality rules", apply_quality_rules),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The rules' trees, MinHash and the merges can't be stated in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # What a stage wrote on its way goes when its rows are written, and these go when the next stage's are.
        with passing() as stay:
            kept = cut(stage(spark, docs, sf_dir))
            stay.append(kept)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
