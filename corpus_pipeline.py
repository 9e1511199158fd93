"""A training corpus from documents: STAGES are (name, function) pairs, each function (spark, docs, sf_dir) -> DataFrame.

A stage's result is written as Parquet and read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenrel.llm import bitplane, decontaminate, jaccard_join, mixing, quality
from lumenrel.llm._common import materialise, read_table
from lumenrel.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 1."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word shingles and a similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, similarity=(80, 100))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"), exact=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return bitplane.read_documents(bitplane.encode_documents(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", keep_quality),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mix", mix_sources),
    ("token output", write_tokens),
]

#: The classifier and the tokenizer have no SQL form; tests compare run() with the stages applied by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
    return docs
