"""The corpus pipeline: documents in, token files out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.decontaminate import drop_leaking
from loupe.llm.mixing import mix_documents
from loupe.llm.quality import fit_quality, keep_quality
from loupe.llm.queries import MIX, domain, ratings, table, tokenizer_path
from loupe.llm.simhash import keep_one_per_group
from loupe.llm.store import written
from loupe.llm.tokenfile import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier gives at least even odds of a grade of 1 or more."""
    return keep_quality(docs, fit_quality(docs, ratings(spark, sf_dir)), least=1, at_least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (3-word shingles, at most 2 bits)."""
    return keep_one_per_group(docs, shingle=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by domain, language and source budgets, once for every epoch that takes them."""
    return mix_documents(docs, domain(), MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; start, length and checksum of every document read back from them."""
    return read_token_files(spark, write_token_files(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: SQL cannot fit the classifier or run the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
