"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that the next one gets
as its docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import line_dedup, mixing, ordinal, pieces, simhash
from sluice.llm.common import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects to be good; toxic and junk ones go."""
    model = ordinal.fit(docs, ordinal.ratings(read(spark, sf_dir, "labels")), grades=3)
    return ordinal.select(docs, model, grade=2, at_least=ordinal.KEEP_FROM)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; those with nothing left go."""
    return line_dedup.clean(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8
    or more; every such pair is found."""
    return simhash.dedup(docs, words=5, min_similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, exact) of every document of the mix."""
    return pieces.encode(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The stages learn, follow links and fit budgets, which SQL can't express;
#: tests/llm/test_pipeline.py checks each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is materialised in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
