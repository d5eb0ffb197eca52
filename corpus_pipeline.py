"""A corpus made ready for training: toxic documents go, near-duplicates are reduced to one, secrets are masked, sources are mixed, sequences are packed.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Stages meet as Parquet in the shared folder. A stage begins by dropping the tables that
earlier ones wrote on their way, so a stage's result must be written before the next stage is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sediment.llm import dedup, mixing, packing, secrets, toxicity
from sediment.llm.common import discard, materialize, own_tables, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; null and empty texts stay, and each repeated row is judged alike."""
    with own_tables(spark):
        return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays: of equal rows one, of null and empty texts together one."""
    with own_tables(spark):
        return dedup.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked and n_chars follows; every row stays, null texts as they are."""
    with own_tables(spark):
        return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by rates that bring the domains' tokens to the target shares.

    Equal rows have equal rates and chances; without labels or tokens every row stays once.
    """
    with own_tables(spark):
        return mixing.mixed(docs, mixing.domains_of(table(spark, sf_dir, "labels")), keep="good")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut into pieces and packed into sequences; a null text is its end token, repeated rows are documents of their own."""
    with own_tables(spark):
        return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("minhash_dedup", dedup_stage), ("secret_scan", secrets_stage), ("mix_sources", mixing_stage), ("best_fit", packing_stage)]

#: The stages learn, hash and pack: SQL can't say the same. tests/llm/test_pipeline.py holds what each stage keeps,
#: masks, repeats and packs against plain Python on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole pipeline, as a written table; what the stages wrote on their way is deleted.

    Nulls, repeated rows, empty tables and further columns are as each stage's operator says.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(last)
    with own_tables(spark):
        return docs
