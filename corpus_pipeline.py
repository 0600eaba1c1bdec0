"""A corpus pipeline: quality, near-duplicates, secrets, mixing, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewright.llm.common import Stash, small_batches
from candlewright.llm.minhash import one_of_each
from candlewright.llm.mixing import labelled_domains, mix_documents, production_factors
from candlewright.llm.packing import pack_documents
from candlewright.llm.quality import keep_good
from candlewright.llm.secrets import redact

#: SQL can't express the classifier, MinHash or packing; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts (op9, keep_good). Null and empty texts are scored like texts without
    words; rows that repeat are kept or go together; a row without a doc_id is judged by its text."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Stash(spark, "pipeline-quality"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (op5, one_of_each): the one of smallest doc_id, without one last. Rows
    are judged by their own texts, also where they repeat a doc_id; rows without words all stay."""
    return one_of_each(docs, Stash(spark, "pipeline-near"), width=5, similarity=(80, 100))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by [kind] and n_chars counted anew (op2, redact). Null texts stay
    null; every row is searched, also one that repeats or has no doc_id."""
    return redact(docs, Stash(spark, "pipeline-secrets"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or dropped by their rates, for domain totals at the production targets (op6, mix_documents). Null
    and empty texts have the prior as posterior; rows that repeat a doc_id and text get equal rates and copies."""
    stash = Stash(spark, "pipeline-mixing")
    labelled = stash.put(labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "domains")
    return mix_documents(docs, labelled, stash, factors=production_factors(labelled))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in training sequences (op3, pack_documents). Null and empty texts are an end id alone; each
    row that repeats is packed, and a null doc_id stays null."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. A stage's table is deleted when the next one's is written."""
    stash, before = Stash(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            stash.drop(before)
        before = docs
    return docs
