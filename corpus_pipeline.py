"""From raw documents to packed training sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written to
the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvoice.llm import best_fit, decontaminate, secret_scan, simhash_trie, toxicity
from shelfvoice.llm.common import stage, table, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: Words of a shingle, and differing bits of two fingerprints up to which documents are near copies.
SHINGLE, NEAR_BITS = 3, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network trained on the labels rejects go; all others stay with their columns.

    Null texts are scored as empty ones. Repeated rows share their fate, a null
    id only means that no label belongs to the row. An empty table stays empty.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, with its columns.

    Null and empty texts are one group. Repeated rows are copies of each other;
    a null id comes after all others. An empty table stays empty.
    """
    return simhash_trie.one_of_each(docs, shingle=SHINGLE, radius=NEAR_BITS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; all others stay with their columns, null and empty texts too."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten; every row stays, null texts as they are.

    ``n_chars`` follows the text where the table has it; other columns are kept.
    """
    made = secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark)))
    return made.withColumn("n_chars", F.length("text").cast(made.schema["n_chars"].dataType)) if "n_chars" in made.columns else made


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens; a null text is an empty one, which still has its end mark."""
    return best_fit.pack(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_copy),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: A trained network, groups of near copies and packing are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
