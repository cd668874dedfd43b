"""The corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents`` (and any others that the input has).

Defined cases: an empty table passes through every stage; a null text is scored, compared, scanned, mixed and packed as
an empty one (it has no near-duplicates); a null doc_id stays where its text does; repeated rows are scanned and packed
each for itself, share their fate in the first two stages, and are drawn one by one by the mix; long texts are processed
whole; columns whose names clash with internal ones keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import minhash, mixing, packing, quality, secretscan, tokenfile
from evalspark.llm.common import read, ship_package
from evalspark.llm.tokens import public_vocabulary


#: Stage 2 links documents whose five-word shingle sets are this alike or more; op10 alone links at its own 85.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship_package(spark)
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without words all stay."""
    ship_package(spark)
    return minhash.drop_near_duplicates(docs, NEAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows; no document goes."""
    return secretscan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: complete epochs repeat it, the fractional rest selects by key."""
    return mixing.apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with the sequence and offset at which they are packed."""
    ship_package(spark)
    return packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Trees and a tokenizer decide the rows, which SQL cannot express; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; what each stage returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    base = tokenfile.scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
