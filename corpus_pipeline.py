"""The training-corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as
Parquet in the shared scratch folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquilon.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from aquilon.llm.common import release, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Repeated rows and rows with null ids or texts are judged each by its text."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 the one with the smallest doc_id stays; rows without words stay."""
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and runs of sentences are cut out where they stood earlier; n_chars follows the text. Null texts stay null."""
    spans = "removed"
    while spans.lower() in [c.lower() for c in docs.columns]:
        spans += "_"
    cut = substring_dedup.dedup_units(docs, column=spans)
    return cut.select([F.length("text").cast("long").alias(c) if c == "n_chars" else cut[c] for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; rows without words stay, and so do all if the benchmark is empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised, in sequences of at most 4096 tokens; a null text is one end id."""
    import public_tokenizers  # here, so that the module can be imported without it

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # tokens and packing are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
            release(spark)
    return docs
