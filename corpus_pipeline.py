"""The training-text pipeline: named stages over the documents table.

Each stage takes (spark, docs, sf_dir) and reads its docs as they are; all but the last
return the columns of its docs, whatever they are called.

Defined results
- null text counts as empty; an empty table stays empty; texts may have any length.
- rows without doc_id are judged by quality and decontamination like others; the two duplicate stages keep them all.
- rows that repeat doc_id and text are one document, of which the duplicate stages leave one row; of a doc_id with several texts each text is a document of its own.
- ties: of equal texts the largest doc_id stays, of near copies the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm import bpe, decontam, exact_dedup, minhash, quality
from bramble.llm.common import bounded_batches, table
from bramble.llm.queries import quality_model, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    bounded_batches(spark)
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = "_".join(["score", *docs.columns])  # a name that no column has
    return quality.score(docs, model, out=score).filter(F.col(score) >= 0.3).select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    bounded_batches(spark)
    return exact_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five words, 0.8)."""
    bounded_batches(spark)
    return minhash.drop_near_duplicates(docs, minhash.Params(words=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a passage with the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text and what they decode to."""
    bounded_batches(spark)
    coded = bpe.encode(docs, tokenizer_path(), ids="ids", decoded="decoded", keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]
ORACLE_SQL = None  # the classifier and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    from bramble.llm.common import materialize

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
