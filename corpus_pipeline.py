"""From raw documents to tokens: quality, near duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the
columns of `docs`:

1. quality      drops the documents that the classifier with its site posteriors rejects;
2. near_dedup   keeps one document of each group (five-word shingles, similarity of 0.8 or more);
3. benchmark    drops the documents that hold a window of ten words of a benchmark item;
4. secrets      replaces secrets by a mark and brings n_chars up to date;
5. encode       adds token_ids and decoded_text.

An empty table passes through all stages; nulls, empty texts and repeated rows are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import bpe, secrets
from tideline.llm.common import table, written
from tideline.llm.decontaminate import contaminated
from tideline.llm.near_dedup import without_near_duplicates
from tideline.llm.quality import judged
from tideline.llm.queries import vocabulary_path


def guarded(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """`docs` with all but the used columns out of the operators' way, and the columns that bring the names back."""
    names = {c: f"_own_{k}_" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", *used)}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, own = guarded(docs, "source", "lang")
    return judged(held, table(spark, sf_dir, "labels")).where("accepted").select(own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, own = guarded(docs)
    return without_near_duplicates(held).select(own)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, own = guarded(docs)
    return contaminated(held, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(own)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, own = guarded(docs)
    clean = secrets.redacted(held).select(own)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary_path(), decode=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("benchmark", benchmark), ("secrets", mask_secrets), ("encode", encode)]
#: Fitted and iterative stages have no SQL form; tests hold the rows against plain recomputation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
