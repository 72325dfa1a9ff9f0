"""A corpus pipeline: documents in, token ids of the documents worth training on out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. Near-duplicate and benchmark stages take shingles of five words and a similarity of 0.8.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.llm import bpe, decontaminate, jobs, line_dedup, near_dup, quality
from lingloom.llm.queries import bpe_path, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on rated ones of docs, does not reject.

    A null or empty text is judged by its emptiness; rows that repeat an id are judged each by its text; null ids
    cannot be rated and are judged as all others. Without two rated grades, as in an empty table, every row stays.
    """
    jobs.small_batches(spark)
    model = quality.fit(docs, quality.ratings_of_labels(table(spark, sf_dir, "labels")))
    return quality.select_documents(docs, model, grade=1, least=0.4)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than a tenth of their source's documents have; n_chars follows the text.

    Copies count once: the next stage keeps one of them, which has to have its text still. A null source is a source of
    its own. A null text stays null, with null n_chars; a text of such lines only becomes empty, and its row stays.
    """
    out = line_dedup.drop_boilerplate_from_text(docs, "source", "doc_id", "text", ratio=0.1, min_pages=3, copies_once=True)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id.

    Documents without words, null texts and rows of null id are near nothing and all stay. An id goes or stays with all
    of its rows.
    """
    groups = near_dup.near_duplicates(docs, "doc_id", "text", words=5, percent=80)
    gone = jobs.saved(groups.where("not kept").select(F.col("doc_id").alias("__ll_gone")).distinct())
    return docs.join(jobs.side(gone, 32), F.col("doc_id") == F.col("__ll_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; a row of null id stays; an id goes with all
    of its rows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", n_words=5, percent=80)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row, null and repeated ids too, and the hash of the text that decoding gives. A null
    or empty text has no ids and decodes to ''."""
    coded = bpe.encode(docs, bpe_path(), "text", "doc_id", decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", tokenize),
]

#: Not SQL: a fitted classifier, similarity components and byte-pair encoding. Stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written to the shared checkpoint folder and reread."""
    jobs.with_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{home}/{k}-{name}")
            docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
