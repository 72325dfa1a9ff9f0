"""Segments out of text tables, and the synthetic and dimension tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, is_blank, plain_text

#: The built-in terminology (term, source, target, translation, domain, note).
GLOSSARY = [
    ("Informed Consent", "en", "hi", "सूचित सहमति", "medical", "Standard clinical trial terminology"),
    ("Consent Form", "en", "hi", "सहमति पत्र", "medical", None),
    ("Clinical Trial", "en", "hi", "नैदानिक परीक्षण", "medical", None),
    ("Adverse Event", "en", "hi", "प्रतिकूल घटना", "medical", None),
    ("Principal Investigator", "en", "hi", "प्रधान अन्वेषक", "medical", None),
    ("Informed Consent", "en", "gu", "જાણકારી સંમતિ", "medical", None),
    ("Consent Form", "en", "gu", "સંમતિ પત્ર", "medical", None),
    ("Clinical Trial", "en", "gu", "ક્લિનિકલ ટ્રાયલ", "medical", None),
    ("Informed Consent", "en", "ur", "باخبر رضامندی", "medical", None),
    ("Consent Form", "en", "ur", "رضامندی فارم", "medical", None),
    ("Clinical Trial", "en", "ur", "طبی آزمائش", "medical", None),
    ("Liability", "en", "hi", "दायित्व", "legal", None),
    ("Indemnity", "en", "hi", "क्षतिपूर्ति", "legal", None),
    ("Jurisdiction", "en", "hi", "न्यायक्षेत्र", "legal", None),
]
GLOSSARY_SCHEMA = "source_term string, source_lang string, target_lang string, preferred_translation string, domain string, note string"
DOMAIN = ("universal", "Universal Contextual", "Infer the subject matter from the segment and its context, whatever the document is, and choose terminology, register and style from it.")


def segments_of(df: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    """One row for each non-blank piece of an array column, densely numbered inside its row; no shuffle."""
    rows = df.select(*keep, F.posexplode(F.filter(pieces, lambda x: ~is_blank(x))).alias("seg_index", "source_raw"))
    return rows.withColumn("segment_id", F.concat(F.lit("p-"), (F.col("seg_index") + 1).cast("string"))).withColumn("source_text", plain_text(F.col("source_raw")))


def segments_from_text(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, split: str = "\n") -> DataFrame:
    return segments_of(df, F.split(F.col(text_col), split, -1), keep or ["doc_id"])


def segments_from_pattern(df: DataFrame, text_col: str, pattern: str, keep: list[str]) -> DataFrame:
    return segments_of(df, F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1)), keep)


def synthetic_segments(spark: SparkSession, n: int) -> DataFrame:
    """n numbered sentences of one document, for load tests."""
    i = F.col("id") + 1
    rows = spark.range(n).select(F.lit("synthetic").alias("doc_id"), F.col("id").cast("int").alias("seg_index"), F.concat(F.lit("seg-"), i.cast("string")).alias("segment_id"), F.format_string("This is test sentence number %d for load measurement.", i).alias("source_raw"))
    return rows.withColumn("source_text", plain_text(F.col("source_raw")))


def languages(spark: SparkSession, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """The built-in languages; rules are a caller's own, by code: none are built in."""
    rows = [(*r, (rules or {}).get(r[0], [])) for r in LANGUAGES]
    return spark.createDataFrame(rows, "code string, name string, native_name string, direction string, rules array<string>")


def default_glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, GLOSSARY_SCHEMA)


def with_user_terms(glossary: DataFrame, terms: list[tuple]) -> DataFrame:
    """Built-in and a user's own terms together, none taken out."""
    return glossary.unionByName(glossary.sparkSession.createDataFrame(terms, GLOSSARY_SCHEMA))


def domains(spark: SparkSession) -> DataFrame:
    """One profile whatever domain is asked for."""
    return spark.createDataFrame([DOMAIN], "code string, name string, instructions string")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what jobs keep between stages. Only a local session without one gets a folder
    of its own: on a cluster each machine would write to its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return shared or tempfile.mkdtemp(prefix="lingloom-")
