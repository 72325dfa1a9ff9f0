"""Lookups in the small fixed dimension tables; each is broadcast, its size does not depend on the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_language(df: DataFrame, code: str, languages: DataFrame, prefix: str = "") -> DataFrame:
    """df with label, is_rtl, script_note and rules of a language code; unknown codes are their own label."""
    dim = F.broadcast(languages.select(F.col("code").alias("_code"), F.col("name").alias("_name"), F.col("native_name").alias("_native"), F.col("direction").alias("_dir"), F.col("rules").alias("_rules")))
    c = F.col(code)
    label = F.coalesce(F.concat("_name", F.lit(" ("), "_code", F.lit(")")), c)
    note = F.when(F.col("_native") != F.col("_name"), F.concat(F.lit(" Write the output in "), label, F.lit(" script ("), "_native", F.lit("), not in Latin letters."))).otherwise("")
    out = df.join(dim, c == F.col("_code"), "left")
    return out.withColumns({f"{prefix}label": label, f"{prefix}is_rtl": F.coalesce(F.col("_dir") == "rtl", F.lit(False)), f"{prefix}script_note": note, f"{prefix}rules": F.coalesce("_rules", F.array().cast("array<string>"))}).drop("_code", "_name", "_native", "_dir", "_rules")


def output_name(df: DataFrame, file_name: str, target_lang: str, languages: DataFrame, out: str = "output_name") -> DataFrame:
    """<base>_<language name in lower case><extension>; only the last extension is parted, an unknown code is its own name."""
    dim = F.broadcast(languages.select(F.col("code").alias("_code"), F.lower("name").alias("_lname")))
    ext = F.regexp_extract(F.col(file_name), r"[^/](\.[^./]*)$", 1)
    base = F.regexp_extract(F.expr(f"left(`{file_name}`, length(`{file_name}`) - length(regexp_extract(`{file_name}`, '[^/](\\\\.[^./]*)$', 1)))"), r"([^/]*)$", 1)
    name = F.concat(base, F.lit("_"), F.coalesce("_lname", F.lower(F.col(target_lang))), ext)
    return df.join(dim, F.col(target_lang) == F.col("_code"), "left").withColumn(out, name).drop("_code", "_lname")


def glossary_for(pairs: DataFrame, glossary: DataFrame, domain: str = "universal") -> DataFrame:
    """pairs(source_lang, target_lang, ...) with the terms of their languages: codes compare exactly, a term without a
    domain fits any, and a universal or empty request takes all."""
    open_request = domain in ("", "universal")
    fits = F.lit(True) if open_request else F.col("g.domain").isNull() | (F.col("g.domain") == domain)
    p, g = pairs.alias("p"), F.broadcast(glossary).alias("g")
    return p.join(g, (F.col("p.source_lang") == F.col("g.source_lang")) & (F.col("p.target_lang") == F.col("g.target_lang")) & fits).select("p.*", "g.source_term", "g.preferred_translation", "g.domain", "g.note")


def glossary_section(terms: Column) -> Column:
    """Lines for an array of (source_term, preferred_translation, note)."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('- "'), t["source_term"], F.lit('" -> "'), t["preferred_translation"], F.lit('"'), F.coalesce(F.concat(F.lit(" ("), F.nullif(t["note"], F.lit("")), F.lit(")")), F.lit("")))), "\n")
