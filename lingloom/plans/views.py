"""Views over the given tables, for both engines: the same expressions as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..sources.tables import GLOSSARY, segments_from_pattern, segments_from_text

LATIN = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI = "".join(chr(0x0915 + k) for k in range(26))
PARAGRAPH = r"<p>((?s:.*?))</p>"
#: Terms over the tables' own languages, some with a domain.
TERMS = [
    ("the", "en", "fr", "le", None, None),
    ("and", "en", "fr", "et", "legal", "conjunction"),
    ("of", "en", "hi", "का", "medical", None),
    ("le", "fr", "en", "the", None, "article"),
    ("und", "de", "en", "and", "general", None),
    ("de", "es", "en", "of", None, None),
    ("de", "es", "hi", "का", "medical", None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """df over all cores. A table of fewer partitions than per_core for each core is dealt out once, before work on its
    texts; a larger one is left as it is. A few partitions for each core, some of them without a row group, are uneven:
    work that is dear beside a shuffle of its table is dealt out finer."""
    tasks = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def seg_doc_of(documents: DataFrame) -> DataFrame:
    return segments_from_text(documents, "text", ["doc_id", "lang"])


def seg_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg_doc_of(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


def seg_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_from_pattern(spread(table(spark, sf_dir, "pages"), 4), "html", PARAGRAPH, ["page_id", "url"])


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_of(seg_doc(spark, sf_dir))


def pair_of(segments: DataFrame) -> DataFrame:
    s, case = F.col("source_text"), F.col("doc_id") % 4
    swapped = F.array_join(F.transform(F.split(s, " ", -1), lambda w, k: F.when(k % 2 == 1, F.reverse(w)).otherwise(w)), " ")
    target = F.when(case == 0, s).when(case == 1, F.translate(F.lower(s), LATIN, DEVANAGARI)).when(case == 2, swapped).otherwise("")
    to = F.when(case == 1, "hi").when(F.col("lang") == "en", "fr").otherwise("en")
    return segments.withColumns({"target_text": target, "source_lang": F.col("lang"), "target_lang": to})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results for most of `pair`: some missing, some failed, some with placeholders left in, some with a warning of their own."""
    i = F.col("seg_index")
    raw = F.concat("target_text", F.when(i % 13 == 5, " __TAG_1__").otherwise(""), F.when(i % 17 == 3, " __ENTITY_2__").otherwise(""))
    failed = (F.col("doc_id") % 7 == 0) & (i % 5 == 0)
    return (
        pair(spark, sf_dir)
        .where(i % 11 != 10)
        .select(
            "doc_id", "segment_id", "seg_index", "source_lang", "target_lang",
            raw.alias("translated_raw"), raw.alias("translated_text"),
            F.when(failed, "failed").otherwise("completed").alias("status"),
            F.when(failed, F.when(F.col("doc_id") % 2 == 0, "429 quota exceeded, try again in 2.5s").otherwise("model m not found")).alias("error_message"),
            F.when(i % 19 == 4, F.array(F.lit("checked twice"))).otherwise(F.array().cast("array<string>")).alias("validation_warnings"),
            F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("provider"),
        )
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_log_of(table(spark, sf_dir, "events"))


def call_log_of(e: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("long")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("batch_no"), "ts",
        F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("provider"),
        F.floor("value").cast("long").alias("latency_ms"), (k % 3).alias("retry_count"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.concat(F.lit("HTTP "), (F.lit(400) + k % 4 * 29).cast("string"), F.when(k % 2 == 0, ": rate limit, try again in 1.25s").otherwise(""))).alias("message"),
    )


def terms(spark: SparkSession) -> DataFrame:
    from ..sources.tables import GLOSSARY_SCHEMA

    return spark.createDataFrame(TERMS, GLOSSARY_SCHEMA)


# ---- the same in SQL ----


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_plain(x: str) -> str:
    return sql_trim(f"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '[{WS}]+', ' ', 'g')")


def sql_values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _segments(keep: str, pieces: str, source: str) -> str:
    return f"""SELECT {keep}, seg_index, source_raw, 'p-' || (seg_index + 1) AS segment_id, {sql_plain("source_raw")} AS source_text FROM (
  SELECT {keep}, unnest(l) AS source_raw, unnest(range(len(l))) AS seg_index FROM (SELECT {keep}, list_filter({pieces}, lambda x: {sql_trim("x")} <> '') AS l FROM {source}))"""


VIEWS = {
    "seg_doc": _segments("doc_id, lang", "string_split(text, chr(10))", "documents"),
    "seg_page": _segments("page_id, url", "regexp_extract_all(html, '<p>([\\s\\S]*?)</p>', 1)", "pages"),
    "pair": f"""SELECT *, CASE doc_id % 4 WHEN 0 THEN source_text WHEN 1 THEN translate(lower(source_text), '{LATIN}', '{DEVANAGARI}')
  WHEN 2 THEN array_to_string(list_transform(string_split(source_text, ' '), lambda w, k: CASE WHEN k % 2 = 0 THEN reverse(w) ELSE w END), ' ') ELSE '' END AS target_text,
  lang AS source_lang, CASE WHEN doc_id % 4 = 1 THEN 'hi' WHEN lang = 'en' THEN 'fr' ELSE 'en' END AS target_lang FROM seg_doc""",
    "results": """SELECT doc_id, segment_id, seg_index, source_lang, target_lang, raw AS translated_raw, raw AS translated_text, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN bad THEN CASE WHEN doc_id % 2 = 0 THEN '429 quota exceeded, try again in 2.5s' ELSE 'model m not found' END END AS error_message,
  CASE WHEN seg_index % 19 = 4 THEN ['checked twice'] ELSE [] END AS validation_warnings, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider
  FROM (SELECT *, target_text || CASE WHEN seg_index % 13 = 5 THEN ' __TAG_1__' ELSE '' END || CASE WHEN seg_index % 17 = 3 THEN ' __ENTITY_2__' ELSE '' END AS raw, (doc_id % 7 = 0 AND seg_index % 5 = 0) AS bad FROM pair WHERE seg_index % 11 <> 10)""",
    "call_log": """SELECT user_id AS job_id, event_id AS batch_no, ts, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, CAST(floor(value) AS BIGINT) AS latency_ms, k % 3 AS retry_count,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'HTTP ' || (400 + k % 4 * 29) || CASE WHEN k % 2 = 0 THEN ': rate limit, try again in 1.25s' ELSE '' END END AS message
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "terms": f"SELECT * FROM (VALUES {sql_values(TERMS)}) t(source_term, source_lang, target_lang, preferred_translation, domain, note)",
    "glossary": f"SELECT * FROM (VALUES {sql_values(GLOSSARY)}) t(source_term, source_lang, target_lang, preferred_translation, domain, note)",
}
NEEDS = {"pair": ["seg_doc"], "results": ["seg_doc", "pair"]}


def with_views(query: str, *names: str) -> str:
    """query behind WITH clauses of the views it names and of those that they need."""
    wanted: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    query = query.strip()
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted]
    if parts and query.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + query[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query
