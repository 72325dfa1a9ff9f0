"""Queries of the validation checks, issues, reports and gates (V, U3-U5, M1-M3, M8-M10, K4-K5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.completeness import cleaned, held, script_count, with_completeness
from ..functions.protect import find_tokens
from ..functions.text import SCRIPT_RANGES, WS
from ..operators import validate
from . import views as V
from .queries_text import SQL_NUMBER, entity_steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = V.with_views(sql, *needs)
        return fn

    return register


def sql_clean(x: str) -> str:
    for p in ("__TAG_[0-9]+__", "__ENTITY_[0-9]+__", rf"https?://[^{WS}]+|www\.[^{WS}]+", rf"[^{WS}]+@[^{WS}]+\.[^{WS}]+", SQL_NUMBER):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return V.sql_trim(f"regexp_replace({x}, '[^\\p{{L}}{WS}]', ' ', 'g')")


def sql_script(text: str, lang: str) -> str:
    return "CASE lower(" + lang + ") " + " ".join(f"WHEN '{c}' THEN length(regexp_replace({text}, '[^{r}]', '', 'g'))" for c, r in SCRIPT_RANGES.items()) + " END"


def sql_script_name(lang: str) -> str:
    return f"CASE WHEN lower({lang}) IN ('hi', 'mr') THEN 'hi' WHEN lower({lang}) IN ({', '.join(repr(c) for c in SCRIPT_RANGES)}) THEN lower({lang}) END"


def completeness_ctes(rows: str, source: str, target: str) -> str:
    """CTEs q_clean .. q_done over `rows` with source_lang and target_lang: q_done adds c_status and c_reason."""
    return f"""q_clean AS (SELECT *, {sql_clean(f"coalesce({source}, '')")} AS cs, {sql_clean(f"coalesce({target}, '')")} AS ct FROM {rows}),
q_words AS (SELECT *, list_filter(regexp_split_to_array(cs, '[{WS}]+'), lambda w: length(w) >= 4) AS sw, list_distinct(regexp_split_to_array(ct, '[{WS}]+')) AS tw FROM q_clean),
q_hits AS (SELECT *, len(list_filter(sw, lambda w: list_contains(tw, w))) / greatest(len(sw), 1) AS hit, {sql_script("ct", "source_lang")} AS l_in, {sql_script("ct", "target_lang")} AS t_in, coalesce(lower(source_lang) <> lower(target_lang), false) AS differ, coalesce({sql_script_name("source_lang")} = {sql_script_name("target_lang")}, false) AS same_script FROM q_words),
q_case AS (SELECT *, CASE WHEN length(cs) < 3 THEN 0 WHEN ct = '' THEN 1 WHEN regexp_matches(ct, '(?i)^(unfortunately|there is no text|here is the translation|i cannot translate|as an ai|note:)') THEN 2
  WHEN differ AND NOT same_script AND lower(source_lang) <> 'en' AND l_in > 3 AND l_in > 0.15 * length(ct) THEN 3 WHEN differ AND lower(target_lang) <> 'en' AND length(cs) >= 8 AND t_in = 0 THEN 4
  WHEN differ AND len(sw) >= 3 AND hit >= 0.70 THEN 5 WHEN differ AND len(sw) >= 3 AND hit >= 0.45 THEN 6 ELSE 0 END AS c_case FROM q_hits),
q_done AS (SELECT * EXCLUDE (cs, ct, sw, tw), CASE WHEN c_case = 0 THEN 'valid' WHEN c_case = 6 THEN 'warning' ELSE 'failed' END AS c_status,
  CASE c_case WHEN 1 THEN 'Empty target output after stripping placeholders' WHEN 2 THEN 'LLM returned conversational commentary instead of translation'
  WHEN 3 THEN 'Untranslated source script (' || source_lang || ') detected in target (' || target_lang || ') output' WHEN 4 THEN 'Target translation missing expected script characters for ' || target_lang
  WHEN 5 THEN 'Substantial source text (' || CAST(floor(hit * 100 + 0.5) AS BIGINT) || '%) left untranslated' WHEN 6 THEN 'Possible untranslated source words (' || CAST(floor(hit * 100 + 0.5) AS BIGINT) || '%) detected' END AS c_reason FROM q_case)"""


#: results with their sources, completeness and one list of issues, as CTEs.
CHECKED = (
    "joined AS (SELECT r.*, p.source_text FROM results r LEFT JOIN pair p USING (doc_id, segment_id)),\n"
    + completeness_ctes("joined", "source_text", "translated_text")
    + f""",
flat AS (
  SELECT doc_id, segment_id, seg_index, 0 AS check_no, 'api_error' AS error_type, coalesce(error_message, 'Translation failed') AS message FROM q_done WHERE status = 'failed'
  UNION ALL SELECT doc_id, segment_id, seg_index, 4, 'validation_error', 'Empty translation output for non-empty source segment' FROM q_done WHERE status = 'completed' AND {V.sql_trim("coalesce(source_text, '')")} <> '' AND {V.sql_trim("translated_text")} = ''
  UNION ALL SELECT doc_id, segment_id, seg_index, 5, 'tag_error', 'Unrestored tag tokens: ' || array_to_string(regexp_extract_all(translated_raw, '__TAG_[0-9]+__'), ', ') FROM q_done WHERE status = 'completed' AND regexp_matches(translated_raw, '__TAG_[0-9]+__')
  UNION ALL SELECT doc_id, segment_id, seg_index, 6, 'entity_error', 'Unrestored entity tokens: ' || array_to_string(regexp_extract_all(translated_raw, '__ENTITY_[0-9]+__'), ', ') FROM q_done WHERE status = 'completed' AND regexp_matches(translated_raw, '__ENTITY_[0-9]+__')
  UNION ALL SELECT doc_id, segment_id, seg_index, 8, 'validation_error', c_reason FROM q_done WHERE status = 'completed' AND {V.sql_trim("coalesce(source_text, '')")} <> '' AND c_status = 'failed'
  UNION ALL SELECT doc_id, segment_id, seg_index, -1, 'validation_error', 'Segment missing from translation results' FROM pair p WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.doc_id = p.doc_id AND r.segment_id = p.segment_id)),
firsts AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, segment_id ORDER BY check_no) AS k FROM flat) WHERE k = 1)
"""
)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return V.pair(spark, sf_dir), V.results(spark, sf_dir)


@query(f"SELECT doc_id, seg_index, {sql_clean('source_text')} AS cleaned FROM pair", "pair")
def v1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pair(spark, sf_dir).select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), cleaned(F.col("source_text")).alias("cleaned"))


@query(f"SELECT doc_id, seg_index, {sql_script('target_text', 'target_lang')} AS in_target_script FROM pair", "pair")
def v8_script_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pair(spark, sf_dir).select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), script_count(F.col("target_text"), F.col("target_lang")).cast("long").alias("in_target_script"))


@query("WITH " + completeness_ctes("pair", "source_text", "target_text") + "\nSELECT doc_id, seg_index, c_status AS status, c_reason AS reason FROM q_done", "pair")
def v2_v7_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_completeness(V.pair(spark, sf_dir), "source_text", "target_text", "source_lang", "target_lang")
    return out.select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), F.col("completeness.status").alias("status"), F.col("completeness.reason").alias("reason"))


@query(f"""SELECT doc_id, seg_index, array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(source_text, '{SQL_NUMBER}'))), lambda n: NOT list_contains(regexp_extract_all(target_text, '{SQL_NUMBER}'), n)), '|') AS missing_numbers FROM pair""", "pair")
def v9_u4_missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.array_sort(validate.missing_numbers(F.col("source_text"), F.col("target_text")))
    return V.pair(spark, sf_dir).select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), F.array_join(lost, "|").alias("missing_numbers"))


@query("SELECT doc_id, seg_index, len(list_filter(string_split(lower(source_text), ' '), lambda w: list_contains(string_split(lower(target_text), ' '), w))) AS n_common FROM pair", "pair")
def u5_word_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.split(F.lower("source_text"), " ", -1), F.split(F.lower("target_text"), " ", -1)
    rows = held(V.pair(spark, sf_dir), s=s, t=F.array_distinct(t))
    return rows.select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), F.size(F.filter("s", lambda w: F.array_contains("t", w))).cast("long").alias("n_common"))


@query("SELECT doc_id, seg_index, len(regexp_extract_all(translated_raw, '__TAG_[0-9]+__')) AS n_tags, len(regexp_extract_all(translated_raw, '__ENTITY_[0-9]+__')) AS n_entities FROM results", "results")
def v11_v12_placeholders_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("translated_raw")
    return V.results(spark, sf_dir).select("doc_id", F.col("seg_index").cast("long").alias("seg_index"), F.size(find_tokens(raw, "TAG")).cast("long").alias("n_tags"), F.size(find_tokens(raw, "ENTITY")).cast("long").alias("n_entities"))


@query("SELECT doc_id, segment_id, seg_index FROM pair p WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.doc_id = p.doc_id AND r.segment_id = p.segment_id)", "results")
def j2_missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = both(spark, sf_dir)
    return validate.missing_segments(s, r).select("doc_id", "segment_id", F.col("seg_index").cast("long").alias("seg_index"))


@query("WITH " + CHECKED + "SELECT doc_id, segment_id, seg_index, CAST(check_no AS BIGINT) AS check_no, error_type, message FROM flat", "results")
def u3_v10_v14_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.issues_of(*both(spark, sf_dir))
    return out.withColumns({"seg_index": F.col("seg_index").cast("long"), "check_no": F.col("check_no").cast("long")})


@query("WITH " + CHECKED + "SELECT doc_id, segment_id, seg_index, CAST(check_no AS BIGINT) AS check_no, error_type, message FROM firsts", "results")
def m8_first_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.first_issue(validate.issues_of(*both(spark, sf_dir)))
    return out.withColumns({"seg_index": F.col("seg_index").cast("long"), "check_no": F.col("check_no").cast("long")})


@query("WITH " + CHECKED + "SELECT doc_id, error_type, count(*) AS n FROM flat GROUP BY ALL", "results")
def m9_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_histogram(validate.issues_of(*both(spark, sf_dir)))


@query("SELECT doc_id, segment_id, seg_index FROM (SELECT *, lag(seg_index) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM (SELECT *, CASE WHEN seg_index % 6 = 2 THEN seg_index + 1.5 ELSE CAST(seg_index AS DOUBLE) END AS pos FROM results)) WHERE seg_index < b", "results")
def v15_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.results(spark, sf_dir)
    moved = r.withColumn("pos", F.when(F.col("seg_index") % 6 == 2, F.col("seg_index") + 1.5).otherwise(F.col("seg_index").cast("double")))
    return validate.out_of_order(moved).select("doc_id", "segment_id", F.col("seg_index").cast("long").alias("seg_index"))


@query("SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM results GROUP BY doc_id", "results")
def m3_job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.job_counts(V.results(spark, sf_dir))


REPORT = (
    "WITH "
    + CHECKED
    + f""",
warned AS (SELECT doc_id, count(*) AS n FROM (
  SELECT DISTINCT doc_id, segment_id, w FROM (
    SELECT doc_id, segment_id, unnest(list_concat(
      CASE WHEN status = 'completed' AND source_text IS NOT NULL THEN list_transform(list_filter(list_distinct(regexp_extract_all(source_text, '{SQL_NUMBER}')), lambda n: NOT list_contains(regexp_extract_all(translated_text, '{SQL_NUMBER}'), n)), lambda n: 'number ' || n) ELSE [] END,
      CASE WHEN status = 'completed' AND {V.sql_trim("coalesce(source_text, '')")} <> '' AND c_status = 'warning' THEN [c_reason] ELSE [] END, validation_warnings)) AS w FROM q_done)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_source FROM pair GROUP BY 1), r AS (SELECT doc_id, count(*) AS n_results FROM results GROUP BY 1),
x AS (SELECT doc_id, count(*) FILTER (check_no = -1) AS n_missing, count(*) AS failed_segments FROM firsts GROUP BY 1)
SELECT *, segment_count_match AND all_segments_present AND failed_segments = 0 AS valid FROM (
  SELECT doc_id, coalesce(n_source, 0) AS n_source, coalesce(n_results, 0) AS n_results, coalesce(n_missing, 0) AS n_missing, coalesce(failed_segments, 0) AS failed_segments, coalesce(n, 0) AS n_warnings,
    coalesce(n_source, 0) = coalesce(n_results, 0) AS segment_count_match, coalesce(n_missing, 0) = 0 AS all_segments_present
  FROM s FULL JOIN r USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN warned USING (doc_id))"""
)


@query(REPORT, "results")
def slice0_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.validation_report(*both(spark, sf_dir))
    return out.withColumn("n_warnings", F.size("warnings").cast("long")).drop("warnings")


@query("WITH " + CHECKED + """, hurt AS (SELECT doc_id, count(*) AS protected_issues FROM flat WHERE error_type IN ('tag_error', 'entity_error') GROUP BY 1),
st AS (SELECT doc_id, count(*) FILTER (status = 'completed') AS c, arg_min(error_message, seg_index) FILTER (status = 'failed') AS cause FROM results GROUP BY 1),
g AS (SELECT doc_id, c, cause, coalesce(protected_issues, 0) AS protected_issues, CASE WHEN coalesce(protected_issues, 0) > 0 THEN 'placeholders' WHEN c = 0 THEN 'nothing_completed' ELSE 'open' END AS gate FROM st LEFT JOIN hurt USING (doc_id))
SELECT doc_id, gate <> 'open' AS blocked, gate, CASE WHEN gate = 'nothing_completed' THEN coalesce(cause, 'Translation failed') END AS root_cause,
  CASE WHEN gate = 'nothing_completed' THEN CASE WHEN regexp_matches(coalesce(cause, 'Translation failed'), '(?i)model.+not found|not supported for generatecontent') THEN 'model_config' ELSE 'quota_auth_network' END END AS hint, protected_issues FROM g""", "results")
def k4_k5_gate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = both(spark, sf_dir)
    return validate.gate_outputs(r, validate.issues_of(s, r))


@query("WITH rows_ AS (SELECT *, source_text AS t FROM pair),\n" + entity_steps() + ",\n" + completeness_ctes("e5", "source_text", "target_text") + "\nSELECT doc_id, segment_id, x AS protected_text, c_status AS status FROM q_done", "pair")
def r2_stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of arriving documents protected and checked as in batch."""
    from ..streaming import jobs
    from .queries_flow import streamed

    return streamed(spark, sf_dir, lambda s: jobs.stream_validate(s).select("doc_id", "segment_id", "protected_text", F.col("completeness.status").alias("status")), "append", table="documents")
