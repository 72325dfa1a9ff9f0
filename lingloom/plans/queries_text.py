"""Queries of the text, protection and reply functions (sources S, projections P, protection T, scalars F)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import protect as P
from ..functions import text as T
from ..functions.responses import batch_items, user_prompt
from ..operators import dimensions, segments
from ..sources.tables import languages
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = V.with_views(sql, *needs)
        return fn

    return register


PAGE_TAG = "<(?:a|b|br)[^>]*>"
SQL_NUMBER = r"\b[0-9]+(?:\.[0-9]+)?\b"
LANG_VALUES = V.sql_values(T.LANGUAGES)


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<b>([\\s\\S]*?)</b>', 1), '') AS runs FROM pages")
def s6_joined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", T.joined_runs(F.col("html"), r"<b>([\s\S]*?)</b>").alias("runs"))


@query("""SELECT page_id, CASE lower(regexp_extract(path, '(\\.[^./\\\\]*)$', 1)) WHEN '.docx' THEN 'docx' WHEN '.xliff' THEN 'xliff' WHEN '.mqxliff' THEN 'mqxliff' WHEN '.xml' THEN 'mqxliff' END AS source_format
FROM (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.docx' WHEN 1 THEN '.XLIFF' WHEN 2 THEN '.mqxliff' WHEN 3 THEN '.xml' WHEN 4 THEN '.pdf' ELSE '' END AS path FROM pages)""")
def s7_classify_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 6
    path = F.concat("url", F.when(k == 0, ".docx").when(k == 1, ".XLIFF").when(k == 2, ".mqxliff").when(k == 3, ".xml").when(k == 4, ".pdf").otherwise(""))
    return V.table(spark, sf_dir, "pages").select("page_id", T.classify_format(path).alias("source_format"))


@query("SELECT doc_id, segment_id, seg_index, source_raw, source_text FROM seg_doc", "seg_doc")
def s10_segments_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.seg_doc(spark, sf_dir).select("doc_id", "segment_id", F.col("seg_index").cast("long").alias("seg_index"), "source_raw", "source_text")


@query("SELECT page_id, segment_id, seg_index, source_raw, source_text FROM seg_page", "seg_page")
def s10_segments_from_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.seg_page(spark, sf_dir).select("page_id", "segment_id", F.col("seg_index").cast("long").alias("seg_index"), "source_raw", "source_text")


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped_sha256 FROM pages")
def k3_xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha2(T.xml_escape(F.col("html")), 256).alias("escaped_sha256"))


@query("""SELECT page_id, CASE WHEN strpos(file_name, '.') > 0 THEN regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) ELSE file_name END || '_' || lower(coalesce(name, code)) || regexp_extract(file_name, '(\\.[^.]*)$', 1) AS output_name
FROM (SELECT page_id, 'Report.v' || page_id || CASE WHEN page_id % 3 = 0 THEN '.docx' ELSE '.mqxliff' END AS file_name, CASE page_id % 4 WHEN 0 THEN 'ta' WHEN 1 THEN 'fa' WHEN 2 THEN 'hi' ELSE 'XX' END AS code FROM pages)
LEFT JOIN (VALUES """ + LANG_VALUES + ") l(code, name, native_name, direction) USING (code)")
def k9_output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rows = V.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Report.v"), k.cast("string"), F.when(k % 3 == 0, ".docx").otherwise(".mqxliff")).alias("file_name"), F.when(k % 4 == 0, "ta").when(k % 4 == 1, "fa").when(k % 4 == 2, "hi").otherwise("XX").alias("code"))
    return dimensions.output_name(rows, "file_name", "code", languages(spark)).select("page_id", "output_name")


@query("SELECT doc_id, sha256(base64(encode(text))) AS payload_sha256 FROM documents")
def k10_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.rewrite import with_payload

    rows = with_payload(V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))
    return rows.select("doc_id", F.sha2(F.regexp_replace("payload", "[\r\n]", ""), 256).alias("payload_sha256"))


@query(f"SELECT page_id, seg_index, {V.sql_plain('source_raw')} AS plain_text, {V.sql_trim(chr(114) + 'egexp_replace(source_raw, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS plain_result FROM seg_page", "seg_page")
def p1_p2_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("source_raw")
    return V.seg_page(spark, sf_dir).select("page_id", F.col("seg_index").cast("long").alias("seg_index"), T.plain_text(raw).alias("plain_text"), T.plain_result(raw).alias("plain_result"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_index, CASE WHEN turn % 3 = 0 THEN 'segment-' || turn ELSE 'c' || conv_id || '-' || turn END AS segment_id FROM conversations WHERE role <> 'system'")
def p3_p4_p5_unlocked_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    rows = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(turn % 3 != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))).alias("segment_id"), F.create_map(F.lit("translate"), F.when(F.col("role") == "system", "no").otherwise("yes")).alias("attributes"))
    open_rows = segments.reindex(segments.with_segment_id(segments.drop_locked(rows), position="turn"), "conv_id", "turn")
    return open_rows.select("conv_id", "turn", F.col("seg_index").cast("long").alias("seg_index"), "segment_id")


@query("SELECT event_id, CASE WHEN event_type IN ('general', 'medical', 'legal') THEN event_type ELSE 'universal' END AS as_is, CASE WHEN event_id % 5 < 3 THEN ['general', 'medical', 'legal'][1 + event_id % 5] ELSE 'universal' END AS mixed FROM events")
def p8_normalize_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    mixed = F.when(k == 0, "general").when(k == 1, "medical").when(k == 2, "legal").when(k == 3, "Legal")
    return V.table(spark, sf_dir, "events").select("event_id", T.normalize_domain(F.col("event_type")).alias("as_is"), T.normalize_domain(mixed).alias("mixed"))


@query(f"""SELECT doc_id, coalesce(name || ' (' || code || ')', c) AS label, coalesce(direction = 'rtl', false) AS is_rtl,
  CASE WHEN native_name <> name THEN ' Write the output in ' || name || ' (' || code || ') script (' || native_name || '), not in Latin letters.' ELSE '' END AS script_note
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ur' WHEN 1 THEN 'fa' WHEN 2 THEN 'gu' ELSE lang END AS c FROM documents) LEFT JOIN (VALUES {LANG_VALUES}) l(code, name, native_name, direction) ON c = code""")
def p9_p10_p11_language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "ur").when(k == 1, "fa").when(k == 2, "gu").otherwise(F.col("lang")).alias("c"))
    return dimensions.with_language(rows, "c", languages(spark)).select("doc_id", "label", "is_rtl", "script_note")


T1_SQL = f"""WITH m AS (SELECT page_id, seg_index, source_raw, regexp_extract_all(source_raw, '{PAGE_TAG}') AS f, string_split_regex(source_raw, '{PAGE_TAG}') AS g FROM seg_page)
SELECT page_id, seg_index, len(f) AS n_tokens, array_to_string(list_transform(f, lambda x, k: '__TAG_' || k || '__=' || x), '|') AS tokens,
  array_to_string(list_transform(g, lambda x, k: x || CASE WHEN k <= len(f) THEN '__TAG_' || k || '__' ELSE '' END), '') AS protected_text, source_raw AS restored, len(f) > 0 AS has_tags FROM m"""


@query(T1_SQL, "seg_page")
def t1_t8_t12_protect_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.protect_tags(V.seg_page(spark, sf_dir), "source_raw", pattern=PAGE_TAG)
    return rows.select("page_id", F.col("seg_index").cast("long").alias("seg_index"), F.size("tag_tokens").cast("long").alias("n_tokens"), P.token_texts(F.col("tag_tokens")).alias("tokens"), "protected_text", P.restored(F.col("protected_text"), F.col("tag_tokens")).alias("restored"), P.has_tags(F.col("source_raw"), PAGE_TAG).alias("has_tags"))


_URL, _FTP = r"""https?://[^ \t\n\x0B\f\r\x{A0}\x{FEFF}<>"''()\[\]{}]+""", r"""ftp://[^ \t\n\x0B\f\r\x{A0}\x{FEFF}<>"''()\[\]{}]+"""
_EMAIL, _NCT, _CODE = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", r"\bNCT[0-9]{8}\b", r"\b[A-Z]{2,}-[A-Z0-9-]{2,}\b"


def entity_steps() -> str:
    steps = ["e0 AS (SELECT *, t AS x, CAST([] AS VARCHAR[]) AS toks FROM rows_)"]
    for k, pattern in enumerate((_URL, _FTP, _EMAIL, _NCT, _CODE)):
        steps.append(f"""m{k} AS (SELECT *, regexp_extract_all(x, '{pattern}') AS f, string_split_regex(x, '{pattern}') AS g FROM e{k}),
e{k + 1} AS (SELECT * EXCLUDE (x, toks, f, g), array_to_string(list_transform(g, lambda y, i: y || CASE WHEN i <= len(f) THEN '__ENTITY_' || (i + len(toks)) || '__' ELSE '' END), '') AS x, list_concat(toks, f) AS toks FROM m{k})""")
    return ",\n".join(steps)


ENTITY_ROWS = """rows_ AS (SELECT page_id, seg_index, source_text || ' see ' || url || ', ftp://h.example/' || page_id || ' or write u' || page_id || '.x@mail.example.org on NCT1234567' || (page_id % 10) || ' STUDY-' || page_id || '-X9.' AS t FROM seg_page)"""


@query(f"WITH {ENTITY_ROWS},\n{entity_steps()}\nSELECT page_id, seg_index, x AS protected_text, array_to_string(list_transform(toks, lambda y, i: '__ENTITY_' || i || '__=' || y), '|') AS tokens, t AS restored FROM e5", "seg_page")
def t2_t4_t9_protect_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    text = F.concat("source_text", F.lit(" see "), "url", F.lit(", ftp://h.example/"), p, F.lit(" or write u"), p, F.lit(".x@mail.example.org on NCT1234567"), (F.col("page_id") % 10).cast("string"), F.lit(" STUDY-"), p, F.lit("-X9."))
    rows = P.protect_entities(V.seg_page(spark, sf_dir).withColumn("t", text), "t")
    return rows.select("page_id", F.col("seg_index").cast("long").alias("seg_index"), "protected_text", P.token_texts(F.col("entity_tokens")).alias("tokens"), P.restored(F.col("protected_text"), F.col("entity_tokens")).alias("restored"))


@query("SELECT page_id, seg_index, source_raw AS restored, CAST(NULL AS VARCHAR) AS restore_error FROM seg_page", "seg_page")
def t10_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, then tags, and back: the input again, by the full tag pattern."""
    rows = P.restore_all(P.protect(V.seg_page(spark, sf_dir), "source_raw"), "protected_text")
    return rows.select("page_id", F.col("seg_index").cast("long").alias("seg_index"), "restored", "restore_error")


@query(f"""WITH m AS (SELECT page_id, seg_index, list_transform(regexp_extract_all(source_raw, '{PAGE_TAG}'), lambda x, k: '__TAG_' || k || '__') AS toks, array_to_string(list_transform(string_split_regex(source_raw, '{PAGE_TAG}'), lambda x, k: x || CASE WHEN k <= len(regexp_extract_all(source_raw, '{PAGE_TAG}')) THEN '__TAG_' || k || '__' ELSE '' END), '') AS p FROM seg_page),
h AS (SELECT *, CASE page_id % 3 WHEN 0 THEN replace(p, '__TAG_1__', '') WHEN 1 THEN replace(p, '__TAG_1__', '__TAG_1__ __TAG_1__') ELSE p || ' __TAG_99__' END AS x FROM m),
r AS (SELECT *, list_filter(toks, lambda t: strpos(x, t) = 0) AS lost, list_filter(toks, lambda t: (length(x) - length(replace(x, t, ''))) // length(t) > 1) AS twice FROM h)
SELECT page_id, seg_index, array_to_string(lost, ',') AS missing, array_to_string(twice, ',') AS duplicated, len(regexp_extract_all(x, '__TAG_[0-9]+__')) AS n_placeholders,
  nullif(concat_ws('; ', CASE WHEN len(lost) > 0 THEN 'Missing tokens: ' || array_to_string(lost, ', ') END, CASE WHEN len(twice) > 0 THEN 'Duplicated tokens: ' || array_to_string(twice, ', ') END), '') AS restore_error,
  CAST((length(x) - length(replace(x, '__TAG_1__', ''))) // length('__TAG_1__') AS BIGINT) AS n_first FROM r""", "seg_page")
def t5_t6_t7_t11_t13_token_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.protect_tags(V.seg_page(spark, sf_dir), "source_raw", pattern=PAGE_TAG)
    p, k, one = F.col("protected_text"), F.col("page_id") % 3, F.lit("__TAG_1__")
    rows = rows.withColumn("x", F.when(k == 0, F.replace(p, one, F.lit(""))).when(k == 1, F.replace(p, one, F.lit("__TAG_1__ __TAG_1__"))).otherwise(F.concat(p, F.lit(" __TAG_99__"))))
    x, toks = F.col("x"), F.col("tag_tokens")
    return rows.select("page_id", F.col("seg_index").cast("long").alias("seg_index"), F.array_join(P.missing_tokens(x, toks), ",").alias("missing"), F.array_join(P.duplicated_tokens(x, toks), ",").alias("duplicated"), F.size(P.find_tokens(x, "TAG")).cast("long").alias("n_placeholders"), P.restore_error(x, toks).alias("restore_error"), T.occurrences(x, one).cast("long").alias("n_first"))


@query(f"SELECT doc_id, seg_index, array_to_string(regexp_extract_all(source_text, '{SQL_NUMBER}'), '|') AS numbers, CAST(floor(seg_index / 3.0 + 0.5) AS BIGINT) AS rounded, CAST((length(source_text) + 5) // 10 AS DOUBLE) / 100 AS seconds FROM seg_doc", "seg_doc")
def f1_f12_f13_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seg_index").cast("long")
    return V.seg_doc(spark, sf_dir).select("doc_id", i.alias("seg_index"), F.array_join(T.numbers(F.col("source_text")), "|").alias("numbers"), T.half_up(i / 3.0).alias("rounded"), T.seconds_of(F.length("source_text")).alias("seconds"))


@query("""SELECT conv_id, turn, CASE turn % 6 WHEN 5 THEN NULL ELSE 'c' || conv_id || '|' || turn || ' ok' END AS items FROM conversations""")
def f2_parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in each accepted wrapping, fenced, as a root array and broken."""
    k, ident = F.col("turn") % 6, F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    listed = F.concat(F.lit('[{"id": "'), ident, F.lit('", "translation": "'), F.col("turn").cast("string"), F.lit(' ok"}]'))
    wrapped = lambda key: F.concat(F.lit('{"note": 1, "' + key + '": '), listed, F.lit("}"))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), wrapped("translations"), F.lit("\n```"))).when(k == 1, wrapped("segments")).when(k == 2, wrapped("items")).when(k == 3, listed).when(k == 4, F.concat(F.lit('{"translations": "none", "results": '), listed, F.lit("}"))).otherwise('{"translations": [')
    items = batch_items(reply)
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(items, lambda x: F.concat_ws("|", x["id"], x["translation"])), ";").alias("items"))


@query("""SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN p <> '' THEN 'PREVIOUS SEGMENT (context only, do not translate):' || chr(10) || p || chr(10) END, 'CURRENT SEGMENT (translate this):' || chr(10) || text, CASE WHEN n <> '' THEN chr(10) || 'NEXT SEGMENT (context only, do not translate):' || chr(10) || n END) AS prompt
FROM (SELECT *, coalesce(lag(text) OVER w, '') AS p, coalesce(lead(text) OVER w, '') AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""")
def f6_user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.with_context(V.table(spark, sf_dir, "conversations"), 1 << 30, "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", user_prompt(F.col("previous_text"), F.col("text"), F.col("next_text")).alias("prompt"))


@query("""SELECT batch_no, CAST(least(1000 * pow(2, retry_count), 30000) AS BIGINT) AS backoff_ms, CASE WHEN message LIKE '%try again in%' THEN CAST(least(ceil(1.25 * 1000) + 1000, 65000) AS BIGINT) END AS retry_after_ms,
  coalesce(regexp_matches(lower(message), '429|500|502|503|504|rate limit|quota|timeout|network|econnreset'), false) AS retryable FROM call_log""", "call_log")
def f9_f10_f11_retry_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.call_log(spark, sf_dir).select("batch_no", T.backoff_ms(F.col("retry_count")).alias("backoff_ms"), T.retry_after_ms(F.col("message")).alias("retry_after_ms"), T.is_retryable(F.col("message")).alias("retryable"))
