"""Queries of order, context, batches, joins, metrics, sinks and streams (W, M, J, O, U, K, I, R)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.protect import protect_tags, token_texts
from ..functions.text import failure_hint, is_blank, plain_text, xml_escape
from ..operators import dimensions, metrics, segments, validate
from ..sources import files, rewrite
from ..sources.listing import list_files
from ..sources.tables import default_glossary, shared_folder, with_user_terms
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


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def _cut(x: str) -> str:
    right = "regexp_replace(substr(" + x + f", 1, 60), '[{V.WS}]+$', '', 'g')"
    return f"CASE WHEN length({x}) > 60 THEN {right} || '...' ELSE {x} END"


@query(f"SELECT doc_id, seg_index, {_cut('p')} AS previous_text, {_cut('n')} AS next_text FROM (SELECT *, coalesce(lag(source_text) OVER w, '') AS p, coalesce(lead(source_text) OVER w, '') AS n FROM seg_doc WINDOW w AS (PARTITION BY doc_id ORDER BY seg_index))", "seg_doc")
def w1_w2_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_context(V.seg_doc(spark, sf_dir), 60).select("doc_id", *long("seg_index"), "previous_text", "next_text")


@query("SELECT doc_id, seg_index, seg_index // 10 AS batch_no, max(seg_index // 10) OVER (PARTITION BY doc_id) + 1 AS total_batches FROM seg_doc", "seg_doc")
def w3_batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_batch_no(V.seg_doc(spark, sf_dir), 10).select("doc_id", *long("seg_index", "batch_no", "total_batches"))


@query("""SELECT doc_id, batch_no, CAST(sum(c) OVER w AS BIGINT) AS completed, CAST(sum(f) OVER w AS BIGINT) AS failed, CAST(least((batch_no + 1) * 10 - 1, sum(n) OVER (PARTITION BY doc_id) - 1) AS BIGINT) AS current_index
FROM (SELECT doc_id, seg_index // 10 AS batch_no, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'failed') AS f, count(*) AS n FROM results GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY batch_no ROWS UNBOUNDED PRECEDING)""", "results")
def w4_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.progress(V.results(spark, sf_dir), 10).select("doc_id", *long("batch_no", "completed", "failed", "current_index"))


@query(f"""SELECT lang, pos, {_cut('p')} AS previous_text, {_cut('n')} AS next_text
FROM (SELECT *, coalesce(lag(source_text) OVER w, '') AS p, coalesce(lead(source_text) OVER w, '') AS n FROM (SELECT *, CAST(doc_id AS BIGINT) * 100000 + seg_index AS pos FROM seg_doc) WINDOW w AS (PARTITION BY lang ORDER BY pos))""", "seg_doc")
def w1_w2_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a language as one document, in ranges of fifty texts: positions have gaps."""
    rows = V.seg_doc(spark, sf_dir).withColumn("pos", F.col("doc_id").cast("long") * 100_000 + F.col("seg_index"))
    return segments.with_context(rows, 60, "lang", "pos", span=5_000_000).select("lang", "pos", "previous_text", "next_text")


@query("""WITH r AS (SELECT source_lang AS doc_id, status, row_number() OVER (PARTITION BY source_lang ORDER BY CAST(doc_id AS BIGINT) * 100000 + seg_index) - 1 AS seg_index FROM results)
SELECT doc_id AS lang, batch_no, max(batch_no) OVER (PARTITION BY doc_id) + 1 AS total_batches, CAST(sum(c) OVER w AS BIGINT) AS completed, CAST(sum(f) OVER w AS BIGINT) AS failed, CAST(least((batch_no + 1) * 10 - 1, sum(n) OVER (PARTITION BY doc_id) - 1) AS BIGINT) AS current_index
FROM (SELECT doc_id, seg_index // 10 AS batch_no, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'failed') AS f, count(*) AS n FROM r GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY batch_no ROWS UNBOUNDED PRECEDING)""", "results")
def p4_w3_w4_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes, batches and progress of all results of a language as one document, by ranges."""
    r = V.results(spark, sf_dir).select(F.col("source_lang").alias("lang"), "status", (F.col("doc_id").cast("long") * 100_000 + F.col("seg_index")).alias("pos"))
    rows = segments.with_batch_no(segments.reindex(r, "lang", "pos", span=5_000_000), 10, "lang", span=5_000_000)
    totals = rows.groupBy("lang").agg(F.max("total_batches").alias("total_batches"))
    return segments.progress(rows, 10, "lang", span=50).join(totals, "lang").select("lang", *long("batch_no", "total_batches", "completed", "failed", "current_index"))


@query("""SELECT doc_id, seg_index // 10 AS batch_no, count(*) AS n_items, string_agg(segment_id, ',' ORDER BY seg_index) AS ids, sha256(string_agg(source_text, chr(10) ORDER BY seg_index)) AS texts_sha256, count(*) FILTER (seg_index > 0) AS with_previous FROM seg_doc GROUP BY ALL""", "seg_doc")
def m11_f3_pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments.with_context(V.seg_doc(spark, sf_dir)).withColumn("protected_text", F.col("source_text"))
    packed = segments.pack_batches(rows, 10)
    each = lambda f: F.transform("items", f)
    return packed.select("doc_id", *long("batch_no"), F.size("items").cast("long").alias("n_items"), F.array_join(each(lambda x: x["id"]), ",").alias("ids"), F.sha2(F.array_join(each(lambda x: x["sourceText"]), "\n"), 256).alias("texts_sha256"), F.regexp_count("items_json", F.lit('"previousText":')).cast("long").alias("with_previous"))


@query("""SELECT conv_id, turn, CASE WHEN blank THEN 'completed' ELSE 'pending' END AS state, CASE WHEN blank THEN 'Source text was empty' END AS warning
FROM (SELECT *, (turn % 3 = 1) AS blank FROM conversations)""")
def p6_blank_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("segment_id"), F.col("turn").alias("seg_index"), F.when(F.col("turn") % 3 == 1, "  \t").otherwise(F.col("text")).alias("source_text"), F.lit(None).cast("string").alias("target_text"))
    todo, done = segments.split_blank(rows)
    both = todo.select("doc_id", "seg_index", F.lit("pending").alias("state"), F.lit(None).cast("string").alias("warning")).unionByName(done.select("doc_id", "seg_index", F.col("status").alias("state"), F.get("validation_warnings", F.lit(0)).alias("warning")))
    return both.withColumnsRenamed({"doc_id": "conv_id", "seg_index": "turn"})


@query("SELECT provider, status, count(*) AS n FROM results WHERE status IN ('completed', 'failed') GROUP BY ALL", "results")
def p7_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.results(spark, sf_dir)
    return r.where("status = 'completed'").unionByName(r.where("status = 'failed'")).groupBy("provider", "status").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT page_id, regexp_extract_all(html, '<p>[\\s\\S]*?</p>') AS us, string_split_regex(html, '<p>[\\s\\S]*?</p>') AS gs FROM pages),
n AS (SELECT page_id, gs, us, list_transform(us, lambda u: CASE WHEN length(u) % 3 = 0 THEN u ELSE '<p>' || length(u) || ':' || substr(u, 4, 20) || '</p>' END) AS ns FROM c)
SELECT page_id, sha256(array_to_string(list_transform(gs, lambda g, k: g || coalesce(ns[k], '')), '')) AS output_sha256, len(list_filter(us, lambda u: length(u) % 3 <> 0)) AS replaced FROM n""")
def k1_k12_rewrite_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of a page's paragraphs replaced, everything else byte for byte as it was."""
    pages = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    unit = r"<p>[\s\S]*?</p>"
    keys = pages.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(unit), F.lit(0)))).alias("key")).where(F.length("key") % 3 != 0)
    value = F.concat(F.lit("<p>"), F.length("key").cast("string"), F.lit(":"), F.substring("key", 4, 20), F.lit("</p>"))
    out = rewrite.rewrite_marked(pages, "html", unit, keys.withColumn("value", value))
    return out.select(F.col("doc_id").alias("page_id"), F.sha2("output", 256).alias("output_sha256"), "replaced")


@query("SELECT page_id, sha256(html) AS output_sha256, 0 AS replaced FROM pages")
def k1_rewrite_without_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    none = pages.select("doc_id", F.lit("").alias("key"), F.lit("").alias("value")).where("1 = 0")
    out = rewrite.rewrite_marked(pages, "html", r"<p>[\s\S]*?</p>", none)
    return out.select(F.col("doc_id").alias("page_id"), F.sha2("output", 256).alias("output_sha256"), F.col("replaced").cast("int").alias("replaced"))


@query("SELECT doc_id, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(b, 0) = coalesce(a, 0) AS ok FROM (SELECT doc_id, count(*) AS b FROM seg_doc GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS a FROM results GROUP BY 1) USING (doc_id)", "results")
def k8_verify_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.verify_roundtrip(V.results(spark, sf_dir), V.seg_doc(spark, sf_dir))


@query("SELECT doc_id, status, CASE WHEN regexp_matches(error_message, '(?i)model.+not found|not supported for generatecontent') THEN 'model_config' ELSE 'quota_auth_network' END AS hint, count(*) AS n FROM results WHERE status = 'failed' GROUP BY ALL", "results")
def k6_failure_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.results(spark, sf_dir).where("status = 'failed'")
    return r.groupBy("doc_id", "status", failure_hint(F.col("error_message")).alias("hint")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id, segment_id, seg_index, source_text FROM seg_doc),
m AS (SELECT doc_id, source_text AS t, arg_max(translated_text, s.seg_index) AS r FROM s JOIN results USING (doc_id, segment_id) WHERE status = 'completed' GROUP BY 1, 2)
SELECT s.doc_id, seg_index, r AS repeated_translation FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.source_text = m.t""", "results")
def j5_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.propagate_repetitions(V.seg_doc(spark, sf_dir), V.results(spark, sf_dir)).select("doc_id", *long("seg_index"), "repeated_translation")


@query("SELECT doc_id, text_key, seg_index, segment_id FROM (SELECT doc_id, lower(source_text) AS text_key, seg_index, segment_id, row_number() OVER (PARTITION BY doc_id, lower(source_text) ORDER BY seg_index DESC) AS k FROM seg_doc) WHERE k = 1", "seg_doc")
def j4_last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.seg_doc(spark, sf_dir).select("doc_id", F.lower("source_text").alias("text_key"), *long("seg_index"), "segment_id")
    return segments.last_by_key(rows, ["doc_id", "text_key"], "seg_index")


@query("""SELECT doc_id, batch_no, seg_index, t.translation AS translation FROM (SELECT *, seg_index // 10 AS batch_no FROM seg_doc) s
LEFT JOIN (SELECT doc_id, segment_id, 'T ' || source_text AS translation FROM seg_doc WHERE seg_index % 4 <> 3) t USING (doc_id, segment_id)""", "seg_doc")
def j3_match_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of segments met by a reply's items, of which every fourth is missing and every second is sent twice."""
    from .inference import match_responses

    s = segments.with_batch_no(V.seg_doc(spark, sf_dir), 10)
    items = s.where("seg_index % 4 <> 3").select("doc_id", F.col("segment_id").alias("id"), F.concat(F.lit("T "), "source_text").alias("translation"), F.col("seg_index").alias("item_pos"))
    early = items.where("item_pos % 2 = 0").withColumns({"translation": F.lit("early"), "item_pos": F.lit(-1)})
    return match_responses(s, items.unionByName(early)).select("doc_id", *long("batch_no", "seg_index"), "translation")


@query("""SELECT doc_id, count(*) AS n_terms, string_agg(source_term || '=' || preferred_translation, ',' ORDER BY source_term, preferred_translation) AS terms
FROM (SELECT DISTINCT doc_id, source_lang, target_lang FROM pair) p JOIN terms g USING (source_lang, target_lang) WHERE g.domain IS NULL OR g.domain = 'medical' GROUP BY doc_id""", "pair", "terms")
def j6_glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = V.pair(spark, sf_dir).select("doc_id", "source_lang", "target_lang").distinct()
    rows = dimensions.glossary_for(pairs, V.terms(spark), "medical")
    each = F.concat_ws("=", "source_term", "preferred_translation")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.array_join(F.array_sort(F.collect_list(each)), ",").alias("terms"))


@query("""SELECT doc_id, string_agg('- "' || source_term || '" -> "' || preferred_translation || '"' || coalesce(' (' || note || ')', ''), chr(10) ORDER BY source_term) AS section
FROM (SELECT DISTINCT doc_id, source_lang, target_lang FROM pair) p JOIN terms g USING (source_lang, target_lang) GROUP BY doc_id""", "pair", "terms")
def f7_glossary_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = V.pair(spark, sf_dir).select("doc_id", "source_lang", "target_lang").distinct()
    rows = dimensions.glossary_for(pairs, V.terms(spark), "universal")
    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_term", "preferred_translation", "note"))).alias("t"))
    return found.select("doc_id", dimensions.glossary_section(F.col("t")).alias("section"))


@query("""SELECT lang, (SELECT count(*) FROM glossary g WHERE g.source_lang = d.lang) + count(DISTINCT source) AS n_terms FROM documents d GROUP BY lang""", "glossary")
def u1_glossary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in terms and one of each source and language of the documents, counted by source language."""
    own = V.table(spark, sf_dir, "documents").select("lang", "source").distinct()
    user = own.select(F.col("source").alias("source_term"), F.col("lang").alias("source_lang"), F.lit("xx").alias("target_lang"), F.lit("x").alias("preferred_translation"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("note"))
    both = with_user_terms(default_glossary(spark), []).unionByName(user)
    return own.select("lang").distinct().join(both.groupBy(F.col("source_lang").alias("lang")).agg(F.count("*").alias("n_terms")), "lang")


@query("""SELECT s.doc_id, s.segment_id, coalesce(nullif(a.t, ''), '(failed)') AS text_a, coalesce(nullif(b.t, ''), '(failed)') AS text_b
FROM (SELECT doc_id, segment_id, translated_text AS t FROM results) a JOIN (SELECT doc_id, segment_id FROM results) s USING (doc_id, segment_id)
LEFT JOIN (SELECT doc_id, segment_id, 'T ' || translated_text AS t FROM results WHERE seg_index % 3 <> 0) b ON b.doc_id = s.doc_id AND b.segment_id = s.segment_id""", "results")
def j9_compare_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.results(spark, sf_dir)
    b = a.where("seg_index % 3 <> 0").withColumn("translated_text", F.concat(F.lit("T "), "translated_text"))
    return metrics.compare_samples(a, b)


@query("""SELECT doc_id, segment_id, source_text IS NOT NULL AND h.t IS NOT NULL AND m.t IS NOT NULL AS complete, coalesce(h.t = m.t, false) AS equal
FROM (SELECT * FROM seg_doc WHERE seg_index % 5 <> 1) s FULL JOIN (SELECT doc_id, segment_id, target_text AS t FROM pair WHERE seg_index % 5 <> 2) h USING (doc_id, segment_id)
FULL JOIN (SELECT doc_id, segment_id, translated_text AS t FROM results) m USING (doc_id, segment_id)""", "results")
def j10_golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = V.pair(spark, sf_dir).where("seg_index % 5 <> 2").select("doc_id", "segment_id", F.col("target_text").alias("text"))
    machine = V.results(spark, sf_dir).select("doc_id", "segment_id", F.col("translated_text").alias("text"))
    return validate.golden_compare(V.seg_doc(spark, sf_dir).where("seg_index % 5 <> 1"), human, machine).select("doc_id", "segment_id", "complete", "equal")


@query("""SELECT source_lang, target_lang, CASE WHEN max(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'validated' WHEN max(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) = 1 THEN 'tested' ELSE 'implemented' END AS status
FROM results r LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY 1, 2""", "results")
def m12_pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.pair_status(V.results(spark, sf_dir), V.table(spark, sf_dir, "labels").where("quality = 1"))


METRICS_SQL = "count(*) AS requests, CAST(coalesce(sum(retry_count), 0) AS BIGINT) AS retries, CAST(coalesce(floor(avg(latency_ms) + 0.5), 0) AS BIGINT) AS avg_latency_ms, coalesce(max(latency_ms), 0) AS max_latency_ms, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS api_time_ms"


@query(f"SELECT job_id, {METRICS_SQL} FROM call_log GROUP BY job_id", "call_log")
def m4_call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.call_metrics(V.call_log(spark, sf_dir), ["job_id"])


@query(f"SELECT job_id, {METRICS_SQL} FROM (SELECT * FROM call_log UNION ALL SELECT * REPLACE (latency_ms // 2 AS latency_ms) FROM call_log WHERE status = 'failed') GROUP BY job_id", "call_log")
def m13_calls_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch calls and the single calls that follow failed ones, together."""
    batch = V.call_log(spark, sf_dir)
    single = batch.where("status = 'failed'").withColumn("latency_ms", F.floor(F.col("latency_ms") / 2).cast("long"))
    return metrics.call_metrics(batch.unionByName(single), ["job_id"])


SUMMARY_SQL = f"""SELECT *  FROM (SELECT provider, {METRICS_SQL} FROM call_log GROUP BY provider) JOIN (SELECT provider, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM results GROUP BY provider) USING (provider)"""


@query(SUMMARY_SQL, "results", "call_log")
def m5_provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.provider_summary(V.call_log(spark, sf_dir), V.results(spark, sf_dir))


@query("SELECT provider, rank, doc_id, segment_id, source_text, translated_text FROM (SELECT provider, row_number() OVER (PARTITION BY provider ORDER BY r.doc_id, r.seg_index) AS rank, r.doc_id, r.segment_id, s.source_text, translated_text FROM results r JOIN seg_doc s USING (doc_id, segment_id)) WHERE rank <= 5", "results")
def m6_o2_j8_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.samples(V.results(spark, sf_dir), V.seg_doc(spark, sf_dir))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH s AS ({SUMMARY_SQL}), x AS (SELECT min(api_time_ms) AS lo, max(api_time_ms) AS hi, min(failed) AS fl FROM s)
SELECT CASE WHEN (SELECT count(*) FROM s, x WHERE api_time_ms = lo) > 1 THEN 'equal' ELSE (SELECT arg_min(provider, api_time_ms) FROM s) END AS fastest_provider,
  CASE WHEN (SELECT count(*) FROM s, x WHERE api_time_ms = lo) > 1 THEN 0 ELSE CAST(floor((hi - lo) * 100.0 / hi + 0.5) AS BIGINT) END AS speedup_percentage,
  CASE WHEN (SELECT count(*) FROM s, x WHERE failed = fl) > 1 THEN 'equal' ELSE (SELECT arg_min(provider, failed) FROM s) END AS most_reliable_provider FROM x""", "results", "call_log")
def m7_provider_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.provider_verdict(metrics.provider_summary(V.call_log(spark, sf_dir), V.results(spark, sf_dir)))


@query("SELECT job_id, arg_max(batch_no, latency_ms * 10000000 - batch_no) AS batch_no, max(latency_ms) AS latency_ms FROM call_log GROUP BY job_id", "call_log")
def o4_slowest_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slowest_call(V.call_log(spark, sf_dir), "job_id")


@query("SELECT doc_id, arg_min(error_message, seg_index) AS first_error, min(seg_index) AS seg_index FROM results WHERE status = 'failed' GROUP BY doc_id", "results")
def o3_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = V.results(spark, sf_dir).where("status = 'failed'")
    return bad.groupBy("doc_id").agg(F.min_by("error_message", "seg_index").alias("first_error"), F.min("seg_index").cast("long").alias("seg_index"))


@query("SELECT doc_id, seg_index, segment_id, status FROM results ORDER BY doc_id, seg_index", "results")
def o1_document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.results(spark, sf_dir).select("doc_id", *long("seg_index"), "segment_id", "status").orderBy("doc_id", "seg_index")


@query("""SELECT doc_id, segment_id, CASE WHEN seg_index % 4 = 1 THEN 'blank' WHEN seg_index % 4 = 2 THEN 'retried' ELSE 'batch' END AS kind FROM seg_doc""", "seg_doc")
def u2_results_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank pass-through, batch successes and single retries together: every segment once."""
    s = V.seg_doc(spark, sf_dir).withColumn("source_text", F.when(F.col("seg_index") % 4 == 1, " ").otherwise(F.col("source_text"))).withColumn("target_text", F.lit(None).cast("string"))
    todo, blank = segments.split_blank(s)
    kinds = [blank.withColumn("kind", F.lit("blank")), todo.where("seg_index % 4 <> 2").withColumn("kind", F.lit("batch")), todo.where("seg_index % 4 = 2").withColumn("kind", F.lit("retried"))]
    out = kinds[0].select("doc_id", "segment_id", "kind")
    for k in kinds[1:]:
        out = out.unionByName(k.select("doc_id", "segment_id", "kind"))
    return out


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND role = 'assistant' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN turn % 3 = 0 AND role = 'assistant' THEN '' ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS translated_text FROM conversations""")
def i3_i6_translate_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through a deterministic callable that turns word order round, answers some items in the single round only, and never others."""
    import json

    from .inference import translate

    t = V.table(spark, sf_dir, "conversations")
    hard = (F.col("turn") % 3 == 0) & (F.col("role") == "assistant")
    text = F.concat(F.when(hard, "HARD ").when(F.col("turn") % 3 == 1, "LATE ").otherwise(""), F.col("text"))
    rows = t.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("segment_id"), F.col("turn").cast("int").alias("seg_index"), text.alias("source_raw"), text.alias("source_text"), F.lit(None).cast("string").alias("target_text"), F.lit("en").alias("source_lang"), F.lit("en").alias("target_lang"))

    def turned(s: str) -> str:
        s = s.removeprefix("LATE ")
        return " ".join(reversed(s.split(" ")))

    def fn(system: str, user: str, json_mode: bool) -> str:
        if json_mode:
            return json.dumps({"translations": [{"id": x["id"], "translation": turned(x["sourceText"])} for x in json.loads(user) if not x["sourceText"].startswith(("HARD ", "LATE "))]})
        now = user.split("CURRENT SEGMENT (translate this):\n", 1)[1].split("\n\nNEXT SEGMENT (context only", 1)[0]
        return "" if now.startswith("HARD ") else turned(now)

    out, _ = translate(rows, fn, patterns=[], tags="<never>")
    shown = F.when(F.col("status") == "failed", "").otherwise(F.col("translated_raw"))
    return out.select(F.col("doc_id").cast("long").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), "status", shown.alias("translated_text"))


def _turns(spark: SparkSession, sf_dir: str, source: str = "text") -> DataFrame:
    t = V.table(spark, sf_dir, "conversations").withColumn("t", F.expr(source))
    lang = F.when(F.col("turn") % 2 == 0, "hi").otherwise("gu")
    return t.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("string").alias("segment_id"), F.col("turn").cast("int").alias("seg_index"), F.col("t").alias("source_raw"), F.col("t").alias("source_text"), F.lit(None).cast("string").alias("target_text"), F.lit("en").alias("source_lang"), lang.alias("target_lang"))


def _answer(user: str, json_mode: bool, text) -> str:
    import json

    return json.dumps([{"id": x["id"], "translation": text} for x in json.loads(user)]) if json_mode else text


@query("""SELECT conv_id, turn, provider, CASE turn % 3 WHEN 0 THEN '503 overloaded' WHEN 1 THEN '400 bad request' END AS error, CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END AS retry_count,
CASE WHEN turn % 3 = 2 THEN provider || ' ' || upper(role) END AS reply FROM conversations, (VALUES ('a'), ('b')) p(provider)""")
def i2_retries_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two providers that fail for good, for now, or not: what may be tried again comes again in a later round."""
    from .inference import infer

    def fn(name):
        def call(system, user, json_mode):
            turn, role = user.split(" ")
            if int(turn) % 3 < 2:
                raise ValueError(["503 overloaded", "400 bad request"][int(turn) % 3])
            return f"{name} {role.upper()}"

        return call

    rows = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("provider"), F.lit("s").alias("system"), F.concat_ws(" ", F.col("turn").cast("string"), "role").alias("prompt"), F.lit(False).alias("json_mode"))
    out = infer(rows, {"a": fn("a"), "b": fn("b")}, retries=2, pause=lambda seconds: None)
    return out.select("conv_id", "turn", "provider", "error", "retry_count", "reply")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN conv_id % 4 = 0 THEN '401 unauthorized' END AS error_message FROM conversations""")
def i5_failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose call fails for good fail as a whole; no single calls follow."""
    from .inference import translate

    def fn(system, user, json_mode):
        if "CONV0 " in user:
            raise ValueError("401 unauthorized")
        return _answer(user, json_mode, "\u0915\u0916\u0917" if "Hindi" in system else "\u0a95\u0a96\u0a97")

    out, _ = translate(_turns(spark, sf_dir, "concat('CONV', conv_id % 4, ' words')"), fn, patterns=[], tags="<never>", on_error="batch", parallel=8, max_context=20)
    return out.select(F.col("doc_id").cast("long").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), "status", "error_message")


@query("""SELECT provider, conv_id, turn, CASE WHEN provider = 'b' AND turn % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM conversations, (VALUES ('a'), ('b')) p(provider)""")
def i7_two_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments through two providers at once, one of which leaves every third turn out."""
    from .inference import benchmark

    word = lambda system: "\u0915\u0916\u0917" if "Hindi" in system else "\u0a95\u0a96\u0a97"

    def b(system, user, json_mode):
        import json

        if json_mode:
            return json.dumps([{"id": x["id"], "translation": word(system)} for x in json.loads(user) if not x["sourceText"].startswith("LEFT0")])
        now = user.split("CURRENT SEGMENT (translate this):\n", 1)[1]
        return "" if now.startswith("LEFT0") else word(system)

    rows = _turns(spark, sf_dir, "concat('LEFT', turn % 3, ' out')")
    out, _ = benchmark(rows, {"a": lambda s, u, j: _answer(u, j, word(s)), "b": b}, patterns=[], tags="<never>")
    return out.select("provider", F.col("doc_id").cast("long").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), "status")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'rules terms profile model script' ELSE 'profile model script' END AS seen FROM conversations""")
def f4_f5_f8_i8_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompts of two language pairs hold: rules of one target, terms of one pair, the domain's profile, the model."""
    from ..sources.tables import DOMAIN, languages
    from .inference import translate

    def fn(system, user, json_mode, model=None):
        hindi = "Hindi" in system
        seen = {"rules": "Use the formal address." in system, "terms": '"word"' in system and "TERM" in system, "profile": DOMAIN[2] in system, "model": model == "big", "script": "not in Latin letters" in system}
        return _answer(user, json_mode, "".join(chr((0x915 if hindi else 0xA95) + k) for k in range(25)) + " " + " ".join(k for k, v in seen.items() if v))

    glossary = spark.createDataFrame([("word", "en", "hi", "TERM", "legal", None), ("word", "en", "gu", "TERM", "medical", None)], "source_term string, source_lang string, target_lang string, preferred_translation string, domain string, note string")
    rules = languages(spark, {"hi": ["Use the formal address."]})
    out, _ = translate(_turns(spark, sf_dir, "'number one'"), fn, patterns=[], tags="<never>", glossary=glossary, domain="legal", languages=rules, profile=DOMAIN[2], model="big", attempts=0)
    return out.select(F.col("doc_id").cast("long").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), F.regexp_extract("translated_text", "^[^ ]* (.*)$", 1).alias("seen"))


@query("SELECT doc_id, seg_index, source_text || ' __ENTITY_1__ x __ENTITY_2__' AS protected_text, '__ENTITY_1__=REF:' || seg_index || ';|__ENTITY_2__=REF:7;' AS tokens FROM (SELECT doc_id, seg_index, regexp_replace(source_text, 'REF:', '', 'g') AS source_text FROM seg_doc)", "seg_doc")
def t3_custom_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own pattern alone: addresses and codes stay in the text."""
    from ..functions.protect import custom_patterns, protect_entities

    raw = F.concat(F.regexp_replace("source_text", "REF:", ""), F.lit(" REF:"), F.col("seg_index").cast("string"), F.lit("; x REF:7;"))
    rows = V.seg_doc(spark, sf_dir).select("doc_id", *long("seg_index"), raw.alias("raw"))
    out = protect_entities(rows, "raw", patterns=custom_patterns({"ref": "REF:[0-9]+;"}, urls=False, emails=False))
    return out.select("doc_id", "seg_index", "protected_text", token_texts(F.col("entity_tokens")).alias("tokens"))


@query("SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM call_log GROUP BY job_id", "call_log")
def r1_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    return streamed(spark, sf_dir, lambda s: jobs.stream_progress(s), "update", ["job_id"])


@query("""SELECT date_trunc('day', ts) AS window_start, provider, count(*) AS requests, count(*) FILTER (status = 'failed') AS failed, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms, max(latency_ms) AS max_latency_ms FROM call_log GROUP BY ALL""", "call_log")
def r3_stream_call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    out = streamed(spark, sf_dir, lambda s: jobs.stream_call_metrics(s, "1 day"), "update", ["window_start", "provider"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def streamed(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None, table: str = "events") -> DataFrame:
    """The job over a stream of the table's files, everything that is there, read back from its sink in the shared folder."""
    import uuid

    from ..streaming import jobs

    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = V.table(spark, sf_dir, table).schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")
    stream = V.call_log_of(rows) if table == "events" else V.pair_of(V.seg_doc_of(rows))
    jobs.run_available(job(stream), f"{home}/out", f"{home}/state", mode).awaitTermination()
    out = spark.read.parquet(f"{home}/out")
    return jobs.latest(out, keys) if keys else out


@query("""SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) >= any_value(expected) AS finished
FROM call_log JOIN (SELECT job_id, count(*) + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS expected FROM call_log GROUP BY 1) USING (job_id) GROUP BY job_id""", "call_log")
def r1_progress_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that know how many calls they will have, every fifth one more than there are: finished ones leave the state."""
    from ..streaming import jobs

    expected = V.call_log(spark, sf_dir).groupBy("job_id").agg((F.count("*") + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0)).alias("expected"))
    return streamed(spark, sf_dir, lambda s: jobs.stream_progress_until_done(s.join(expected, "job_id")), "update", ["job_id"])


@query("""SELECT 'd' || d.doc_id || '_hindi.' || CASE WHEN d.doc_id % 2 = 0 THEN 'xliff' ELSE 'MQXLIFF' END AS name, count(s.doc_id) AS segments, count(s.doc_id) FILTER (seg_index % 2 = 0) AS translated
FROM documents d LEFT JOIN (SELECT * FROM seg_doc WHERE seg_index % 7 <> 3) s ON s.doc_id = d.doc_id WHERE d.doc_id % 10 <> 9 GROUP BY d.doc_id""", "seg_doc")
def k11_k9_export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents translated in part and written as files under their translations' names, but for those that a gate holds
    back; the files of that folder read and scanned again."""
    import uuid

    from ..sources import sink
    from ..sources.tables import languages

    found, own, done = _translated_files(spark, sf_dir)
    gates = found.select("doc_id", (F.regexp_extract("doc_id", "([0-9]+)$", 1).cast("long") % 10 == 9).alias("blocked"))
    home = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    sink.export_documents(found, own, done, home, F.lit("hi"), languages(spark), gates)
    rows = files.xliff_segments(files.xml_documents(files.read_files(spark, home))).groupBy("doc_id").agg(F.count("*").alias("segments"), F.count("target_text").alias("translated"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    there = list_files(spark, home).select(*files.named("path"))  # the names alone: no file is opened for them
    return there.select("doc_id", F.col("file_name").alias("name")).join(rows, "doc_id", "left").select("name", zero("segments"), zero("translated"))


def _translated_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as files of two extensions, their segments, and a translation of every second one."""
    docs = stored(_xliff_documents(spark, sf_dir), "documents")
    name = F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id").cast("long") % 2 == 0, ".xliff").otherwise(".MQXLIFF"))
    found = docs.select("doc_id", name.alias("file_name"), F.when(F.endswith(name, F.lit(".xliff")), "xliff").otherwise("mqxliff").alias("source_format"), F.length("xml").cast("long").alias("length"), F.col("xml").cast("binary").alias("content"))
    own = files.xliff_segments(docs)
    even = own.where("cast(substring(segment_id, 2) as int) % 2 = 0")
    return found, own, even.select("doc_id", "segment_id", F.lit("completed").alias("status"), F.concat(F.lit("T "), "source_text").alias("translated_raw"), F.concat(F.lit("T "), "source_text").alias("translated_text"))


@query("""SELECT CASE doc_id % 6 WHEN 1 THEN 'Unsupported file type' WHEN 2 THEN 'File is empty.' WHEN 3 THEN 'No <trans-unit> elements found.' WHEN 4 THEN 'XML parse error' ELSE 'segment' END AS kind, count(*) AS n
FROM (SELECT d.doc_id FROM documents d WHERE doc_id % 6 BETWEEN 1 AND 4 UNION ALL SELECT doc_id FROM seg_doc WHERE doc_id % 6 IN (0, 5) AND seg_index % 7 <> 3) GROUP BY 1""", "seg_doc")
def r2_s8_s9_arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, two of three of them of no use, in two arrivals; each arrival's files are taken in by a
    stream that goes on where it ended: segments, and a quarantine with the reasons."""
    import uuid

    from ..sources import sink
    from ..streaming import jobs

    home = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    docs = _xliff_documents(spark, sf_dir)
    case = F.col("doc_id").cast("long") % 6
    name = F.concat(F.lit("d"), "doc_id", F.when(case == 1, ".txt").otherwise(".xliff"))
    text = F.when(case == 2, " \n").when(case == 3, "<xliff></xliff>").when(case == 4, "<a><b></a>").otherwise(F.col("xml"))
    made = docs.select(F.col("doc_id").cast("long").alias("k"), name.alias("name"), text.cast("binary").alias("content"))
    for part in (0, 1):
        sink.write_files(made.where(F.col("k") % 2 == part), f"{home}/in")
        jobs.ingest(jobs.arriving_files(spark, f"{home}/in", per_batch=50_000), home, f"{home}/state").awaitTermination()
    ok = spark.read.parquet(f"{home}/segments").select(F.lit("segment").alias("kind"))
    bad = spark.read.parquet(f"{home}/quarantine").select(F.col("error_message").alias("kind"))
    return ok.unionByName(bad).groupBy("kind").agg(F.count("*").alias("n"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, made once for its readers."""
    import uuid

    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _unit(t, k):
    return F.concat(F.lit('<trans-unit id="u'), k.cast("string"), F.when(k % 7 == 3, '" translate="no">').otherwise('">'), F.lit("<source>"), xml_escape(t), F.lit("</source><target/></trans-unit>"))


def _xliff_documents(spark: SparkSession, sf_dir: str, unit=_unit) -> DataFrame:
    """(doc_id, xml, lang): each document's segments as a bilingual file, every seventh unit locked."""
    d = V.spread(V.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    texts = F.transform(F.filter(F.split("text", "\n", -1), lambda x: ~is_blank(x)), plain_text)
    body = F.array_join(F.transform(texts, unit), "\n")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.concat(F.lit('<xliff><file source-language="'), "lang", F.lit('">'), body, F.lit("</file></xliff>")).alias("xml"))


RAW = """source_text || chr(160) || 'A&#0; <c> & <bpt id="1">x</bpt>'"""


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'u' || seg_index AS segment_id, {RAW} AS source_raw, {V.sql_plain(f"({RAW})")} AS source_text, 's' || (seg_index % 3) AS own_status, 'a & "b"' AS note FROM seg_doc""", "seg_doc")
def s2_s3_inner_xml_and_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner XML with references, CDATA and markup, and attributes in either quotes; each unit's copy in a comment is no unit."""

    def unit(t, k):
        u = F.concat(F.lit("<trans-unit id='u"), k.cast("string"), F.lit("' mq:status=\"s"), (k % 3).cast("string"), F.lit("\" note='a &amp; \"b\"'><source>"), xml_escape(t), F.lit('&#160;&#x41;&#0;<![CDATA[ <c> & ]]><bpt id="1">x</bpt></source></trans-unit>'))
        return F.concat(u, F.lit("<!-- <trans-unit id='no'><source>no</source></trans-unit> -->"))

    rows = files.xliff_segments(_xliff_documents(spark, sf_dir, unit))
    return rows.select("doc_id", "segment_id", "source_raw", "source_text", F.col("attributes")["mq:status"].alias("own_status"), F.col("attributes")["note"].alias("note"))


@query("SELECT doc_id, doc_id % 3 = 0 AS well_formed FROM documents")
def k7_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as XML, two of three with an element left open or a bare ampersand."""
    case = F.col("doc_id") % 3
    clean = F.regexp_replace(xml_escape(F.coalesce("text", F.lit(""))), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    xml = F.concat(F.lit("<r><p>"), clean, F.when(case == 1, "<b></p></r>").when(case == 2, "A & B</p></r>").otherwise("</p></r>"))
    return V.table(spark, sf_dir, "documents").select("doc_id", files.is_well_formed(xml).alias("well_formed"))


@query("""SELECT doc_id, seg_index, '__TAG_1__' || t || '__TAG_2____TAG_3__' AS protected_text, '__TAG_1__=<bpt id="1">i</bpt>|__TAG_2__=<ph id="2"/>|__TAG_3__=<mq:ch val="x">y</mq:ch>' AS tokens
FROM (SELECT doc_id, seg_index, regexp_replace(source_text, '<', '', 'g') AS t FROM seg_doc)""", "seg_doc")
def t1_inline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline tags of translation files around each segment, by the default pattern."""
    rows = V.seg_doc(spark, sf_dir).select("doc_id", *long("seg_index"), F.concat(F.lit('<bpt id="1">i</bpt>'), F.regexp_replace("source_text", "<", ""), F.lit('<ph id="2"/><mq:ch val="x">y</mq:ch>')).alias("raw"))
    return protect_tags(rows, "raw").select("doc_id", "seg_index", "protected_text", token_texts(F.col("tag_tokens")).alias("tokens"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'u' || seg_index AS segment_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_index) - 1 AS seg_index, source_text, lang AS declared_source_lang FROM seg_doc WHERE seg_index % 7 <> 3""", "seg_doc")
def s1_s4_scan_xliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.with_declared_langs(_xliff_documents(spark, sf_dir))
    langs = docs.select("doc_id", "declared_source_lang")
    return files.xliff_segments(docs).join(langs, "doc_id").select("doc_id", "segment_id", *long("seg_index"), "source_text", "declared_source_lang")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'u' || seg_index AS segment_id, CASE WHEN seg_index % 2 = 0 THEN {V.sql_plain("('T & ' || source_text)")} END AS target_text FROM seg_doc WHERE seg_index % 7 <> 3""", "seg_doc")
def k1_rewrite_xliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second unit translated into its file, and the written files scanned again."""
    docs = _xliff_documents(spark, sf_dir)
    own = files.xliff_segments(docs)
    done = own.where("cast(substring(segment_id, 2) as int) % 2 = 0").select("doc_id", "segment_id", F.lit("completed").alias("status"), F.concat(F.lit("T & "), "source_text").alias("translated_raw"))
    written = rewrite.rewrite_xliff(docs, done).select("doc_id", F.col("output").alias("xml"))
    return files.xliff_segments(written).select("doc_id", "segment_id", "target_text")


@query(f"""WITH u AS (SELECT *, CASE WHEN seg_index % 3 = 2 THEN 'own' END AS before FROM seg_doc), n AS (SELECT doc_id, count(*) AS units, count(*) FILTER (seg_index % 2 = 0) AS replaced FROM seg_doc GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'u' || seg_index AS segment_id, before, CASE WHEN seg_index % 2 = 0 THEN {V.sql_plain("('T & ' || source_text)")} ELSE before END AS after, replaced, 2 * units AS others FROM u JOIN n USING (doc_id)""", "seg_doc")
def s1_k1_own_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose comments, alternatives and notes hold targets of theirs: read, every second one translated into its own
    target, and read again; what the others hold stays."""

    def unit(t, k):
        own = F.when(k % 3 == 0, "").when(k % 3 == 1, "<target state='a>b'/>").otherwise("<target>own</target>")
        head = F.concat(F.lit('<trans-unit note="1 > 0" id="u'), k.cast("string"), F.lit('"><!-- <target>old</target> --><source>'), xml_escape(t), F.lit("</source>"))
        return F.concat(head, F.lit("<alt-trans><source>x</source><target>near</target></alt-trans><m:h><m:e><target>near</target></m:e></m:h>"), own, F.lit("</trans-unit>"))

    docs = stored(_xliff_documents(spark, sf_dir, unit).select("doc_id", "xml"), "documents")
    own = stored(files.xliff_segments(docs).select("doc_id", "segment_id", "source_text", "target_text"), "segments")
    done = own.where("cast(substring(segment_id, 2) as int) % 2 = 0").select("doc_id", "segment_id", F.lit("completed").alias("status"), F.concat(F.lit("T & "), "source_text").alias("translated_raw"))
    written = rewrite.rewrite_xliff(docs, done)
    others = F.regexp_count("output", F.lit("<target>near</target>")).cast("long").alias("others")
    again = files.xliff_segments(written.select("doc_id", F.col("output").alias("xml"), "replaced", others), ("replaced", "others"))
    after = again.select("doc_id", "segment_id", F.col("target_text").alias("after"), "replaced", "others")
    return own.select("doc_id", "segment_id", F.col("target_text").alias("before")).join(after, ["doc_id", "segment_id"])


def _package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): documents as word-processor markup, each paragraph in two runs, some in tables, an empty run and an
    empty paragraph before each."""
    s = V.seg_doc(spark, sf_dir)
    half = F.floor(F.length("source_text") / 2).cast("int")
    runs = F.concat(F.lit('<w:p w:id="0"/><w:p><w:pPr/><w:r><w:t xml:space="preserve"/></w:r><w:r><w:t>'), xml_escape(F.substring("source_text", F.lit(1), half)), F.lit('</w:t></w:r><w:r><w:t xml:space="preserve">'), xml_escape(F.substring("source_text", half + 1, F.length("source_text"))), F.lit("</w:t></w:r></w:p>"))
    p = F.when(F.col("seg_index") % 5 == 2, F.concat(F.lit("<w:tbl><w:tc>"), runs, F.lit("</w:tc></w:tbl>"))).otherwise(runs)
    parts = s.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seg_index", p.alias("p")))).alias("x"))
    return parts.select("doc_id", F.concat(F.lit("<w:document><w:body>"), F.array_join(F.transform("x", lambda x: x["p"]), ""), F.lit("</w:body></w:document>")).alias("xml"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'p-' || row_number() OVER (PARTITION BY doc_id ORDER BY seg_index) AS segment_id, source_text FROM seg_doc WHERE source_text <> ''""", "seg_doc")
def s5_s6_scan_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.docx_segments(_package_documents(spark, sf_dir)).select("doc_id", "segment_id", "source_text")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'p-' || row_number() OVER (PARTITION BY doc_id ORDER BY seg_index) AS segment_id, 'T & ' || source_text AS source_text, true AS same_count FROM seg_doc WHERE source_text <> ''""", "seg_doc")
def k2_k8_rewrite_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph translated into its document; the outputs opened again, and their segments counted."""
    docs = _package_documents(spark, sf_dir)
    own = files.docx_segments(docs)
    done = own.select("doc_id", "segment_id", F.lit("completed").alias("status"), F.concat(F.lit("T & "), "source_text").alias("translated_text"))
    again = files.docx_segments(rewrite.rewrite_docx_xml(docs, own, done).select("doc_id", F.col("output").alias("xml")))
    same = rewrite.verify_roundtrip(again, own).select("doc_id", F.col("ok").alias("same_count"))
    return again.join(same, "doc_id").select("doc_id", "segment_id", "source_text", "same_count")
