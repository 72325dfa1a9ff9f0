"""Checks of results against their segments, issues, reports and output gates, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.completeness import held, with_completeness
from ..functions.protect import find_tokens
from ..functions.text import failure_hint, is_blank, numbers
from .ranges import beside

KEYS = ["doc_id", "segment_id"]
#: What is said of a segment without a result, of a failed check, and of a number that was lost.
NO_RESULT = "Segment missing from translation results"
NO_MESSAGE = "Translation failed"
EMPTY_RESULT = "Empty translation output for non-empty source segment"
TAGS_LEFT = "Unrestored tag tokens: "
ENTITIES_LEFT = "Unrestored entity tokens: "
NUMBER_LOST = ('number "', '" from source not found in translation')


def missing_segments(segments: DataFrame, results: DataFrame) -> DataFrame:
    return segments.join(results.select(*KEYS).distinct(), KEYS, "left_anti")


def missing_numbers(source: Column, target: Column) -> Column:
    return F.array_except(F.array_distinct(numbers(source)), numbers(F.coalesce(target, F.lit(""))))


def _issue(no: int, kind: str, message: Column) -> Column:
    return F.struct(F.lit(no).alias("check_no"), F.lit(kind).alias("error_type"), message.alias("message"))


def checked(segments: DataFrame, results: DataFrame) -> DataFrame:
    """results with source, completeness, `issues` (one struct for each failed check) and `warnings`, and a row with
    `missing` set for each segment without a result.

    segments: doc_id, segment_id, seg_index, source_text, source_lang, target_lang; of repeated ids the last row counts
    (by seg_index), n_segments says how many there were. Orphan results keep a null source and get the placeholder
    checks only. One full join by segment; result_no numbers the results of a segment on the join's own partitions.
    """
    sources = segments.groupBy(*KEYS).agg(F.max_by(F.struct(F.col("seg_index").alias("s_index"), "source_text", "source_lang", "target_lang"), "seg_index").alias("s"), F.count("*").alias("n_segments"))
    order = Window.partitionBy(*KEYS).orderBy("seg_index")
    own = results.drop("source_text", "source_lang", "target_lang").withColumn("result_no", F.row_number().over(order))
    joined = own.join(sources.select(*KEYS, "s.*", "n_segments"), KEYS, "full").withColumn("missing", F.col("result_no").isNull())
    joined = joined.withColumn("seg_index", F.coalesce("seg_index", "s_index")).drop("s_index")
    df = with_completeness(joined, "source_text", "translated_text", "source_lang", "target_lang")
    done, has = F.col("status") == "completed", F.col("source_text").isNotNull()
    worded = has & ~is_blank(F.col("source_text"))
    raw = F.coalesce("translated_raw", F.lit(""))
    tags, entities = find_tokens(raw, "TAG"), find_tokens(raw, "ENTITY")
    verdict = F.col("completeness.status")
    issues = F.filter(
        F.array(
            F.when(F.col("missing"), _issue(-1, "validation_error", F.lit(NO_RESULT))),
            F.when(F.col("status") == "failed", _issue(0, "api_error", F.coalesce("error_message", F.lit(NO_MESSAGE)))),
            F.when(done & worded & is_blank(F.col("translated_text")), _issue(4, "validation_error", F.lit(EMPTY_RESULT))),
            F.when(done & (F.size(tags) > 0), _issue(5, "tag_error", F.concat(F.lit(TAGS_LEFT), F.array_join(tags, ", ")))),
            F.when(done & (F.size(entities) > 0), _issue(6, "entity_error", F.concat(F.lit(ENTITIES_LEFT), F.array_join(entities, ", ")))),
            F.when(done & worded & (verdict == "failed"), _issue(8, "validation_error", F.col("completeness.reason"))),
        ),
        lambda x: x.isNotNull(),
    )
    lost = F.when(done & has, missing_numbers(F.col("source_text"), F.col("translated_text")))
    own = F.coalesce("validation_warnings", F.array().cast("array<string>"))
    texts = F.array_distinct(F.concat(F.coalesce(F.transform(lost, lambda n: F.concat(F.lit(NUMBER_LOST[0]), n, F.lit(NUMBER_LOST[1]))), F.array().cast("array<string>")), F.when(done & worded & (verdict == "warning"), F.array("completeness.reason")).otherwise(F.array().cast("array<string>")), own))
    warnings = F.transform(texts, lambda w: F.concat(F.lit("Segment "), F.col("segment_id"), F.lit(": "), w))
    return held(df, issues=issues, warnings=F.when(F.col("missing"), F.array().cast("array<string>")).otherwise(warnings), missing_numbers=F.coalesce(lost, F.array().cast("array<string>")))


def issues_of(segments: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, segment_id, seg_index, check_no, error_type, message) of missing segments (check_no -1) and failed checks."""
    return checked(segments, results).select(*KEYS, "seg_index", F.explode("issues").alias("i")).select(*KEYS, "seg_index", "i.*")


def first_issue(issues: DataFrame) -> DataFrame:
    """One row for each segment with issues: the one that comes first."""
    best = issues.groupBy(*KEYS).agg(F.min(F.struct("check_no", "seg_index", "error_type", "message")).alias("b"))
    return best.select(*KEYS, "b.seg_index", "b.check_no", "b.error_type", "b.message")


def issue_histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id", "error_type").agg(F.count("*").alias("n"))


def out_of_order(results: DataFrame, position: str = "pos", span: int | None = None) -> DataFrame:
    """Results that come after one of a later segment. span: positions of a range of a long document."""
    return beside(results, "doc_id", position, {"_before": ("seg_index", -1)}, span).where("seg_index < _before").drop("_before")


def job_counts(results: DataFrame, key: str = "doc_id") -> DataFrame:
    return results.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def validation_report(segments: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each document: valid, segment_count_match, all_segments_present, failed segments and ordered warnings."""
    first = F.col("missing") | (F.col("result_no") == 1)
    failed = F.max(F.size("issues") > 0).over(Window.partitionBy(*KEYS))
    rows = checked(segments, results).withColumn("failed", failed)
    n = lambda c: F.count_if(c).alias
    out = rows.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(first, F.col("n_segments"))), F.lit(0)).cast("long").alias("n_source"),
        n(~F.col("missing"))("n_results"),
        n(F.col("missing"))("n_missing"),
        n(first & F.col("failed"))("failed_segments"),
        F.array_sort(F.collect_list(F.when(F.size("warnings") > 0, F.struct("seg_index", "warnings")))).alias("w"),
    )
    out = out.withColumn("warnings", F.flatten(F.transform("w", lambda x: x["warnings"]))).drop("w")
    out = out.withColumn("segment_count_match", F.col("n_source") == F.col("n_results")).withColumn("all_segments_present", F.col("n_missing") == 0)
    return out.withColumn("valid", F.col("segment_count_match") & F.col("all_segments_present") & (F.col("failed_segments") == 0))


def gate_outputs(results: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, blocked, gate, root_cause, hint, protected_issues): documents with a tag or entity error are blocked, and
    those with nothing completed, with the first failure as their cause; other errors let a partial output through."""
    hurt = issues.where(F.col("error_type").isin("tag_error", "entity_error")).groupBy("doc_id").agg(F.count("*").alias("protected_issues"))
    state = results.groupBy("doc_id").agg(F.count_if(F.col("status") == "completed").alias("c"), F.min_by("error_message", F.when(F.col("status") == "failed", F.col("seg_index"))).alias("cause"))
    out = state.join(hurt, "doc_id", "left").withColumn("protected_issues", F.coalesce("protected_issues", F.lit(0)))
    gate = F.when(F.col("protected_issues") > 0, "placeholders").when(F.col("c") == 0, "nothing_completed").otherwise("open")
    cause = F.when(gate == "nothing_completed", F.coalesce("cause", F.lit(NO_MESSAGE)))
    return out.select("doc_id", (gate != "open").alias("blocked"), gate.alias("gate"), cause.alias("root_cause"), F.when(cause.isNotNull(), failure_hint(cause)).alias("hint"), "protected_issues")


def golden_compare(source: DataFrame, human: DataFrame, machine: DataFrame) -> DataFrame:
    """Source, approved and machine text side by side for each segment that any of them has, with flags."""
    out = source.select(*KEYS, "source_text").join(human.select(*KEYS, F.col("text").alias("human_text")), KEYS, "full").join(machine.select(*KEYS, F.col("text").alias("machine_text")), KEYS, "full")
    return out.withColumns({"equal": F.coalesce(F.col("human_text") == F.col("machine_text"), F.lit(False)), "complete": F.col("source_text").isNotNull() & F.col("human_text").isNotNull() & F.col("machine_text").isNotNull()})


def pair_status(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_lang, target_lang, status): validated with a review, tested with a completed result, else implemented."""
    reviewed = reviews.select("doc_id").distinct().withColumn("reviewed", F.lit(1))
    rows = results.join(reviewed, "doc_id", "left").groupBy("source_lang", "target_lang").agg(F.max(F.coalesce("reviewed", F.lit(0))).alias("r"), F.max((F.col("status") == "completed").cast("int")).alias("c"))
    return rows.select("source_lang", "target_lang", F.when(F.col("r") == 1, "validated").when(F.col("c") == 1, "tested").otherwise("implemented").alias("status"))
