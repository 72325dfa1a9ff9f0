"""Order, context and batches of segments. A document that is one file fits a task; `span` cuts longer ones into ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, right_trimmed
from .ranges import beside, running

EMPTY_SOURCE = "Source text was empty"


def drop_locked(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    return df.where(F.coalesce(F.col(attributes)["translate"], F.lit("")) != "no")


def reindex(df: DataFrame, key: str = "doc_id", position: str = "pos", out: str = "seg_index", span: int | None = None) -> DataFrame:
    """Dense index from 0 in document order; run it after locked rows are gone. span: positions of a range."""
    if span is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1)
    return running(df, key, position, {"_rows": F.lit(1)}, span).withColumn(out, F.col("_rows") - 1).drop("_rows", "_rows_all")


def with_segment_id(df: DataFrame, id_col: str = "segment_id", position: str = "pos") -> DataFrame:
    return df.withColumn(id_col, F.coalesce(id_col, F.concat(F.lit("segment-"), F.col(position).cast("string"))))


def cut_context(c: Column, max_chars: int) -> Column:
    return F.when(F.length(c) > max_chars, F.concat(right_trimmed(F.substring(c, 1, max_chars)), F.lit("..."))).otherwise(c)


def with_context(df: DataFrame, max_chars: int = 500, key: str = "doc_id", order: str = "seg_index", text: str = "source_text", span: int | None = None) -> DataFrame:
    """previous_text and next_text, '' at the ends, cut to max_chars; blank neighbours count, so run it before split_blank."""
    near = lambda c: cut_context(F.coalesce(c, F.lit("")), max_chars)
    rows = beside(df, key, order, {"previous_text": (text, -1), "next_text": (text, 1)}, span)
    return rows.withColumns({c: near(F.col(c)) for c in ("previous_text", "next_text")})


def with_batch_no(df: DataFrame, size: int = 10, key: str = "doc_id", span: int | None = None) -> DataFrame:
    """batch_no from 0 and total_batches; with span, the last batch comes from an aggregate in place of a window."""
    batch = F.floor(F.col("seg_index") / size).cast("int")
    if span is not None:
        last = df.groupBy(F.col(key).alias("_key")).agg((F.max(batch) + 1).alias("total_batches"))
        return df.withColumn("batch_no", batch).join(last, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return df.withColumn("batch_no", batch).withColumn("total_batches", F.max(batch).over(Window.partitionBy(key)) + 1)


def split_blank(df: DataFrame, text: str = "source_text", target: str = "target_text") -> tuple[DataFrame, DataFrame]:
    """(rows to translate, finished rows of blank sources: completed with the target they have and a warning)."""
    blank = is_blank(F.col(text))
    done = df.where(blank).select("doc_id", "segment_id", "seg_index", F.coalesce(F.col(target), F.lit("")).alias("translated_text"), F.lit("completed").alias("status"), F.array(F.lit(EMPTY_SOURCE)).alias("validation_warnings"))
    return df.where(~blank), done


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by the order column; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def pack_batches(df: DataFrame, size: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, batch_no, items, items_json): the rows of a batch in order, as structs and as compact JSON without absent context."""
    item = F.struct("seg_index", F.col("segment_id").alias("id"), F.nullif("previous_text", F.lit("")).alias("previousText"), F.col("protected_text").alias("sourceText"), F.nullif("next_text", F.lit("")).alias("nextText"))
    packed = df.groupBy(key, F.floor(F.col("seg_index") / size).cast("int").alias("batch_no")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    slim = F.transform("items", lambda x: x.dropFields("seg_index"))
    return packed.withColumn("items_json", F.to_json(slim))


def progress(results: DataFrame, size: int = 10, key: str = "doc_id", span: int | None = None) -> DataFrame:
    """(key, batch_no, completed, failed, current_index): running counts after each batch. span: batches of a range."""
    batch = results.groupBy(key, F.floor(F.col("seg_index") / size).cast("int").alias("batch_no")).agg(F.count_if(F.col("status") == "completed").alias("c"), F.count_if(F.col("status") == "failed").alias("f"), F.count("*").alias("n"))
    run = running(batch, key, "batch_no", {"completed": F.col("c"), "failed": F.col("f"), "rows": F.col("n")}, span)
    return run.select(key, "batch_no", "completed", "failed", F.least((F.col("batch_no") + 1) * size - 1, F.col("rows_all") - 1).cast("long").alias("current_index"))


def propagate_repetitions(segments: DataFrame, results: DataFrame, text: str = "source_text") -> DataFrame:
    """Every segment with the last completed translation of its text in its document, null if there is none."""
    from ..functions.text import trimmed

    keyed = segments.withColumn("_text", trimmed(F.col(text)))
    done = keyed.join(results.where("status = 'completed'").select("doc_id", "segment_id", "translated_text"), ["doc_id", "segment_id"])
    memory = done.groupBy("doc_id", "_text").agg(F.max_by("translated_text", "seg_index").alias("repeated_translation"))
    return keyed.join(memory, ["doc_id", "_text"], "left").drop("_text")
