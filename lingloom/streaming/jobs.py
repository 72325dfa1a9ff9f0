"""The batch operators on streams: progress of jobs, validation of arriving segments, call statistics by time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.completeness import with_completeness
from ..functions.protect import protect
from ..functions.text import classify_format
from ..sources import files
from ..sources.listing import list_files, open_files


def stream_progress(results: DataFrame, key: str = "job_id") -> DataFrame:
    """Completed, failed and all results of each job so far; state is one row for each job. Output mode update."""
    return results.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def stream_progress_until_done(results: DataFrame, key: str = "job_id", expected: str = "expected", abandoned_after_ms: int | None = None) -> DataFrame:
    """(key, total, completed, failed, finished) of each job that a micro-batch has changed. A row says how many results its job
    will have; when they are there the job is finished and its state goes. So does the state of a job that got nothing for
    `abandoned_after_ms`, with a last row that is not finished; a stream with that never runs out of micro-batches, so it is
    for triggers other than available-now. State is one row for each open job."""
    kind = results.schema[key].dataType.simpleString()

    def update(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, completed, failed, wanted = state.get if state.exists else (0, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
        else:
            for pdf in batches:
                total += len(pdf)
                completed += int((pdf["status"] == "completed").sum())
                failed += int((pdf["status"] == "failed").sum())
                wanted = max(wanted, int(pdf["expected"].max()))
            if total < wanted:
                state.update((total, completed, failed, wanted))
                if abandoned_after_ms is not None:
                    state.setTimeoutDuration(abandoned_after_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame({key: [name[0]], "total": [total], "completed": [completed], "failed": [failed], "finished": [total >= wanted]})

    rows = results.select(key, F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.col(expected).cast("long"), F.lit(0)).alias("expected")).where(F.col(key).isNotNull())
    out = f"{key} {kind}, total long, completed long, failed long, finished boolean"
    return rows.groupBy(key).applyInPandasWithState(update, out, "total long, completed long, failed long, wanted long", "update", "NoTimeout" if abandoned_after_ms is None else "ProcessingTimeTimeout")


@dataclass
class Arrivals:
    """Files below a path, to be taken in so many at a time."""

    spark: SparkSession
    path: str
    per_batch: int

    def stream(self, log: str) -> DataFrame:
        """(path, length) of the files, a stream of the lists that the log holds; files that it does not name yet are added, in
        lists of at most per_batch. A file is told by its path, and named once. Tasks list the folder and compare, so what
        the driver and the stream's own checkpoint hold grows with the lists, not with the files."""
        schema = "path string, length long"
        found, first = list_files(self.spark, self.path), False
        try:
            found = found.join(self.spark.read.schema(schema).parquet(log), "path", "left_anti")
        except AnalysisException:
            first = True
        found = found.persist()
        count = found.count()
        if count or first:
            lists = max(1, math.ceil(1.1 * count / self.per_batch))
            found.repartition(lists).write.mode("append").option("maxRecordsPerFile", self.per_batch).parquet(log)
        found.unpersist()
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)


def arriving_files(spark: SparkSession, path: str, per_batch: int = 1000) -> Arrivals:
    """Files below a path that pyarrow reaches, as they arrive; `ingest` takes each in once."""
    return Arrivals(spark, path, per_batch)


def ingest(arriving: Arrivals, home: str, checkpoint: str, max_bytes: int = files.MAX_BYTES) -> StreamingQuery:
    """Arrived files as segments (home/segments), and those of another type, too large or unreadable with the reason
    (home/quarantine); a micro-batch that is run again overwrites its own rows. The next call takes in what has arrived
    since; what has been seen is in checkpoint/arrivals."""

    def keep(batch: DataFrame, number: int) -> None:
        packages = not batch.where(classify_format(F.col("path")) == "docx").isEmpty()  # else no task asks Python for them
        batch = files.file_rows(open_files(batch, max_bytes)).persist()  # its readers would open every file again
        accepted, rejected = files.split_acceptable(batch, max_bytes)
        segments = files.xliff_segments(files.xml_documents(accepted.where("source_format in ('xliff', 'mqxliff')")))
        errors = files.text_errors(accepted)
        if packages:
            segments = segments.unionByName(files.docx_segments(files.unpacked(accepted.where("source_format = 'docx'")).where("xml is not null")))
            errors = files.scan_errors(accepted)
        segments.write.mode("overwrite").parquet(f"{home}/segments/micro_batch={number}")
        rejected.select("doc_id", "error_message").unionByName(errors).write.mode("overwrite").parquet(f"{home}/quarantine/micro_batch={number}")
        batch.unpersist()

    return arriving.stream(f"{checkpoint}/arrivals").writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def stream_validate(segments: DataFrame, source: str = "source_text", target: str = "target_text") -> DataFrame:
    """Protection and completeness of each arriving segment; the same columns as in batch, no state."""
    return with_completeness(protect(segments, source), source, target, "source_lang", "target_lang")


def stream_call_metrics(call_log: DataFrame, window: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Requests, failures, mean and greatest latency by window and provider; the watermark bounds the state."""
    at = call_log.withColumn(time, F.col(time).cast("timestamp"))
    rows = at.withWatermark(time, late) if call_log.isStreaming else at
    out = rows.groupBy(F.window(time, window).alias("w"), "provider").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg("latency_ms").alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))
    return out.select(F.col("w.start").alias("window_start"), "provider", "requests", "failed", F.floor(F.col("avg_latency_ms") + 0.5).alias("avg_latency_ms"), "max_latency_ms")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, written as Parquet, each micro-batch once. In update mode, a micro-batch writes the
    rows that it changed into a folder of its own, which a retry overwrites; `latest` reads the last ones."""
    if mode == "append":
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    return df.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{path}/micro_batch={k}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of what an update stream wrote; combines before the shuffle."""
    rest = [c for c in changes.columns if c not in (*keys, "micro_batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "micro_batch").alias("_b")).select(*keys, "_b.*")
