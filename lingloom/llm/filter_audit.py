"""Operator 13: which of five filters removes what, in every order of them, by a stream with retractions.

The files of a table come as available-now micro-batches. Filters A to D are judged by a text alone, so each row gets their
mask at once; E, a text that a smaller id has too, depends on rows that may come later. A keyed state therefore holds for
each text (by its SHA-256) the smallest id so far and what its rows were counted as. When a smaller id arrives, the earlier
rows are retracted from their part's counter of (mask, labels), and counted again with E. A micro-batch writes the sums of
its changes; the report comes from the sums of all, a small table: at most 32 masks x 4 labels for each part.

Texts are dealt into `buckets` groups of some BUCKET_TEXTS, whose state is one row of arrays, so a group is one call of
Python and its size is bounded by the number of buckets, a count of the table's rows. Before the shuffle each Arrow batch
is folded: of a text's rows only those of the least id go on to its group, all others are E for certain and go on as
counts. So a text that a third of all rows have sends one row for each Arrow batch.

The stream's checkpoint, its state and its changes are in the shared folder; a lost task or executor is run again from there, a
repeated micro-batch overwrites its own changes. They are removed when the sums have been saved.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import removed, saved, with_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
E = 16  #: the bit of filter E; A to D are 1, 2, 4 and 8
BUCKET_TEXTS = 1024
MICRO_BATCHES = 4
CHANGES = "part string, mask int, good boolean, toxic boolean, n long"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < 50, F.size(F.array_distinct(words)) * 100 < n * 65, capitals * 100 > F.length(text) * 5, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def available_now(spark: SparkSession, path: str, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """A stream over the Parquet files at a path, in about so many micro-batches."""
    table = spark.read.parquet(path)
    files = max(1, -(-len(table.inputFiles()) // micro_batches))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{path.rstrip('/')}*")


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, settled, key, id, part, mask, good, toxic, n): rows of a text's least id of the batch, and counts of the rest."""
    by = ["part", "mask", "good", "toxic"]
    for pdf in batches:
        if not len(pdf):
            continue
        buckets = int(pdf["buckets"].iloc[0])
        known = pdf[pdf["known"]]
        least = known.groupby("key")["id"].transform("min")
        first = known[known["id"] == least].groupby(["bucket", "key", "id", *by], sort=False).size().rename("n").reset_index().assign(settled=False)
        later = known[known["id"] != least]
        rest = pd.concat([later.assign(mask=later["mask"] | E), pdf[~pdf["known"]]])
        rest = rest.groupby(by, sort=False).agg(n=("mask", "size"), id=("id", "first"), key=("key", "first")).reset_index().assign(settled=True)
        rest["bucket"] = [zlib.crc32(repr(x).encode()) % buckets for x in rest[by].itertuples(index=False)]
        for out in (first, rest):
            if len(out):
                yield out[["bucket", "settled", "key", "id", *by, "n"]]


def _updated(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What a bucket's new rows change in the counters; its state keeps the rows of each text's least id."""
    by = ["part", "mask", "good", "toxic"]
    new = pd.concat(list(batches))
    changes = [new[new["settled"]][[*by, "n"]]]
    new = new[~new["settled"]][["key", "id", *by, "n"]].assign(old=False)
    if len(new):
        held = dict(zip(["key", "id", *by, "n"], state.get)) if state.exists else None
        rows = pd.concat([pd.DataFrame(held).assign(old=True), new]) if held else new
        least = rows["id"] == rows.groupby("key")["id"].transform("min")
        gone, late, first = rows[rows["old"] & ~least], rows[~rows["old"] & ~least], rows[~rows["old"] & least]
        changes += [x[[*by, "n"]] for x in (gone.assign(n=-gone["n"]), gone.assign(mask=gone["mask"] | E), late.assign(mask=late["mask"] | E), first)]
        if len(gone) or len(first):
            kept = rows[least].groupby(["key", "id", *by], sort=False)["n"].sum().reset_index()
            state.update(tuple(kept[c].tolist() for c in ["key", "id", *by, "n"]))
    yield pd.concat(changes).groupby(by, sort=False)["n"].sum().reset_index()


def count_masks(stream: DataFrame, labels: DataFrame, n_rows: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n) of a finite stream's rows: which filters they fail.

    labels(id, quality, toxic) may lack ids and may repeat them: good is any quality of 1, toxic any toxic of 1. A null text
    counts as empty, a null part as ''. A row of null id fails no E and makes no other row fail it; rows that repeat the
    least id of their text are all its first. An empty stream gives no rows.
    """
    spark = stream.sparkSession
    with_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/audit-{uuid.uuid4().hex}"
    buckets = max(1, -(-n_rows // BUCKET_TEXTS))
    kind = stream.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stream.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = rows.withColumn("_salt", F.when(F.col("_id").isNull(), F.xxhash64("key")).otherwise(0))
    flags = labels.groupBy(F.col(id_col).alias("_label")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("_label is not null").withColumn("_zero", F.lit(0).cast("long"))
    rows = rows.join(flags, (F.col("_id") == F.col("_label")) & (F.col("_salt") == F.col("_zero")), "left")
    no = F.lit(False)
    blank = F.lit("0").cast(kind)
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.lit(buckets).cast("long").alias("buckets"), F.col("_id").isNotNull().alias("known"), "key", F.coalesce("_id", blank).alias("id"), "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    folded = rows.mapInPandas(_folded, f"bucket long, settled boolean, key binary, id {kind}, part string, mask int, good boolean, toxic boolean, n long")
    held = f"key array<binary>, id array<{kind}>, part array<string>, mask array<int>, good array<boolean>, toxic array<boolean>, n array<bigint>"
    changes = folded.groupBy("bucket").applyInPandasWithState(_updated, CHANGES, held, "append", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(f"{home}/changes/micro_batch={number}")

    spark.createDataFrame([], CHANGES).write.parquet(f"{home}/changes/micro_batch=-1")
    changes.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(CHANGES).parquet(f"{home}/changes")
    out = saved(every.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0"))
    removed(spark, home)
    return out


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits of the filters before, bit) of all orders."""
    out = []
    for p in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(p):
            out.append(("".join(FILTERS[x] for x in p), k + 1, sum(1 << x for x in p[:k]), 1 << f))
    return out


def report(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): five steps of each of
    the 120 orders for each part of counts(part, mask, good, toxic, n)."""
    spark, n = counts.sparkSession, len(FILTERS)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("c"))
    cases = {(b, f): math.factorial(bin(b).count("1")) * math.factorial(n - 1 - bin(b).count("1")) for _, _, b, f in orders()}
    case = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit"), F.lit(w).cast("long").alias("ways")) for (b, f), w in cases.items())))
    rows = parts.withColumn("x", case).select("part", "c", "x.*")

    def total(test) -> Column:
        return F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda a, r: a + r["n"])

    before = lambda r: r["mask"].bitwiseAND(F.col("before")) == 0
    fails = lambda r: r["mask"].bitwiseAND(F.col("bit")) != 0
    rows = rows.select(
        "part", "before", "bit", "ways",
        total(lambda r: before(r) & ~fails(r)).alias("kept"),
        total(lambda r: before(r) & fails(r)).alias("removed"),
        total(lambda r: ~before(r) & fails(r)).alias("redundant"),
        total(lambda r: r["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda r: before(r) & fails(r) & r["good"]).alias("good_lost"),
        total(lambda r: before(r) & fails(r) & r["toxic"]).alias("toxic_lost"),
    )
    rows = rows.withColumn("shapley", F.sum(F.col("ways") * F.col("removed")).over(Window.partitionBy("part", "bit")))
    steps = F.broadcast(spark.createDataFrame(orders(), "filter_order string, step int, before int, bit int"))  # 600 rows
    return rows.join(steps, ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
