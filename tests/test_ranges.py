"""Ranges of long keys against whole windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lingloom.operators import segments, validate
from lingloom.operators.ranges import beside, running

SCHEMA = "k string, pos double, text string, n int"


def _rows(kind):
    rnd = random.Random(7)
    places = rnd.sample(range(-4000, 9000), 900)
    rows = [("hot", float(p), f"t{p}", p % 5) for p in places] + [(None, float(p), f"u{p}", 1) for p in places[:40]] + [("one", 3.5, "alone", 2)]
    extra = {"plain": [], "null": [("hot", None, "first", 1), ("void", None, "only", 1)], "ends": [("hot", float("nan"), "last", 1), ("hot", float("inf"), "late", 1), ("hot", float("-inf"), "early", 1)], "empty": []}
    return ([] if kind == "empty" else rows) + extra[kind]


@pytest.mark.parametrize("kind, span", [("plain", 1), ("plain", 100_000), ("null", 7), ("ends", 1000), ("empty", 7)])
def test_ranges_equal_whole_windows(spark, kind, span):
    df = spark.createDataFrame(_rows(kind), SCHEMA)
    wanted = {"p": ("text", -1), "n2": ("text", 1), "before": ("n", -1)}
    rows = lambda x: sorted(map(str, x.select(*sorted(x.columns)).collect()))
    assert rows(beside(df, "k", "pos", wanted, span)) == rows(beside(df, "k", "pos", wanted))
    sums = {"s": F.col("n"), "c": F.lit(1)}
    assert rows(running(df, "k", "pos", sums, span)) == rows(running(df, "k", "pos", sums))
    assert rows(segments.reindex(df, "k", "pos", span=span)) == rows(segments.reindex(df, "k", "pos"))


def test_repeated_positions_stay_together(spark):
    df = spark.createDataFrame([("d", p, c, 1) for p in (1, 1, 2, 3, 3) for c in "xx"], SCHEMA.replace("double", "int"))
    got = beside(df, "k", "pos", {"before": ("pos", -1)}, 1).collect()
    assert sorted(str(r.before) for r in got) == ["1"] * 4 + ["2"] * 2 + ["3"] * 3 + ["None"]


def test_no_task_holds_a_long_document(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") >= 0, "one").alias("doc_id"), F.col("id").alias("seg_index"), F.col("id").cast("string").alias("source_text"), F.lit("completed").alias("status"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (segments.with_context(rows, span=500), segments.reindex(rows.drop("seg_index").withColumn("pos", F.col("source_text").cast("long")), span=500), segments.progress(rows, 2, span=250)):
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.hash("*"))).collect()]
            assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_spans_of_batches_and_order(spark):
    rows = spark.range(95).select((F.col("id") % 2).alias("doc_id"), (F.col("id") / 2).cast("int").alias("seg_index"), F.when(F.col("id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.expr("cast(id / 2 as int) + if(id % 5 = 0, 1.5, 0)").alias("pos"))
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    assert same(segments.with_batch_no(rows, 10, span=3), segments.with_batch_no(rows, 10))
    assert same(segments.progress(rows, 10, span=2), segments.progress(rows, 10))
    assert same(validate.out_of_order(rows, span=4), validate.out_of_order(rows)) and validate.out_of_order(rows).count() > 0
    w = Window.partitionBy("doc_id").orderBy("seg_index")
    whole = rows.select("doc_id", "seg_index", F.lag("status").over(w).alias("p"))
    assert same(beside(rows, "doc_id", "seg_index", {"p": ("status", -1)}, 6).select(*whole.columns), whole)
