"""What several operators need from Spark: checkpoints in the shared folder, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names. Only a local session without one gets a folder of its own (tests): on a
    cluster each machine would write to its own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lingloom-"))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder: lost executors lose nothing of it.

    The shuffle files behind them go at once, as nothing reads them again; else they would wait for the driver's
    garbage collection and add up on the executors' disks.
    """
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store that a job made for itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A join's side up to this size goes to the tasks as a broadcast (its measured size); beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def side(df: DataFrame, row_bytes: int) -> DataFrame:
    """A saved df as a side of a join: its rows are counted, and it is broadcast where they are small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in Arrow batches of 8 MB at most; a smaller bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with a number from 0 in this order, equal rows in any order of theirs. Rows are dealt out by ranges of the order,
    numbered in each, and the ranges' counts added up."""
    dealt = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", inside).join(counts, "_range").withColumn(out, F.col("_own") - 1 + F.col("_before")).drop("_range", "_own", "_before")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph edges(src, dst); component is the smallest node reachable.

    Alternating star steps over edges (u, v), u > v. Large star: the smaller end of an edge gives way to its own least
    neighbour. Small star: smaller neighbours of a node are linked with the least of them. A star around its smallest
    node stays as it is, and all is settled when every edge is of one. Edges stay in Spark; the driver sees two counts
    a round. Only nodes that occur in an edge are returned. Null ends and loops are ignored. Both sides of each join
    are saved tables, so the edges of a hub are one side of a skewed join that Spark can split.
    """
    e = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(max_rounds):
        low = saved(e.groupBy("u").agg(F.min("v").alias("m")))
        up = low.select(F.col("u").alias("v"), "m")
        if e.count() == low.count() and not e.join(up, "v", "left_semi").limit(1).count():
            break
        large = saved(e.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
