"""Operator 11: sources mixed to target weights, by a multivariate-hypergeometric splitting tree.

1. Targets: each source gets its weight's share of the words wanted, `repeats` times its own words at most; what a full
   source leaves is shared again by weight until none is above.
2. Blocks: the documents of a source stand in the order of a hash of their own, and running totals of words cut that
   order into blocks of `block_words`. A source gives all of its blocks as often as its target holds it whole, and then
   the first ones, up to the document whose middle passes the target. One document that goes out or in for the last time
   then closes the gap as far as it can: the one whose size is nearest to the gap, if it makes it smaller.
3. Splitting tree: a node is a run of output shards, with the number of blocks that it gets of each source. What its left
   half gets is a multivariate-hypergeometric draw, source after source by inversion, each with a uniform number that is a
   hash of node and source; the right half gets the rest. Leaves hold exact quotas, and sum up to the sources'.
4. Shards take disjoint runs of each source's blocks, in an order that a bijection of their numbers gives, and a shard's
   rows are sorted by a hash of document and round.

All of it is column expressions. No step holds a source: documents are numbered in buckets of about BUCKET_ROWS, buckets
in groups of as many; only tables of a row for each source, block or shard and source meet otherwise. A node's array has
an entry for each source that has blocks left in it: mixtures of up to some 100,000 sources are what it is meant for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import numbered, saved, side

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1000
BLOCK_WORDS = 100_000
SHARD_WORDS = 20_000_000
LEVELS = 8  #: levels of the tree between two saved tables
_STEP = 2147483647  #: a prime, so multiples of it run through all residues of any smaller number of blocks
_LOG_FACTORIALS = [math.lgamma(n + 1) for n in range(16)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, F.get(F.array(*map(F.lit, _LOG_FACTORIALS)), n.cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `marked` among `total` blocks are in a draw of `drawn`: the inverse of the distribution function at
    `uniform`. Values 12 standard deviations and 12 off the mean have less weight than a double's last digit."""

    def draw(a: Column) -> Column:
        n, k, m, u = (a[c] for c in ("n", "k", "m", "u"))
        mean = m * k / n
        spread = 12 * F.sqrt(F.greatest(mean * ((n - k) / n) * ((n - m) / F.greatest(n - 1, F.lit(1.0))), F.lit(0.0))) + 12
        first = F.greatest(F.lit(0.0), m + k - n, F.floor(mean - spread).cast("double"))
        last = F.least(m, k, F.ceil(mean + spread).cast("double"))
        return let(F.struct(first.alias("a"), last.alias("b")), lambda r: F.when(r["b"] <= r["a"], r["a"]).otherwise(walk(r["a"], r["b"], n, k, m, u)))

    def walk(a: Column, b: Column, n: Column, k: Column, m: Column, u: Column) -> Column:
        p = F.exp(_log_choose(k, a) + _log_choose(n - k, m - a) - _log_choose(n, m))
        start = let(p, lambda v: F.struct(a.alias("x"), v.alias("p"), v.alias("sum")))

        def step(acc: Column, y: Column) -> Column:
            q = acc["p"] * (k - y + 1) * (m - y + 1) / (y * (n - k - m + y))
            return F.when(acc["sum"] >= u, acc).otherwise(F.struct(y.alias("x"), q.alias("p"), (acc["sum"] + q).alias("sum")))

        return F.aggregate(F.transform(F.sequence(a.cast("long") + 1, b.cast("long")), lambda y: y.cast("double")), start, step)["x"]

    given = F.struct(*(c.cast("double").alias(x) for c, x in ((total, "n"), (marked, "k"), (drawn, "m"), (uniform, "u"))))
    return F.when(total > 0, let(given, draw)).otherwise(0).cast("long")


def uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)).cast("double") / float(1 << 53)


def with_targets(sources: DataFrame, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """sources(size, weight, ...) with target: least(repeats * size, level * weight), the level such that targets sum up to
    share * all sizes, or all sources are full. A null or negative weight counts as 0."""
    w = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast("double")
    cap = F.col("size") * repeats
    total = (sources.agg(F.sum("size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = cap <= level * w
        r = sources.agg(F.sum(F.when(full, cap).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(w)).alias("weights")).first()
        higher = (total - (r["full"] or 0)) / r["weights"] if r["weights"] else level
        if higher <= level:
            return sources.withColumn("target", F.least(cap.cast("double"), level * w))
        level = higher


def cyclic_weights(sources: DataFrame, source: str, weights: tuple[float, ...]) -> DataFrame:
    """sources with a weight each: those given, again and again, by code points of the name, null last."""
    n = numbered(sources, [F.col(source).asc_nulls_last()], "_n")
    return n.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("_n", F.lit(len(weights))).cast("int"))).drop("_n")


def _before(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """df(key, order from 0, value) with the total of value before each row; groups of BUCKET_ROWS rows, then groups of groups."""
    g = df.withColumn("_g", F.floor(F.col(order) / BUCKET_ROWS))
    w = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = g.groupBy(key, "_g").agg(F.sum(value).alias("_v")).select(key, "_g", F.coalesce(F.sum("_v").over(w(key).orderBy("_g")), F.lit(0)).alias("_go"))
    inner = F.coalesce(F.sum(value).over(w(key, "_g").orderBy(order)), F.lit(0))
    return g.withColumn("_gi", inner).join(groups, [key, "_g"]).withColumn(out, F.col("_gi") + F.col("_go")).drop("_g", "_gi", "_go")


def shard_quotas(quotas: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """(s, shard, n): quotas(s long, quota long) split among shards 0..n_shards-1, whose totals differ by one at most.

    A null or zero quota gives nothing."""
    spark = quotas.sparkSession
    quotas = quotas.where("quota > 0")
    total = quotas.agg(F.sum("quota")).first()[0]
    if not total:
        return spark.createDataFrame([], "s long, shard long, n long")
    upto = lambda k: F.floor(k.cast("decimal(38,0)") * total / n_shards).cast("long")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("s", F.col("quota").alias("q")))).alias("x")).select(F.lit(0).cast("long").alias("a"), F.lit(n_shards).cast("long").alias("b"), "x")
    mid = F.floor((F.col("a") + F.col("b")) / 2)
    for level in range(max(0, (n_shards - 1).bit_length())):
        wanted = (upto(mid) - upto(F.col("a"))).alias("m")
        init = F.struct((upto(F.col("b")) - upto(F.col("a"))).alias("n"), wanted, F.array().cast("array<bigint>").alias("left"))

        def draw(acc: Column, x: Column) -> Column:
            got = hypergeometric(acc["n"], x["q"], acc["m"], uniform(F.lit(seed), F.col("a"), F.col("b"), x["s"]))
            return let(got, lambda v: F.struct((acc["n"] - x["q"]).alias("n"), (acc["m"] - v).alias("m"), F.array_append(acc["left"], v).alias("left")))

        drawn = nodes.withColumn("left", F.when(F.col("b") - F.col("a") > 1, F.aggregate("x", init, draw)["left"]))
        part = lambda f: F.filter(F.zip_with("x", "left", f), lambda v: v["q"] > 0)
        left = F.struct("a", mid.alias("b"), part(lambda x, n: F.struct(x["s"].alias("s"), n.alias("q"))).alias("x"))
        right = F.struct(mid.alias("a"), "b", part(lambda x, n: F.struct(x["s"].alias("s"), (x["q"] - n).alias("q"))).alias("x"))
        nodes = drawn.select(F.explode(F.when(F.col("left").isNull(), F.array(F.struct("a", "b", "x"))).otherwise(F.array(left, right))).alias("_c")).select("_c.*")
        if level % LEVELS == LEVELS - 1:
            nodes = saved(nodes.repartition("a"))
    return nodes.select(F.col("a").alias("shard"), F.explode("x").alias("x")).select("x.s", "shard", F.col("x.q").alias("n"))


def mix(df: DataFrame, weights: tuple[float, ...] | DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.0, repeats: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 0) -> DataFrame:
    """(id, source, text_hash, size, source_size, target, draws) for each row of df; draws has (round, shard, place) for each time
    that the row is in the mixture, `repeats` times at most.

    weights: numbers that sources take in turn by code point, null last, or a table (source, weight). The mixture has
    share * all words. Sizes are words; a null or empty text has 0, and is drawn like any other row. A null source is a
    source of its own. Rows that repeat id, source and text are rows of their own, and null ids are no exception. Equal
    input gives equal output, whatever its order and partitions. An empty table gives no rows.
    """
    clean = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    docs = saved(clean.groupBy("id", "source", "size", "text_hash").agg(F.count("*").alias("same")))
    sources = saved(docs.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("size"), F.sum("same").alias("n_rows")))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_s"), "weight").groupBy("_s").agg(F.max("weight").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    else:
        sources = cyclic_weights(sources, "source", weights)
    sources = numbered(with_targets(saved(sources), share, repeats), [F.col("source").asc_nulls_last()], "s")
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.when(F.col("size") > 0, F.col("size"))), F.lit(repeats).cast("long"))).otherwise(0)
    sources = sources.withColumns({"whole": whole, "blocks": F.greatest(F.ceil(F.col("size") / block_words), F.lit(1).cast("long")), "buckets": F.greatest(F.ceil(F.col("n_rows") / BUCKET_ROWS), F.lit(1).cast("long"))})
    sources = sources.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("size"), F.lit(0.0)))
    some = F.when(F.col("rest") > 0, F.least(F.floor(F.col("rest") / block_words) + 1, F.col("blocks"))).otherwise(0)
    sources = saved(sources.withColumn("quota", F.col("whole") * F.col("blocks") + some))

    of = side(sources.withColumnsRenamed({"source": "_source", "size": "source_size"}).drop("weight", "n_rows"), 120)
    rows = docs.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same")))).drop("same")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "id", "text_hash", "nth")).withColumn("bucket", F.pmod("order", F.col("buckets"))).drop("buckets")
    totals = _before(rows.groupBy("s", "bucket").agg(F.sum("size").alias("_size")), "s", "bucket", "_size", "_off").drop("_size")
    inside = Window.partitionBy("s", "bucket").orderBy("order", "id", "text_hash", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["s", "bucket"])
    rows = rows.withColumn("start", F.col("_in") + F.col("_off")).drop("_in", "_off", "bucket")

    rows = saved(rows.withColumn("some", F.col("start") + F.col("size") / 2 < F.col("rest")))
    gaps = rows.groupBy("s").agg((F.first("rest") - F.sum(F.when(F.col("some"), F.col("size")).otherwise(0))).alias("gap"))
    near = F.abs(F.col("size") - F.abs("gap"))
    fits = (F.col("some") == (F.col("gap") < 0)) & (near < F.abs("gap"))
    turned = rows.join(side(saved(gaps), 40), "s").where(fits).groupBy("s").agg(F.min(F.struct(near.alias("near"), "order", "text_hash", "nth")).alias("t"))
    turned = side(saved(turned.select(F.col("s").alias("_s"), F.col("t.order").alias("_order"), F.col("t.text_hash").alias("_hash"), F.col("t.nth").alias("_nth"))), 60)
    met = (F.col("s") == F.col("_s")) & (F.col("order") == F.col("_order")) & (F.col("text_hash") == F.col("_hash")) & (F.col("nth") == F.col("_nth"))
    rows = rows.join(turned, met, "left").withColumn("some", F.col("some") != F.col("_s").isNotNull()).drop("_s", "_order", "_hash", "_nth")

    none = F.array().cast("array<bigint>")
    rounds = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).otherwise(none), F.when(F.col("some"), F.array("whole")).otherwise(none))
    block = F.least(F.floor(F.col("start") / block_words), F.col("blocks") - 1)
    drawn = rows.withColumn("block", block).withColumn("round", F.explode_outer(rounds))
    number = F.when(F.col("round").isNotNull(), F.least(F.col("round") * F.col("blocks") + F.col("block"), F.col("quota") - 1))
    drawn = drawn.withColumn("run", F.pmod(number * _STEP + F.pmod(F.xxhash64(F.lit(seed), "s"), F.col("quota")), F.when(F.col("quota") > 0, F.col("quota"))))

    n_blocks = sources.agg(F.sum("quota")).first()[0] or 0
    n_shards = max(1, -(-n_blocks * block_words // shard_words))
    leaves = saved(shard_quotas(sources.select("s", "quota"), n_shards, seed))
    runs = _before(leaves, "s", "shard", "n", "first")
    runs = runs.select("s", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("run"))
    placed = drawn.join(runs, ["s", "run"], "left").withColumn("place", F.xxhash64(F.lit(seed), F.lit(1), "id", "text_hash", "nth", "round"))
    draw = F.when(F.col("shard").isNotNull(), F.struct("round", "shard", "place"))
    keys = ["id", "source", "text_hash", "nth", "size", "source_size", "target"]
    return placed.groupBy(*keys).agg(F.array_sort(F.collect_list(draw)).alias("draws")).drop("nth")


def shard_rows(df: DataFrame, mixture: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture itself: rows of df with round and shard, a row for each draw, each shard in one partition in shuffled order.

    A shard has about `shard_words` words, so a partition is bounded. Rows of equal id, source and text are one another's."""
    key = {"__ll_i": F.col(id_col), "__ll_s": F.col(source_col).cast("string"), "__ll_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    rows = df.withColumns(key).dropDuplicates(list(key))
    draws = mixture.select(F.col("id").alias("__ll_id"), F.col("source").alias("__ll_source"), F.col("text_hash").alias("__ll_text"), F.explode("draws").alias("__ll_d"))
    same = F.col("__ll_i").eqNullSafe(F.col("__ll_id")) & F.col("__ll_s").eqNullSafe(F.col("__ll_source")) & (F.col("__ll_h") == F.col("__ll_text"))
    out = rows.join(draws, same).repartition("__ll_d.shard").sortWithinPartitions("__ll_d.shard", "__ll_d.place")
    return out.withColumns({"round": F.col("__ll_d.round"), "shard": F.col("__ll_d.shard")}).select(*[c for c in df.columns if c not in ("round", "shard")], "round", "shard")
