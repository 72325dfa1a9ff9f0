"""Windows over the rows of a key that no single task should hold: ranges of positions, with what crosses their edges.

A key's rows are cut into ranges of `span` positions. Each range is a window of its own; what it needs of the others is
a row for each range: its ends, or its sums. With span=None a key is one window, which is cheaper for keys that fit a task.
Positions are numbers, with gaps or not; null comes first and NaN last, as in a window. Rows of one position stay
together, so a range holds at most the rows of `span` whole positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_no(position: Column, span: int) -> Column:
    """The number of a position's range; never falls as positions rise, and is null for null."""
    return F.when(F.isnan(position.cast("double")), F.lit((1 << 63) - 1)).otherwise(F.floor(position.cast("double") / span))


def beside(df: DataFrame, key: str, order: str, wanted: dict[str, tuple[str, int]], span: int | None = None) -> DataFrame:
    """df with a column for each name: (column, step) of wanted, its value in the row before (step -1) or after (1); null
    at a key's ends.

    With span, each range also gets copies of the rows at the near ends of its neighbours. df is read three times: for the
    ends, which takes key and order only, for the copies, by a small join, and for the windows; save it first if it is dear.
    """
    look = lambda x, w: x.withColumns({name: (F.lag if step < 0 else F.lead)(c).over(w) for name, (c, step) in wanted.items()})
    if span is None:
        return look(df, Window.partitionBy(key).orderBy(order))
    rows = df.withColumns({"_range": range_no(F.col(order), span), "_copy": F.lit(False)})
    ranges = Window.partitionBy(key).orderBy("_range")
    ends = rows.groupBy(key, "_range").agg(F.struct(F.min(order).alias("at")).alias("lo"), F.struct(F.max(order).alias("at")).alias("hi"))
    near = ends.select(F.col(key).alias("_key"), F.col("_range").alias("_to"), F.array(F.lag("hi").over(ranges), F.lead("lo").over(ranges)).alias("_ends"))
    near = near.select("_key", "_to", F.explode(F.array_compact("_ends")).alias("_end"))
    taken = list(dict.fromkeys([key, order, *(c for c, _ in wanted.values())]))
    copies = rows.select(*taken).join(near, F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_end.at")))
    both = rows.unionByName(copies.select(*taken, F.col("_to").alias("_range"), F.lit(True).alias("_copy")), allowMissingColumns=True)
    return look(both, Window.partitionBy(key, "_range").orderBy(order)).where("not _copy").drop("_range", "_copy")


def running(df: DataFrame, key: str, order: str, sums: dict[str, Column], span: int | None = None) -> DataFrame:
    """df with, for each name of sums, the sum of its values up to and with each row as `name`, and of the key as `name_all`.

    With span, sums of ranges are added up first, a row for each range, and joined to the range's own running sums.
    Values are not null.
    """
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if span is None:
        whole = Window.partitionBy(key)
        return df.withColumns({n: F.sum(c).over(up_to(key)) for n, c in sums.items()} | {f"{n}_all": F.sum(c).over(whole) for n, c in sums.items()})
    rows = df.withColumn("_range", range_no(F.col(order), span))
    earlier, whole = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    parts = rows.groupBy(key, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    parts = parts.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in sums])
    own = rows.withColumns({n: F.sum(c).over(up_to(key, "_range")) for n, c in sums.items()})
    joined = own.join(parts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_of")), "left")  # left: rows stay where they are
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", "_key", "_of", *[f"_{n}" for n in sums])
