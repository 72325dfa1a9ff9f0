"""Operator 8: exact top-k inner products over a pivot-distance index.

Index: each vector is keyed by its nearest pivot and its distance to it; rows are range-partitioned and sorted by
that key, so a shard holds sorted annuli of few pivots, each annulus with its least and greatest distance and its
longest vector. Pivots are a bounded sample of vectors (`n_pivots`, those of least id hash); every vector is indexed.

Search: a query first meets the shard that its own key falls in, which gives a lower bound of its k-th score. It
then goes to the other shards that the triangle inequality cannot rule out, and there from annulus to annulus
outward from its own distance, until no annulus left can reach its bound. With |q - x| >= |d(q, p) - d(x, p)|,
q . x <= (|q|^2 + |x|^2 - |q - x|^2) / 2; and q . x <= q . p + |q| d(x, p).

Shards hold about `shard_rows` vectors, and the queries that meet in a shard are dealt into blocks, so a task's size is
bounded. The table of annuli that is broadcast has at most MAX_RUNS + n_pivots rows: with more shards than that, an
entry of it stands for several shards in a row, all of which a query that cannot rule it out goes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import saved

N_PIVOTS = 64
SHARD_ROWS = 20_000
QUERY_BLOCK = 4096
ANNULUS = 1024  #: vectors of an annulus that one step scores
MAX_RUNS = 50_000  #: entries of the table of annuli, some 40 bytes each
RUN_BLOCK = 2048  #: annuli that 1024 queries are held against at once


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, v array<long>, columns to keep) with floor(scale * x) of each component; vectors that are null or empty, or hold a null or
    non-finite component, and null ids, take no part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fit = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), *keep)


def _matrix(lists) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in lists]) if len(lists) else np.zeros((0, 1), np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles are exact while no sum can reach 2**53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _bound(qq: np.ndarray, dq: np.ndarray, qp: np.ndarray, lo, hi, longest) -> np.ndarray:
    """No vector at distance lo..hi of the pivot, of squared length `longest` at most, has a greater product than this."""
    apart = np.maximum(0, np.maximum(lo - dq, dq - hi))
    by_distance = (qq + longest - apart**2) / 2
    by_pivot = qp + np.sqrt(qq) * hi
    b = np.minimum(np.minimum(by_distance, by_pivot), np.sqrt(qq * longest))
    return b + 1e-6 * (1 + np.abs(b))


def _merge(ids, scores, new_ids, new_scores, k: int):
    """The k best of both, by score and then smaller id."""
    ids, scores = np.concatenate([ids, new_ids]), np.concatenate([scores, new_scores])
    if len(ids) > 4 * k:
        part = np.argpartition(-scores, k - 1)[:k]
        keep = scores >= scores[part].min()
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "v", n_pivots: int = N_PIVOTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each query its k rows of greatest inner product, ties to the smaller id.

    Both tables hold (id long, v array<long>); a vector with fewer components than another counts as having zeros after
    them. A row whose id is the query's own is no candidate. Rows that repeat an id are candidates of their own with
    equal score; queries that repeat an id count once, by their least vector. Rows of null id or vector take no part,
    and other columns are left out. An empty table of either kind gives no rows.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    usable = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    vectors, queries = usable(vectors), usable(queries)
    sizes = vectors.select(F.size(vector_col).alias("n")).union(queries.select(F.size(vector_col))).agg(F.max("n")).first()[0]
    if not sizes:
        return empty
    padded = F.concat(F.col(vector_col).cast("array<long>"), F.array_repeat(F.lit(0).cast("long"), F.lit(sizes) - F.size(vector_col)))
    vectors, queries = vectors.select(id_col, padded.alias(vector_col)), queries.select(id_col, padded.alias(vector_col))
    pivots_rows = vectors.orderBy(F.xxhash64(id_col), id_col, vector_col).limit(n_pivots).select(vector_col).collect()
    if not pivots_rows:
        return empty
    pivots = np.unique(_matrix([r[0] for r in pivots_rows]), axis=0).astype(np.float64)
    square = (pivots**2).sum(1)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 4096):
                part = pdf.iloc[a : a + 4096]
                x = _matrix(part["v"]).astype(np.float64)
                xx = (x**2).sum(1)
                d = np.sqrt(np.maximum(0, xx[:, None] + square[None, :] - 2 * x @ pivots.T))
                p = d.argmin(1)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].tolist(), "pivot": p, "dist": d[np.arange(len(p)), p], "norm": xx})

    schema = "id long, v array<long>, pivot int, dist double, norm double"
    own = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    data = own(vectors).mapInPandas(keyed, schema)
    n_shards = max(1, -(-vectors.count() // shard_rows))
    shards = saved(data.repartitionByRange(n_shards, "pivot", "dist", "id").withColumn("shard", F.spark_partition_id()))
    together = -(-n_shards // MAX_RUNS)
    annuli = shards.groupBy(F.floor(F.col("shard") / together).cast("int").alias("shard"), "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("longest"))
    runs = annuli.orderBy("shard", "pivot").toPandas()  # MAX_RUNS + n_pivots rows at most
    asked = saved(own(queries).groupBy("id").agg(F.min("v").alias("v")).mapInPandas(keyed, schema))
    table = vectors.sparkSession.sparkContext.broadcast(tuple(runs[c].to_numpy() for c in ("pivot", "shard", "lo", "hi", "longest")))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_pivot, run_shard, run_lo, run_hi, _ = table.value
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                pivot, dist = part["pivot"].to_numpy()[:, None], part["dist"].to_numpy()[:, None]
                best, least = np.zeros(len(part), np.int64), np.full(len(part), np.inf)
                for r in range(0, len(run_pivot), RUN_BLOCK):
                    s = slice(r, r + RUN_BLOCK)
                    far = np.where(run_pivot[None, s] == pivot, np.maximum(np.maximum(run_lo[None, s] - dist, dist - run_hi[None, s]), 0), np.inf)
                    at = far.argmin(1)
                    far = far[np.arange(len(part)), at]
                    best, least = np.where(far < least, at + r, best), np.minimum(far, least)
                yield part[["id", "v"]].assign(shard=run_shard[best] * together, bound=np.iinfo(np.int64).min, home=-1)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_pivot, run_shard, run_lo, run_hi, run_longest = table.value
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                q = _matrix(part["v"]).astype(np.float64)
                qq = (q**2).sum(1)[:, None]
                qp = q @ pivots.T
                dq = np.sqrt(np.maximum(0, qq + square[None, :] - 2 * qp))
                pairs = [np.zeros((0, 2), np.int64)]
                for r in range(0, len(run_pivot), RUN_BLOCK):
                    s = slice(r, r + RUN_BLOCK)
                    b = _bound(qq, dq[:, run_pivot[s]], qp[:, run_pivot[s]], run_lo[None, s], run_hi[None, s], run_longest[None, s])
                    row, run = np.nonzero(b >= part["bound"].to_numpy()[:, None])
                    pairs.append(np.stack([row, run_shard[s][run]], 1))
                pair = np.unique(np.concatenate(pairs), axis=0)
                pair = np.stack([np.repeat(pair[:, 0], together), (pair[:, 1:] * together + np.arange(together)).ravel()], 1)
                pair = pair[(pair[:, 1] < n_shards) & (pair[:, 1] != part["home"].to_numpy()[pair[:, 0]])]
                for c in range(0, len(pair), 4096):
                    pair_ = pair[c : c + 4096]
                    got = part.iloc[pair_[:, 0]]
                    yield pd.DataFrame({"id": got["id"].to_numpy(), "v": got["v"].tolist(), "shard": pair_[:, 1].astype(np.int32), "bound": got["bound"].to_numpy(), "home": got["home"].to_numpy()})

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_values(["pivot", "dist"])
            x, ids = _matrix(right["v"]), right["id"].to_numpy()
            pv, dist, norm = (right[c].to_numpy() for c in ("pivot", "dist", "norm"))
            cut = np.flatnonzero(np.concatenate([[True], pv[1:] != pv[:-1]]))
            starts = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(cut, [*cut[1:], len(pv)])])
            ends = np.concatenate([starts[1:], [len(pv)]])
            lo, hi = dist[starts], dist[ends - 1]
            longest = np.maximum.reduceat(norm, starts)
            q = _matrix(left["v"])
            qf = q.astype(np.float64)
            qq = (qf**2).sum(1)[:, None]
            qp = qf @ pivots.T
            dq = np.sqrt(np.maximum(0, qq + square[None, :] - 2 * qp))
            reach = _bound(qq, dq[:, pv[starts]], qp[:, pv[starts]], lo[None, :], hi[None, :], longest[None, :])
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(len(q))]
            bound = left["bound"].to_numpy().astype(np.float64)
            own_ids = left["id"].to_numpy()
            # annuli from the most to the least promising one for each query; a step scores one annulus for all that still want it
            turn = np.argsort(-reach, axis=1, kind="stable")
            for step in range(len(starts)):
                best = reach[np.arange(len(q)), turn[:, step]]
                live = np.flatnonzero(best >= bound)
                if not len(live):
                    break
                for a in np.unique(turn[live, step]).tolist():
                    who = live[turn[live, step] == a]
                    s, e = starts[a], ends[a]
                    scores = products(q[who], x[s:e])
                    for r, w in enumerate(who.tolist()):
                        ok = (ids[s:e] != own_ids[w]) & (scores[r] >= bound[w])
                        found[w] = _merge(*found[w], ids[s:e][ok], scores[r][ok], k)
                        if len(found[w][0]) == k:
                            bound[w] = max(bound[w], found[w][1][-1])
            for w, (i, s) in enumerate(found):
                out += [(own_ids[w], j, z, key[0]) for j, z in zip(i.tolist(), s.tolist())]
        return pd.DataFrame(out, columns=["query_id", "id", "score", "shard"]).astype({"query_id": "int64", "id": "int64", "score": "int64", "shard": "int32"})

    def meet(wanted: DataFrame) -> DataFrame:
        """Queries and shards, the queries of a shard in blocks; a shard is repeated for each of its blocks."""
        wanted = saved(wanted)
        n_blocks = wanted.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        left = wanted.join(n_blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        times = n_blocks.select(F.col("shard").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to_block"))
        right = shards.withColumnRenamed("shard", "to").join(times, "to")
        left = left.select(*wanted.columns, "block")
        return left.groupBy("shard", "block").cogroup(right.groupBy("to", "to_block")).applyInPandas(search, "query_id long, id long, score long, shard int")

    at = "id long, v array<long>, shard int, bound long, home int"
    first = saved(meet(asked.mapInPandas(home, at)))
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.first("shard").alias("home"))
    known = asked.select("id", "v").join(bounds, F.col("id") == F.col("query_id"), "left")
    lowest = F.lit(-(1 << 63)).cast("long")
    known = known.select("id", "v", F.when(F.col("n") >= k, F.col("least")).otherwise(lowest).alias("bound"), F.coalesce("home", F.lit(-1)).cast("int").alias("home"))
    rest = meet(known.mapInPandas(others, at))
    both = first.select("query_id", "id", "score").unionByName(rest.select("query_id", "id", "score"))
    best = both.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score"))
