"""Operator 12: hard negatives by lists that the anchors of a cluster share.

Anchors are grouped by the direction nearest to theirs among `n_clusters` centres, which a bounded sample of anchors gives.
A vector x at angle t from a centre has with no anchor a of its cluster, which are at b at most, a greater product than
|a| |x| cos(max(0, t - b)). So for each cluster the vectors are sorted once by |x| cos(max(0, t - b)), and every anchor walks
that list until what is left cannot change its answer: each k-th best is certified, nothing is approximate.

Anchors come in blocks of `block` rows, sorted by cluster, which are broadcast (their size is bounded: `block` rows); a pass
over the saved vectors serves a block, batch by batch, and a task keeps its k best of each anchor over all of its batches.
What leaves a task is k rows for each anchor of the block at most, so what is written grows with vectors + anchors, and
nothing is replicated. First pass: positives. Second pass: the k best within each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import numbered, saved
from .topk_search import products

N_CLUSTERS = 64
SAMPLE = 4096  #: anchors that the centres are fitted on, those of least id hash
BLOCK = 16_384
STEP = 1024  #: vectors of a list that a step scores
_NONE = -(1 << 62)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); a zero vector keeps direction zero."""
    f = x.astype(np.float64)
    n = np.sqrt((f**2).sum(1))
    return f / np.where(n > 0, n, 1)[:, None], n


def _centres(unit: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means, begun from vectors far from each other."""
    pick, near = [0], np.full(len(unit), -np.inf)
    for _ in range(min(n, len(unit)) - 1):
        near = np.maximum(near, unit @ unit[pick[-1]])
        pick.append(int(near.argmin()))
    c = unit[pick]
    for _ in range(5):
        at = (unit @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, unit)
        c = np.where((np.abs(sums).sum(1) > 0)[:, None], _directions(sums)[0], c)
    return c


class Block:
    """Anchors of one block: (id, label, vector), in order of their clusters, and for each cluster its angle."""

    def __init__(self, pdf: pd.DataFrame, centres: np.ndarray):
        at = pdf["cluster"].to_numpy()
        self.ids, self.v = pdf["id"].to_numpy(np.int64), np.stack([np.asarray(v, np.int64) for v in pdf["v"]])
        self.labels = pd.Index(pdf["label"].unique())
        self.label = self.labels.get_indexer(pdf["label"])
        unit, self.length = _directions(self.v)
        self.runs = []
        for c in np.unique(at).tolist():
            a, b = np.searchsorted(at, [c, c + 1])
            cos = (unit[a:b] @ centres[c])[self.length[a:b] > 0]
            self.runs.append((int(a), int(b), centres[c], float(np.arccos(np.clip(cos.min(initial=1), -1, 1)))))


def merged(best_score: np.ndarray, best_id: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Put hits (slot, score, id) into the k best of their slots, by score and then smaller id."""
    if not len(slot):
        return
    k = best_score.shape[1]
    touched = np.unique(slot)
    rows = np.concatenate([np.repeat(touched, k), slot])
    s, i = np.concatenate([best_score[touched].ravel(), score]), np.concatenate([best_id[touched].ravel(), ids])
    order = np.lexsort((i, -s, rows))
    rank = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
    take = order[rank < k]
    best_score[touched], best_id[touched] = s[take].reshape(-1, k), i[take].reshape(-1, k)


def _lists(block: Block, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For each cluster: its anchors, x in order of their bound, and the bounds for an anchor of length one."""
    unit, length = _directions(x)
    for a, b, centre, angle in block.runs:
        apart = np.arccos(np.clip(unit @ centre, -1, 1)) - angle
        bound = length * np.cos(np.maximum(apart, 0))
        order = np.argsort(-bound, kind="stable")
        yield slice(a, b), order, bound[order] + 1e-9 * (1 + np.abs(bound[order]))


def walk(block: Block, batch: pd.DataFrame, least: Callable[[], np.ndarray], take: Callable) -> int:
    """Walk the lists of a batch: least() is what each anchor still asks for, take(anchors, rows, scores) gets the products
    that reach it. Returns the number of products."""
    ids, x = batch["id"].to_numpy(np.int64), np.stack([np.asarray(v, np.int64) for v in batch["v"]])
    label = block.labels.get_indexer(batch["label"])
    done = 0
    for members, order, bound in _lists(block, x):
        for s in range(0, len(order), STEP):
            want = least()[members]
            live = np.flatnonzero(block.length[members] * bound[s] + 1e-6 >= want) + members.start
            if not len(live):
                break
            part = order[s : s + STEP]
            score = products(block.v[live], x[part])
            done += score.size
            row, col = np.nonzero(score >= want[live - members.start][:, None])
            row_, col_ = live[row], part[col]
            ok = block.ids[row_] != ids[col_]
            take(row_[ok], score[row, col][ok], ids[col_[ok]], label[col_[ok]])
    return done


def _rows(best_score: np.ndarray, best_id: np.ndarray, names: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    slot, j = np.nonzero(best_score > _NONE)
    for a in range(0, len(slot), 1 << 16):
        s, t = slot[a : a + (1 << 16)], j[a : a + (1 << 16)]
        yield pd.DataFrame({**{n: v[s] for n, v in names.items()}, "id": best_id[s, t], "score": best_score[s, t]})


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, n_clusters: int = N_CLUSTERS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables hold (id long, label, v array<long>), and may hold more. An anchor's positives are its `positives` best
    rows of its label and other ids, by inner product and then smaller id; for each of them the `negatives` best rows of
    another label with low * positive <= 100 * score <= high * positive. A vector with fewer components counts as followed
    by zeros. Rows with a null id, label or vector take no part. Rows that repeat an id are rows of their own; anchors that
    repeat one count once, by their least label and vector. A positive without negatives, an anchor without positives and an
    empty table of either kind give no rows.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    usable = lambda df: df.where("id is not null and label is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<long>").alias("v"))
    rows, anchors = usable(rows), usable(anchors)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    dims = max(dims or 0, anchors.agg(F.max(F.size("v"))).first()[0] or 0) if dims else 0
    if not dims:
        return empty
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    rows = saved(rows.withColumn("v", padded))
    anchors = anchors.withColumn("v", padded).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(sample):
        return empty
    centres = _centres(_directions(np.stack([np.asarray(v, np.int64) for v in sample]))[0], n_clusters)

    def clustered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cos = _directions(np.stack([np.asarray(v, np.int64) for v in pdf["v"]]))[0] @ centres.T if len(pdf) else np.zeros((0, len(centres)))
            yield pdf.assign(cluster=cos.argmax(1).astype(np.int32), cos=cos.max(1, initial=-1))

    anchors = saved(anchors.mapInPandas(clustered, "id long, label string, v array<long>, cluster int, cos double"))
    blocks = saved(numbered(anchors, [F.col("cluster"), F.col("cos"), F.col("id")], "n").withColumn("block", F.floor(F.col("n") / block)))
    found = []
    for b in range(-(-anchors.count() // block)):
        own = blocks.where(F.col("block") == b).orderBy("cluster", "id").toPandas()
        found.append(saved(_block_negatives(rows, Block(own, centres), positives, negatives, low, high)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _block_negatives(rows: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark, n = rows.sparkSession, len(block.ids)
    shared = spark.sparkContext.broadcast(block)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        score, ids = np.full((n, positives), _NONE, np.int64), np.full((n, positives), 1 << 62, np.int64)

        def take(anchor, s, i, label):
            ok = label == own.label[anchor]
            merged(score, ids, anchor[ok], s[ok], i[ok])

        for batch in batches:
            if len(batch):
                walk(own, batch, lambda: score[:, -1], take)
        yield from _rows(score, ids, {"anchor": np.arange(n)})

    best = saved(_first(rows.mapInPandas(nearest, "anchor int, id long, score long"), ["anchor"], positives)).toPandas()
    slot_anchor, slot_rank = best["anchor"].to_numpy(), best["rank"].to_numpy() - 1
    p = np.full((n, positives), -1, np.int64)  # a negative product has an empty window, like none
    p[slot_anchor, slot_rank] = best["score"]
    p_id = np.zeros((n, positives), np.int64)
    p_id[slot_anchor, slot_rank] = best["id"]
    windows = spark.sparkContext.broadcast(p)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, pos = shared.value, windows.value
        floor = np.where(pos >= 0, -(-low * pos // 100), 1 << 62)
        top = high * pos // 100
        score, ids = np.full((n * positives, negatives), _NONE, np.int64), np.full((n * positives, negatives), 1 << 62, np.int64)

        def least() -> np.ndarray:
            return np.maximum(floor, score[:, -1].reshape(n, positives)).min(1)

        def take(anchor, s, i, label):
            ok = label != own.label[anchor]
            anchor, s, i = anchor[ok], s[ok], i[ok]
            for j in range(positives):
                slot = anchor * positives + j
                fit = (s >= np.maximum(floor[anchor, j], score[slot, -1])) & (s <= top[anchor, j])
                merged(score, ids, slot[fit], s[fit], i[fit])

        for batch in batches:
            if len(batch):
                walk(own, batch, least, take)
        slots = np.arange(n * positives)
        yield from _rows(score, ids, {"anchor": slots // positives, "pos": slots % positives})

    out = _first(rows.mapInPandas(within, "anchor int, pos int, id long, score long"), ["anchor", "pos"], negatives)
    names = pd.DataFrame({"anchor": np.repeat(np.arange(n), positives), "pos": np.tile(np.arange(positives), n), "anchor_id": np.repeat(block.ids, positives), "positive_id": p_id.ravel(), "positive_score": p.ravel()})
    table = spark.createDataFrame(names[names["positive_score"] >= 0], "anchor int, pos int, anchor_id long, positive_id long, positive_score long")
    met = out.join(F.broadcast(table), ["anchor", "pos"])  # `block` * `positives` rows at most
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
