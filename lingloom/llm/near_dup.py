"""Operator 6: near-duplicate documents by b-bit MinHash, with every link confirmed on the full shingle sets.

1. One pass over the texts: shingle sets, `n_hashes` minima of each set, band keys, a signature that keeps the low
   `bits` bits of each minimum, packed, and the SHA-256 of the text's words.
2. Texts of the same words fold into one class by that digest, so a group of exact copies is one row from here on. Sets
   that are equal by other words, or only by their hashes, are classes of their own and have to be confirmed.
3. Classes that share a band key are compared by signature: with a share m of equal low bits the similarity is
   estimated as (m - 2**-bits) / (1 - 2**-bits), which takes out the agreement by chance. A bucket is walked
   breadth first, each class against those not reached yet, so a bucket of n mutual copies costs n comparisons
   and gives n - 1 edges.
4. Clusters of edges are walked the same way over full sets with the exact threshold, on words told apart by their
   bytes, not by hashes. The estimate only has to bring true partners into one cluster, directly or through others:
   it is held `slack` below the threshold.
5. Components of the confirmed links.

Buckets and clusters over a size limit are dealt into tiles, pairs of blocks that cover all pairs between them, and
nothing is capped. Rows come to Python sorted by tile, in Arrow batches; a task holds a batch and the tile it ends in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jobs import connected_components, saved, shuffle_partitions, side
from .kernels import exact_sets, mix, shingle_sets, text_chunks, word_digests

BUCKET_ROWS = 4096  #: classes of a bucket that one task compares; more are dealt into tiles
CLUSTER_BYTES = 16 << 20  #: text of a cluster that one task holds; more is dealt into tiles
MISS = 1e-6  #: chance that a pair right at the threshold shares no band


def band_rows(threshold: float, n_hashes: int) -> int:
    """The most rows a band can have so that a pair at the threshold is missed with a chance of MISS at most."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (n_hashes // r) <= MISS]
    return max(fit, default=1)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seed[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[n:] >> np.uint64(32)).astype(np.uint32)


def _minima(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """Minimum of each hash function over each non-empty set."""
    a, c = _multipliers(n_hashes)
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), n_hashes), np.uint32)
    work = np.empty_like(x)
    for k in range(n_hashes):
        np.bitwise_xor(x, c[k], out=work)
        np.multiply(work, a[k], out=work)
        work ^= work >> np.uint32(15)
        work *= np.uint32(0x2C1B3C6D)
        np.minimum.reduceat(work, at, out=out[:, k])
    return out


def _pack(minima: np.ndarray, bits: int) -> np.ndarray:
    low = ((minima[:, :, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(low.reshape(len(minima), -1), axis=1)


def _sketch_rows(df: DataFrame, id_col: str, text_col: str, words: int, n_hashes: int, rows: int, bits: int) -> DataFrame:
    bands = n_hashes // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_chunks(batch.column(1), 1 << 20):
                sets = shingle_sets(data, offs, words)
                full = [s for s in sets if len(s)]
                n = len(sets)
                where = np.flatnonzero([len(s) > 0 for s in sets])
                sig, band = [None] * n, [None] * n
                if full:
                    m = _minima(full, n_hashes)
                    packed = _pack(m, bits)
                    h = np.zeros((len(full), bands), np.uint64)
                    for r in range(rows):
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + m[:, r : bands * rows : rows] + np.uint64(r))
                    h = mix(h + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    for k, w in enumerate(where.tolist()):
                        sig[w], band[w] = packed[k].tobytes(), h[k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array([len(s) for s in sets], pa.int64()), pa.array(word_digests(data, offs), pa.binary()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                    names=["id", "n_bytes", "n_shingles", "digest", "sig", "bands"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_bytes long, n_shingles long, digest binary, sig binary, bands array<long>")


def _walk(n: int, near) -> Iterator[tuple[int, int]]:
    """(node, root) for nodes 0..n-1; near(node, others) gives which of others it is linked with."""
    left = np.arange(n)
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            hit = near(queue.pop(), left)
            for v in left[hit].tolist():
                queue.append(v)
                yield v, root
            left = left[~hit]


def _tiles(df: DataFrame, blocks: str, spread: str) -> DataFrame:
    """A row for each tile (i, j), i <= j, that the row's block is in, of `blocks` blocks; one tile if there is one block."""
    b = F.pmod(F.xxhash64(F.lit(3), spread), F.col(blocks))
    return df.withColumn("_b", b).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))).withColumn("tile_i", F.least("_b", "_o")).withColumn("tile_j", F.greatest("_b", "_o")).drop("_b", "_o")


def _groups(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, rows of its groups, a line each) for each size of the groups that keys make; rows are in order of id and
    number the rows of pdf. Groups of one row are left out."""
    order = np.lexsort([pd.factorize(pdf["id"], sort=True)[0], *(pdf[k].to_numpy() for k in reversed(keys))])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = pdf[k].to_numpy()[order]
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    for n in np.unique(size[size > 1]).tolist():
        yield n, order[begin[size == n][:, None] + np.arange(n)]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups of rows sorted by keys: what a batch ends and the groups within it. Only the last group of a
    batch waits for the next one."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        start = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        if start:
            yield pd.concat([*held, pdf.iloc[:start]])
            held = [pdf.iloc[start:]]
        elif held and (held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any():
            yield pd.concat(held)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held)


def _by_tile(rows: DataFrame, keys: list[str], parts: int, run, schema: str) -> DataFrame:
    """run(frame) over frames of whole tiles: rows meet by keys, sorted by them."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, keys):
            yield run(pdf)

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(each, schema)


def _estimated_edges(buckets: DataFrame, kind: str, n_hashes: int, bits: int, bound: float, ratio: float, parts: int) -> DataFrame:
    """Forest edges between classes of a tile whose estimated similarity reaches the bound.

    Buckets of two or three classes, which are nearly all, are compared side by side; larger ones are walked.
    """
    per_byte = 8 // bits
    mask = np.array([sum(((x >> (bits * p)) & ((1 << bits) - 1)) == 0 for p in range(per_byte)) for x in range(256)], np.uint16)
    pad = per_byte * (-(-n_hashes // per_byte)) - n_hashes
    chance = 2.0**-bits

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        ids, size = pdf["id"].to_numpy(), pdf["n_shingles"].to_numpy().astype(float)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            s, t = size[a], size[b]
            ok = (np.minimum(s, t) >= ratio * np.maximum(s, t) - 1e-6) & (ids[a] != ids[b])
            at = np.flatnonzero(ok)
            for k in range(0, len(at), 1 << 16):
                i = at[k : k + (1 << 16)]
                m = (mask[sig[a[i]] ^ sig[b[i]]].sum(1) - pad) / n_hashes
                ok[i] = (m - chance) / (1 - chance) >= bound
            return ok

        def add(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> None:
            src.append(ids[a[ok]]), dst.append(ids[b[ok]])

        for n, rows in _groups(pdf, ["band", "key", "tile_i", "tile_j"]):
            if n <= 3:
                met = [(rows[:, j], rows[:, i], alike(rows[:, j], rows[:, i])) for i in range(n) for j in range(i + 1, n)]
                if n == 3:  # the third side of a triangle links nothing more
                    met[2][2][met[0][2] & met[1][2]] = False
                for edge in met:
                    add(*edge)
            else:
                for g in rows:
                    pairs = np.array(list(_walk(len(g), lambda v, others, g=g: alike(np.full(len(others), g[v]), g[others]))), np.int64).reshape(-1, 2)
                    add(g[pairs[:, 0]], g[pairs[:, 1]], np.ones(len(pairs), bool))
        return pd.DataFrame({"src": np.concatenate(src) if src else [], "dst": np.concatenate(dst) if dst else []})

    return _by_tile(buckets, ["band", "key", "tile_i", "tile_j"], parts, run, f"src {kind}, dst {kind}")


def _confirmed_edges(members: DataFrame, kind: str, words: int, percent: float, parts: int) -> DataFrame:
    """Forest edges between classes of a cluster tile whose full sets reach the threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for _, g in pdf.groupby(["cluster", "tile_i", "tile_j"], sort=False):
            if len(g) < 2:
                continue
            g = g.drop_duplicates(["id", "text"]).sort_values("id")
            raw = [t.encode() for t in g["text"]]
            sets = exact_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), words)
            size = np.array([len(s) for s in sets], np.int64)
            ids, sets, size = g["id"].to_numpy()[size > 0], [s for s in sets if len(s)], size[size > 0]
            _, dense = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(size)])
            flag = np.zeros(dense.max() + 1, bool)

            def near(v: int, others: np.ndarray) -> np.ndarray:
                own = dense[at[v] : at[v + 1]]
                flag[own] = True
                n = size[others]
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                take = np.arange(n.sum()) + np.repeat(at[others] - first, n)
                both = np.add.reduceat(flag[dense[take]].astype(np.int64), first)
                flag[own] = False
                return 100 * both >= percent * (n + size[v] - both)

            for v, root in _walk(len(ids), near):
                src.append(ids[v])
                dst.append(ids[root])
        return pd.DataFrame({"src": src, "dst": dst})

    return _by_tile(members, ["cluster", "tile_i", "tile_j"], parts, run, f"src {kind}, dst {kind}")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: float = 80, n_hashes: int = 252, bits: int = 2, slack: float = 0.12) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df.

    Two documents are linked when 100 * |A and B| >= percent * |A or B| of their word shingle sets. component_id is
    the smallest id that links reach; kept is id = component_id. Fewer words than a shingle has are one shingle. A
    document without words, or of null text, has no shingles and is its own component. A row of null id is linked
    with nothing: component_id null, kept true. Rows that repeat an id each get a result row; the texts of an id
    count as linked.
    """
    spark, t = df.sparkSession, percent / 100
    rows, kind = band_rows(t, n_hashes), df.schema[id_col].dataType.simpleString()
    parts = shuffle_partitions(spark)
    docs = saved(_sketch_rows(df, id_col, text_col, words, n_hashes, rows, bits))
    linkable = docs.where("id is not null and n_shingles > 0")
    classes = saved(linkable.groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "n_bytes", "sig", "bands")).alias("s")).select("digest", "s.*"))

    keys = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key", F.ceil(F.col("n") / BUCKET_ROWS).alias("blocks"))
    buckets = _tiles(keys.join(shared, ["band", "key"]).join(classes.select("id", "n_shingles", "sig"), "id"), "blocks", "id")
    edges = _estimated_edges(buckets, kind, n_hashes, bits, t - slack, t, parts)

    cluster = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    cluster = cluster.join(classes.groupBy("id").agg(F.sum("n_bytes").alias("n_bytes")), "id")
    totals = cluster.groupBy("cluster").agg(F.ceil((F.sum("n_bytes") + 1) / CLUSTER_BYTES).alias("blocks"))
    wanted = side(saved(cluster.select("id", "cluster").join(totals, "cluster")), 48)
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    members = _tiles(texts.join(wanted, "id"), "blocks", "id")
    confirmed = _confirmed_edges(members, kind, words, percent, parts)
    twice = linkable.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if twice.limit(1).count():  # an id of several texts ties their classes together
        own = linkable.join(twice, "id", "left_semi").join(classes.select("digest", F.col("id").alias("dst")), "digest")
        confirmed = confirmed.unionByName(own.select(F.col("id").alias("src"), "dst"))
    links = connected_components(confirmed).select(F.col("node").alias("rep"), "component")

    reps = classes.select("digest", F.col("id").alias("rep")).join(links, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    alone = docs.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linkable.join(reps, "digest").select("id", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
