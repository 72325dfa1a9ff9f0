"""Operators 11 to 13 against brute force, and on unusual input."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingloom.llm import filter_audit, hard_negatives, mixing

DOC = "doc_id long, text string, source string"


def leveled(sizes: dict, weights: dict, repeats: int = 3) -> dict:
    """Targets by sharing again what full sources leave, until none is above."""
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = total - sum(repeats * sizes[s] for s in full)
        out = {s: repeats * sizes[s] if s in full else rest * weights[s] / sum(weights[x] for x in open_) for s in sizes}
        over = {s for s in open_ if out[s] > repeats * sizes[s]}
        if not over:
            return out
        full |= over


def words_of(n: int, rng) -> str:
    return " ".join(rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows = [(i, words_of(rng.choice([0, 3, 20, 40, 400]), rng), rng.choice(["a", "a", "a", "a", "b", "é", "z", None])) for i in range(3000)]
    return rows + [(9001, words_of(30, rng), "tiny")] + [(9002, "same text here", "a")] * 5 + [(None, "no id", "b")] * 7 + [(9003, None, "z")]


def test_hypergeometric_is_the_inverse_of_the_distribution(spark):
    for n, k, m in ((50, 20, 15), (9, 4, 5), (40, 39, 39), (30, 0, 7), (30, 30, 7)):
        got = spark.range(3000).select(mixing.hypergeometric(F.lit(n), F.lit(k), F.lit(m), (F.col("id") + 0.5) / 3000).alias("x")).groupBy("x").count().collect()
        for r in got:
            exact = math.comb(k, r.x) * math.comb(n - k, m - r.x) / math.comb(n, m)
            assert abs(r["count"] / 3000 - exact) < 1e-3
    far = spark.range(500).select(mixing.hypergeometric(F.lit(20_000_000), F.lit(7_000_000), F.lit(10_000_000), mixing.uniform(F.col("id"))).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(far[0] - 3.5e6) < 250 and 950 < far[1] < 1200


def test_tree_splits_quotas_exactly(spark):
    quotas = {0: 400, 1: 1, 2: 37, 3: 0, 5: 600}
    rows = mixing.shard_quotas(spark.createDataFrame(list(quotas.items()), "s long, quota long"), 300, seed=4).collect()
    for s, q in quotas.items():
        assert sum(r.n for r in rows if r.s == s) == q
    by_shard = Counter()
    for r in rows:
        by_shard[r.shard] += r.n
    assert set(by_shard) == set(range(300)) and set(by_shard.values()) == {3, 4} and all(r.n > 0 for r in rows)
    assert mixing.shard_quotas(spark.createDataFrame([], "s long, quota long"), 3).count() == 0


def test_mix_meets_targets_and_is_disjoint(spark, corpus):
    df = spark.createDataFrame(corpus, DOC)
    kw = dict(block_words=300, shard_words=3000)
    out = mixing.mix(df, (5, 2, 1), **kw).collect()
    assert len(out) == len(corpus)
    size = {}
    for _, t, s in corpus:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = leveled(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and len(r.draws) <= 3
        assert len({d.round for d in r.draws}) == len(r.draws)
        taken[r.source] += r.size * len(r.draws)
    assert want["tiny"] == 90 and taken["tiny"] == 90
    for s in size:
        assert abs(taken[s] - want[s]) <= 200, s  # half of the longest document
    words = Counter()
    for r in out:
        for d in r.draws:
            words[d.shard] += r.size
    assert len(words) == -(-sum(taken.values()) // 3000) or len(words) > 20
    again = mixing.mix(df.repartition(7), (5, 2, 1), **kw).collect()
    assert Counter(map(repr, out)) == Counter(map(repr, again))
    other = mixing.mix(df, (5, 2, 1), seed=9, **kw).collect()
    assert Counter(map(repr, out)) != Counter(map(repr, other))


def test_mix_by_table_shards_and_unusual_input(spark, corpus):
    df = spark.createDataFrame(corpus[:500], DOC).withColumns({"shard": F.lit("x"), "size": F.lit(1), "id": F.lit("y")})
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 0.0), ("none", 4.0)], "source string, weight double")
    m = mixing.mix(df, weights, share=0.5, block_words=100, shard_words=500)
    rows = m.collect()
    assert all(r.target == 0 and not r.draws for r in rows if r.source not in ("a", "b"))
    total = sum(len((t or "").split()) for _, t, _ in corpus[:500])
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total / 2)
    out = mixing.shard_rows(df, m)
    assert Counter((r.doc_id, r.round) for r in out.collect()) == Counter((r.id, d.round) for r in rows for d in r.draws)
    parts = out.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(parts) == len({r.shard for r in parts})
    assert mixing.mix(df.where("1 = 0"), (5, 2, 1)).count() == 0
    void = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a")], DOC)
    assert [(r.size, r.target, r.draws) for r in mixing.mix(void, (5, 2, 1)).collect()] == [(0, 0.0, [])] * 3
    long = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "w " * 10, "a"), (3, "w " * 10, "b")], DOC)
    got = {r.id: len(r.draws) for r in mixing.mix(long, (1, 1)).collect()}
    assert got[3] == 3 and sum(got.values()) <= 9


def mined(rows: list[tuple], anchors: set[int]) -> list[tuple]:
    """(id, label, v) by brute force."""
    rows = [r for r in rows if None not in r]
    own: dict = {}
    for i, label, v in rows:
        if i in anchors:
            own[i] = min(own.get(i, (str(label), v)), (str(label), v))
    out = []
    for i, (label, v) in own.items():
        score = [(sum(a * b for a, b in zip(v, w)), -j, str(k) == label) for j, k, w in rows if j != i]
        score.sort(reverse=True)
        for p, pid, _ in [x for x in score if x[2]][:5]:
            fit = [x for x in score if not x[2] and 30 * p <= 100 * x[0] <= 90 * p][:10]
            out += [(i, -pid, k + 1, -x[1], p, x[0]) for k, x in enumerate(fit)]
    return out


VEC = "id long, label int, v array<long>"


@pytest.mark.parametrize("seed", [0, 1])
def test_hard_negatives_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), [int(x) for x in rng.integers(-9, 10, 5)]) for i in range(700)]
    rows += [(1000 + i, 2, [3, 3, 0, 1, 2]) for i in range(60)] + [(2000 + i, 1, [0] * 5) for i in range(5)]
    rows += [(20, 1, rows[20][2]), (20, 3, rows[20][2]), (21, 2, rows[30][2]), (None, 1, [1] * 5), (5000, None, [1] * 5), (5001, 1, None)]
    df = spark.createDataFrame(rows, VEC).withColumns({"anchor": F.lit(1), "score": F.lit("x"), "rank": F.lit(2)}).repartition(5)
    ids = {i for i in range(0, 700, 10)} | {1000, 1001, 2000}
    for kw in ({}, {"n_clusters": 3, "block": 16}):
        got = hard_negatives.hard_negatives(df, df.where(F.col("id").isin(sorted(ids))), **kw)
        assert Counter(map(tuple, got.collect())) == Counter(mined(rows, ids))
    assert hard_negatives.hard_negatives(df.where("1 = 0"), df).count() == 0
    assert hard_negatives.hard_negatives(df, df.where("1 = 0")).count() == 0
    assert hard_negatives.hard_negatives(df.where("label = 1"), df.where("label = 1 and id = 1")).count() == 0


def test_walk_ends_early_where_data_are_clustered():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16)) * 1000
    make = lambda n: (np.repeat(centre, n, 0) + rng.normal(size=(20 * n, 16)) * 30).astype(int)
    x, q = make(2000), make(3)
    unit = hard_negatives._directions(q)[0]
    c = hard_negatives._centres(unit, 20)
    own = pd.DataFrame({"id": -1 - np.arange(len(q)), "label": "a", "v": list(q), "cluster": (unit @ c.T).argmax(1)}).sort_values("cluster")
    block = hard_negatives.Block(own, c)
    score, ids = np.full((len(q), 5), -(1 << 62)), np.full((len(q), 5), 1 << 62)
    done = hard_negatives.walk(block, pd.DataFrame({"id": np.arange(len(x)), "label": "a", "v": list(x)}), lambda: score[:, -1], lambda a, s, i, _: hard_negatives.merged(score, ids, a, s, i))
    assert (score == -np.sort(-(block.v @ x.T), 1)[:, :5]).all() and done < 0.2 * len(x) * len(q)


def audited(rows: list[tuple], labels: list[tuple]) -> dict:
    """Report of (doc_id, text, source) by removing documents filter by filter."""
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((s or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out: dict = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f)
        for key, v in out.items():
            if key[0] == part:
                out[key] = (*v[:6], shapley[v[6]]) if len(v) == 7 and isinstance(v[6], str) else v
    return out


@pytest.mark.parametrize("descending", [True, False])
def test_audit_retracts_when_smaller_ids_arrive(spark, tmp_path, descending):
    rng = random.Random(3)
    texts = [words_of(60, rng), " ".join(f"w{i}" for i in range(70)), "SHOUT " * 80, "a # b", "", None, " ".join(f"x{i}" for i in range(55))]
    texts += [" ".join(f"u{i}_{k}" for i in range(52)) for k in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(240)]
    rows += [(5, texts[1], "c"), (7, texts[10], "a"), (7, texts[10], "b"), (None, texts[1], "a"), (None, texts[6], "a"), (0, texts[10], None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 240, 2)] + [(4, 1, 0), (None, 1, 1)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0), reverse=descending)
    d = str(tmp_path / "documents.parquet")
    for k in range(6):
        df = spark.createDataFrame(rows[k * 41 : (k + 1) * 41], DOC).withColumns({"mask": F.lit("x"), "key": F.lit(1), "n": F.lit(2)})
        df.coalesce(1).write.mode("append").parquet(d)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stream = filter_audit.available_now(spark, d, micro_batches=3)
    counts = filter_audit.count_masks(stream, marks, 50)
    assert counts.agg(F.sum("n")).first()[0] == len(rows) and counts.agg(F.min("n")).first()[0] > 0
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.report(counts).collect()}
    assert got == audited(rows, labels)


def test_audit_of_an_empty_table_and_string_ids(spark, tmp_path):
    d = str(tmp_path / "documents.parquet")
    none = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    spark.createDataFrame([], "doc_id string, text string, source string").write.parquet(d)
    assert filter_audit.report(filter_audit.count_masks(filter_audit.available_now(spark, d), none, 0)).count() == 0
    spark.createDataFrame([("b", "x", "s"), ("a", "x", "s"), ("é", "y" * 200_000, None)], "doc_id string, text string, source string").write.mode("append").parquet(d)
    got = filter_audit.count_masks(filter_audit.available_now(spark, d), none, 3)
    assert {(r.part, r.mask): r.n for r in got.collect()} == {("s", 1): 1, ("s", 17): 1, ("", 1): 1}
