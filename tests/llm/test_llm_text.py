"""Operators on single texts: tokens, near duplicates, repeats, benchmark items, lines."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lingloom.llm import bpe, decontaminate, jobs, kernels, line_dedup, near_dup, suffix_dedup

DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "x y z"), (5, "Ünï codé 　 ​𝄞 end"), (6, "a" * 5000), (7, "<|endoftext|>a b<|endoftext|> "), (8, "It's we'll  12 3\n\n x")]


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, encoding="utf-8") as f:
        return bpe.TokenizationAutomaton(f.read())


def test_encoder_equals_the_library(automaton):
    rng, library, enc = random.Random(5), Tokenizer.from_file(PATH), bpe.Encoder(automaton)
    letters = [*map(chr, range(32, 127)), *"éßñçЖ中　 \u0085​\n\t'1٣"]
    for k in range(3000):
        n = rng.randint(0, 30)
        t = "".join(rng.choice("abeht '" if k % 3 else letters) for _ in range(n)) + ("<|endoftext|>" if k % 50 == 0 else "")
        assert [i for run in enc.encode(t) for i in run] == library.encode(t, add_special_tokens=False).ids, t


def test_encode_and_decode_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ODD], DOCS + ", ids string")
    library = Tokenizer.from_file(PATH)
    rows = bpe.encode(df, PATH, decoded=True).collect()
    assert len(rows) == len(ODD)
    for r, (i, t) in zip(rows, ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r.doc_id == i and r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == (t or "")
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [r.decoded for r in back] == [t or "" for _, t in ODD]
    assert bpe.encode(df.where("1 = 0"), PATH, decoded=True).collect() == []


def shingles(t, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def families(seed, count=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(count):
        base = [word() for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else rng.choice([" ", "\n "]).join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent, monkeypatch):
    texts = families(words) + [None, "", " ", "lonely", "Lonely", "a b"]
    sets = [shingles(t, words) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS + ", component_id string")
    for rows, held in ((4096, 16 << 20), (2, 400)):  # the second deals even these small groups into tiles
        monkeypatch.setattr(near_dup, "BUCKET_ROWS", rows)
        monkeypatch.setattr(near_dup, "CLUSTER_BYTES", held)
        monkeypatch.setattr(jobs, "BROADCAST_BYTES", held)
        got = {r.doc_id: r for r in near_dup.near_duplicates(df, words=words, percent=percent).collect()}
        assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), root(k), root(k) == k) for k in range(len(texts))}


def test_near_duplicates_of_odd_rows(spark):
    got = near_dup.near_duplicates(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(got) == len(ODD) and all(r.component_id == r.doc_id for r in got) and all(r.kept for r in got)
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def thue_morse(n, swap):
    """A word whose hash by powers modulo 2**64 equals that of its swapped twin."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s.translate(str.maketrans("ab", "ba")) if swap else s


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_are_told_apart_by_their_bytes(spark, n, monkeypatch):
    a, b, rest = thue_morse(n, False), thue_morse(n, True), "one two three four"
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a.upper()} {rest}")], DOCS)
    item = spark.createDataFrame([(1, f"{a} {rest}")], "item_id long, text string")
    for clash in (False, True):
        if clash:  # even where all words of a length have one hash
            monkeypatch.setattr(kernels, "word_hashes", lambda data, starts, ends: kernels.mix((ends - starts).astype("uint64")))
            monkeypatch.setattr(decontaminate, "word_hashes", kernels.word_hashes)
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        starts, ends, _ = kernels.words(data, np.array([0, len(data)]))
        x, y, z = kernels.word_numbers(data, starts, ends).tolist()
        assert x == z != y
        sets = kernels.exact_sets(np.frombuffer((a + b + a).encode(), np.uint8), np.array([0, n, 2 * n, 3 * n]), 5)
        assert sets[0].tolist() == sets[2].tolist() != sets[1].tolist()
        if not clash:
            got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
            assert got == {1: 1, 2: 2, 3: 1}
        assert sorted(r.doc_id for r in decontaminate.contained_items(df, item).collect()) == [1, 3]


def test_an_id_of_several_texts_ties_their_groups(spark):
    one, two = " ".join(f"w{k}" for k in range(30)), " ".join(f"x{k}" for k in range(30))
    rows = [(2, one), (9, one), (9, two), (11, two), (9, None), (20, one + " end"), (30, "alone here"), (9, two + " more")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(2, 2), (9, 2), (11, 2), (20, 2), (30, 30)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(None, 4), (2000, 2000)]
    got = {r.node: r.component for r in jobs.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length, gram, hot, often", [(100, 24, 50_000, 50), (20, 8, 50_000, 50), (16, 16, 50_000, 50), (100, 24, 1, 50), (20, 8, 3, 50), (100, 24, 50_000, 2), (20, 4, 50, 3)])
def test_repeats_equal_brute_force(spark, length, gram, hot, often, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_HITS", often)
    rng = random.Random(length)
    word = lambda: rng.choice(["the", "ä", "of", "Straße", "x", "ing ", "\n"]) + rng.choice("abc ") * rng.randint(0, 3)
    passages = ["".join(word() for _ in range(rng.randint(5, 120))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.5 else "".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        rows.append((k, "".join(parts)))
    rows += [(100, "ab" * 300), (101, "ab" * 301), (102, "z" * 400), (103, None), (104, ""), (105, "y" * length)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", kept int"), length=length, gram=gram).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == brute_repeats(rows, length)


@pytest.mark.parametrize("length", [512, 600, 2000])
@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats_of_long_strings(spark, length, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    rng = random.Random(length)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, regular = noise(2300), thue_morse(2048, False)
    rows = [(1, noise(900) + shared + noise(50)), (2, noise(30) + shared + noise(900)), (3, shared[100:1900]), (4, shared), (5, "z" * 3 * length)]
    rows += [(6, "<" + regular + ">" + noise(300)), (7, "<" + thue_morse(2048, True) + ">" + noise(300)), (8, noise(40) + regular[7:])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS), length=length).collect()
    want = brute_repeats(rows, length)
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    assert sum(w[1] for w in want.values()) > 2 * length


def test_repeats_of_an_id_with_several_texts(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = noise(300), noise(400)
    rows = [(7, one), (7, two + one[:150]), (7, one), (3, noise(20) + two), (9, one + two), (None, one), (7, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    removed = {(r.doc_id, r.n_bytes): r.n_bytes - len(r.kept) for r in got}
    assert len(got) == len(rows) and removed[9, 700] == 700 and removed[3, 420] == 0 and removed[None, 300] == 0 and removed[7, 0] == 0
    # of the two texts of id 7 the one of greater hash loses what it shares with the other; two is 3's already
    assert (removed[7, 300], removed[7, 550]) in {(0, 550), (150, 400)}


def test_long_and_short_texts_around_a_chunk(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    long = " ".join(rng.choice(vocabulary) for _ in range(230_000))
    assert len(long) > 1.1 * kernels.CHUNK_BYTES
    item = " ".join(long.split()[200_000:200_030])
    rows = [(1, long), (2, long + " end"), (3, item), (4, "short one here with words"), (5, long[-600:])]
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    found = decontaminate.contained_items(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3]
    got = {r.doc_id: r.n_bytes - len(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1] < 1000 and got[2] >= len(long) and got[3] == len(item) and got[4] == 0 and got[5] == 600
    coded = {r.doc_id: r for r in bpe.encode(df, PATH, decoded=True).collect()}
    assert coded[1].decoded == long and coded[1].ids == Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids
    lines = spark.createDataFrame([(k, f"menu\n{long[k * 100 : k * 100 + 50]}\n" + ("x y\n" * 100_000 if k == 0 else "")) for k in range(12)], DOCS).withColumn("source", F.lit("s"))
    left = {r.doc_id: r.text for r in line_dedup.drop_boilerplate_from_text(lines).collect()}
    assert len(left) == 12 and not any("menu" in t for t in left.values()) and len(left[0]) > 400_000


def test_repeats_of_odd_rows(spark):
    got = suffix_dedup.remove_repeats(spark.createDataFrame([*ODD, (9, "q" * 150), (9, "q" * 150)], DOCS)).collect()
    assert len(got) == len(ODD) + 2 and {(r.n_bytes, len(r.kept)) for r in got if r.doc_id == 9} == {(150, 1)} and [len(r.kept) for r in got if r.doc_id == 1] == [0]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_array():
    rng = random.Random(0)
    for _ in range(400):
        t = [rng.randint(0, rng.choice([1, 3, 90])) for _ in range(rng.randint(0, 60))]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 5, 12, 40])))) for k in range(30)] + [(90, None), (91, " "), (None, "a b c d e f"), (0, "x y z w v u")]
    docs = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            text = (items[rng.randrange(30)][1]).split()
            if rng.random() < 0.5 and len(text) > 8:
                text[rng.randrange(len(text))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = text
        docs.append((k, " ".join(w).upper() if k % 3 else "\n".join(w)))
    docs += [(200, None), (201, ""), (None, items[4][1])]
    want = []
    for i, t in docs:
        for j, x in items:
            n = min(5, len((x or "").split()))
            s = shingles(x, 5) if x else set()
            if j is None or not s:
                continue
            found = len(s & (shingles(t, n) if len((t or "").split()) >= n else set()))
            if 100 * found >= 80 * len(s):
                want.append((i, j, len(s), found))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_found int")
    for block in (500_000, 60):
        got = decontaminate.contained_items(d, b, block_shingles=block).collect()
        assert sorted(map(str, ((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got))) == sorted(map(str, want)) and want
    kept = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {w[0] for w in want if w[0] is not None}
    assert decontaminate.contained_items(d, b.where("1 = 0")).collect() == [] and decontaminate.decontaminate(d.where("1 = 0"), b).collect() == []


def test_boilerplate_lines_of_split_hosts(spark, monkeypatch):
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(30)]
    rows = [(k, rng.choice(["big", "big", "big", "mid", "few", None]), "\n".join(rng.choice(lines[: 8 + k % 23]) for _ in range(rng.randint(0, 6)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = sorted(map(tuple, line_dedup.drop_boilerplate_from_text(df).select("doc_id", "text").collect()))
    monkeypatch.setattr(jobs, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "SPLIT_PAGES", 20)
    got = line_dedup.drop_boilerplate_from_text(df)
    assert got.columns == df.columns and sorted(map(tuple, got.select("doc_id", "text").collect())) == want
    pages = {}
    for _, h, t in rows:
        pages.setdefault(h or "", []).append(set(t.split("\n")) - {""})
    bad = {h: {x for x in lines if (n := sum(x in p for p in ps)) >= 3 and n > 0.1 * len(ps)} for h, ps in pages.items()}
    assert want == sorted((k, "\n".join(x for x in t.split("\n") if x not in bad[h or ""])) for k, h, t in rows)


def test_boilerplate_lines(spark):
    rows = [(k, "h", f"menu\nbody {k}\n\nmenu\n foot ") for k in range(8)] + [(8, "h", "body 1\nonly"), (9, None, "menu\nx"), (10, "h", None), (11, "h", "menu"), (11, "h", "menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit("clash"))
    got = line_dedup.drop_boilerplate_from_text(df, ratio=0.3, min_pages=3)
    assert got.columns == df.columns
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[0] == "body 0\n" and text[8] == "body 1\nonly" and text[9] == "menu\nx" and text[10] is None and text[11] == "" and got.count() == 13
    assert line_dedup.drop_boilerplate_from_text(df.where("1 = 0")).collect() == []
    urls = spark.createDataFrame([("HTTPS://A.b.c:80/x?y",), ("a/b",), (None,)], "u string").select(line_dedup.host_of(F.col("u"))).collect()
    assert [r[0] for r in urls] == ["a.b.c", "", ""]
    html = spark.createDataFrame([("<p>a<br>b </p><script>x<y</script><!-- n -->\n<style>s</style>c",)], "h string").select(line_dedup.html_lines(F.col("h"))).first()
    assert html[0] == ["a", "b", "c"]


def test_sets_that_only_their_hashes_make_equal_are_not_folded(spark):
    """Two texts of one shingle that an earlier, linear hash gave the same key, and texts of equal sets by other words."""
    rows = [(0, "alpha beta gamma"), (1, "doc76988 other i&n]nwya"), (2, "Alpha\tbeta  gamma "), (3, "a b c a b c a"), (4, "c a b c a b c"), (5, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (3, 3), 4: (3, 3), 5: (0, 5)}


def test_word_digests_are_of_the_words_alone():
    texts = ["", " ", "a", " a", "a ", "A\n\tb ", "a b", "ab", "é b", "", "  x", "x"]
    raw = [t.encode() for t in texts]
    got = kernels.word_digests(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [tuple(re.sub("[A-Z]", lambda m: m[0].lower(), t).split()) for t in texts]
    for i in range(len(texts)):
        assert (got[i] is None) == (not want[i])
        for j in range(len(texts)):
            assert (got[i] == got[j]) == (want[i] == want[j]), (texts[i], texts[j])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_are_whole_whatever_the_batches(size):
    rng = np.random.default_rng(size)
    pdf = pd.DataFrame({"k": np.sort(rng.integers(0, 12, 60)), "j": 0, "x": np.arange(60)})
    frames = list(near_dup.whole_groups((pdf.iloc[a : a + size] for a in range(0, 60, size)), ["k", "j"]))
    assert pd.concat(frames)["x"].tolist() == list(range(60))
    assert sum(f["k"].nunique() for f in frames) == pdf["k"].nunique()
    assert max(map(len, frames)) <= size + 2 * pdf.groupby("k").size().max()


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "bigint"])
def test_items_of_any_id_type(spark, kind):
    docs = spark.createDataFrame([(1, "zero one two three four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([("7", "one two three four five six")], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    found = decontaminate.contained_items(docs, items)
    assert found.schema["item_id"].dataType.simpleString() == kind and [str(r.item_id) for r in found.collect()] == ["7"]
