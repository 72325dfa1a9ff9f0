"""Operators with models and indexes: search, quality, toxicity, secrets, licences, and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lingloom.llm import licenses, quality, secrets, topk_search, toxicity

SF = "/root/testdata/sf0.01"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("shard_rows, k, runs", [(20_000, 10, 50_000), (40, 3, 50_000), (10, 4, 5)])
def test_top_k_equals_brute_force(spark, shard_rows, k, runs, monkeypatch):
    monkeypatch.setattr(topk_search, "ANNULUS", 16)
    monkeypatch.setattr(topk_search, "MAX_RUNS", runs)
    monkeypatch.setattr(topk_search, "RUN_BLOCK", 3)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 8)) + 3 * rng.normal(size=(1, 8)), np.repeat(rng.normal(size=(1, 8)), 60, 0), np.zeros((3, 8))])
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (901, [], 1), (902, [1.0] * 7 + [None], 1), (903, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    q = topk_search.quantized(df, "vec_id", "embedding", 1024)
    assert q.count() == len(x)
    got = {}
    for r in topk_search.top_k(q, q.where("id % 20 = 0"), k, shard_rows=shard_rows, n_pivots=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    v = np.floor(1024 * x.astype(np.float32).astype(float)).astype(np.int64)
    for i in range(0, len(x), 20):
        best = sorted(((-int(v[i] @ v[j]), j) for j in range(len(x)) if j != i))[:k]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert topk_search.top_k(q.where("1 = 0"), q.where("1 = 0"), k).collect() == []
    alone = q.where("id = 0")
    assert topk_search.top_k(alone, alone, k).collect() == []


def test_top_k_of_two_dimensions_nulls_and_repeats(spark):
    rows = [(1, [1, 2, 3], "x"), (2, [4], "x"), (3, [1, 1], "x"), (3, [1, 1], "x"), (4, [], "x"), (5, None, "x"), (None, [9, 9, 9], "x"), (6, [0, 0, 0, 5], "x")]
    df = spark.createDataFrame(rows, "id long, v array<long>, score string")
    got = {}
    for r in topk_search.top_k(df, df.where("id <= 3 or id is null"), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {1: [(1, 2, 4), (2, 3, 3), (3, 3, 3)], 2: [(1, 1, 4), (2, 3, 4), (3, 3, 4)], 3: [(1, 2, 4), (2, 1, 3), (3, 4, 0)]}
    assert topk_search.top_k(df, df.where("1 = 0"), 3).collect() == [] == topk_search.top_k(df.where("id = 5"), df, 3).collect()


def test_cumulative_link_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    eta = x @ np.array([2, -1, 0, 1, 0, 0.5])
    u = np.log(1 / rng.uniform(size=3000) - 1)
    y = np.searchsorted(np.array([-2.0, 0.0, 2.5]), eta - u)
    m = quality.CumulativeLink.fit(x, y, 4)
    assert np.all(np.diff(m.thresholds) > 0) and np.abs(m.thresholds - [-2, 0, 2.5]).max() < 0.3
    t = m.tails(x)
    assert np.all(np.diff(t, axis=1) <= 0) and np.corrcoef(t.sum(1), y)[0, 1] > 0.75


def test_quality_held_out(spark):
    d = docs(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = quality.fit(d, quality.ratings_of_labels(labels.where(fold != 1)))
    rows = quality.grade_documents(d, model).join(labels.where(fold == 1), "doc_id").collect()
    right = [(r.tails[0] >= 0.4) == (r.quality == 1) for r in rows]
    assert sum(right) / len(right) > 0.9
    odd = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "the of and", "c"), (3, "x" * 300_000, "c"), (3, "x", "c")], "doc_id long, text string, tails string")
    assert quality.grade_documents(odd, model).count() == 5 and quality.select_documents(odd, model).columns == odd.columns
    assert quality.grade_documents(odd.where("1 = 0"), model).collect() == [] and quality.select_documents(odd, None).count() == 5
    assert quality.fit(d, quality.ratings_of_labels(labels.where("1 = 0"))) is None
    assert all(r.expected_grade is None for r in quality.grade_documents(odd, None).collect())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = ["idiot", "scum", "ab", "worthless", "pathetic", "idiom"]
    a = toxicity.TermAutomaton(dict.fromkeys(terms, 1.0))
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "i", "x", "ss"])
        w = "".join(w)
        near = min(((edit_distance(w, t), k) for k, t in enumerate(terms) if edit_distance(w, t) <= toxicity.edits_for(t)), default=None)
        got = a.match(w)
        assert (got and (got[1], got[0])) == near, w


def test_quotation_counts_less_than_abuse(spark):
    model = toxicity.Model(dict.fromkeys(toxicity.SEEDS, toxicity.SEED_WEIGHT))
    texts = ["you idiot, you worthless scum", 'he said the word "idiot" in court', "you pathetlc 1diot", "a calm day", None, "", "z" * 100_000]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)] + [(None, "moron", 0.5)], "doc_id long, text string, score double")
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    assert s[0] > 0.9 > 0.5 > s[1] and s[2] > 0.5 and max(s[3], s[4], s[5], s[6]) < 0.1 and s[None] > 0.5
    assert toxicity.score_toxicity(df.where("1 = 0"), model).collect() == []


def test_quotation_marks_are_paired_over_the_line():
    reader = toxicity.Reader(toxicity.Model(dict.fromkeys(toxicity.SEEDS, toxicity.SEED_WEIGHT)))
    score = lambda t: 1 / (1 + np.exp(-reader.features(t) @ toxicity.PRIOR))
    far = "quite a long way of words " * 6
    quoted = ['a "idiot" b', "a „idiot“ b", "a „idiot” b", "a “idiot” b", "a «idiot» b", "a »idiot« b", "a ‹idiot› b", "a ‘idiot’ b", "a ‚idiot‘ b", "a 'idiot' b", "a ‘it’s an idiot’ b", f'a "{far} idiot {far}" b', f"a „{far} idiot {far}“ b", "l'homme 'don't idiot' b"]
    abuse = ["a idiot b", 'a "thing" idiot "b"', "„a“ idiot „b“", "it’s an idiot, don’t", "it's an idiot, don't", 'a " idiot\n" b', "«a» idiot «b»", f'"{far}" idiot "{far}"']
    assert all(score(t) < 0.5 for t in quoted), [t for t in quoted if score(t) >= 0.5]
    assert all(score(t) >= 0.5 for t in abuse), [t for t in abuse if score(t) < 0.5]
    assert score(("'a " * 30_000) + "„" * 30_000 + "‘x " * 30_000) < 0.1


def test_no_learned_word_is_left_out(spark):
    names = [f"z{chr(97 + k // 26)}{chr(97 + k % 26)}qq" for k in range(200)]
    rows = [(f"{n} clean{k} text{j} more words", j % 2) for k, n in enumerate(names) for j in range(8)]
    rows = [(t if y else t.replace(t.split()[0], "plain"), y) for t, y in rows]
    terms, innocent = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"), [], odds=2.0)
    assert set(names) <= set(terms)
    rows += [(f"{n}x and {n}x again", 0) for n in names for _ in range(3)]
    terms, innocent = toxicity.learn_terms(spark.createDataFrame(rows, "text string, toxic int"), [], odds=2.0)
    assert {f"{n}x" for n in names} <= innocent


def test_toxicity_held_out(spark):
    from lingloom.llm.queries import op5_toxicity

    rows = op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    none = toxicity.fit(docs(spark), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert list(none.terms) == toxicity.SEEDS


def secret_rows():
    rng = random.Random(6)
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f'some words token = "{code(40)}" and more') for k in range(60)] + [(100 + k, f"commit {code(40)} of words 4111111111111111 end") for k in range(60)]
    return rows + [(300, None), (301, ""), (None, f'api_key: "{code(32)}"'), (302, "no digits herehereherehere"), (303, "a1" * 20_000), (0, "plain")]


def test_secrets(spark):
    df = spark.createDataFrame([(*r, 0, "p") for r in secret_rows()], "doc_id long, text string, finding int, path string")
    out = secrets.scan_secrets(df, secrets.example_findings(spark), secrets.confirmed_by_assignment()).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.is_secret for k in range(60) for r in by[k]) and not any(r.is_secret for k in range(100, 160) for r in by[k])
    assert sorted(r.finding for r in by[100]) == [0, 1] and by[None][0].is_secret and 300 not in by and 302 not in by
    only = secrets.scan_secrets(df.where("doc_id < 60")).collect()
    assert all(r.is_secret and r.probability is None for r in only) and secrets.scan_secrets(df.where("1 = 0")).collect() == []


def test_planted_secrets_are_found_and_the_rest_left(spark):
    rng = random.Random(16)
    any_of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ['password = "{}"', "DB_PASSWORD: {}", "Authorization: Bearer {}", 'my "auth_token": "{}",', "the api key is {} here", "secret={}"]
    shapes = [lambda: any_of(base62, 32), lambda: any_of("0123456789abcdef", 40), lambda: any_of(base62, 9) + "!x", lambda: any_of("bcdfgBCDFGHJKLM.@#", 12)]
    rows, want = [], {}
    for k in range(120):
        value = shapes[k % 4]()
        if k % 4 >= 2 and k % 6 == 2:
            continue  # a header's key is a long run of key characters
        rows.append((k, "words before\n" + planted[k % 6].format(value) + "\nwords after"))
        want[k] = value
    plain = ["commit {} fixes it", "the md5 {} of the file", "order 2024{} shipped", "see src/user/order/index/{} there", "call get_user_order_value_{}(x)"]
    for k in range(100):
        t = plain[k % 5]
        rows.append((1000 + k, t.format(any_of("0123456789abcdef", 40) if k % 5 < 2 else str(10**12 + k))))
    rows += [(2000, "password = changeme"), (2001, 'token = "your_token_here"'), (2002, "the password is incorrect"), (2003, "token: none123")]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), secrets.example_findings(spark)).collect()
    found = {r.doc_id for r in out if r.is_secret and r.secret == want.get(r.doc_id)}
    false = {r.doc_id for r in out if r.is_secret and r.doc_id >= 1000}
    assert {r.doc_id for r in out if r.secret == want.get(r.doc_id)} == set(want)  # each is a candidate
    assert len(found) >= 0.9 * len(want), (len(found), len(want), [want[k] for k in set(want) - found][:8])
    assert len(false) <= 0.1 * 104, false


def test_families_of_keys_that_were_not_trained_on(spark):
    """GitHub, AWS and Slack keys by a forest that saw none, URL passwords, JWTs; hashes, links and names beside them."""
    rng = np.random.default_rng(5)
    pick = lambda n, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(list(chars), n))
    upper, hexes, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "0123456789"
    secret = [
        lambda: f"git clone https://ghp_{pick(36)}@github.com/team/app.git",
        lambda: f"aws_access_key_id = AKIA{pick(16, upper)}",
        lambda: f"SLACK_TOKEN=xoxb-{pick(11, digits)}-{pick(12, digits)}-{pick(24)}",
        lambda: f"Cookie: auth=eyJ{pick(33)}.eyJ{pick(60)}.{pick(43)}; path=/",
        lambda: f"url: postgres://app:{pick(12)}@db.internal/main",
    ]
    other = [lambda: f"auth commit = {pick(40, hexes)}", lambda: f"see commit {pick(40, hexes)} of the branch", lambda: f"checksum = {pick(32, hexes)}", lambda: "https://user.example.com/total_result_index_2/page", lambda: "mail me at http://a.b:8080/x@y"]
    rows = [(k, secret[k % 5]()) for k in range(100)] + [(1000 + k, other[k % 5]()) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = secrets.scan_secrets(docs, secrets.example_findings(spark, without=("github", "aws", "slack"))).collect()
    found = {r.doc_id for r in out if r.is_secret}
    recall = [sum(k in found for k in range(s, 100, 5)) / 20 for s in range(5)]
    wrong = [sum(1000 + k in found for k in range(s, 100, 5)) / 20 for s in range(5)]
    assert sum(recall) / 5 >= 0.8 and sum(wrong) / 5 <= 0.1, (recall, wrong)


def test_findings_of_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 'token = "0123456789abcdef0123"', 1)], "doc_id long, text string, f_length int")
    findings = secrets.example_findings(spark, 400).withColumn("length", F.lit(1)).withColumn("f_length", F.lit("x")).withColumn("id", F.lit(3)).withColumn("letters", F.lit(0))
    odd = spark.createDataFrame([(None, None, None, None, 1), ("", "", "", "", 0), ("x" * 100_000, "a", "b", "c", None)], "secret string, before string, after string, path string, label long")
    out = secrets.scan_secrets(df, findings.unionByName(odd, allowMissingColumns=True)).collect()
    assert [(r.doc_id, r.finding, r.secret) for r in out] == [(1, 0, "0123456789abcdef0123")] and out[0].is_secret
    assert secrets.scan_secrets(df, findings.where("1 = 0")).first().probability is None


def test_features_equal_brute_force(spark):
    rng = random.Random(21)
    words = spark.createDataFrame([("some",), ("words",), ("token",)], "word string")
    rows = [("".join(rng.choice("aeiouTHerinXZ0189_+/=-.!") for _ in range(rng.randint(1, 40))) + rng.choice(["", "some", "words_some"]), rng.choice(["token = '", "commit ", "the word: ", "", 'x="']), rng.choice(["'", '"', " end", ""]), rng.choice(["", "a/b.env", "tests/x", "src/doc/y.json"])) for _ in range(200)]
    got = secrets.featured(spark.createDataFrame(rows, "secret string, before string, after string, path string"), words).collect()
    assert len(got) == len(rows)
    strip = lambda p: p.removeprefix("(?i)")
    for r in got:
        s, n, near = r.secret, len(r.secret), r.before + r.after
        count = lambda p, t=s: len(re.findall(p, t))  # noqa: E731, B023
        want = {
            "f_length": n, "f_digits": count("[0-9]") / n, "f_uppers": count("[A-Z]") / n, "f_symbols": sum(not (c.isascii() and c.isalnum()) for c in s) / n,
            "f_turns": sum((a.isdigit() and b.isalpha()) or (a.isalpha() and b.isdigit()) for a, b in zip(s, s[1:])) / n,
            "f_case_turns": sum((a.islower() and b.isupper()) or (a.isupper() and b.islower()) for a, b in zip(s, s[1:])) / n,
            "f_pairs": count(secrets.FREQUENT_PAIRS, s.lower()) / n, "f_vowels": sum(c in "aeiouAEIOU" for c in s) / n, "f_distinct": len(set(s)) / n,
            "f_hex": float(all(c in "0123456789abcdefABCDEF" for c in s)), "f_covered": sum(len(w) for w in re.findall("[a-z]{3,}", s.lower()) if w in ("some", "words", "token")) / n,
            "f_test_path": float(re.search(strip(secrets.TEST_PATH), r.path, re.I) is not None), "f_config_path": float(re.search(strip(secrets.CONFIG_PATH), r.path, re.I) is not None), "f_depth": r.path.count("/") + 1,
            "f_near_letters": sum(c.isalpha() for c in near) / max(1, len(near)), "f_near_symbols": sum(not c.isalnum() and c != " " for c in near) / max(1, len(near)),
            "f_in_url": float(re.search(":/{0,2}$", r.before) is not None and r.after.startswith("@")),
            "f_secret_word": float(re.search(strip(secrets.SECRET_WORDS), r.before, re.I) is not None), "f_other_word": float(re.search(strip(secrets.OTHER_WORDS), r.before, re.I) is not None),
            "f_assigned": float(re.search("[:=]\\s*[\"']?$", r.before) is not None), "f_quoted": float(r.before[-1:] in ("'", '"') and r.before != "" and r.after[:1] in ("'", '"') and r.after != ""),
        }
        assert set(want) == set(secrets.FEATURES)
        assert all(abs(r[c] - v) < 1e-9 for c, v in want.items()), [(c, r[c], v) for c, v in want.items() if abs(r[c] - v) >= 1e-9]


def test_licenses_are_inherited_from_the_nearest_ancestor(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [("a/LICENSE", apache), ("a/x.py", "code"), ("a/b/c/y.py", "code\n" + mit + "\nmore code that is long enough not to be a licence file at all"), ("a/b/c/z.py", "x"), ("a/b/COPYING", mit), ("q/w.py", "text"), ("LICENSE.txt", "All rights reserved."), ("n.py", None), ("", ""), (None, apache), ("a/x.py", "code"), ("a/b/c/d/e.py", "My license to drive")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "path string, text string, license string")
    got = {r.path: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == 10 and got["a/x.py"].license == "Apache-2.0" and got["a/x.py"].license_path == "a/LICENSE" and got["a/x.py"].distance == 0
    assert (got["a/b/c/y.py"].own_license, got["a/b/c/z.py"].license, got["a/b/c/z.py"].distance) == ("MIT", "MIT", 1)
    assert got["q/w.py"].license == "LicenseRef-all-rights-reserved" and got["a/b/c/d/e.py"].license == "MIT" and got["a/b/c/d/e.py"].distance == 2
    assert licenses.scan_licenses(df.where("1 = 0")).collect() == []


def tf_idf_cosine(text, templates, unknown=2.0):
    """{license: best cosine}, in plain Python."""
    terms = lambda t: re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", t.lower())
    vectors = [(name, Counter(terms(t))) for name, t in templates]
    df = Counter(x for _, v in vectors for x in v)
    idf = {x: 1 + math.log(len(templates) / n) for x, n in df.items()}
    weigh = lambda v: {x: (1 + math.log(n)) * idf.get(x, unknown) for x, n in v.items()}
    length = lambda v: math.sqrt(sum(w * w for w in v.values()))
    own, out = weigh(Counter(terms(text))), {}
    for name, v in vectors:
        w = weigh(v)
        out[name] = max(out.get(name, 0), sum(w[x] * own[x] for x in w if x in own) / (length(w) * length(own) or 1))
    return out


def test_licence_files_equal_brute_force(spark):
    rng = random.Random(13)
    texts, headers = dict(licenses.FULL_TEXTS), licenses.TEMPLATES
    rows, folders = [], ["", "a", "a/b", "a/b/c", "d", "d/e", "f"]
    for k, f in enumerate(folders):
        body = rng.choice(list(texts.values())).split()
        for j in range(rng.randint(0, 60)):
            body[rng.randrange(len(body))] = f"word{j}"
        if f in ("a", "d", "f"):
            rows.append((f + "/LICENSE", "Copyright (c) 2019 Someone\n" + " ".join(body)))
        if f == "a/b":
            rows.append((f + "/legal.txt", "\n".join(" ".join(body[i : i + 9]) for i in range(0, len(body), 9))))
        rows += [(f"{f}/x{k}.py".lstrip("/"), "plain code of words"), (f"{f}/y{k}.py".lstrip("/"), f"line\n{rng.choice(headers[:6])[1]}\n" + "code of other words " * 30)]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    own, gives = {}, {}
    for p, t in rows:
        file = p.rsplit("/", 1)[-1]
        whole = tf_idf_cosine(t, licenses.FULL_TEXTS) if file in ("LICENSE", "legal.txt") else {}
        best = {n: s for n, s in whole.items() if s >= 0.8}
        for line in t.split("\n"):
            if re.search("licen[sc]|copyright|rights reserved|permission is hereby|redistribution and use|spdx|public domain", line.lower()):
                for n, s in tf_idf_cosine(line, headers).items():
                    if s >= 0.6:
                        best[n] = max(best.get(n, 0), s)
        own[p] = best
        if p in got and got[p].own_license:
            assert got[p].own_license in texts or got[p].own_license in dict(headers)
        if whole and max(whole.values()) >= 0.8:
            gives[p.rpartition("/")[0]] = p
            top = max(whole, key=whole.get)
            assert got[p].own_license == top and got[p].own_score >= round(whole[top], 6) - 1e-6
        elif best:
            top = min(best, key=lambda n: (n == licenses.RESERVED, -best[n], n))
            assert got[p].own_license is not None and got[p].own_score >= best[top] - 1e-6  # windows may score higher than lines
    assert gives
    for p, t in rows:
        if "code" in t and "plain" in t:
            at, d, want = p.rpartition("/")[0], 0, None
            while want is None:
                want = gives.get(at)
                if want is None and not at:
                    break
                if want is None:
                    at, d = at.rpartition("/")[0], d + 1
            assert (got[p].license_path, got[p].license) == (want, got[want].own_license if want else None), p
            assert want is None or got[p].distance == d


def plain_features(text):
    """quality.features of one text, in plain Python."""
    raw = (text or "").encode()
    out, m = np.zeros(quality.DIM), (1 << 32) - 1
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m) ^ (c * 0xC2B2AE3D & m)
        h ^= h >> 15
        out[(h * 0x27D4EB2F & m) % (1 << 32) // 256 % quality.TRIGRAMS] += 1
    words = [w for w in re.split(b"[\x20\x09-\x0d]+", raw) if w]
    kind = lambda c: 1 if 97 <= c < 123 or c >= 128 else 2 if 65 <= c < 91 else 4 if 48 <= c < 58 else 5 if c in b".,;:'\"-?" else 3
    low = lambda w: bytes(c + 32 if 65 <= c < 91 else c for c in w)
    for k, w in enumerate(words):
        counts = [min(3, sum(kind(c) == j for c in w)) for j in range(1, 6)]
        shape = sum(c * 4**j for j, c in enumerate(counts)) * 4 + min(3, len(w) // 8)
        out[quality.TRIGRAMS + ((shape * 0x9E3779B1 & m) >> 9) % quality.SHAPES] += 1
        out[quality.DIM - 4 + (k > 0 and low(w) == low(words[k - 1]))] += 1
    for a, b in ((0, quality.TRIGRAMS), (quality.TRIGRAMS, quality.TRIGRAMS + quality.SHAPES), (quality.DIM - 4, quality.DIM - 2)):
        out[a:b] = np.sqrt(out[a:b] / max(1, out[a:b].sum()))
    out[quality.DIM - 2 if words else quality.DIM - 1] = 1
    return out


def test_quality_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a", "The the THE cat.", "Ünï codé x9 x9 -- ??", "q" * 70_000] + ["".join(rng.choice("ab cdeXY 19.,é\n!") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    want = np.stack([plain_features(t) for t in texts])
    got = np.concatenate([x for _, _, x in quality.feature_rows(pa.array(texts, pa.string()))])
    assert np.abs(got - want).max() < 1e-5
    model = quality.CumulativeLink(np.random.default_rng(2).normal(size=quality.DIM).astype(np.float32), np.array([-0.5, 0.7]))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.grade_documents(df, model).collect():
        eta = float(want[r.doc_id] @ model.weights)
        tails = [1 - 1 / (1 + math.exp(-(c - eta))) for c in (-0.5, 0.7)]
        assert np.abs(np.array(r.tails) - tails).max() < 1e-4 and abs(r.expected_grade - sum(tails)) < 1e-4
    kept = {r.doc_id for r in quality.select_documents(df, model, grade=2, least=0.3).collect()}
    assert kept == {k for k, x in enumerate(want) if 1 - 1 / (1 + math.exp(-(0.7 - float(x @ model.weights)))) >= 0.3}


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    good, item = "the committee will meet again in the town hall on the second day of the month", " ".join(f"item{k}" for k in range(20))
    rows = [(1, None, None), (2, "", "s"), (3, " \n\t", "s"), (None, good, "s"), (4, good, "s"), (4, good + " and so on", "s"), (5, good, None), (6, good + " " + item, "s"), (None, "x " + item, "s"), (7, "y" * 300_000, "s"), (8, None, "s"), (8, "other words of this id", "t")]
    extra = "0 as kept, 'a' as ids, 1 as component_id, 'h' as host, 2 as n, 'i' as item_id, 'x' as tails, 'l' as lines"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).selectExpr("*", *extra.split(", "))
    spark.createDataFrame([(1, item), (2, None), (None, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())
    every = Counter(r[0] for r in rows)
    out = stage["quality_classifier"](spark, df, str(tmp_path))
    assert out.columns == df.columns and not ids(out) - every and ids(out)[4] == 2 and ids(out)[7] == 0
    out = stage["line_dedup"](spark, df, str(tmp_path))
    assert out.columns == df.columns and ids(out) == every and {r.doc_id: (r.text, r.n_chars) for r in out.collect()}[1] == (None, None)
    out = stage["minhash_near_dedup"](spark, df, str(tmp_path))
    assert out.columns == df.columns and every - ids(out) == Counter({5: 1})
    out = stage["benchmark_decontamination"](spark, df, str(tmp_path))
    assert out.columns == df.columns and every - ids(out) == Counter({6: 1})
    out = stage["bpe_encoding"](spark, df, str(tmp_path))
    assert ids(out) == every and all((r.n_tokens == 0) == (r.ids == []) for r in out.collect())
    for name, f in corpus_pipeline.STAGES:
        none = f(spark, df.where("1 = 0"), str(tmp_path))
        assert none.collect() == [] and (name == "bpe_encoding" or none.columns == df.columns)


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(31)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(25) for _ in range(3)]
    docs = []
    for k in range(60):
        body = text(rng.randint(10, 80))
        if k % 9 == 4:
            body[3:3] = items[k % 3]
        if k % 5 == 2 and docs:
            body = rng.choice(docs)[1].split("\n")[-1].split() + ["end"]
        docs.append((k, ("menu of the site\n" if k % 2 else "") + " ".join(body), "s"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # nothing is rated: all stay
    lines = {k: t.split("\n") for k, t, _ in docs}
    sets = {frozenset(x) for x in lines.values()}
    bad = {x for x in set().union(*sets) if (n := sum(x in s for s in sets)) >= 3 and n > 0.1 * len(sets)}
    left = {k: "\n".join(x for x in t if x not in bad) for k, t in lines.items()}
    shingles = lambda t, n=5: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} or ({tuple(t)} if t else set())
    own = {k: shingles(t.split()) for k, t in left.items()}
    root = {k: k for k in left}
    for _ in range(len(left)):
        for a in left:
            for b in left:
                if a < b and own[a] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = [k for k in left if root[k] == k]
    clean = [k for k in kept if not any(100 * len(shingles(i) & own[k]) >= 80 * len(shingles(i)) for i in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == clean and len(clean) < len(kept) < len(left) and bad == {"menu of the site"}
    for k in clean:
        assert got[k].ids == library.encode(left[k], add_special_tokens=False).ids and got[k].n_tokens == len(got[k].ids)
        assert got[k].decoded_sha256 == hashlib.sha256(left[k].encode()).hexdigest()


def test_pipeline_keeps_the_columns_and_decides(spark):
    d = docs(spark)
    seen, at = [], d
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.jobs.saved(stage(spark, at, SF))
        seen.append((name, at.count(), at.columns))
    counts = [n for _, n, _ in seen]
    assert all(c == d.columns for _, _, c in seen[:-1]) and counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * d.count()
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]


def test_pipeline_keeps_the_text_of_frequent_copies(spark):
    copy = "a passage of several words that many rows repeat\nand its second line of words"
    rows = [(k, copy, "s") for k in range(20)] + [(20 + k, f"menu\nbody number {k} with w{k} x{k} y{k} z{k}", "s") for k in range(40)]
    rows += [(100 + k, copy, "few") for k in range(3)] + [(200, None, "s"), (201, " \n", "s"), (202, copy.replace("\n", " \n\n"), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = corpus_pipeline.drop_boilerplate(spark, df, SF)
    text = {r.doc_id: r.text for r in lines.collect()}
    assert all(text[k] == copy for k in range(20)) and all(text[100 + k] == copy for k in range(3)) and len(text) == len(rows)
    assert all(text[20 + k] == f"body number {k} with w{k} x{k} y{k} z{k}" for k in range(40))
    left = corpus_pipeline.keep_one_of_each_group(spark, lines, SF).collect()
    assert [r.doc_id for r in left if r.text and "second line" in r.text] == [0]


def test_licenses_of_one_line_and_wrapped_headers(spark):
    apache, other = "Licensed under the Apache License, Version 2.0.", " ".join(f"word{k}" for k in range(50))
    rows = [("a/x", f"{other} {apache} {other}"), ("b/x", "Copyright 2020 The Foo Authors. All rights reserved. " + apache[:-1] + ' (the "License"); you may not use this file except in compliance with the License.')]
    rows += [("c/x", f"{other}\n# This work is licensed under the GNU\n# General Public License, version 3.\n{other}")]
    rows += [("d/x", f"/* you can redistribute it\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or {other}")]
    rows += [("e/x", f"{other} All rights\nreserved. {other}"), ("f/x", f"{other} my license to drive and the license plate {other}"), ("g/x", apache.replace(" ", "\n")), ("g/y", "code")]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"{d}/x"].own_license for d in "abcdefg"] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", "GPL-3.0", "LicenseRef-all-rights-reserved", None, "Apache-2.0"]
    assert (got["g/y"].license, got["g/y"].distance) == ("Apache-2.0", 0)


def test_secrets_in_prose_are_not_taught_as_false_positives(spark):
    rows = [("Authorization: Bearer ", "a1b2c3d4e5f6a7b8", 0.0), ("the token is ", "a1b2c3d4e5f6a7b8", 0.0), ("seen in ", "a1b2c3d4e5f6a7b8", 0.0), ("commit ", "a1b2c3d4e5f6a7b8", 0.0), ("paid ", "4111111111111111", 0.0), ("see ", "some-words-here-2", 0.9), ('token = "', "a1b2c3d4e5f6a7b8", 0.0)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, before string, secret string, f_covered double")
    got = {r.k: r.label for r in df.select("k", secrets.confirmed_by_assignment().alias("label")).collect()}
    assert [got[k] for k in range(7)] == [None, None, None, 0.0, 0.0, 0.0, 1.0]


def test_a_small_bound_still_shows_every_grade(spark):
    docs = spark.createDataFrame([(i % 30, f"{'fine calm words' if i % 30 < 15 else 'bad junk lines'} {i}") for i in range(90)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, int(i < 15)) for i in range(30)], "doc_id long, grade int")
    assert quality.fit(docs, ratings, max_labelled=25) is not None
