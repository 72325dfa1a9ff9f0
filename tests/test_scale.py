"""What a file costs to read and write: patterns without the slow class, units read once, arrivals opened once."""

import re

from pyspark.sql import functions as F

from lingloom.functions import protect as P
from lingloom.functions import text as T
from lingloom.plans import views as V
from lingloom.sources import files as S
from lingloom.sources import rewrite as R


def test_no_slow_class_in_file_patterns():
    for pattern in (S.UNIT, S.RUN_TEXT, T.NOT_MARKUP, V.PARAGRAPH):
        assert r"[\s\S]" not in pattern


def test_filters_do_not_read_units_again(spark):
    docs = spark.createDataFrame([("d", '<x><trans-unit id="u1"><source>a</source></trans-unit></x>')], "doc_id string, xml string")
    kept = S.xliff_segments(docs).where("cast(substring(segment_id, 2) as int) % 2 = 1").where("segment_id is not null")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "trans-unit" in x] and kept.count() == 1


def test_units_stay_out_of_the_join(spark):
    docs = spark.createDataFrame([("d", '<x><trans-unit id="a"><source>s</source></trans-unit><trans-unit translate="no"><source>l</source></trans-unit><trans-unit><source>t</source></trans-unit></x>')], "doc_id string, xml string")
    results = spark.createDataFrame([("d", k, "completed", f"new {k}") for k in ("a", "segment-1", "zz")], "doc_id string, segment_id string, status string, translated_raw string")
    out = R.rewrite_xliff(docs, results)
    row = out.first()
    assert (row.replaced, row.skipped, row.not_found) == (2, 0, 1) and re.findall("new [a-z0-9-]+", row.output) == ["new a", "new segment-1"]
    aggregates = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert aggregates and not [x for x in aggregates if "made" in x or "unit#" in x]


def test_white_space_as_before(spark):
    odd = ["a b", " a  b ", "a\tb", "a 　 b", " a \nb﻿", "", "a<b>c d</b>  e", "x\u0085y", "a \r\n b"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    old = T.trimmed(F.regexp_replace(F.regexp_replace("x", "<[^>]+>", ""), f"[{T.WS}]+", " "))
    assert df.where(~old.eqNullSafe(T.plain_text(F.col("x")))).count() == 0


def test_white_space_without_intersected_classes(spark):
    assert "&&" not in T.RUNS
    every = [f"{a}{w}{b}" for w in T.WS_CHARS for a in ("x", "x ", "é", "") for b in ("y", " y", "é", "", f"{w} z")]
    df = spark.createDataFrame([(x,) for x in every], "x string")
    old = T.trimmed(F.regexp_replace("x", f"[{T.WS}]+", " "))
    assert df.where(~old.eqNullSafe(T.plain_text(F.col("x")))).count() == 0


def test_protection_scans_a_text_once_for_each_pattern(spark):
    out = P.protect_entities(spark.createDataFrame([("a",)], "t string"), "t", patterns=[("own", "X[0-9]+")])
    lines = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "X[0-9]+" in x]
    assert len(lines) == 1 and lines[0].count("regexp_replace(") == 1 and lines[0].count("regexp_extract_all(") == 1  # the latter for texts with marks


def test_protection_of_texts_with_marks(spark):
    texts = ["", "X1", "aX1bX22", "\x01", "X1\x01X2", "\x01X3\x01", "$0 \\ X4"]
    rows = P.protect_entities(spark.createDataFrame([(x,) for x in [*texts, None]], "t string"), "t", patterns=[("own", "X[0-9]+")]).collect()
    for r in rows[:-1]:
        assert [k["original"] for k in r["entity_tokens"]] == re.findall("X[0-9]+", r["t"])
        want, n = r["t"], len(r["entity_tokens"])
        for k in range(n):
            want = re.sub("X[0-9]+", f"__ENTITY_{k + 1}__", want, count=1)
        assert r["protected_text"] == want
    assert rows[-1]["protected_text"] is None and rows[-1]["entity_tokens"] == []


def test_entity_patterns_as_before(spark):
    w, e = "[A-Za-z0-9_]", "(?![A-Za-z0-9_])"
    edge = rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    old = {"email": edge + r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}" + e, "nct_id": rf"(?<!{w})NCT[0-9]{{8}}" + e, "code": rf"(?<!{w})[A-Z]{{2,}}-[A-Z0-9-]{{2,}}" + edge}
    pieces = ["a", "+", ".", "_", "@", "b.co", "é", " ", "NCT00000042", "N", "AB-", "-X9", "B", "%", "-"]
    df = spark.createDataFrame([(a + b + c + d,) for a in pieces for b in pieces for c in pieces for d in ("", "@c.org", "AB-C1", "NCT12345678_")], "x string")
    for name, pattern in P.ENTITY_PATTERNS:
        if name in old:
            both = [F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in (pattern, old[name])]
            assert df.where(~both[0].eqNullSafe(both[1])).count() == 0 and df.where(F.size(both[0]) > 0).count() > 9


def test_pages_are_dealt_out_finely(spark):
    pages = V.seg_page(spark, "/root/testdata/sf0.001")
    assert pages.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_runs_and_edges_of_packages_as_before(spark):
    assert "*?" not in S.RUN_TEXT and S.PARAGRAPH_EDGE.count("(?=") == 1
    pieces = ["<w:p>", "<w:p w:id='1'>", "<w:p/>", "<w:pPr/>", "</w:p>", "<w:t>", '<w:t xml:space="preserve">', "<w:t/>", "</w:t>", "a", "\n", "<b>&amp;#65;</b>", "<w:tbl>"]
    df = spark.createDataFrame([(a + b + c + d,) for a in pieces for b in pieces for c in pieces for d in pieces], "x string")
    runs = [F.regexp_extract_all("x", F.lit(p), F.lit(1)) for p in (S.RUN_TEXT, r"<w:t(?:\s(?:[^>]*[^/>])?)?>((?s:.*?))</w:t>")]
    cuts = [F.split("x", p, -1) for p in (S.PARAGRAPH_EDGE, r"(?=<w:p[\s>])|(?=</w:p>)")]
    assert df.where(~runs[0].eqNullSafe(runs[1]) | ~cuts[0].eqNullSafe(cuts[1])).count() == 0 and df.where(F.size(runs[0]) > 0).count() > 99


def test_runs_of_a_paragraph_are_read_once(spark):
    out = S.docx_segments(spark.createDataFrame([("d", "<w:p><w:t>&amp;lt; &#65;</w:t><w:t>b</w:t></w:p><w:p><w:t> </w:t></w:p>")], "doc_id string, xml string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lambda") == 2  # the runs; references of a text with '&'
    assert [r.source_text for r in out.collect()] == ["&lt; Ab"]


def test_repetitions_clean_texts_by_the_fast_pattern(spark):
    from lingloom.plans import queries_flow as Q

    out = Q.j5_repetitions(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=[^!-~])" in plan and "&&[" not in plan


def _odd_units() -> list[str]:
    import random

    chance = random.Random(5)
    loose = ["<source>", "</source>", "<source/>", "<target>", "</target>", "<target/>", "<target state='a>b' />", "<alt-trans>", "</alt-trans>", "<m:e>" * 7, "</m:e>" * 7, "<sourcex>", "</x>", "x", "&amp; y", "<", "<!z>", "<?p?>", '<g id="1 > 0">', "</g>", "<n/>", "$1\\", "é\n"]
    whole = ["<source>s</source>", "<target>t</target>", "<target/>", "<alt-trans><source>x</source><target>near</target></alt-trans>", "<note>n</note>", "\x03"]
    body = lambda k: "".join(chance.choice(loose if chance.random() < (0.2, 0.9)[k % 2] else whole) for _ in range(chance.randint(0, 9)))
    return [f"<trans-unit id='1'>{body(k)}</trans-unit>" for k in range(6000)] + ["<trans-unit/>", "<trans-unit a='/>'>" + "<a>" * 9 + "<target>t</target>" + "</a>" * 9 + "<source>s</source></trans-unit>"]


def test_patterns_read_and_write_what_the_fold_does(spark):
    df = spark.createDataFrame([(x,) for x in _odd_units()], "u string").persist()
    u, value = F.col("u"), F.lit("V$1\\")
    fold = S.own_children(u, lambda c: F.struct(S._within(c, c["at"]["sa"], c["at"]["sb"]).alias("source"), S._within(c, c["at"]["ta"], c["at"]["tb"]).alias("target")))
    out = df.select(fold.alias("a"), S._own_texts(u).alias("b"), R._with_target(u, value).alias("c"), R._with_own_target(u, value).alias("d")).persist()
    assert out.where("not (a <=> b) or not (c <=> d)").count() == 0
    assert out.where("a.target <> ''").count() > 999 and out.where("c is null").count() > 999
    by_pattern = df.where(F.regexp_like("u", F.concat(F.lit(S.UNIT_OPEN), F.lit(S._both_children()[1:]))))
    assert by_pattern.count() > 499


def test_units_as_before(spark):
    old = S.UNIT_OPEN + r"(?:(?<=/>)|(?s:.*?)</trans-unit\s*>)"
    texts = ["".join(_odd_units()[k : k + 3]) + "<trans-unit>open </trans-unitx> <trans-unit id='q'/>" for k in range(0, 900, 3)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    both = [F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in (S.UNIT, old)]
    assert ".*?" not in S.UNIT and df.where(~both[0].eqNullSafe(both[1])).count() == 0


def test_what_is_not_markup_as_before(spark):
    old = r"(?s:<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>)"
    pieces = ["<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "a", "<!x>", "\n"]
    df = spark.createDataFrame([(a + b + c + d,) for a in pieces for b in pieces for c in pieces for d in pieces], "x string")
    cuts = [F.split("x", p, -1) for p in (T.NOT_MARKUP, old)]
    assert T.NOT_MARKUP.count("<") == 1 and df.where(~cuts[0].eqNullSafe(cuts[1])).count() == 0


def test_own_children_are_made_and_read_once(spark):
    from lingloom.plans import queries_flow as Q

    plan = Q.s1_k1_own_children(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("alt-trans") == 0
