from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingloom.functions import protect as P
from lingloom.functions import text as T
from lingloom.functions.completeness import with_completeness
from lingloom.functions.responses import batch_items


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [("",)], list(values) or ["_"]).select(column.alias("x")).first()["x"]


def test_numbers_keep_ascii_boundaries(spark):
    assert one(spark, T.numbers(F.col("t")), t="é12 x12é 7.5 12 a3 4b 5.x") == ["12", "7.5", "12", "5"]


def test_trim_takes_every_kind_of_space(spark):
    assert one(spark, T.trimmed(F.col("t")), t=" 　 a b ﻿") == "a b"
    assert one(spark, T.plain_text(F.col("t")), t=" <b>a</b>\n\t b<br/> ") == "a b"
    assert one(spark, T.plain_result(F.col("t")), t=" <b>a</b>\n\t b<br/> ") == "a\n\t b"


def test_formats_escapes_and_hints(spark):
    got = [one(spark, T.classify_format(F.col("p")), p=p) for p in ("A.DOCX", "a/b.c.xliff", "x.mqxliff", "x.xml", "x.pdf", "x")]
    assert got == ["docx", "xliff", "mqxliff", "mqxliff", None, None]
    assert one(spark, T.xml_escape(F.col("t")), t="a&<b>\"'") == "a&amp;&lt;b&gt;&quot;&apos;"
    assert one(spark, T.xml_unescape(F.col("t")), t="&amp;lt; &lt;") == "&lt; <"
    assert one(spark, T.xml_unescape(F.col("t")), t="&#65;&#x1F600;&#xe9;&amp;#66; &#0; &#xD800; &#; &#1114112;") == "A\U0001f600é&#66; &#0; &#xD800; &#; &#1114112;"
    assert one(spark, T.only_markup(F.col("t")), t="a<![CDATA[<b>&<!-- ]]>c<![CDATA[]]><!-- <![CDATA[ -->d<?p <x> ?>") == "a&lt;b&gt;&amp;&lt;!-- cd"
    left, found = T.taken_out(F.col("t"))
    assert one(spark, F.struct(left, T.put_back(left, found)), t="a<!-- b -->c<![CDATA[d]]>") == ("a\x010\x02c\x011\x02", "a<!-- b -->c<![CDATA[d]]>")
    assert one(spark, T.retry_after_ms(F.col("t")), t="Please try again in 1.2s.") == 2200
    assert one(spark, T.retry_after_ms(F.col("t")), t="try again in 100s") == 65000
    assert one(spark, T.backoff_ms(F.col("n")), n=9) == 30000
    assert one(spark, T.is_retryable(F.col("t")), t="Error 503") is True
    assert one(spark, T.half_up(F.col("n")), n=2.5) == 3
    assert one(spark, T.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2


def test_tags_are_numbered_in_text_order(spark):
    text = 'On <bpt id="7" i="4">&lt;i&gt;</bpt>harbour<ept id="8" i="4"/> at <ph id="9">low tide</ph> or <phrase>'
    r = P.protect_tags(spark.createDataFrame([(text,)], ["t"]), "t").first()
    assert [t["token"] for t in r["tag_tokens"]] == ["__TAG_1__", "__TAG_2__", "__TAG_3__", "__TAG_4__"]
    assert r["protected_text"] == "On __TAG_1__harbour__TAG_2__ at __TAG_3__ or __TAG_4__"
    greedy = P.protect_tags(spark.createDataFrame([('a<g id="5">b<ph id="6">two oars</ph>c</g>d',)], ["t"]), "t").first()
    assert [t["original"] for t in greedy["tag_tokens"]] == ['<g id="5">', '<ph id="6">two oars</ph>c</g>']


def test_entities_are_numbered_by_pass(spark):
    text = "Mail boats@quay.test, see https://quay.test/tides or ftp://f.org/x; NCT00000042, LOG-7-OAK-19."
    r = P.protect_entities(spark.createDataFrame([(text,)], ["t"]), "t").first()
    assert [t["original"] for t in r["entity_tokens"]] == ["https://quay.test/tides", "ftp://f.org/x;", "boats@quay.test", "NCT00000042", "LOG-7-OAK-19"]
    assert r["protected_text"].startswith("Mail __ENTITY_3__, see __ENTITY_1__ or __ENTITY_2__ __ENTITY_4__")
    edge = P.protect_entities(spark.createDataFrame([(" +x@y.org ",)], ["t"]), "t").first()
    assert [t["original"] for t in edge["entity_tokens"]] == ["x@y.org"]
    assert [n for n, _ in P.custom_patterns({"own": "X+"}, urls=False)] == ["email", "own"]


def test_restore_reports_lost_and_doubled_tokens(spark):
    df = P.protect_tags(spark.createDataFrame([("a<x/>b<bx/>c<ex/>",)], ["t"]), "t").withColumn("entity_tokens", F.array().cast(P.EMPTY_TOKENS))
    bad = P.restore_all(df.withColumn("y", F.lit("__TAG_2__ __TAG_2__ __TAG_3__")), "y").first()
    assert bad["restore_error"] == "Missing tokens: __TAG_1__; Duplicated tokens: __TAG_2__" and bad["restored"] == "__TAG_2__ __TAG_2__ __TAG_3__"
    good = P.restore_all(df.withColumn("y", F.lit("__TAG_3__$&__TAG_1__ __TAG_2__")), "y").first()
    assert good["restore_error"] is None and good["restored"] == "<ex/>$&<x/> <bx/>"
    none = P.restore_all(df.withColumn("tag_tokens", F.array().cast(P.EMPTY_TOKENS)).withColumn("y", F.lit("__TAG_9__")), "y").first()
    assert none["restore_error"] is None and none["restored"] == "__TAG_9__"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='<>/ abpht="x_NCT1234567890@.-:\n', max_size=60), min_size=1, max_size=20))
def test_protection_round_trips(spark, texts):
    rows = P.restore_all(P.protect(spark.createDataFrame([(t,) for t in texts], ["t"]), "t"), "protected_text").select("t", "restored", "restore_error").collect()
    for r in rows:
        assert r["restore_error"] is not None or r["restored"] == r["t"]


CASES = [
    ("நோயாளி இந்த ஆவணத்தை கவனமாக படிக்க வேண்டும்", "रोगी को यह दस्तावेज़ ध्यान से पढ़ना चाहिए", "ta", "hi", "valid"),
    ("நோயாளி இந்த ஆவணத்தை கவனமாக படிக்க வேண்டும்", "நோயாளி இந்த ஆவணத்தை கவனமாக படிக்க வேண்டும்", "ta", "hi", "failed"),
    ("रोगी को यह दस्तावेज़ पढ़ना चाहिए", "रोगी को यह दस्तावेज़ पढ़ना चाहिए", "hi", "ta", "failed"),
    ("The patient should read this document", "The patient should read this document", "en", "hi", "failed"),
    ("Participation is __TAG_1__ voluntary", "भागीदारी __TAG_1__ स्वैच्छिक है", "en", "hi", "valid"),
    ("रोगी को यह दस्तावेज़ पढ़ना चाहिए", "रुग्णाने हा दस्तऐवज वाचावा", "hi", "mr", "valid"),
    ("one word here", "", "en", "fr", "failed"),
    ("A1", "", "en", "fr", "valid"),
    ("some longer text", "Unfortunately, there is no text", "en", "fr", "failed"),
    ("alpha beta gamma delta", "alpha beta zeta teta", "en", "fr", "warning"),
    (None, None, None, None, "valid"),
]


def test_completeness_cascade(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, s string, t string, sl string, tl string, want string")
    for r in with_completeness(df, "s", "t", "sl", "tl").collect():
        assert r["completeness"]["status"] == r["want"], r


def test_replies_in_every_wrapping(spark):
    item = '[{"id": "1", "translation": "x"}]'
    for key in ("translations", "segments", "items", "data", "results"):
        assert one(spark, batch_items(F.col("t")), t='```json\n{"%s": %s}\n```' % (key, item))[0]["translation"] == "x"
    assert one(spark, batch_items(F.col("t")), t=item)[0]["id"] == "1"
    assert one(spark, batch_items(F.col("t")), t='{"translations": "no", "data": %s}' % item)[0]["id"] == "1"
    for broken in ("", "sorry", '{"other": []}', '{"translations": ['):
        assert not one(spark, batch_items(F.col("t")), t=broken)


def test_shared_words_and_trims_against_plain_python(spark):
    from lingloom.functions.completeness import script_count, with_completeness
    from lingloom.functions.text import WS_CHARS, right_trimmed, trimmed

    texts = ["alpha beta gamma alpha", "alpha alpha alpha", "one", "", "delta 　 gamma\tbeta  beta", "words words other thing again again", "\xa0  mixed हिन्दी text﻿"]
    pairs = [(s, t) for s in texts for t in texts]
    df = with_completeness(spark.createDataFrame([(*p, "fr", "en") for p in pairs], "s string, t string, sl string, tl string"), "s", "t", "sl", "tl")
    for r in df.collect():
        s, t = ("".join(c if c.isalpha() else " " for c in x) for x in (r.s, r.t))
        sw = [w for w in s.split() if len(w) >= 4]
        hit = sum(w in t.split() for w in sw) / max(len(sw), 1)
        if not t.strip() or len(sw) < 3:
            continue
        assert (r.completeness.status == "failed") == (hit >= 0.70) and (r.completeness.status == "warning") == (0.45 <= hit < 0.70), (r, hit)
    rows = spark.createDataFrame([(t, "hi") for t in [*texts, None]], "t string, l string")
    got = rows.select("t", trimmed(F.col("t")).alias("a"), right_trimmed(F.col("t")).alias("b"), script_count(F.col("t"), F.col("l")).alias("n")).collect()
    for r in got:
        if r.t is None:
            assert (r.a, r.b, r.n) == (None, None, None)
        else:
            assert (r.a, r.b, r.n) == (r.t.strip(WS_CHARS), r.t.rstrip(WS_CHARS), sum("ऀ" <= c <= "ॿ" for c in r.t))
