import json

from pyspark.sql import functions as F

from lingloom.operators import dimensions, metrics, segments, validate
from lingloom.plans import inference
from lingloom.plans.prompts import prompt_table, system_prompt
from lingloom.sources.tables import GLOSSARY, default_glossary, domains, languages, synthetic_segments, with_user_terms

SEG = "doc_id string, segment_id string, seg_index int, source_raw string, source_text string, target_text string, source_lang string, target_lang string"


def test_context_is_cut_at_the_edges(spark):
    df = spark.createDataFrame([("d", 0, "x" * 98 + "  y"), ("d", 1, "mid"), ("d", 2, "end")], "doc_id string, seg_index int, source_text string")
    rows = segments.with_context(df, 100).orderBy("seg_index").collect()
    assert rows[0].previous_text == "" and rows[1].previous_text == "x" * 98 + "..." and rows[1].next_text == "end" and rows[2].next_text == ""


def test_dimension_tables(spark):
    assert languages(spark).count() == 12 and default_glossary(spark).count() == 14 and domains(spark).count() == 1
    assert with_user_terms(default_glossary(spark), [GLOSSARY[0]]).count() == 15
    assert synthetic_segments(spark, 25).count() == 25
    names = spark.createDataFrame([("Tides.docx", "ta"), ("Log.of.June.docx", "gu"), ("Map.xliff", "zz"), ("Bare", "hi")], "f string, l string")
    assert {r.output_name for r in dimensions.output_name(names, "f", "l", languages(spark)).collect()} == {"Tides_tamil.docx", "Log.of.June_gujarati.docx", "Map_zz.xliff", "Bare_hindi"}
    pairs = spark.createDataFrame([("en", "hi"), ("EN", "hi")], "source_lang string, target_lang string")
    assert dimensions.glossary_for(pairs, default_glossary(spark), "legal").count() == 3 and dimensions.glossary_for(pairs, default_glossary(spark), "").count() == 8


def test_prompts(spark):
    p = system_prompt("ta", "hi", "batch", terms=(("a", "b", "n"),), retry=True)
    assert "Tamil (ta)" in p and "हिन्दी" in p and '- "a" -> "b" (n)' in p and "RETRY" in p and "translations" in p
    assert "script (" not in system_prompt("hi", "en") and prompt_table(spark, [("en", "hi"), ("ur", "ta")], GLOSSARY).count() == 8


def _segments(spark, n):
    return spark.createDataFrame([("d", f"s{k}", k, f"word{k} here https://e.org/{k}", f"word{k} here https://e.org/{k}", None, "en", "en") for k in range(n)] + [("d", "blank", n, " ", " ", "kept", "en", "en")], SEG)


def test_translation_rounds(spark):
    def fn(system, user, json_mode):
        if json_mode:
            items = json.loads(user)
            if items[0]["id"] == "s10":
                return "no json"
            out = [{"id": x["id"], "translation": x["sourceText"].upper().replace("__ENTITY_1__", "" if x["id"] == "s3" else "__ENTITY_1__")} for x in items if x["id"] != "s1"]
            return "```json\n" + json.dumps({"items": out}) + "\n```"
        now = user.split("CURRENT SEGMENT (translate this):\n")[1].split("\n")[0]
        if now.startswith("word12") and "RETRY" not in system:
            return ""
        if now.startswith("word13"):
            raise ValueError("401 unauthorized")
        return now.upper()

    results, log = inference.translate(_segments(spark, 15), fn)
    rows = {r.segment_id: r for r in results.collect()}
    assert len(rows) == 16 and rows["blank"].translated_text == "kept" and rows["blank"].validation_warnings == ["Source text was empty"]
    for k in range(15):
        r = rows[f"s{k}"]
        if k == 13:
            assert r.status == "failed" and "401" in r.error_message
        else:
            assert r.status == "completed" and r.translated_text == f"WORD{k} HERE https://e.org/{k}", r
    calls = log.groupBy("round").count().orderBy("round").collect()
    assert [(c["round"], c["count"]) for c in calls] == [(0, 2), (1, 7), (2, 2)]


def test_failures_are_tried_again_by_their_message():
    assert inference.pause_before("400 bad request", 0) is None and inference.pause_before("took 4290 ms", 0) is None
    assert inference.pause_before("503 overloaded, took 4012 ms", 1) == 2.0 and inference.pause_before("Rate limit: try again in 1.25s", 0) == 2.25
    assert inference.pause_before("quota, retry after 900 s", 0) == 65.0 and inference.pause_before("timeout", 9) == 30.0


def test_retries_wait_by_the_hint(spark):
    def fn(system, user, json_mode):
        raise ValueError({"a": "400 bad request", "b": "503 overloaded, took 4012 ms", "c": "429, try again in 0.5 s"}[user])

    rows = spark.createDataFrame([(x, "s", x, False) for x in "abc"], "k string, system string, prompt string, json_mode boolean")
    got = {r.k: r for r in inference.infer(rows, fn, retries=2, pause=lambda s: None).collect()}
    assert {k: r.retry_count for k, r in got.items()} == {"a": 0, "b": 2, "c": 2} and got["a"].error == "400 bad request"


def test_no_task_waits_and_a_hint_holds_back_its_provider(spark):
    made = spark.sparkContext.accumulator(0)

    def hinting(system, user, json_mode, model=None):
        made.add(1)
        raise ValueError("429, try again in 9 s")

    fine = lambda s, u, j, model=None: f"{u} {model}"
    rows = spark.createDataFrame([(p, m, "s", f"{k}", False) for p in ("slow", "fine") for k, m in enumerate(["m", None] * 10)], "provider string, model string, system string, prompt string, json_mode boolean").coalesce(1)
    waits = []
    got = inference.infer(rows, {"slow": hinting, "fine": fine}, retries=1, pause=waits.append).collect()
    assert len(got) == 40 and {r.reply for r in got if r.provider == "fine"} == {f"{k} {'m' if k % 2 == 0 else None}" for k in range(20)}
    assert {r.error for r in got if r.provider == "slow"} == {"429, try again in 9 s"}
    # each round calls the held provider until its first hint, and one task's rows wait for it together
    assert made.value <= 40 and all(8 < w <= 11 for w in waits) and len(waits) >= 20


def test_a_budget_of_calls_is_kept_in_each_round(spark):
    waits = []
    rows = spark.createDataFrame([(f"{k}", "s", f"{k}", False) for k in range(50)], "k string, system string, prompt string, json_mode boolean").coalesce(1)
    got = inference.infer(rows, lambda s, u, j: u, parallel=2, calls_per_interval=20, interval=30.0, pause=waits.append).collect()
    assert sorted(r.reply for r in got) == sorted(r.k for r in got) and len(got) == 50
    assert 2 <= len(waits) <= 4 and all(25 < w <= 30 for w in waits)


def test_prompts_hold_rules_profile_and_model(spark):
    from lingloom.sources.tables import DOMAIN, languages

    def fn(system, user, json_mode, model=None):
        ok = model == "big" and DOMAIN[2] in system and ("Use the formal address." in system) == ("Hindi" in system)
        letters = "".join(chr((0x915 if "Hindi" in system else 0xA95) + k) for k in range(9))
        return json.dumps([{"id": x["id"], "translation": f"{letters} {ok}"} for x in json.loads(user)])

    rows = [("d", f"s{k}", k, f"word{k} text", f"word{k} text", None, "en", "hi" if k % 2 else "gu") for k in range(4)]
    results, _ = inference.translate(spark.createDataFrame(rows, SEG), fn, languages=languages(spark, {"hi": ["Use the formal address."]}), profile=DOMAIN[2], model="big", attempts=0)
    assert [r.translated_text.split()[-1] for r in results.collect()] == ["True"] * 4


def test_prompts_go_by_pair_with_its_terms(spark):
    rows = [("d", f"s{k}", k, f"word{k} text", f"word{k} text", None, "en", "hi" if k % 2 else "gu") for k in range(12)]
    glossary = spark.createDataFrame([("word", "en", "hi", "H-TERM", "legal", None), ("word", "en", "gu", "G-TERM", None, "n"), ("other", "en", "hi", "M-TERM", "medical", None)], "source_term string, source_lang string, target_lang string, preferred_translation string, domain string, note string")

    def fn(system, user, json_mode):
        own = "H-TERM" if "H-TERM" in system else "G-TERM" if "G-TERM" in system else "none"
        if "M-TERM" in system or (own == "H-TERM") != ("Hindi" in system):
            own = "wrong"
        letters = "".join(chr((0x915 if own == "H-TERM" else 0xA95) + k) for k in range(9))
        return json.dumps([{"id": x["id"], "translation": f"{own} {letters}"} for x in json.loads(user)])

    seen = []
    results, log = inference.translate(spark.createDataFrame(rows, SEG), fn, glossary=glossary, domain="legal", on_round=lambda *x: seen.append(x))
    got = {r.segment_id: r.translated_text.split()[0] for r in results.collect()}
    assert got == {f"s{k}": "H-TERM" if k % 2 else "G-TERM" for k in range(12)} and seen == [(0, 12, 0)]
    assert log.count() == 4  # two pairs, two batches of ten numbers each


def test_a_failed_batch_fails_as_a_whole(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(system, user, json_mode):
        calls.add(1)
        if json_mode and "s0" in user:
            raise ValueError("401 unauthorized")
        return json.dumps([{"id": x["id"], "translation": x["sourceText"].upper()} for x in json.loads(user)]) if json_mode else user

    seen = []
    results, log = inference.translate(_segments(spark, 12), fn, on_error="batch", on_round=lambda *x: seen.append(x))
    assert seen[0] == (0, 2, 10)
    rows = {r.segment_id: r for r in results.collect()}
    assert [rows[f"s{k}"].status for k in range(12)] == ["failed"] * 10 + ["completed"] * 2 and rows["s3"].error_message == "401 unauthorized"
    assert len(rows) == 13 and log.count() == 2 and calls.value == 2


def test_two_providers(spark):
    fn = lambda s, u, j: json.dumps([{"id": x["id"], "translation": x["sourceText"]} for x in json.loads(u)]) if j else u
    bad = lambda s, u, j: (_ for _ in ()).throw(ValueError("403"))
    results, log = inference.benchmark(_segments(spark, 3), {"good": fn, "bad": bad})
    summary = metrics.provider_summary(log.withColumn("provider", F.col("provider")), results)
    verdict = metrics.provider_verdict(summary).first()
    assert verdict.most_reliable_provider == "good" and {r.provider: r.failed for r in summary.collect()} == {"good": 0, "bad": 3}


def test_report_and_gate(spark):
    segs = spark.createDataFrame([("d", "a", 0, "text 5", "en", "fr"), ("d", "b", 1, "more", "en", "fr"), ("e", "a", 0, "x", "en", "fr")], "doc_id string, segment_id string, seg_index int, source_text string, source_lang string, target_lang string")
    res = spark.createDataFrame([("d", "a", 0, "texte", "texte __TAG_1__", "completed", None, ["own", "own"]), ("d", "zz", 9, "o", "o __ENTITY_1__", "completed", None, None), ("e", "a", 0, "", "", "failed", "model m not found", None)], "doc_id string, segment_id string, seg_index int, translated_text string, translated_raw string, status string, error_message string, validation_warnings array<string>")
    rep = {r.doc_id: r for r in validate.validation_report(segs, res).collect()}
    assert not rep["d"].valid and rep["d"].segment_count_match and not rep["d"].all_segments_present and rep["d"].failed_segments == 3
    assert rep["d"].warnings == ['Segment a: number "5" from source not found in translation', "Segment a: own"]
    gates = {r.doc_id: r for r in validate.gate_outputs(res, validate.issues_of(segs, res)).collect()}
    assert gates["d"].gate == "placeholders" and gates["d"].protected_issues == 2
    assert gates["e"].gate == "nothing_completed" and gates["e"].root_cause == "model m not found" and gates["e"].hint == "model_config"


def test_batch_equals_stream(spark):
    from lingloom.functions.completeness import with_completeness
    from lingloom.functions.protect import protect
    from lingloom.plans import queries_checks, views

    d = "/root/testdata/sf0.001"
    streamed = {tuple(r) for r in queries_checks.r2_stream_validate(spark, d).collect()}
    batch = with_completeness(protect(views.pair(spark, d), "source_text"), "source_text", "target_text", "source_lang", "target_lang")
    assert streamed == {tuple(r) for r in batch.select("doc_id", "segment_id", "protected_text", "completeness.status").collect()}
