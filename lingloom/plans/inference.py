"""Translation through a pluggable callable: a batch round, then single rounds for what a round left open.

Each round is written to the checkpoint folder before the next one reads it, so a lost executor or a re-plan never
calls the function again for rows that have an answer.
"""

from __future__ import annotations

import json
import math
import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.completeness import with_completeness
from ..functions.protect import ENTITY_PATTERNS, protect, restore_all
from ..functions.responses import batch_items, user_prompt
from ..functions.text import RETRY_HINT, RETRYABLE, plain_result
from ..operators.dimensions import glossary_for
from ..operators.segments import pack_batches, split_blank, with_batch_no, with_context
from ..sources.tables import shared_folder
from .prompts import system_prompt

#: fn(system, user, json_mode) -> text; with a model asked for, fn(system, user, json_mode, model=...)
Infer = Callable[..., str]
#: What is worth another try, its codes as numbers of their own.
_AGAIN = re.compile("|".join(rf"(?<![0-9]){x}(?![0-9])" if x.isdigit() else x for x in RETRYABLE.split("|")))
_HINT = re.compile(RETRY_HINT)


def pause_before(message: str, attempt: int) -> float | None:
    """Seconds to wait before trying again after a failure: by its hint, else growing; None if another try is useless."""
    message = message.lower()
    if not _AGAIN.search(message):
        return None
    hint = _HINT.search(message)
    return min((math.ceil(float(hint[1]) * 1000) + 1000) / 1000, 65.0) if hint else min(2.0**attempt, 30.0)


def saved(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _called(requests: DataFrame, fns: dict[str | None, Infer], retries: int, calls: int | None, interval: float) -> DataFrame:
    """requests with one more call for each row at most: reply or error, and for what may be tried again not_before, in seconds
    since 1970. Nothing waits here: after a failure with a time to wait for, the rest of the task's rows of that provider
    are put off until then, and so are rows beyond `calls`, until `interval` seconds later."""
    fields = {f.name: f for f in requests.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        left: dict = {}
        for pdf in batches:
            rows = []
            models = pdf["model"] if "model" in fields else [None] * len(pdf)
            providers = pdf["provider"] if "provider" in fields else [None] * len(pdf)
            for system, prompt, js, provider, model, tries, spent in zip(pdf["system"], pdf["prompt"], pdf["json_mode"], providers, models, pdf["retry_count"], pdf["latency_ms"]):
                if provider not in held and calls is not None and left.setdefault(provider, calls) == 0:
                    held[provider] = time.time() + interval
                if provider in held:
                    rows.append((None, None, tries, spent, held[provider]))
                    continue
                left[provider] = left.get(provider, 0) - 1
                reply, error, again, began = None, None, None, time.monotonic()
                try:
                    more = {} if model is None or pd.isna(model) else {"model": model}
                    reply = fns[provider](system, prompt, bool(js), **more)
                except Exception as e:  # noqa: BLE001  a caller's function may raise anything; it becomes the row's error
                    error = str(e) or type(e).__name__
                    seconds = pause_before(error, tries) if tries < retries else None
                    if seconds is not None:
                        again = time.time() + seconds
                        if _HINT.search(error.lower()):
                            held[provider] = again
                rows.append((reply, error, tries + (again is not None), spent + int(1000 * (time.monotonic() - began)), again))
            yield pdf.assign(**{c: [r[k] for r in rows] for k, c in enumerate(("reply", "error", "retry_count", "latency_ms", "not_before"))})

    return requests.mapInPandas(run, requests.schema)


def infer(requests: DataFrame, fn: Infer | dict[str, Infer], parallel: int | None = None, retries: int = 2, pause: Callable[[float], None] | None = None, calls_per_interval: int | None = None, interval: float = 60.0) -> DataFrame:
    """requests(..., system, prompt, json_mode[, provider, model]) with reply, error, retry_count and latency_ms; a failure is a value.

    fn runs in the tasks, `parallel` of them at once: one function, or one for each provider; a model goes to it as a
    keyword. Rounds: each calls for what is open once and saves what came of it, so no answer is asked for twice, and no task
    waits. Before the next round the driver waits until the time that failures name, or a growing one, is over. A
    failure that names a time puts off the other rows of its provider as well. With calls_per_interval, no provider gets
    more calls than that in a round, shared evenly over the tasks, and rows left over come `interval` seconds later.
    """
    wait = pause or time.sleep
    fns = fn if isinstance(fn, dict) else defaultdict(_Same(fn))
    names = requests.columns
    none = F.lit(None)
    open_ = requests.withColumns({"reply": none.cast("string"), "error": none.cast("string"), "retry_count": F.lit(0), "latency_ms": F.lit(0).cast("long"), "not_before": none.cast("double")})
    tasks = parallel or (int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")) if calls_per_interval else None)
    calls = max(1, calls_per_interval // tasks) if calls_per_interval else None
    done = []
    while True:
        if tasks:
            open_ = open_.repartition(tasks)
        state = saved(_called(open_, fns, retries, calls, interval))
        done.append(state.where("not_before is null"))
        left = state.agg(F.count("not_before"), F.max("not_before")).first()
        if not left[0]:
            break
        wait(max(0.0, left[1] - time.time()))
        open_ = state.where("not_before is not null").withColumns({"error": none.cast("string"), "not_before": none.cast("double")})
    return reduce(DataFrame.unionByName, done).select(*names, "reply", "error", "retry_count", "latency_ms")


class _Same:
    """The one function for any provider."""

    def __init__(self, fn: Infer):
        self.fn = fn

    def __call__(self) -> Infer:
        return self.fn


def match_responses(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows left-joined with items(doc_id, id, translation) by segment; of a repeated id the last item counts."""
    last = items.groupBy("doc_id", "id").agg(F.max_by("translation", "item_pos").alias("translation"))
    return rows.join(last.withColumnRenamed("id", "segment_id"), ["doc_id", "segment_id"], "left")


def _settled(rows: DataFrame) -> DataFrame:
    """rows with translation to results: restored, checked, and `open` where another try may help."""
    out = restore_all(rows.withColumn("translation", F.coalesce("translation", F.lit(""))), "translation", "translated_raw")
    out = out.withColumn("translated_text", plain_result(F.col("translated_raw")))
    out = with_completeness(out, "source_text", "translated_text", "source_lang", "target_lang")
    bad = F.when(F.col("translation") == "", F.coalesce("call_error", F.lit("Empty translation"))).when(F.col("restore_error").isNotNull(), F.col("restore_error")).when(F.col("completeness.status") == "failed", F.col("completeness.reason"))
    warnings = F.when(F.col("completeness.status") == "warning", F.array("completeness.reason")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"error_message": bad, "status": F.when(bad.isNull(), "completed").otherwise("failed"), "validation_warnings": warnings})


RESULT = ["doc_id", "segment_id", "seg_index", "translated_text", "translated_raw", "status", "error_message", "validation_warnings"]


def translate(segments: DataFrame, fn: Infer | dict[str, Infer], batch_size: int = 10, max_context: int = 500, attempts: int = 2, patterns: list = ENTITY_PATTERNS, tags: str | None = None, terms: tuple = (), parallel: int | None = None, glossary: DataFrame | None = None, domain: str = "", on_error: str = "segment", on_round: Callable[[int, int, int], None] | None = None, languages: DataFrame | None = None, profile: str = "", model: str | None = None, span: int | None = None, **calls) -> tuple[DataFrame, DataFrame]:
    """(results, call_log) of segments(doc_id, segment_id, seg_index, source_raw, source_text, target_text, source_lang, target_lang).

    Round 0 sends batches. A reply that is no list leaves its whole batch open, one that is leaves what is missing,
    lost placeholders or is incomplete. Rounds 1..attempts send open segments singly, from the second on with a retry
    notice. What is open in the end has failed, each segment for itself. Blank sources are done without a call.

    Prompts are made for each language pair: with its terms of `glossary` that fit `domain`, and `terms` for all. A
    batch holds segments of one document and pair. With on_error='batch' a batch whose call failed has failed as a whole.
    on_round(round, completed, failed) is told of each round's end. The rules of a pair's target in languages(code, rules) and
    `profile`, what to know of the domain, are parts of its prompts. `model` goes to fn with every call. span cuts
    documents that are too long for a task into ranges of as many segments. Other options are those of infer.

    With functions by provider all of them get the same protected segments in the same rounds, and results and calls have a
    provider column.
    """

    def tell(attempt: int, state: DataFrame) -> None:
        if on_round is not None:
            n = {r["status"]: r["n"] for r in state.groupBy("status").agg(F.count("*").alias("n")).collect()}
            on_round(attempt, n.get("completed", 0), n.get("failed", 0))

    rows = protect(with_batch_no(with_context(segments, max_context, span=span), batch_size, span=span), "source_raw", patterns, tags)
    todo, blank = split_blank(rows)
    prompt = F.udf(lambda s, t, mode, retry, own, rules: system_prompt(s or "", t or "", mode, rules=tuple(rules or ()), terms=(*terms, *map(tuple, own or ())), retry=retry, profile=profile), "string")
    keys = [F.col("doc_id")]
    if isinstance(fn, dict):
        todo = saved(todo)  # protected once
        each = F.explode(F.array(*map(F.lit, sorted(fn))))
        todo, blank = (x.withColumn("_p", each).withColumn("doc_id", F.struct(F.col("_p").alias("provider"), "doc_id")).drop("_p") for x in (todo, blank))
        keys = [F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.provider").alias("provider")]
    to = {"provider": F.col("doc_id.provider") if isinstance(fn, dict) else F.lit(None).cast("string"), "model": F.lit(model).cast("string")}
    todo = saved(todo.withColumn("pair", F.struct(F.coalesce("source_lang", F.lit("")).alias("s"), F.coalesce("target_lang", F.lit("")).alias("t"))).withColumn("batch_key", F.struct("doc_id", "pair")))
    pairs = todo.select("pair", F.col("pair.s").alias("source_lang"), F.col("pair.t").alias("target_lang")).distinct()
    if glossary is not None:
        own = glossary_for(pairs, glossary, domain).groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("source_term", "preferred_translation", "note"))).alias("own"))
        pairs = pairs.join(own, "pair", "left")
    else:
        pairs = pairs.withColumn("own", F.lit(None).cast("array<struct<a:string,b:string,c:string>>"))
    if languages is not None:
        pairs = pairs.join(F.broadcast(languages.select(F.col("code").alias("target_lang"), "rules")), "target_lang", "left")
    else:
        pairs = pairs.withColumn("rules", F.lit(None).cast("array<string>"))
    pairs = saved(pairs)  # a row for each pair of languages
    system = lambda mode, retry: F.broadcast(pairs.select("pair", prompt("source_lang", "target_lang", F.lit(mode), F.lit(retry), "own", "rules").alias("system")))
    batches = pack_batches(todo, batch_size, "batch_key").select("batch_key.doc_id", "batch_key.pair", "batch_no", "items_json").join(system("batch", False), "pair")
    answered = infer(batches.select("doc_id", "pair", "batch_no", "system", F.col("items_json").alias("prompt"), F.lit(True).alias("json_mode")).withColumns(to), fn, parallel, **calls)
    log = [answered.select("doc_id", "batch_no", F.lit(0).alias("round"), "latency_ms", "retry_count", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"))]
    items = answered.select("doc_id", F.posexplode_outer(batch_items(F.col("reply"))).alias("item_pos", "i")).where("i.id is not null").select("doc_id", "item_pos", "i.id", "i.translation")
    errors = answered.select("doc_id", "pair", "batch_no", F.col("error").alias("call_error"))
    state = saved(_settled(match_responses(todo, items).join(errors, ["doc_id", "pair", "batch_no"], "left")).select("call_error", *todo.columns, *[c for c in RESULT if c not in todo.columns]))
    done = [state.where("status = 'completed'").select(*RESULT)]
    tell(0, state)
    if on_error == "batch":
        done.append(state.where("status = 'failed' and call_error is not null").select(*RESULT))
        state = state.where("call_error is null")
    for attempt in range(1, attempts + 1):
        left = state.where("status = 'failed'").select(*todo.columns)
        if not left.limit(1).count():
            break
        asked = left.join(system("single", attempt > 1), "pair").withColumn("prompt", user_prompt(F.col("previous_text"), F.col("protected_text"), F.col("next_text"))).withColumn("json_mode", F.lit(False))
        reply = infer(asked.withColumns(to), fn, parallel, **calls)
        log.append(reply.select("doc_id", "batch_no", F.lit(attempt).alias("round"), "latency_ms", "retry_count", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status")))
        state = saved(_settled(reply.withColumnsRenamed({"reply": "translation", "error": "call_error"})).select(*todo.columns, *[c for c in RESULT if c not in todo.columns]))
        done.append(state.where("status = 'completed'").select(*RESULT))
        tell(attempt, state)
    done.append(state.where("status = 'failed'").select(*RESULT))
    finished = blank.withColumns({"translated_raw": F.col("translated_text"), "error_message": F.lit(None).cast("string")}).select(*RESULT)
    results, asked_for = finished, log[0]
    for d in done:
        results = results.unionByName(d)
    for d in log[1:]:
        asked_for = asked_for.unionByName(d)
    shown = lambda df: df.select(*keys, *[c for c in df.columns if c != "doc_id"])
    return shown(results), shown(asked_for)


def benchmark(segments: DataFrame, providers: dict[str, Infer], **options) -> tuple[DataFrame, DataFrame]:
    """(results, call_log) of the same segments through each provider, with a provider column: one plan for all of them."""
    return translate(segments, providers, **options)

def items_of(user: str) -> list[dict]:
    """What a provider gets in a batch: for callables in tests and examples."""
    return json.loads(user)
