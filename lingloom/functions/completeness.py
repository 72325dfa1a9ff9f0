"""Whether a target looks like a full translation of its source: one lazily evaluated cascade of column expressions."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NUMBER, SCRIPT_RANGES, WS, half_up, trimmed

#: Openings of a reply that talks about the task instead of doing it.
CONVERSATIONAL = r"(?i)^(unfortunately|there is no text|here is the translation|i cannot translate|as an ai|note:)"
#: The reasons' texts.
EMPTY_OUTPUT = "Empty target output after stripping placeholders"
COMMENTARY = "LLM returned conversational commentary instead of translation"
SOURCE_SCRIPT = ("Untranslated source script (", ") detected in target (", ") output")
NO_TARGET_SCRIPT = "Target translation missing expected script characters for "
MOSTLY_SOURCE = ("Substantial source text (", "%) left untranslated")
PARTLY_SOURCE = ("Possible untranslated source words (", "%) detected")
#: What is taken out before numbers, each with a cheap test that most texts fail.
_STRIPPED = [
    ("__TAG_[0-9]+__", lambda x: F.contains(x, F.lit("__TAG_"))),
    ("__ENTITY_[0-9]+__", lambda x: F.contains(x, F.lit("__ENTITY_"))),
    (rf"https?://[^{WS}]+|www\.[^{WS}]+", lambda x: F.contains(x, F.lit("://")) | F.contains(x, F.lit("www."))),
    (rf"[^{WS}]+@[^{WS}]+\.[^{WS}]+", lambda x: F.contains(x, F.lit("@"))),
]


def once(c: Column, f) -> Column:
    """f of an expression that is evaluated once, however often f refers to it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def _without(pattern: str, may, x: Column) -> Column:
    return F.when(may(x), F.regexp_replace(x, pattern, "")).otherwise(x)


def cleaned(c: Column) -> Column:
    """Letters and white space of a text: placeholders, URLs, e-mails and numbers taken out, other signs blanked.

    Each pattern reads what the ones before it left, as taking one out may join the pieces of another. A text without
    the marks of the first four, as most are, goes by compiled code through the last pattern only.
    """
    special = reduce(Column.__or__, (may(c) for _, may in _STRIPPED))
    stepwise = c
    for pattern, may in _STRIPPED:
        stepwise = once(stepwise, partial(_without, pattern, may))
    rest = F.when(special, stepwise).otherwise(c)
    return trimmed(F.regexp_replace(F.regexp_replace(rest, NUMBER, ""), rf"[[^A-Za-z ]&&[^\p{{L}}{WS}]]", " "))


def script_count(text: Column, lang: Column) -> Column:
    """Letters of text in the script of lang; null for a language without a range."""
    out = None
    for code, letters in SCRIPT_RANGES.items():
        hit = F.lower(lang) == code
        count = F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]+", ""))
        out = F.when(hit, count) if out is None else out.when(hit, count)
    return out


def script_of(lang: Column) -> Column:
    out = None
    for code, letters in SCRIPT_RANGES.items():
        out = (F.when if out is None else out.when)(F.lower(lang) == code, F.lit(letters))
    return out


def _hits(common: Column, lost: Column, words: Column) -> Column:
    """How many of words, repeats counted, are common, where each is common or lost: by arithmetic where none repeats or
    one list is empty, else by a look into the shorter list."""
    n, c, m = F.size(words), F.size(common), F.size(lost)
    in_common = F.size(F.filter(words, lambda w: F.array_contains(common, w)))
    in_lost = F.size(F.filter(words, lambda w: F.array_contains(lost, w)))
    return F.when((c + m == n) | (c == 0), c).when(m == 0, n).when(c <= m, in_common).otherwise(n - in_lost)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: what generates a row is not inlined where filters above refer to it."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", one.alias("_held")).select(*[F.col(c) for c in df.columns], *[F.col("_held")[n].alias(n) for n in columns])


def with_completeness(df: DataFrame, source: str, target: str, source_lang: str, target_lang: str, out: str = "completeness") -> DataFrame:
    """df with `out` struct<status, reason>: valid, warning or failed; the first check that hits decides.

    Cleaned texts and word lists are made once, as columns below the cascade; empty words between two spaces stay in the
    target's list, where no source word of four letters meets them. Source and target scripts are not told
    apart where both languages have the same one.
    """
    df = held(df, _cs=cleaned(F.coalesce(source, F.lit(""))), _ct=cleaned(F.coalesce(target, F.lit(""))))
    words = lambda c: F.split(F.regexp_replace(c, f"[[^ !-~]&&[{WS}]]", " "), " ", -1)
    df = held(df, _sw=F.filter(words(F.col("_cs")), lambda w: F.length(w) >= 4), _tw=words(F.col("_ct")))
    df = held(df, _common=F.array_intersect("_sw", "_tw"), _lost=F.array_except("_sw", "_tw"))
    df = held(df, _hit=_hits(F.col("_common"), F.col("_lost"), F.col("_sw")) / F.greatest(F.size("_sw"), F.lit(1)))
    sl, tl = F.lower(F.col(source_lang)), F.lower(F.col(target_lang))
    differ = F.coalesce(sl != tl, F.lit(False)) & (sl != "") & (tl != "")
    left, there = script_count(F.col("_ct"), sl), script_count(F.col("_ct"), tl)
    same_script = F.coalesce(script_of(sl) == script_of(tl), F.lit(False))
    percent = half_up(F.col("_hit") * 100).cast("string")
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    compared = differ & (F.size("_sw") >= 3)
    cascade = (
        F.when(F.length("_cs") < 3, verdict("valid", none))
        .when(F.col("_ct") == "", verdict("failed", F.lit(EMPTY_OUTPUT)))
        .when(F.col("_ct").rlike(CONVERSATIONAL), verdict("failed", F.lit(COMMENTARY)))
        .when(differ & ~same_script & (sl != "en") & (left > F.greatest(F.lit(3.0), 0.15 * F.length("_ct"))), verdict("failed", F.concat(F.lit(SOURCE_SCRIPT[0]), F.col(source_lang), F.lit(SOURCE_SCRIPT[1]), F.col(target_lang), F.lit(SOURCE_SCRIPT[2]))))
        .when(differ & (tl != "en") & (F.length("_cs") >= 8) & (there == 0), verdict("failed", F.concat(F.lit(NO_TARGET_SCRIPT), F.col(target_lang))))
        .when(compared & (F.col("_hit") >= 0.70), verdict("failed", F.concat(F.lit(MOSTLY_SOURCE[0]), percent, F.lit(MOSTLY_SOURCE[1]))))
        .when(compared & (F.col("_hit") >= 0.45), verdict("warning", F.concat(F.lit(PARTLY_SOURCE[0]), percent, F.lit(PARTLY_SOURCE[1]))))
        .otherwise(verdict("valid", none))
    )
    return df.withColumn(out, cascade).drop("_cs", "_ct", "_sw", "_tw", "_common", "_lost", "_hit")
