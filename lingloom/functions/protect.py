"""Markup and entities swapped for numbered placeholders, and put back; all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, occurrences

#: The inline tags of translation files, and the entity patterns in the order they are applied. A tag's
#: match is an opening tag; with it, up to the last inline closing tag before another inline tag opens, if there is one.
INLINE_TAG = r"<(?:bpt|ept|ph|g|mrk|x|bx|ex|it|mq:[a-zA-Z]+)[^>]*(?:/>|>(?:[^<]*(?:<(?!(?:bpt|ept|ph|g|mrk|x|bx|ex|it|mq:[a-zA-Z]+)[^>]*>)[^<]*)*</(?:bpt|ept|ph|g|mrk|x|bx|ex|it|mq:[a-zA-Z]+)>)?)"
_E = r"(?![A-Za-z0-9_])"
URL = r"https?://[^ \t\n\x0B\f\r\x{A0}\x{FEFF}<>\"'()\[\]{}]+"
FTP = r"ftp://[^ \t\n\x0B\f\r\x{A0}\x{FEFF}<>\"'()\[\]{}]+"
_W = "[A-Za-z0-9_]"
#: A boundary between a word character of ASCII and anything else.
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
#: What can open a match is asked for before what stands around it, so most characters fail at the first step.
EMAIL = rf"(?:(?=[.%+\-])(?<={_W})|(?={_W})(?<!{_W}))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}" + _E
TRIAL_ID = rf"NCT(?<!{_W}NCT)[0-9]{{8}}" + _E
CODE = rf"[A-Z](?<!{_W}[A-Z])[A-Z]+-[A-Z0-9-]{{2,}}" + _EDGE
ENTITY_PATTERNS = [("url", URL), ("ftp", FTP), ("email", EMAIL), ("nct_id", TRIAL_ID), ("code", CODE)]


#: Set around matches as they are found; a text that holds it is read twice instead.
_MARK = "\x01"
EMPTY_TOKENS = "array<struct<token:string,original:string,type:string>>"


def replace_matches(text: Column, pattern: str, kind: str, offset: Column) -> Column:
    """(text with placeholders, tokens: array of (token, original, type)) for the matches of a pattern, numbered from
    offset + 1. A struct, so that its fields are read from one scan: give it a column of its own.

    Matches are marked in one scan and cut out at the marks; a text without any is left as it is.
    """
    name = lambda k: F.concat(F.lit(f"__{kind}_"), (k + 1 + offset).cast("string"), F.lit("__"))
    none = F.array().cast(EMPTY_TOKENS)

    def swapped(gaps: Column, found: Column) -> Column:
        tokens = F.transform(found, lambda m, k: F.struct(name(k).alias("token"), m.alias("original"), F.lit(kind.lower()).alias("type")))
        joined = F.array_join(F.zip_with(gaps, F.transform(found, lambda m, k: name(k)), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
        return F.struct(joined.alias("text"), tokens.alias("tokens"))

    odd = lambda pieces, r: F.filter(pieces, lambda p, k: k % 2 == r)
    unmarked = lambda x: F.struct(x.alias("text"), none.alias("tokens"))
    by_marks = let(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), lambda x: F.when(F.contains(x, F.lit(_MARK)), let(F.split(x, _MARK, -1), lambda p: swapped(odd(p, 0), odd(p, 1)))).otherwise(unmarked(x)))
    read_twice = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, swapped(F.split(text, pattern, -1), f)).otherwise(unmarked(text)))
    return F.when(F.contains(text, F.lit(_MARK)), read_twice).otherwise(by_marks)


def protect_tags(df: DataFrame, col: str, out: str = "protected_text", tokens: str = "tag_tokens", pattern: str | None = None) -> DataFrame:
    df = df.withColumn("_m", replace_matches(F.col(col), pattern or INLINE_TAG, "TAG", F.lit(0)))
    return df.withColumns({out: F.col("_m.text"), tokens: F.col("_m.tokens")}).drop("_m")


def protect_entities(df: DataFrame, col: str, out: str = "protected_text", tokens: str = "entity_tokens", patterns: list[tuple[str, str]] = ENTITY_PATTERNS) -> DataFrame:
    """One pass for each pattern; numbers go on from pass to pass, so they follow the passes, not the text."""
    df = df.withColumns({"_t": F.col(col), "_k": F.array().cast(EMPTY_TOKENS)})
    for _, pattern in patterns:
        df = df.withColumn("_m", replace_matches(F.col("_t"), pattern, "ENTITY", F.size("_k")))
        df = df.withColumns({"_t": F.col("_m.text"), "_k": F.concat("_k", "_m.tokens")})
    return df.withColumns({out: F.col("_t"), tokens: F.col("_k")}).drop("_t", "_k", "_m")


def protect(df: DataFrame, col: str, patterns: list[tuple[str, str]] = ENTITY_PATTERNS, tags: str | None = None) -> DataFrame:
    """Entities first, then markup around them, so that an entity inside a tag nests."""
    return protect_tags(protect_entities(df, col, "_p", patterns=patterns), "_p", pattern=tags).drop("_p")


def missing_tokens(text: Column, tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: F.instr(text, t["token"]) == 0), lambda t: t["token"])


def duplicated_tokens(text: Column, tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: occurrences(text, t["token"]) > 1), lambda t: t["token"])


def restore_error(text: Column, tokens: Column, kind: str = "") -> Column:
    """What is wrong with the placeholders of a translated text, null if each is there once."""
    kind = f"{kind} " if kind else ""
    lost, twice = missing_tokens(text, tokens), duplicated_tokens(text, tokens)
    parts = F.concat_ws("; ", F.when(F.size(lost) > 0, F.concat(F.lit(f"Missing {kind}tokens: "), F.array_join(lost, ", "))), F.when(F.size(twice) > 0, F.concat(F.lit(f"Duplicated {kind}tokens: "), F.array_join(twice, ", "))))
    return F.when(parts != "", parts)


def restored(text: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, text, lambda acc, t: F.replace(acc, t["token"], t["original"]))


def restore_all(df: DataFrame, col: str, out: str = "restored", error: str = "restore_error") -> DataFrame:
    """Tags and then entities put back; a text with lost or doubled placeholders stays as it is and has an error."""
    df = df.withColumn("_e1", restore_error(F.col(col), F.col("tag_tokens"))).withColumn("_r1", restored(F.col(col), F.col("tag_tokens")))
    df = df.withColumn("_e2", restore_error(F.col("_r1"), F.col("entity_tokens"), "entity")).withColumn(error, F.coalesce("_e1", "_e2"))
    return df.withColumn(out, F.when(F.col(error).isNull(), restored(F.col("_r1"), F.col("entity_tokens"))).otherwise(F.col(col))).drop("_e1", "_r1", "_e2")


def find_tokens(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"__{kind}_[0-9]+__"), F.lit(0))


def has_tags(text: Column, pattern: str | None = None) -> Column:
    return text.rlike(pattern or INLINE_TAG)


def token_texts(tokens: Column) -> Column:
    """Tokens and originals as one string, for reports."""
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws("=", t["token"], t["original"])), "|")


def custom_patterns(extra: dict[str, str], urls: bool = True, emails: bool = True) -> list[tuple[str, str]]:
    """The pattern list with switches for URLs and e-mails, and a caller's own patterns in place of the built-in ones."""
    base = [p for p in ENTITY_PATTERNS if (p[0] in ("url", "ftp") and urls) or (p[0] == "email" and emails)]
    return reduce(lambda acc, item: [*acc, item], extra.items(), base)
