"""System prompts: one template for each language pair and mode, made on the driver and broadcast; only the user part varies by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES

PRINCIPLES = [
    "Keep the order, number and boundaries of the segments.",
    "Translate all of the meaning; add nothing and leave nothing out.",
    "Write fluently and keep the register of the source.",
    "Use one translation for one term throughout.",
    "Keep numbers, units, dates and names as they are.",
    "Write no comments, notes, quotation marks of your own or introductions.",
]
PLACEHOLDERS = "Keep every __TAG_N__ and __ENTITY_N__ placeholder exactly once and unchanged, where the target sentence needs it."
REPLY = 'Reply with one JSON object only: {"translations": [{"id": "segment-id", "translation": "translated text"}]}'


def label(code: str) -> str:
    return next((f"{name} ({c})" for c, name, _, _ in LANGUAGES if c == code), code)


def script_note(code: str) -> str:
    native = next((n for c, name, n, _ in LANGUAGES if c == code and n != name), "")
    return f" Write the output in {label(code)} script ({native}), not in Latin letters." if native else ""


def system_prompt(source: str, target: str, mode: str = "single", rules: tuple = (), terms: tuple = (), retry: bool = False, profile: str = "") -> str:
    """mode: 'single' or 'batch'. terms: (source term, translation, note). retry adds the notice of an incomplete attempt, profile what to know of
    the domain."""
    what = "the CURRENT SEGMENT" if mode == "single" else 'the "sourceText" of every segment'
    parts = [f"You are a translator. Translate {what} from {label(source)} into {label(target)}.{script_note(target)}", "## PRINCIPLES\n" + "\n".join(f"- {p}" for p in PRINCIPLES)]
    if mode == "batch":
        parts.append("## OUTPUT FORMAT\n" + REPLY)
    if retry:
        parts.append(f"## CRITICAL RETRY NOTICE\nThe attempt before left source text untranslated. Translate every part into {label(target)}.")
    if profile:
        parts.append("## DOMAIN\n" + profile)
    if rules:
        parts.append(f"## LANGUAGE RULES ({label(target)})\n" + "\n".join(f"- {r}" for r in rules))
    if terms:
        parts.append("## TERMINOLOGY\n" + "\n".join(f'- "{s}" -> "{t}"' + (f" ({n})" if n else "") for s, t, n in terms))
    return "\n\n".join([*parts, "## PLACEHOLDERS\n" + PLACEHOLDERS])


def prompt_table(spark: SparkSession, pairs: list[tuple[str, str]], glossary: list[tuple] = (), modes: tuple[str, ...] = ("single", "batch")) -> DataFrame:
    """(source_lang, target_lang, mode, retry, system_prompt) for each pair: a table of a few rows to broadcast."""
    rows = [(s, t, m, r, system_prompt(s, t, m, terms=tuple((g[0], g[3], g[5]) for g in glossary if g[1] == s and g[2] == t), retry=r)) for s, t in pairs for m in modes for r in (False, True)]
    return F.broadcast(spark.createDataFrame(rows, "source_lang string, target_lang string, mode string, retry boolean, system_prompt string"))
