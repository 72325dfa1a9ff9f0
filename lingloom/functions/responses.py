"""Prompts and replies of an inference step, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trimmed

#: The keys under which a reply may hold its list, in order of preference.
LIST_KEYS = ["translations", "segments", "items", "data", "results"]
ITEM = "array<struct<id:string,translation:string>>"


def user_prompt(previous: Column, current: Column, following: Column) -> Column:
    """Context and text of one segment; an absent neighbour has no section."""
    return F.concat_ws(
        "\n",
        F.when(previous != "", F.concat(F.lit("PREVIOUS SEGMENT (context only, do not translate):\n"), previous, F.lit("\n"))),
        F.concat(F.lit("CURRENT SEGMENT (translate this):\n"), current),
        F.when(following != "", F.concat(F.lit("\nNEXT SEGMENT (context only, do not translate):\n"), following)),
    )


def without_fences(reply: Column) -> Column:
    c = F.regexp_replace(reply, f"(?i)^```json[{WS}]*", "")
    c = F.regexp_replace(c, f"^```[{WS}]*", "")
    return trimmed(F.regexp_replace(c, f"```[{WS}]*$", ""))


def batch_items(reply: Column) -> Column:
    """The list of (id, translation) in a reply: under one of LIST_KEYS, or the root; null if there is none."""
    c = without_fences(F.coalesce(reply, F.lit("")))
    raw = F.from_json(c, ", ".join(f"{k} string" for k in LIST_KEYS))
    listed = F.coalesce(*[F.when(F.startswith(F.ltrim(raw[k]), F.lit("[")), raw[k]) for k in LIST_KEYS])
    root = F.when(F.startswith(c, F.lit("[")), c)
    return F.from_json(F.when(F.startswith(c, F.lit("{")), listed).otherwise(root), ITEM)
