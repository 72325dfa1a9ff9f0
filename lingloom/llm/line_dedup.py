"""Operator 3: boilerplate lines by their frequency within a site, in DataFrame functions only.

For each host, the number of its pages that contain a line is divided by the number of its pages; lines over
`ratio` are dropped from that host's pages. A host has at most (mean distinct lines of a page) / ratio such lines,
so the lines to drop are a short list for each host, and pages meet their host's list in one join: lines are
filtered inside the row and texts are never exploded and put together again. Counting combines on the map side.

The lists are broadcast where they are small. Else pages are shuffled by host, and hosts of very many pages are dealt
into parts of about SPLIT_PAGES pages, each of which meets a copy of the host's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs
from .jobs import saved

SPLIT_PAGES = 50_000  #: pages of a host that one part has
MOST_SPLIT = 100_000  #: hosts that are dealt into parts; with more of them, parts get larger


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, host: Column, id_col: str, lines: Column, ratio: float = 0.1, min_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """(host, key, n_pages, host_pages): lines that at least min_pages pages of the host have, more than ratio of them.

    lines is an array column; key is xxhash64 of the trimmed line. Blank lines do not count. A null host is a host of
    its own. Rows that repeat an id are pages of their own. With copies_once, pages of a host that have the same set of
    lines are one page in both counts, so that copies of a page do not make its lines boilerplate.
    """
    rows = pages.select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _key)).alias("keys"))
    if copies_once:
        rows = rows.select("host", F.sort_array("keys").alias("keys")).distinct()
    totals = saved(rows.groupBy("host").agg(F.count("*").alias("host_pages")))
    counts = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("n_pages") > ratio * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, host: Column, id_col: str, lines: Column, into: str, ratio: float = 0.1, min_pages: int = 3, min_chars: int = 0, copies_once: bool = False) -> DataFrame:
    """pages, all columns, with the array column `into`: the lines left, in order, those dropped taken out.

    A null text has null lines and stays null. A page all of whose lines go keeps its row with an empty array.
    """
    site = F.coalesce(host.cast("string"), F.lit(""))
    found = saved(boilerplate_lines(pages, host, id_col, lines, ratio, min_pages, copies_once).groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("__ll_keys")).withColumnRenamed("host", "__ll_host"))
    size = found.agg(F.sum(F.size("__ll_keys") * 8 + F.length("__ll_host") + 64)).first()[0] or 0
    sited = pages.withColumn("__ll_site", site)
    if size <= jobs.BROADCAST_BYTES:
        joined = sited.join(F.broadcast(found), F.col("__ll_site") == F.col("__ll_host"), "left")
    else:
        counts = saved(pages.groupBy(site.alias("__ll_big")).agg(F.count("*").alias("__ll_n")))
        part = max(SPLIT_PAGES, -(-(counts.agg(F.sum("__ll_n")).first()[0] or 0) // MOST_SPLIT))
        big = F.broadcast(counts.where(F.col("__ll_n") > part).select("__ll_big", F.ceil(F.col("__ll_n") / part).alias("__ll_parts")))  # MOST_SPLIT rows at most
        lists = found.join(big, F.col("__ll_host") == F.col("__ll_big"), "left").select("__ll_host", "__ll_keys", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__ll_parts", F.lit(1)) - 1)).alias("__ll_of"))
        dealt = sited.join(big, F.col("__ll_site") == F.col("__ll_big"), "left").withColumn("__ll_part", F.pmod(F.xxhash64(F.col(id_col)), F.coalesce("__ll_parts", F.lit(1))))
        joined = dealt.join(lists, (F.col("__ll_site") == F.col("__ll_host")) & (F.col("__ll_part") == F.col("__ll_of")), "left").drop("__ll_big", "__ll_parts", "__ll_part", "__ll_of")
    left = F.when(F.col("__ll_keys").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | (F.length(x) < min_chars) | ~F.array_contains("__ll_keys", _key(x))))
    return joined.withColumn(into, left).drop("__ll_site", "__ll_host", "__ll_keys")


def drop_boilerplate_from_text(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", ratio: float = 0.1, min_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """docs, all columns, with the boilerplate lines taken out of the text; a host is a value of host_col."""
    lines = F.split(F.col(text_col), "\n")
    out = drop_boilerplate(docs, F.col(host_col), id_col, lines, "__ll_left", ratio, min_pages, copies_once=copies_once)
    return out.withColumn(text_col, F.array_join("__ll_left", "\n")).drop("__ll_left")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def html_lines(html: Column) -> Column:
    """Trimmed non-empty pieces of text between tags, scripts, styles and comments left out."""
    visible = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n")
    return F.filter(F.transform(F.split(F.regexp_replace(visible, r"<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
