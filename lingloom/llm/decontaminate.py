"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny resemblance, so a sketch of the document would miss it. The
sketch is the item's: items are partitioned by their number of shingles, a partition for each factor of 16. The
sketch of an item of n shingles, m = ceil(t * n) of which a document must contain, keeps its n - m + s least shingle
hashes (bottom-k MinHash); a document that contains m shingles holds s of any so many of them, where s, the hits that
a partition asks for, grows with its sizes. Sketches are looked up in whole documents, so it does not matter where
in a document the item is. Candidates with the hits of their partition are verified by exact containment: a shingle
counts where its words are the item's, byte for byte.

Documents are read once and never shuffled. Items are sent to the tasks in blocks of at most `block_shingles`
shingles; a larger benchmark takes one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .jobs import saved, side
from .kernels import _LOWER, shingle_hashes, text_chunks, word_hashes, words

BLOCK_SHINGLES = 500_000  #: some 60 bytes each: hash, words and place in the index


def _hits_asked(size: int) -> int:
    """How many hits of a sketch the partition of items of `size` shingles asks for: one up to 15, then more."""
    return 1 + (size.bit_length() - 1) // 4


def _item_sets(items: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """(item_id, width, size, shingles): width is n_words, or the item's words if there are fewer; shingles are the
    distinct ones as (hash, words joined by spaces), in order of hash."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in text_chunks(batch.column(1)):
                starts, ends, first = words(data, offs)
                hashes, low = word_hashes(data, starts, ends), _LOWER[data].tobytes()
                ws = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                width, sets = [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    n = min(n_words, b - a)
                    found = {b" ".join(ws[k : k + n]): h for k, h in zip(range(a, b - n + 1), shingle_hashes(hashes[a:b], n).view(np.int64).tolist())} if n else {}
                    width.append(n)
                    sets.append([{"hash": h, "words": s} for s, h in sorted(found.items(), key=lambda x: (x[1] % (1 << 64), x[0]))])
                size = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(width, pa.int32()), size, pa.array(sets, pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.binary())])))], names=["item_id", "width", "size", "shingles"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"item_id {kind}, width int, size int, shingles array<struct<hash:long,words:binary>>").where("width > 0")


class _Index:
    """Items of one width and size partition: their sketches' hashes, sorted, with the item of each, and their full sets."""

    def __init__(self, rows: list, percent: float, hits: int):
        self.items = [r["item_id"] for r in rows]
        self.words = [[bytes(s["words"]) for s in r["shingles"]] for r in rows]
        self.sets = [np.array([s["hash"] for s in r["shingles"]], np.int64).view(np.uint64) for r in rows]
        must = [max(1, -(-int(percent * len(s)) // 100)) for s in self.sets]
        self.need = np.array([min(hits, m) for m in must])
        sketch = [s[: len(s) - m + n] for s, m, n in zip(self.sets, must, self.need.tolist())]
        self.hashes = np.concatenate(sketch)
        self.of = np.repeat(np.arange(len(sketch)), [len(s) for s in sketch])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.of = self.hashes[order], self.of[order]
        # a table of the hashes' top bits sorts out nearly all of a document's shingles at once
        self.bits = np.uint64(64 - max(12, int(len(self.hashes)).bit_length() + 4))
        self.seen = np.zeros(1 << int(np.uint64(64) - self.bits), bool)
        self.seen[self.hashes >> self.bits] = True

    def candidates(self, found: np.ndarray) -> list[int]:
        """Items that have as many of a document's distinct hashes in their sketch as their partition asks for."""
        lo, hi = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        count = np.bincount(np.concatenate([self.of[a:b] for a, b in zip(lo.tolist(), hi.tolist())]), minlength=len(self.items))
        return np.flatnonzero(count >= np.maximum(self.need, 1)).tolist()


def _contained(item: list[bytes], hashes: np.ndarray, own: np.ndarray, first: int, width: int, word) -> int:
    """How many of an item's shingles a document has: own are the hashes of its shingles, word(k) the bytes of its k-th word."""
    at = np.flatnonzero(np.isin(own, hashes))
    there = {b" ".join(word(first + k + j) for j in range(width)) for k in at.tolist()}
    return sum(s in there for s in item)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n_words: int = 5, percent: float = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, item_id, n_shingles, n_found, containment) for each document that holds `percent` % of an item's shingles.

    Shingles are of n_words words, lower-cased A-Z; an item with fewer words is one shingle of them all. An item
    without words, or of null id or text, is in no document; so is nothing in a null or empty document. A row of
    null document id is reported with that null id. Rows that repeat an id report each for itself.
    """
    spark = docs.sparkSession
    sets = saved(_item_sets(items, item_id_col, item_text_col, n_words))
    total = sets.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-int(total) // block_shingles))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), sets.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(sets.schema["item_id"].dataType)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def one_pass(block: int) -> DataFrame:
        rows = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # bounded by block_shingles
        parts: dict[tuple[int, int], list] = {}
        for r in rows:
            parts.setdefault((r["width"], _hits_asked(r["size"])), []).append(r)
        shared = spark.sparkContext.broadcast([(width, _Index(part, percent, hits)) for (width, hits), part in sorted(parts.items())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, offs in text_chunks(batch.column(1)):
                    starts, ends, first = words(data, offs)
                    hashes = word_hashes(data, starts, ends)
                    word = lambda k: _LOWER[data[starts[k] : ends[k]]].tobytes()  # noqa: E731, B023
                    out: tuple[list, list, list, list] = ([], [], [], [])
                    for width in sorted({w for w, _ in shared.value}):
                        s = shingle_hashes(hashes, width)
                        for index in (x for w, x in shared.value if w == width):
                            at = np.flatnonzero(index.seen[s >> index.bits])
                            at = at[np.isin(s[at], index.hashes)]
                            text = np.searchsorted(first, at, "right") - 1
                            ok = at + width <= first[text + 1]
                            at, text = at[ok], text[ok]
                            for d in np.unique(text).tolist():
                                own = s[first[d] : first[d + 1] - width + 1]
                                for k in index.candidates(np.unique(s[at[text == d]])):
                                    found = _contained(index.words[k], index.sets[k], own, int(first[d]), width, word)
                                    if found and 100 * found >= percent * len(index.words[k]):
                                        for col, x in zip(out, (d, index.items[k], len(index.words[k]), found)):
                                            col.append(x)
                    if out[0]:
                        ids = batch.column(0).slice(i, j - i).take(pa.array(out[0], pa.int64()))
                        item = pa.array(out[1], item_type)
                        yield pa.RecordBatch.from_arrays([ids, item, pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["id", "item_id", "n_shingles", "n_found"])

        return texts.mapInArrow(run, f"id {kind}, item_id {item_kind}, n_shingles long, n_found long")

    found = reduce(DataFrame.unionByName, [one_pass(b) for b in range(blocks)])
    return found.select(F.col("id").alias(id_col), "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: float = 80) -> DataFrame:
    """The rows of docs, all columns, that hold no item; a row of null id stays. An id goes with all of its rows."""
    bad = saved(contained_items(docs, items, id_col, text_col, n_words=n_words, percent=percent).select(F.col(id_col).alias("__ll_id")).distinct())
    return docs.join(side(bad, 32), F.col(id_col) == F.col("__ll_id"), "left_anti")
