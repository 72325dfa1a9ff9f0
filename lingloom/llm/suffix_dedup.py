"""Operator 7: removal of repeated byte strings by suffix arrays, built by linear grouping.

A suffix array of a whole corpus fits no task, so the work is cut by content:

1. Every window of `length` bytes has an anchor, its k-gram of least hash (the rightmost of equals). Equal windows
   have equal anchors at the same place in them, so all that can match meets under one anchor hash. An anchor's
   context is every byte of a window around it.
2. Equal contexts under one anchor fold: all but the first are repeated as a whole. Copies inside a task fold
   before the shuffle, so a text that a third of the documents share costs a row for each task.
3. What is left are first occurrences of contexts that differ, which is where shared passages begin and end. They
   are trimmed to what they share with another one, and equal strings fold again.
4. A suffix array over the remaining strings puts equal windows next to each other; of each such class all windows
   but the earliest are repeated.

A very frequent anchor (the end of a line that a third of the documents share) would fill a task. Those that a bounded
sample of texts shows are dealt out by context from the start, and any other with over HOT_CONTEXTS differing contexts
leaves the arrays as well: their windows are hashed one by one and meet their earliest equal in a grouped minimum,
which combines before the shuffle, and a join: the exact way for the rest. The sample decides where rows go, never what
is removed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import saved
from .kernels import mix, powers, text_chunks

GRAM = 24  #: bytes of an anchor
FOLD_BYTES = 16 << 20  #: text of which a task folds equal contexts before the shuffle
HOT_CONTEXTS = 50_000  #: differing contexts of one anchor that one task takes
SAMPLE_TEXTS, SAMPLE_HITS = 5000, 100  #: texts that are looked at for frequent anchors, and how many contexts one has there
BLOCK = 8_000  #: symbols of one suffix array, few enough for a cache; strings under one anchor are never parted
_C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def suffix_array(text: Sequence[int] | np.ndarray) -> list[int]:
    """Order of all suffixes of text, in linear time, by grouping and without recursive renaming.

    Phase 1 takes the groups of suffixes, at first by their first symbol, from the highest to the lowest. Each suffix
    of the group points to the last earlier suffix of a lower group, its previous smaller one; those that are pointed
    at leave their group for a new one right behind it, the ones with more pointers further behind. At the end, a group
    holds the suffixes with one common Lyndon prefix. Phase 2 goes through the order from the smallest suffix on: each
    one places the suffix before it, and that one's chain of previous smaller suffixes, at the front of their groups.
    """
    n = len(text) + 1
    s = np.append(np.asarray(text, np.int64) + 1, 0)
    by_symbol, count = np.argsort(s, kind="stable"), np.bincount(s)
    begin = np.cumsum(count) - count
    rank = np.empty(n, np.int64)
    rank[by_symbol] = np.arange(n)
    order, place, start = by_symbol.tolist(), rank.tolist(), begin[s].tolist()
    size = [0] * n
    for g, c in zip(begin[count > 0].tolist(), count[count > 0].tolist()):
        size[g] = c
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        i = order[end]
        low = start[i]
        if low == end:  # a group of one, as most are: its previous smaller suffix goes behind its own group
            p = i - 1
            while p >= 0 and start[p] > low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = start[p]
                if size[g] > 1:
                    size[g] -= 1
                    k, here = g + size[g], place[p]
                    if k != here:
                        other = order[k]
                        order[here], place[other] = other, here
                        order[k], place[p] = p, k
                    start[p], size[k] = k, 1
            end -= 1
            continue
        group = order[low : end + 1]
        tied = []
        for i in group:  # up to the last earlier suffix of this group or a lower one
            p = i - 1
            while p >= 0 and start[p] > low:
                p = prev[p]
            prev[i] = p
            if p >= 0 and start[p] == low:
                tied.append(i)
        for i in tied:  # on through this group, each of whose members is passed once
            p = i
            while p >= 0 and start[p] == low:
                p = prev[p]
            q = i
            while q != p and prev[q] != p:
                prev[q], q = p, prev[q]
        times = Counter([prev[i] for i in group])
        times.pop(-1, None)
        by_count: dict[int, list[int]] = {}
        for p, c in times.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            groups = [start[p] for p in by_count[c]]
            # a group that leaves as a whole stays where it is
            leaving = {g: m for g, m in Counter(groups).items() if m < size[g]}
            for p, g in zip(by_count[c], groups):
                if g in leaving:
                    size[g] -= 1
                    k, here = g + size[g], place[p]
                    if k != here:
                        other = order[k]
                        order[here], place[other] = other, here
                        order[k], place[p] = p, k
            for g, m in leaving.items():
                new = g + size[g]
                size[new] = m
                for p in order[new : new + m]:
                    start[p] = new
        end = low - 1
    out, placed, front = [n - 1] * n, [False] * n, list(range(n))
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = start[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, offset, hash, bytes after the offset in the context, context hash) of the anchors of a chunk's texts.

    A string's hash is a sum of powers over its 8-grams, each mixed first: sums over plain bytes collide on long regular
    strings.
    """
    n, w = len(data), length - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.uint64))
    if n < length:
        return none
    p, q = powers(n)
    part = min(8, gram)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    grams = mix(np.ndarray((n,), "<u8", padded, 0, (1,)) & np.uint64((1 << 8 * part) - 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(grams * p[:n], out=total[1:])
    span = lambda lo, hi: (total[hi - part + 1] - total[lo]) * q[lo]
    h = mix((total[gram - part + 1 : n - part + 2] - total[: n - gram + 1]) * q[: n - gram + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    wide = 1
    while wide * 2 <= w:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < w:
        low = np.minimum(low[: len(low) - (w - wide)], low[w - wide :])
    ok = np.zeros(n + 1, np.int32)  # windows that end before their text does
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a >= length:
            ok[a] += 1
            ok[b - length + 1] -= 1
    low = low[np.cumsum(ok)[: len(low)] > 0]
    at = np.zeros(n, bool)
    at[(np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    at = np.flatnonzero(at)
    text = np.searchsorted(offs, at, "right") - 1
    lo = np.maximum(offs[text], at + gram - length)
    hi = np.minimum(offs[text + 1], at + length)
    context = mix(span(lo, hi) + (at - lo).astype(np.uint64) * _C1 + (hi - at).astype(np.uint64) * _C2)
    return text, at - offs[text], h[at], hi - at, context


def _numbered(docs: DataFrame) -> DataFrame:
    """docs(id, text) with `doc`, a number in order of id that two rows share only where they share the text too.

    Ids are such numbers where none is repeated with another text; else ids and text hashes are sorted and numbered.
    """
    own = docs.where("id is not null").select("id", F.xxhash64("text").alias("_x"))
    mixed = own.groupBy("id").agg(F.min("_x").alias("a"), F.max("_x").alias("b")).where("a <> b")
    if not mixed.limit(1).count():
        return docs.withColumn("doc", F.col("id"))
    keys = saved(own.distinct().repartitionByRange("id", "_x").sortWithinPartitions("id", "_x").withColumn("doc", F.monotonically_increasing_id()))
    return docs.withColumn("_x", F.xxhash64("text")).join(keys, ["id", "_x"], "left").select("id", "text", "doc")


def _anchors_of(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...], int]]:
    """(documents, anchors, bytes) of each chunk of batches of (doc, text)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, _, data, offs in text_chunks(batch.column(1), 1 << 20):
            found = anchors(data, offs, length, gram)
            yield ids[i:][found[0]], found, len(data)


def _frequent_anchors(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Sorted hashes of anchors with SAMPLE_HITS differing contexts in about SAMPLE_TEXTS sampled texts."""
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    part = docs.where(F.pmod(F.xxhash64("doc", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, _, h, _, c), _ in _anchors_of(batches, length, gram):
            pair = np.unique(np.stack([h.view(np.int64), c.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["h", "c"])

    pairs = part.where("text is not null").select("doc", "text").mapInArrow(run, "h long, c long").distinct()
    often = pairs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_HITS).select("h").collect()
    return np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64))


def _anchor_rows(docs: DataFrame, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """(h, c, id, at, done, often): at = offset and bytes after it in the context; done: an equal context comes earlier.

    Rows that need no partner, and those of frequent anchors, whose contexts meet elsewhere, are spread over all h.
    """
    shift = length.bit_length()

    def fold(parts: list[tuple]) -> pa.RecordBatch:
        ids, pos, h, after, c = (np.concatenate(x) for x in zip(*parts))
        at = pos << shift | after
        order = np.lexsort((at, ids, c, h))
        ids, at, h, c = ids[order], at[order], h[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        done = (ids != ids[first]) | (at != at[first])
        often = np.isin(h, frequent)
        h = np.where(often, mix(h + c), h)
        h = np.where(done, mix(ids.astype(np.uint64) * _C1 + at.astype(np.uint64)), h)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids), pa.array(at), pa.array(done), pa.array(often)], names=["h", "c", "id", "at", "done", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for ids, (_, pos, h, after, c), size in _anchors_of(batches, length, gram):
            parts.append((ids, pos, h, after, c))
            held += size
            if held >= FOLD_BYTES:
                yield fold(parts)
                parts, held = [], 0
        if parts:
            yield fold(parts)

    return docs.where("doc is not null and text is not null").select("doc", "text").mapInArrow(run, "h long, c long, id long, at long, done boolean, often boolean")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, id, pos, left, body) of wanted(id, h, at): body is the context's bytes, left how many of them are before the anchor."""
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("h", "at")).alias("asked"))
    shift, low = length.bit_length(), (1 << length.bit_length()) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                lists = part.column(2)
                count = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
                flat = lists.flatten()
                at = flat.field("at").to_numpy(zero_copy_only=False)
                pos, hi = at >> shift, (at >> shift) + (at & low)
                lo = np.maximum(0, pos + gram - length)
                row = np.repeat(np.arange(len(count)), count)
                raw = [t.encode() for t in part.column(1).to_pylist()]
                body = [raw[r][a:b] for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([flat.field("h"), part.column(0).take(pa.array(row)), pa.array(pos), pa.array(pos - lo), pa.array(body, pa.binary())], names=["h", "id", "pos", "left", "body"])

    one = docs.where("text is not null").select(F.col("doc").alias("id"), "text")
    return one.join(asked, "id").select("id", "text", "asked").mapInArrow(run, "h long, id long, pos long, left long, body binary")


def _shared_reach(group: np.ndarray, side: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the longest prefix of its side that another row of its group has; side is padded with zeros."""
    m, width = side.shape
    keys = np.ascontiguousarray(side).view(">u8")
    order = np.lexsort((*keys.T[::-1], group))
    a, b = order[:-1], order[1:]
    differ = side[a] != side[b]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.where(group[a] == group[b], np.minimum(common, np.minimum(size[a], size[b])), 0)
    out = np.zeros(m, np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _repeated_in(strings: list[bytes], firsts: list[tuple[int, int]], length: int) -> list[np.ndarray]:
    """For each string, which window starts repeat an earlier window, by the suffix array of all strings."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)  # 0xFF never occurs in UTF-8
    at = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    sa = np.array(suffix_array(text), np.int64)
    owner = np.searchsorted(at, sa, "right") - 1
    fits = sa + length <= at[owner + 1] - 1
    sa, owner = sa[fits], owner[fits]
    off = sa - at[owner]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    new = np.ones(len(sa), bool)
    new[1:] = (windows[sa[1:]] != windows[sa[:-1]]).any(1)
    group = np.cumsum(new)
    doc, pos = (np.array(x)[owner] for x in zip(*firsts))
    start = pos + off
    order = np.lexsort((start, doc, group))
    first = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])] if len(order) else order
    least_doc, least_start = doc[first][group - 1], start[first][group - 1]
    later = (doc != least_doc) | (start != least_start)
    out = [np.zeros(0, np.int64)] * len(strings)
    by = np.argsort(owner, kind="stable")
    for k, rows in zip(*_runs(owner[by])):
        rows = by[rows]
        out[k] = np.sort(off[rows][later[rows]])
    return out


def _runs(x: np.ndarray) -> tuple[list[int], list[slice]]:
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return [int(x[a]) for a in cut[:-1]], [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _repeats_of(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, lo, hi) ranges of the contexts' documents that repeat an earlier string."""
    left_most, right_most = length - gram, length

    def solve(h, ids, pos, left, bodies) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        size = np.array([len(b) for b in bodies])
        _, group = np.unique(h, return_inverse=True)
        rights, lefts = np.zeros((len(h), -(-right_most // 8) * 8), np.uint8), np.zeros((len(h), -(-left_most // 8) * 8), np.uint8)
        raw = np.frombuffer(b"".join(bodies), np.uint8) + np.uint8(1)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        for side, count, step in ((rights, size - left, 1), (lefts, left, -1)):
            row = np.repeat(np.arange(len(h)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            side[row, k] = raw[(at + left)[row] + (k if step > 0 else -1 - k)]
        after = _shared_reach(group, rights, size - left)
        before = _shared_reach(group, lefts, left)
        strings: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for k in np.flatnonzero(before + after >= length).tolist():
            a = int(left[k] - before[k])
            strings.setdefault((int(group[k]), bodies[k][a : int(left[k] + after[k])]), []).append((int(ids[k]), int(pos[k] - before[k])))
        block: list[tuple[bytes, tuple[int, int]]] = []
        held, last = 0, -1

        def settle() -> None:
            for (s, (i, p)), offs in zip(block, _repeated_in([b for b, _ in block], [f for _, f in block], length)):
                if len(offs):
                    gap = np.flatnonzero(np.diff(offs) > length)
                    for a, b in zip(offs[np.concatenate([[0], gap + 1])].tolist(), offs[np.concatenate([gap, [len(offs) - 1]])].tolist()):
                        out[0].append(i), out[1].append(p + a), out[2].append(p + b + length)

        many: dict[int, int] = {}
        for g, _ in strings:
            many[g] = many.get(g, 0) + 1
        for (g, s), found in sorted(strings.items(), key=lambda x: x[0][0]):
            first = min(found)
            for f in set(found) - {first}:
                out[0].append(f[0]), out[1].append(f[1]), out[2].append(f[1] + len(s))
            if many[g] > 1:
                if held >= BLOCK and g != last:
                    settle()
                    block.clear()
                    held = 0
                block.append((s, first))
                held, last = held + len(s), g
        if block:
            settle()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(keep_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            end = int(np.searchsorted(h, h[-1])) if keep_last else len(h)
            held, rows = ([t.slice(end).to_batches()[0]] if end < len(h) else []), len(h) - end
            if end:
                t = t.slice(0, end)
                cols = solve(h[:end], t["id"].to_numpy(), t["pos"].to_numpy(), t["left"].to_numpy(), t["body"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "lo", "hi"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= 40_000:
                    yield from flush(True)
        if rows:
            yield from flush(False)

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "id long, lo long, hi long")


def _window_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of `length` bytes that starts at `at`: its blocks of 8 bytes, mixed with their numbers."""
    if not len(at):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    out = np.zeros(len(at), np.uint64)
    for k in range(0, length, 8):
        left = min(8, length - k)
        out += mix(mix(word[at + k] & np.uint64((1 << 8 * left) - 1)) + np.uint64(k + 1) * _C2)
    return mix(out)


def _repeats_of_hot(contexts: DataFrame, length: int) -> DataFrame:
    """(id, lo, hi) like _repeats_of, for contexts under very frequent anchors, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                bodies = part.column(4).to_pylist()
                size = np.array([len(b) for b in bodies])
                count = np.maximum(size - length + 1, 0)
                row = np.repeat(np.arange(len(size)), count)
                off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                w = _window_hashes(np.frombuffer(b"".join(bodies), np.uint8), (np.cumsum(size) - size)[row] + off, length)
                ids = part.column(1).to_numpy(zero_copy_only=False)
                start = (part.column(2).to_numpy() - part.column(3).to_numpy())[row] + off
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(ids[row]), pa.array(start)], names=["w", "id", "start"])

    windows = saved(contexts).mapInArrow(run, "w long, id long, start long")
    first = windows.groupBy("w").agg(F.min(F.struct("id", "start")).alias("first"), F.max(F.struct("id", "start")).alias("last"))
    # a saved side lets Spark split a window that very many texts have
    first = saved(first.where("first <> last").select(F.col("w").alias("of"), F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")))
    later = windows.join(first, F.col("w") == F.col("of")).where("id <> first_id or start <> first_start")
    return later.select("id", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))


def _ranges(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, lo, hi) of docs(doc, text), id a doc."""
    gram = min(gram, length)
    shift, low = length.bit_length(), (1 << length.bit_length()) - 1
    by_context = Window.partitionBy("h", "c").orderBy("id", "at")
    by_anchor = Window.partitionBy("h")
    rows = _anchor_rows(docs, length, gram, _frequent_anchors(docs, length, gram))
    met = rows.repartition("h").withColumn("k", F.rank().over(by_context)).withColumn("mixed", F.min("c").over(by_anchor) != F.max("c").over(by_anchor))
    met = met.withColumn("repeated", F.col("done") | (F.col("k") > 1))
    met = met.withColumn("hot", F.col("often") | (F.count_if(F.col("k") == 1).over(by_anchor) > HOT_CONTEXTS)).where("repeated or mixed or often").select("h", "id", "at", "repeated", "hot")
    met = saved(met)
    pos = F.shiftright("at", shift)
    whole = met.where("repeated").select("id", F.greatest(F.lit(0), pos + gram - length).alias("lo"), (pos + F.col("at").bitwiseAND(low)).alias("hi"))
    open_rows = met.where("not repeated")
    parts = _repeats_of(_contexts(docs, open_rows.where("not hot").select("id", "h", "at"), length, gram), length, gram)
    hot = open_rows.where("hot").select("id", "h", "at")
    if hot.limit(1).count():
        parts = parts.unionByName(_repeats_of_hot(_contexts(docs, hot, length, gram), length))
    return whole.unionByName(parts)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _numbered(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row of df: spans are the maximal removed byte runs, kept the bytes left over.

    spans cover the byte ranges that strings of `length` bytes cover which start earlier too, in a smaller id or in the
    same text before. Ids are integers. A null or empty text has no bytes, no spans and keeps nothing; neither is anything
    taken from a row of null id. Rows that repeat an id with one text are one document, so they do not remove each
    other; different texts of an id are documents of their own, in order of a hash of the text. kept is binary: a run
    may end inside a character.
    """
    docs = _documents(df, id_col, text_col)
    ranges = _ranges(docs, length, gram).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges")).withColumnRenamed("id", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                n, spans, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw, own, rest, end = (text or "").encode(), [], [], 0
                    for r in found or ():
                        if own and r["lo"] <= own[-1]["end"]:
                            own[-1]["end"] = max(own[-1]["end"], r["hi"])
                        else:
                            own.append({"start": r["lo"], "end": r["hi"]})
                    for s in own:
                        rest.append(raw[end : s["start"]])
                        end = s["end"]
                    rest.append(raw[end:])
                    n.append(len(raw)), spans.append(own), kept.append(b"".join(rest))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = docs.join(ranges, F.col("doc") == F.col("of"), "left").select("id", "text", "ranges").mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
