"""Operator 10: byte-pair encoding through a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state that every byte leads back to. Each merge (u, v) -> uv, in
rank order, is one gadget: the state that arcs labelled u enter is copied without its arc v, the u arcs go to
the copy, and wherever u and then v could be read an arc uv is added to where that v led. After all gadgets a
word has exactly one accepted path, its encoding, and so has each of its prefixes. Each gadget makes one state, so a
token names the state it enters. Written out, 50,000 states would have hundreds of millions of arcs, nearly all of
which no text takes; so the arcs that gadgets cut are kept in one table (token, token) -> rank, what a state inherits
from the state it was copied from is found through the right part of its token, and arcs that a text takes are
remembered.

A word is driven byte by byte through a second table, that of the states' labels: its transitions (node, byte) give
the longest label that ends there, and each label names the next shorter one. The one whose arc the state before it
has is the last arc of the path so far: nothing is tried twice, and the work is in proportion to the bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import text_chunks

#: The pre-split pattern of byte-level BPE, and the printable stand-ins of bytes in its vocabulary file.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CACHE_WORDS = 200_000  #: words, arcs and moves that a task remembers; a full memory is emptied, which costs time only
_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    other = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(other)}


class TokenizationAutomaton:
    """Compiled from a tokenizers JSON file of a byte-level BPE model; picklable, of the vocabulary's size."""

    def __init__(self, model_json: str):
        spec = json.loads(model_json)
        vocab, letter = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.size, self.special = size, {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.left, self.right, self.born, self.label = [-1] * size, [-1] * size, [-1] * size, [b""] * size
        self.cut: dict[int, int] = {}
        self.byte = [-1] * 256
        for ch, b in letter.items():
            if ch in vocab:
                self.byte[b], self.label[vocab[ch]] = vocab[ch], bytes([b])
        self.reached = set(self.byte) - {-1}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        for text, i in self.special.items():
            self.label[i] = text.encode()
        self.token = {self.label[t]: t for t in self.reached}
        self.width = list(map(len, self.label))
        self.ok: dict[int, bool] = {}
        self._table()

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if not self.follows(u, v):
            return  # no word reads u and then v by now: the merge adds no arc
        self.left[uv], self.right[uv], self.born[uv] = u, v, rank
        self.label[uv] = self.label[u] + self.label[v]
        self.reached.add(uv)
        self.cut[u * self.size + v] = rank

    def follows(self, a: int, b: int) -> bool:
        """Whether the state that token a enters has an arc b: no gadget cut it, or cut the arc that b was made of."""
        size, cut, born, left = self.size, self.cut, self.born, self.left
        until = _NEVER
        while True:
            arc, made = b, _NEVER
            while True:
                rank = cut.get(a * size + arc)
                if rank is not None and rank < until and rank <= made:
                    return False
                if born[arc] < 0:
                    break
                made, arc = born[arc], left[arc]
            if born[a] < 0:
                return True
            until, a = born[a], self.right[a]

    def _table(self) -> None:
        """Nodes for the prefixes of all labels: `move` (node, byte) -> node of the longest prefix that ends with the byte,
        `fail` a node's longest proper suffix that is a node, `last` the longest label that ends at a node, and
        `shorter` the longest label that a label ends with."""
        step: dict[int, int] = {}
        ends, depth_first = [-1], [[0]]
        for text, t in self.token.items():
            node = 0
            for k, b in enumerate(text):
                nxt = step.get(node << 8 | b)
                if nxt is None:
                    nxt = step[node << 8 | b] = len(ends)
                    ends.append(-1)
                    if len(depth_first) < k + 2:
                        depth_first.append([])
                    depth_first[k + 1].append(node << 8 | b)
                node = nxt
            ends[node] = t
        self.step, self.move = step, {}
        self.fail, self.last, self.shorter = [0] * len(ends), ends, [-1] * self.size
        for level in depth_first[1:]:
            for key in level:
                node, above = step[key], key >> 8
                if above:
                    self.fail[node] = self._next(self.fail[above], key & 255)
                behind = ends[self.fail[node]]
                if ends[node] >= 0:
                    self.shorter[ends[node]] = behind
                else:
                    ends[node] = behind
        self.move = {}

    def _next(self, node: int, b: int) -> int:
        at = node
        while True:
            nxt = self.step.get(at << 8 | b)
            if nxt is not None or not at:
                break
            at = self.fail[at]
        if len(self.move) >= 4 * CACHE_WORDS:
            self.move.clear()
        self.move[node << 8 | b] = nxt = nxt or 0
        return nxt

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one accepted path."""
        whole = self.token.get(word)
        if whole is not None:
            return (whole,)
        ok, size, width, shorter, last, move = self.ok, self.size, self.width, self.shorter, self.last, self.move
        node, j, arcs = 0, 0, [-1]  # arcs[j]: the last arc of the path of the first j bytes
        for b in word:
            nxt = move.get(node << 8 | b)
            node = self._next(node, b) if nxt is None else nxt
            j += 1
            t = last[node]
            while t >= 0:
                i = j - width[t]
                if not i:
                    break
                key = arcs[i] * size + t
                may = ok.get(key)
                if may is None:
                    if len(ok) >= 2 * CACHE_WORDS:
                        ok.clear()
                    may = ok[key] = self.follows(arcs[i], t)
                if may:
                    break
                t = shorter[t]
            else:
                raise ValueError("the vocabulary lacks a byte of this word")
            arcs.append(t)
        path = []
        while j:
            t = arcs[j]
            path.append(t)
            j -= width[t]
        return tuple(path[::-1])


class Encoder:
    """Splits texts and looks up the path of each piece; what it remembers is bounded."""

    def __init__(self, automaton: TokenizationAutomaton):
        self.a = automaton
        self.split = regex.compile(PRE_SPLIT).findall
        self.gaps = [" " + chr(c) for c in (0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
        self.special = regex.compile("(" + "|".join(map(regex.escape, automaton.special)) + ")").split if automaton.special else None
        self.word: dict[str, tuple[int, ...]] = {}
        self.piece: dict[str, tuple[int, ...]] = {}

    def of_words(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for w in self.split(text):
            ids = self.word.get(w)
            if ids is None:
                if len(self.word) >= CACHE_WORDS:
                    self.word.clear()
                ids = self.a.encode_word(w.encode())
                if len(w) < 64:
                    self.word[w] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """Ids in runs. A single space before a non-space always starts a pre-split word, so pieces cut there stand alone."""
        if self.special is not None and any(s in text for s in self.a.special):
            return list(chain.from_iterable(((self.a.special[s],),) if s in self.a.special else self.encode(s) for s in self.special(text) if s))
        if text.endswith(" ") or any(g in text for g in self.gaps):
            return [self.of_words(text)]
        first, *rest = text.split(" ")
        seen = self.piece
        out = list(map(seen.get, rest))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            p = rest[k]
            ids = seen.get(p)
            if ids is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                ids = self.of_words(" " + p)
                if len(p) < 64:
                    seen[p] = ids
            out[k] = ids
        return [self.of_words(first), *out]


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One for each Python worker and automaton."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast automaton and a name for it."""

    def __init__(self, broadcast, name: int):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> TokenizationAutomaton:
        return TokenizationAutomaton(self.broadcast.value)


def _share(df: DataFrame, tokenizer_path: str) -> _Shared:
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    slim = {"added_tokens": [{"content": t["content"], "id": t["id"]} for t in spec["added_tokens"]], "model": {"vocab": spec["model"]["vocab"], "merges": spec["model"]["merges"]}}
    slim = json.dumps(slim, ensure_ascii=False)
    return _Shared(df.sparkSession.sparkContext.broadcast(slim), hash(slim))


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) for each row of df, in one pass without a shuffle.

    tokenizer_path is a tokenizers JSON file that the driver reads; what is broadcast is its merges (1.5 MB for
    50,000) whatever the corpus. Special tokens' strings in a text become their ids. A null or empty text has no
    ids and decodes to ''. Ids are passed through, null and repeated ones too; other columns are left out.
    """
    shared = _share(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        label = enc.a.label
        for batch in batches:
            for i, j, data, offs in text_chunks(batch.column(1)):
                raw, offs = data.tobytes(), offs.tolist()
                runs = [enc.encode(raw[a:b].decode("utf-8", "replace")) if b > a else [] for a, b in zip(offs, offs[1:])]
                counts = [sum(map(len, r)) for r in runs]
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(runs)), np.int32, sum(counts))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                cols = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    out = list(map(label.__getitem__, flat.tolist()))
                    cols.append(pa.array([b"".join(out[a:b]).decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: len(cols)])

    id_type = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, decoded string): the labels of the arcs that ids name, joined, read as UTF-8 (bad bytes become U+FFFD).

    A null or empty list decodes to ''; null ids in a list are left out; an id outside the vocabulary fails the job.
    """
    shared = _share(df, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _encoder(shared).a.label
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [b"".join(label[t] for t in ids or () if t is not None).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"id {id_type}, decoded string").withColumnRenamed("id", id_col)
