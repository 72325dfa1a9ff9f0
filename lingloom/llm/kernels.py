"""Vectorised kernels over Arrow text columns: words, word hashes and shingle hashes, all documents of a chunk at once.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes after lower-casing A-Z; hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  #: texts are worked on in chunks of this size; a longer text is a chunk of its own
GIVE_BACK_BYTES = 32 << 20  #: bytes of text after which a worker hands freed memory back
_handled = [0]
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  #: keeps the first k of 8 bytes
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i <= n at least."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def give_back() -> None:
    """Hand freed memory back to the system: workers are used again by later stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about limit bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    big = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    _handled[0] += len(raw)
    if _handled[0] > GIVE_BACK_BYTES:
        _handled[0] = 0
        give_back()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it (one entry more than texts)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    cut = offs[1:-1]
    cut = cut[cut < len(data)]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside[:-1] & ~inside[1:]
    cut = cut[cut > 0]
    stop[cut - 1] = inside[cut - 1]
    if len(stop):
        stop[-1] = inside[len(data) - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words in blocks of 8 bytes: (first block of each word; word, number and value of every block after it)."""
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    at = np.ndarray((len(data) + 1,), "<u8", low, 0, (1,))  # the 8 bytes from each byte on
    size = ends - starts
    more = np.flatnonzero(size > 8)
    count = (size[more] + 7 >> 3) - 1
    word = np.repeat(more, count)
    number = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + 1
    left = np.minimum(size[word] - 8 * number, 8)
    return at[starts] & _LOW_BYTES[np.minimum(size, 8)], word, number, at[starts[word] + 8 * number] & _LOW_BYTES[left]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of up to 8 bytes are a bijection of their bytes for each length; longer ones add what mixes each block with
    its number, so no arrangement of equal blocks cancels out as it can in a sum of powers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    head, word, number, rest = _blocks(data, starts, ends)
    h = mix(head ^ mix((ends - starts).astype(np.uint64)))
    if len(word):
        first = np.flatnonzero(number == 1)
        h[word[first]] = mix(h[word[first]] + np.add.reduceat(mix(mix(rest) + number.astype(np.uint64) * _R), first))
    return h


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; two are equal exactly where the lower-cased bytes are, whatever their hashes are."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    like = first[number]  # the first word of the same hash
    head, word, k, rest = _blocks(data, starts, ends)
    size = ends - starts
    same = (size == size[like]) & (head == head[like])
    if len(word):
        begin = np.zeros(len(starts), np.int64)
        begin[word[k == 1]] = np.flatnonzero(k == 1)
        twin = begin[like[word]] + k - 1
        ok = rest == rest[np.minimum(twin, len(rest) - 1)]
        same[word[~ok & same[word]]] = False
    if not same.all():  # different words of one hash: told apart by their bytes
        names: dict[tuple[int, bytes], int] = {}
        low = _LOWER[data]
        for w in np.flatnonzero(np.isin(number, number[~same])).tolist():
            key = int(number[w]), low[starts[w] : ends[w]].tobytes()
            number[w] = names.setdefault(key, len(starts) + len(names))
    return number


def shingle_numbers(numbers: np.ndarray, n: int) -> np.ndarray:
    """Like shingle_hashes, but equal exactly where the n words are: pairs are numbered, then pairs with the next word."""
    m = len(numbers) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    _, numbers = np.unique(numbers, return_inverse=True)
    span = int(numbers.max()) + 1
    out = numbers[:m]
    for j in range(1, n):
        _, out = np.unique(out * span + numbers[j : j + m], return_inverse=True)
    return out


def exact_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Like shingle_sets, with numbers that are equal exactly where the words are, for the texts of this call."""
    starts, ends, first = words(data, offs)
    numbers = word_numbers(data, starts, ends)
    s = shingle_numbers(numbers, n)
    short: dict[bytes, int] = {}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            out.append(np.array([len(numbers) + short.setdefault(numbers[a:b].tobytes(), len(short))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of hashes[i : i + n] for each i that has so many; texts' ends are the caller's to respect."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:m])
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + m]
        out = mix(out)
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; fewer words count as one shingle, none as an empty set."""
    starts, ends, first = words(data, offs)
    h = word_hashes(data, starts, ends)
    s = shingle_hashes(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            out.append(shingle_hashes(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_digests(data: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """SHA-256 of each text's lower-cased words, a space after each; None for a text without words."""
    space = _SPACE[data]
    after = space.copy()
    after[1:] &= ~space[:-1]
    after[:1] = False
    low = np.where(space, np.uint8(0x20), _LOWER[data])
    begins = offs[:-1][np.diff(offs) > 0]
    after[begins] = False  # white space that begins a text follows no word of it
    keep = ~space | after
    at = np.concatenate([[0], np.cumsum(keep)])[offs]
    packed = memoryview(low[keep])
    out: list[bytes | None] = []
    for a, b, end in zip(at[:-1].tolist(), at[1:].tolist(), offs[1:].tolist()):
        h = hashlib.sha256(packed[a:b])
        if b > a and not space[end - 1]:
            h.update(b" ")
        out.append(h.digest() if b > a else None)
    return out
