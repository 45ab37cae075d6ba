"""Words, shingles and lines of Arrow string columns as numpy arrays, without a Python object a word.

A column's UTF-8 buffer is hashed as a whole: with prefix sums of byte * P^i (mod 2^64) the
polynomial hash of any span is a difference of two sums times P^-start.

A word is a run of letters, digits, marks and underscores of any script. Scripts that are written
without spaces (Han, kana, Thai, Lao, Khmer, Burmese) give a word a character, marks included.
Other characters, punctuation of every script among them, divide words.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

#: What an ASCII byte is: 0 divides words, 1 is part of one.
WORD = np.zeros(256, dtype=np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_":
    WORD[_c] = 1
#: Blocks whose characters are words of their own, and the bytes that are hashed at a time.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
BLOCK = 1 << 20
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """By code point: 0 divides words, 1 is part of one, 2 is a word, 3 a mark that belongs to such a word."""
    if not _classes:
        c = np.zeros(0x110000, np.uint8)
        for i in range(0x20000):
            kind = unicodedata.category(chr(i))
            if kind[0] in "LNM":
                c[i] = (3 if kind[0] == "M" else 2) if any(a <= i <= b for a, b in ALONE) else 1
        c[0x20000:0x40000] = 2
        c[0x5F] = 1
        _classes.append(c)
    return _classes[0]


def _wide(data: np.ndarray, kind: np.ndarray) -> None:
    """Set the class of every byte of the non-ASCII characters."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    point = lead & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        more = size > k
        point = np.where(more, point << 6 | (padded[at + k] & 0x3F), point)
    of = classes()[np.minimum(point, 0x10FFFF)]
    kind[at] = of
    for k in (1, 2, 3):
        to = at[size > k] + k
        inside = to < len(data)
        kind[to[inside]] = np.minimum(of[size > k][inside], 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _P), ("inverse", pow(_P, -1, 1 << 64))):
            a = np.full(size, base & _MASK, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["inverse"]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch into pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    ends = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64).cumsum()
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(off):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= p[: len(data)]
    np.cumsum(x, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, whose starts grow; a span's length is part of it. About ``BLOCK`` bytes are looked at together, so memory doesn't follow the longest text."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) <= BLOCK:
        return _span_hashes(data, starts, ends)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        lo, hi = int(starts[at]), int(ends[at:to].max())
        out[at:to] = _span_hashes(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and for each text the place of its first word; first has one more entry than there are texts.

    With ``pairs`` a character that is a word of its own reaches over the next one too, if that follows at once: words of two characters, overlapping.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = WORD[data]
    wide = bool((data >= 0x80).any())
    if wide:
        _wide(data, kind)
    inside = kind > 0
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    alone = np.flatnonzero(kind == 2) if wide else np.zeros(0, np.int64)
    if len(alone):
        begins[alone] = True
        # letters of spaced scripts that follow such a character at once begin a word
        new = np.flatnonzero((kind[1:] == 1) & (data[1:] & 0xC0 != 0x80) & (data[:-1] >= 0x80)) + 1
        lead = new - 1
        for _ in range(3):
            lead = np.where((data[lead] & 0xC0) == 0x80, lead - 1, lead)
        begins[new[kind[lead] >= 2]] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    if pairs and len(alone):
        one = kind[starts] == 2
        joined = np.flatnonzero(one[:-1] & one[1:] & (ends[:-1] == starts[1:]) & ~_text_edge(starts[1:], offsets))
        ends = ends.copy()
        ends[joined] = ends[joined + 1].copy()
    return starts, ends, np.searchsorted(starts, offsets)


def _text_edge(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return offsets[np.minimum(np.searchsorted(offsets, at), len(offsets) - 1)] == at


def word_hashes(texts: pa.Array, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words, first), see words()."""
    data, offsets = buffers(pc.utf8_lower(texts))
    starts, ends, first = words(data, offsets, pairs)
    return span_hashes(data, starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of runs of ``width`` words; a text of fewer words, but one at least, has one shingle of all of them."""
    n = len(hashes)
    counts = np.diff(first)
    last = np.repeat(first[1:], counts)
    place = np.arange(n)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        part = np.zeros(n, dtype=np.uint64)
        part[: n - k] = hashes[k:] if k else hashes
        if k:
            part[place + k >= last] = 0
        out = (out * np.uint64(0x9FB21C651E98DF25)) + part
    used = place <= np.maximum(np.repeat(first[:-1], counts), last - width)
    have = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    return mix(out[used]), np.concatenate([[0], np.cumsum(have)])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the lines, as for words(); a text has one line more than it has line feeds."""
    feeds = np.flatnonzero(data == 10)
    m = len(offsets) - 1
    first = np.searchsorted(feeds, offsets) + np.arange(m + 1)
    total = len(feeds) + m
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    if m:
        is_first[first[:-1]] = True
        is_last[first[1:] - 1] = True
    starts[is_first] = offsets[:-1]
    starts[~is_first] = feeds + 1
    ends[is_last] = offsets[1:]
    ends[~is_last] = feeds
    return starts, ends, first
