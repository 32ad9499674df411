"""Words and word shingles of many texts at once, as numpy arrays over Arrow buffers.

Hashes are 64-bit polynomial sums over bytes, finished by a mixing step, so one
text gives the same values in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in groups of about so many bytes; one longer text is a group of its own.
GROUP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_powers: dict[int, np.ndarray] = {}

#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        x = np.cumprod(x)
        if n > 2 * GROUP_BYTES:  # for one very long text only
            return x
        _powers[base] = x
    return _powers[base][:n]


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about GROUP_BYTES of text."""
    sizes = np.asarray(pc.binary_length(texts.fill_null("")))
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP_BYTES:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, and where each begins and ends; null is empty."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def hashes_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of each stretch of bytes."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * _power(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array, separators: np.ndarray = SPACE, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each text where its words begin (n + 1 places).

    first: with so many leading bytes, hashes are pairs, of the word and of these.
    """
    raw, at = bytes_of(texts)
    if not len(raw):
        return np.zeros((2, 0) if first else 0, np.uint64), np.zeros(len(at), np.int64)
    word = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:]))
    h = hashes_of(raw, starts, ends + 1, _FOLDED)
    if first:
        h = np.stack([h, mix(hashes_of(raw, starts, np.minimum(ends + 1, starts + first), _FOLDED))])
    return h, np.searchsorted(starts, at)


def shingles_of(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, and where they begin.

    A text of fewer words than width gives its whole sequence as one; one without words none.
    """
    n = np.diff(at)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(width)]
    total = len(words)
    each = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), each)
    first = np.concatenate([[0], np.cumsum(each)])
    pos = at[:-1][doc] + (np.arange(first[-1]) - first[doc])
    s = np.zeros(len(pos), np.uint64)
    left = n[doc] - (pos - at[:-1][doc])
    for j in range(width):
        ok = left > j
        s += np.where(ok, words[np.minimum(pos + j, max(total - 1, 0))] * factors[j], np.uint64(0)) if total else np.uint64(0)
    s = mix(s + np.minimum(left, width).astype(np.uint64))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Ragged rows as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column of longs, and where each row's begin."""
    column = pa.concat_arrays([column])
    at = np.asarray(column.offsets, np.int64)
    return np.asarray(column.values)[at[0] : at[-1]].view(np.uint64), at - at[0]
