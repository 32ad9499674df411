"""Token counts by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens. New pre-tokens of a batch are held as one flat array
of symbols with a row number each; in every round each row applies its own pair of
lowest rank at all its places at once, until no row has a pair left. The symbols
that survive are the tokens. Counts of pre-tokens seen before come from a bounded
memory of each worker.

Null and empty texts have no bytes and no tokens. Whole texts are counted, of any
length; of equal pairs side by side the first ones merge. Repeated rows each give a row;
extra columns, of whatever name, are ignored; an empty table gives an empty result.
Remembered counts go by a 64-bit hash of the pre-token: two of a million that meet at
once share a hash with a probability of 3e-8.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.arrays import bytes_of, groups, hashes_of

#: How the byte-level vocabularies cut text before merging (fixed value).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
LETTER, DIGIT, WHITE, OTHER = range(4)
#: The kind of each byte in texts of ASCII and Latin letters.
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
KIND[[32, *range(9, 14)]] = WHITE
#: Bytes of other characters: control separators, and lead bytes outside U+00C0 to U+024F.
ODD = np.zeros(256, bool)
ODD[[*range(0x1C, 0x20), 0xC2, *range(0xCA, 256)]] = True
ONE = np.frombuffer(b"stmd", np.uint8)
TWO = np.array([x[0] * 256 + x[1] for x in (b"re", b"ve", b"ll")])
_loaded: dict[str, ByteMerges] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class ByteMerges:
    """A byte-level merge vocabulary in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.first = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PRE_TOKENS)
        self.literal = "|".join(re.escape(t) for t in special)
        self.known: dict[int, int] = {}

    def merged(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word keeps."""
        counts = np.array([len(w) for w in words], np.int64)
        left = np.zeros(len(words), np.int64)
        rows = np.repeat(np.arange(len(words)), counts)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        never = len(self.made)
        while len(symbols):
            rank = np.full(len(symbols), never, np.int64)
            same = np.flatnonzero(rows[:-1] == rows[1:])
            key = symbols[same] * self.size + symbols[same + 1]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            rank[same] = np.where(self.keys[at] == key, self.ranks[at], never)
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == never
            left[rows[starts[done]]] = sizes[done]
            hit = (rank == np.repeat(lowest, sizes)) & (rank < never)
            # Of neighbouring places of one pair every second one merges.
            p = np.flatnonzero(hit)
            run = np.concatenate([[True], p[1:] != p[:-1] + 1]) if len(p) else np.zeros(0, bool)
            begin = p[np.flatnonzero(run)][np.cumsum(run) - 1] if len(p) else p
            p = p[(p - begin) % 2 == 0]
            symbols[p] = self.made[rank[p]]
            keep = ~np.repeat(done, sizes)
            keep[p + 1] = False
            symbols, rows = symbols[keep], rows[keep]
        return left

    def of_pieces(self, hashes: np.ndarray, piece) -> np.ndarray:
        """Tokens of pre-tokens by hash; piece(i) gives the bytes of the i-th, for new ones."""
        if len(self.known) + len(hashes) > REMEMBERED:
            self.known = {}
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            self.known.update(zip([keys[i] for i in new], self.merged([piece(i) for i in new]).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def plain(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of texts of ASCII and Latin letters, given as bytes and where each text begins."""
        if not len(raw):
            return np.zeros(len(at) - 1, np.int64)
        kind = KIND[raw]
        start = np.empty(len(raw) + 4, bool)
        start[0], start[1 : len(raw)], start[len(raw) :] = True, kind[1:] != kind[:-1], True
        begins = np.zeros(len(raw) + 4, bool)
        begins[at] = True
        begins[len(raw) :] = True
        start |= begins
        # The last white space before other text stands alone, or with the text if it is a space.
        b = np.flatnonzero(start[1 : len(raw)] & ~begins[1 : len(raw)] & (kind[:-1] == WHITE) & (kind[1:] != WHITE)) + 1
        start[b - 1] = True
        start[b] = raw[b - 1] != 32
        # 's and the like at the start of a pre-token are one of their own.
        q = np.flatnonzero((raw[:-2] == 39) & start[: len(raw) - 2] & ~begins[1 : len(raw) - 1]) if len(raw) > 2 else np.zeros(0, np.int64)
        if len(raw) > 1 and raw[-2] == 39 and start[len(raw) - 2] and not begins[len(raw) - 1]:
            q = np.append(q, len(raw) - 2)
        one = q[np.isin(raw[q + 1], ONE)]
        pairs = q[(q + 2 < len(raw)) & ~begins[np.minimum(q + 2, len(raw))]]
        two = pairs[np.isin(raw[pairs + 1].astype(np.int32) * 256 + raw[np.minimum(pairs + 2, len(raw) - 1)], TWO)]
        for places, n in ((one, 2), (two, 3)):
            start[places + 1] = False
            start[places + n] = True
        begin = np.flatnonzero(start[: len(raw)])
        end = np.append(begin[1:], len(raw))
        hashes = hashes_of(raw, begin, end)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        counts = self.of_pieces(unique, lambda i: raw[begin[first[i]] : end[first[i]]].tobytes())
        total = np.concatenate([[0], np.cumsum(counts[which])])
        return np.diff(total[np.searchsorted(begin, at)])

    def any(self, text: str) -> int:
        """Tokens of any text."""
        parts = self.special.split(text) if self.special is not None else [text]
        words = [w.encode() for part in parts for w in self.cut.findall(part)]
        if not words:
            return len(parts) - 1
        joined = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        unique, first, which = np.unique(hashes_of(joined, end - [len(w) for w in words], end), return_index=True, return_inverse=True)
        return len(parts) - 1 + int(self.of_pieces(unique, lambda i: words[first[i]])[which].sum())

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        raw, at = bytes_of(texts)
        odd = np.concatenate([[0], np.cumsum(ODD[raw])])
        cross = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))) if len(raw) else np.zeros(0, np.int64)
        other = (np.diff(odd[at]) > 0) | (np.diff(np.searchsorted(cross, at)) > 0)
        if self.special is not None:
            other |= np.asarray(pc.match_substring_regex(texts.fill_null(""), self.literal))
        if not other.any():
            return self.plain(raw, at)
        out = np.zeros(len(texts), np.int64)
        plain = np.flatnonzero(~other)
        out[plain] = self.plain(*bytes_of(texts.take(pa.array(plain))))
        for i in np.flatnonzero(other):
            out[i] = self.any(texts[int(i)].as_py())
        return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    vocabulary: path of a byte-level merge vocabulary, the same on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = ByteMerges(vocabulary)
        merges = _loaded[vocabulary]
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in groups(texts):
                some = texts.slice(a, b - a)
                n = merges.counts(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pc.binary_length(some).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
