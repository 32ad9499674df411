"""Packing of token sequences into fixed windows by best-fit decreasing.

Documents are tokenised in tasks; of each one only lengths and checksums of its possible
pieces go on, so that what is shuffled does not hold the texts. Documents are dealt by a
hash of a row key into packing groups of about GROUP_DOCS documents, however many there
are. In each group, documents longer than a window are first cut into full windows; what
is left of every document goes, the longest first, into the open window that it leaves
least room in, found by a segment tree over remaining capacities. Windows that stay too
empty are dissolved: their documents are cut into pieces of powers of two, which fill gaps
of other windows by the same tree; those left over pair up into sequences of a power of two,
which need no padding.

Null and empty texts are one token (the end mark). Texts are tokenised whole, of any
length. Repeated rows and rows with repeated or null ids are documents of their own; of
documents of one length the one of the smaller row key goes first. Extra columns, of
whatever name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.arrays import SPACE, bytes_of, groups
from loomfield.llm.common import stored
from loomfield.llm.token_counts import _byte_letters

#: Documents that one packing task gets, on average.
GROUP_DOCS = 8192
#: Batches of more bytes are worked on in parts.
TEXT_BYTES = 4 << 20
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 700_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts may be cut between an ASCII letter and an ASCII digit or mark; not at quotes, which begin
#: contractions, and not at the marks of special tokens.
SIDE = np.zeros(256, np.int8)
SIDE[[*range(65, 91), *range(97, 123)]] = 1
SIDE[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<|>"]] = 2
SIDE[48:58] = 2
#: Words of letters that lower-casing and normalising treat byte by byte, up to LONG bytes; the library gets all others.
PLAIN, LONG = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"), 256
_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts by a tokenizer that never joins words across white space."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # What ends a word stands for itself.
        self.first, self.last = (np.array([vocab[c + end] for c in _byte_letters()], np.int64) for end in ("", model["end_of_word_suffix"]))
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.ranks = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.ranks], np.array([vocab[a + b] for a, b in merges], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin = array("I"), array("q", [0])

    def learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if len(w) <= LONG and PLAIN.fullmatch(w)]
        if plain:
            ids, sizes = self.merged([w.lower() for w in plain])
            self.known.update(zip(plain, range(len(self.begin) - 1, len(self.begin) - 1 + len(plain)), strict=True))
            self.begin.frombytes((len(self.ids) + np.cumsum(sizes)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.astype(np.uint32).tobytes())
        other = [w for w in words if w not in self.known]
        for word, found in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False), strict=True):
            self.known[word] = len(self.begin) - 1
            self.ids.extend(found.ids)
            self.begin.append(len(self.ids))

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that lower-case words keep, one word after the other, and how many each keeps.

        In every round each word applies its own pair of lowest rank at all its places.
        """
        counts = np.array([len(w) for w in words], np.int64)
        raw, rows = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), counts)
        symbols = self.first[raw]
        ends = np.cumsum(counts) - 1
        symbols[ends] = self.last[raw[ends]]
        done, never = [], len(self.made)
        rank = self.ranked(symbols, rows, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            ready = lowest == never
            done.append((rows[ready], symbols[ready]))
            rows, symbols, rank, lowest = rows[~ready], symbols[~ready], rank[~ready], lowest[~ready]
            # Of neighbouring places of one pair every second one merges.
            p = np.flatnonzero(rank == lowest)
            run = np.ones(len(p), bool)
            run[1:] = p[1:] != p[:-1] + 1
            p = p[(p - p[np.flatnonzero(run)][np.cumsum(run) - 1]) % 2 == 0] if len(p) else p
            symbols[p] = self.made[rank[p]]
            keep = np.ones(len(symbols), bool)
            keep[p + 1] = False
            rows, symbols, rank = rows[keep], symbols[keep], rank[keep]
            # Only pairs with a new symbol have a new rank.
            new = p - np.arange(len(p))
            touched = np.zeros(len(symbols), bool)
            touched[new] = touched[np.maximum(new - 1, 0)] = True
            new = np.flatnonzero(touched)
            rank[new] = self.ranked(symbols, rows, new)
        rows, symbols = (np.concatenate([x[k] for x in done]) for k in (0, 1))
        return symbols[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(words))

    def ranked(self, symbols: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; one beyond all at the end of a word."""
        out = np.full(len(places), len(self.made), np.int64)
        inner = np.flatnonzero(places < len(symbols) - 1)
        inner = inner[rows[places[inner]] == rows[places[inner] + 1]]
        key = symbols[places[inner]] * self.size + symbols[places[inner] + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[inner] = np.where(self.keys[at] == key, self.ranks[at], len(self.made))
        return out

    def of(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and where each text's begin (n + 1 places)."""
        raw, at = bytes_of(texts)
        side, solid = SIDE[raw], ~SPACE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[at] = True
        first[1:-1] |= ~solid[:-1] | (side[1:] + side[:-1] == 3) & (side[1:] != 0) & (side[:-1] != 0) if len(raw) else False
        starts = np.flatnonzero(first[:-1] & solid)
        data = raw[solid]
        places = np.concatenate([[0], np.cumsum(solid)])
        offsets = np.append(places[starts], len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        each, which = words.dictionary.to_pylist(), np.asarray(words.indices)
        if len(self.known) + len(each) > REMEMBERED:
            self.forget()
        if new := [w for w in each if w not in self.known]:
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, each), np.int64, len(each))
        ids, begin = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32), np.frombuffer(self.begin, np.int64)
        from_, sizes = begin[index][which], (begin[index + 1] - begin[index])[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(from_ - total[:-1], sizes) + np.arange(total[-1])]
        # A text's end id stands behind the ids of its last word.
        ends = total[np.searchsorted(starts, at[1:])]
        out = np.insert(flat, ends, end).astype("<u4")
        return out, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def binary(n: int) -> list[int]:
    """The powers of two that n is the sum of, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def checksums(ids: bytes, n: int, window: int) -> list[int]:
    """Of each full window, of what is left, and of the powers of two that this can be cut into."""
    left = n % window
    cuts = [(k, window) for k in range(0, n - left, window)] + [(n - left, left)] * (left > 0)
    at = n - left
    for size in binary(left):
        cuts.append((at, size))
        at += size
    return [zlib.crc32(memoryview(ids)[4 * a : 4 * (a + size)]) for a, size in cuts]


class Capacities:
    """Open windows by remaining capacity, with a segment tree that tells which capacities occur."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.tree = bytearray(2 * self.width)
        self.open: dict[int, list[int]] = {}

    def put(self, window: int, room: int) -> None:
        held = self.open.setdefault(room, [])
        held.append(window)
        if len(held) == 1:
            k = room + self.width
            while k and not self.tree[k]:
                self.tree[k] = 1
                k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of least room that is enough, and its room; it is open no longer."""
        k = need + self.width
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.width
        held = self.open[room]
        window = held.pop()
        if not held:
            self.tree[k] = 0
            while k > 1 and not self.tree[k ^ 1]:
                k >>= 1
                self.tree[k] = 0
        return window, room


def pack(sizes: list[int], window: int, slack: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, which checksum, sequence, offset) of documents by their tokens.

    Every sequence is as long as a power of two or lacks slack tokens at most.
    """
    pieces, sequences = [], 0
    for i, n in enumerate(sizes):
        for k in range(n // window):
            pieces.append((i, k * window, window, k, sequences, 0))
            sequences += 1
    left = [n % window for n in sizes]
    tree, holds, used = Capacities(window), [], []
    for i in sorted((i for i, r in enumerate(left) if r), key=lambda i: -left[i]):
        w, room = tree.take(left[i]) or (len(holds), window)
        if w == len(holds):
            holds.append([])
            used.append(0)
        holds[w].append((i, sizes[i] - left[i], left[i], sizes[i] // window, used[w]))
        used[w] += left[i]
        if room > left[i]:
            tree.put(w, room - left[i])
    # Windows are dissolved, the emptiest first, until their tokens would fill the gaps of all others.
    whole = [True] * len(holds)
    gaps, loose = sum(window - u for u in used), []

    def dissolve(w: int) -> None:
        whole[w] = False
        for i, start, size, which, _ in holds[w]:
            for k, part in enumerate(binary(size)):
                loose.append((i, start, part, which + 1 + k))
                start += part

    filled = 0
    for w in sorted(range(len(holds)), key=used.__getitem__):
        if filled >= gaps:
            break
        filled += used[w]
        gaps -= window - used[w]
        dissolve(w)
    tree = Capacities(window)
    for w in range(len(holds)):
        if whole[w] and used[w] < window:
            tree.put(w, window - used[w])
    loose, rest = [], sorted(loose, key=lambda x: -x[2])
    for i, start, size, which in rest:
        if (found := tree.take(size)) is None:
            loose.append((i, start, size, which))
            continue
        w, room = found
        holds[w].append((i, start, size, which, used[w]))
        used[w] += size
        if room > size:
            tree.put(w, room - size)
    for w in range(len(holds)):
        if whole[w] and window - used[w] > slack and used[w] & (used[w] - 1):
            # Pieces that had come to fill it are of a power of two already.
            own, holds[w] = holds[w], []
            for i, start, size, which, at in own:
                if which == sizes[i] // window:
                    holds[w].append((i, start, size, which, at))
                else:
                    loose.append((i, start, size, which))
            dissolve(w)
    for w in range(len(holds)):
        if whole[w]:
            pieces.extend((*x[:4], sequences, x[4]) for x in holds[w])
            sequences += 1
    # Pieces of one size pair up, as digits are carried in binary addition.
    level = {1 << k: [] for k in range(window.bit_length())}
    for x in loose:
        level[x[2]].append([(*x, 0)])
    for size in sorted(level):
        held = level[size]
        while len(held) > 1 and 2 * size <= window:
            one, two = held.pop(), held.pop()
            level[2 * size].append(one + [(*x[:4], x[4] + size) for x in two])
        for some in held:
            pieces.extend((*x[:4], sequences, x[4]) for x in some)
            sequences += 1
    return pieces


def tokenised(docs: DataFrame, vocabulary: str, end: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of the row), doc_tokens and sums (see checksums()) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = WordIds(vocabulary)
        words, key = _loaded[vocabulary], TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in groups(batch.column(1)) if batch.nbytes > TEXT_BYTES else [(0, len(batch))]:
                ids, at = words.of(batch.column(1).slice(a, b - a), end)
                n, data = np.diff(at), ids.tobytes()
                sums = [checksums(memoryview(data)[4 * at[i] : 4 * at[i + 1]], int(n[i]), window) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.arange(key, key + b - a)), pa.array(n), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "key", "doc_tokens", "sums"])
                key += b - a

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, key long, doc_tokens long, sums array<long>")


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end: int = 2, slack: int | None = None) -> DataFrame:
    """Pieces of all documents: start and length among the document's tokens, checksum, and the place in a sequence.

    vocabulary: path of a tokenizers file, the same on every executor; its ids must not
    depend on what stands beyond white space. window: a power of two. slack: tokens that a
    sequence may lack without being cut further, by default a 256th of the window.
    """
    slack = window // 256 if slack is None else slack
    docs = stored(spark, tokenised(docs, vocabulary, end, window, id_col, text_col), "tokens")
    parts = max(-(-docs.count() // GROUP_DOCS), 1)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        found = np.array(pack(pdf["doc_tokens"].tolist(), window, slack), np.int64).reshape(-1, 6)
        row, sums = found[:, 0], pdf["sums"].tolist()
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").take(row).array, "start": found[:, 1], "length": found[:, 2], "ids_crc32": [int(sums[i][k]) for i, k in found[:, [0, 3]].tolist()],
            "doc_tokens": pdf["doc_tokens"].to_numpy()[row], "sequence_id": (int(key[0]) << 32) + found[:, 4], "offset": found[:, 5],
        })

    return docs.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).applyInPandas(run, PIECES)
