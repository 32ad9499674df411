"""Divergence of sources: how each source's words differ from those of its language.

Each task counts terms into a radix trie over bytes, whose leaves have a counter for each
source, and begins a new one whenever it holds LEAVES counters. The leaves are dealt by
ranges of language and prefix, so that each range comes to one task in order; there, what
the tries have of a range merges into new ones piece by piece, counters of equal leaves
add up, and the leaves in enough documents stay. Ranges are cut by the number of leaves,
so a frequent prefix takes several; a frequent term is one leaf in each trie, however
often it occurs.

The leaves that stay are walked in UTF-8 order in blocks of bounded size, each beside the
totals of its language's sources: a block streams what its terms add to the distance of
each pair of sources, and for each source its candidates, ties in the order of the walk.

Null texts, languages and sources count as empty strings. Texts are read whole, of any
length. Repeated rows and ids count as documents of their own; ids are not read. Extra
columns, of whatever name, are ignored. An empty table gives an empty result. A language
without terms that stay has distances of 0 and no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.arrays import bytes_of, groups
from loomfield.llm.common import stored

#: Counters of a trie; beyond it its leaves are passed on and a new one begins.
LEAVES = 500_000
#: Counters of a merged piece, and bytes of text that are counted at once.
PIECE, TEXT_BYTES = 200_000, 8 << 20
#: Cells (term by source) of a block that are worked on at once.
CELLS = 1 << 20
UNIT, PRIOR = 1_000_000_000, 5
TERM = np.zeros(256, bool)
TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


class Trie:
    """A radix trie over bytes: leaves are (language, term), with counters (occurrences, documents) by source.

    A level takes the next WIDTH bytes of all paths at once: its nodes are pairs of parent
    and label, in order, so that a walk finds the leaves in UTF-8 order. Terms hold no byte
    0, which fills up labels. Roots are languages.
    """

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.sources: dict[str, int] = {}
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        #: level, node and source of each counter; occurrences and documents.
        self.at, self.counts = np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64)

    def insert(self, leaf: pa.Table) -> None:
        """Put in leaves (see LEAF) of documents or of another trie; counters of equal ones add up."""
        if not len(leaf):
            return
        node, source = (numbered(leaf.column(c), names) for c, names in (("lang", self.langs), ("source", self.sources)))
        raw, offsets = bytes_of(pa.concat_arrays(leaf.column("term").chunks))
        begin, size = offsets[:-1], np.diff(offsets)
        level, active, pos, moved = np.zeros(len(leaf), np.int64), np.arange(len(leaf)), 0, None
        k = 0
        while len(active) or k < len(self.levels):
            parent, label = self.levels[k] if k < len(self.levels) else (np.zeros(0, np.int64), labels(raw, begin[:0], size[:0], width(k)))
            parent = parent if moved is None else moved[parent]
            new = labels(raw, begin[active] + pos, size[active] - pos, width(k))
            parent, label, old = np.concatenate([parent, node[active]]), np.concatenate([label, new]), len(parent)
            first, place = distinct(label, parent)
            self.levels[k : k + 1] = [(parent[first], label[first])]
            moved, mine = place[:old], self.at[0] == k
            self.at[1, mine] = moved[self.at[1, mine]]
            node[active], level[active] = place[old:], k
            pos += width(k)
            active = active[size[active] > pos]
            k += 1
        at = np.concatenate([self.at, [level, node, source]], axis=1)
        counts = np.concatenate([self.counts, [leaf.column(c).to_numpy() for c in ("n", "docs")]], axis=1)
        first, place = distinct(at[2], at[1] << 8 | at[0])
        self.at, self.counts = at[:, first], np.stack([np.bincount(place, c, len(first)).astype(np.int64) if c.sum() < 1 << 53 else sums(place, c, len(first)) for c in counts])

    def walk(self) -> pa.Table:
        """The leaves in UTF-8 order within each language, each by source."""
        if not self.levels:
            return LEAF.empty_table()
        own = [np.zeros(len(parent), np.int64) for parent, _ in self.levels]
        for k, here in enumerate(own):
            here[self.at[1, self.at[0] == k]] = 1
        size = [x.copy() for x in own]
        for k in range(len(size) - 1, 0, -1):
            size[k - 1] += np.bincount(self.levels[k][0], size[k], len(size[k - 1])).astype(np.int64)
        position, lang, terms = np.zeros(len(self.at[0]), np.int64), np.zeros(len(self.at[0]), np.int64), [None] * len(size)
        paths = roots = start = None
        for k, (parent, label) in enumerate(self.levels):
            before = np.cumsum(size[k]) - size[k]
            text = label.astype(">u8").view("S8") if label.dtype == np.uint64 else label
            if k:
                before += start[parent] + own[k - 1][parent] - before[np.searchsorted(parent, parent)]
                text, roots = np.char.add(paths[parent], text), roots[parent]
            else:
                roots = parent
            paths, start = text, before
            mine = np.flatnonzero(self.at[0] == k)
            position[mine], lang[mine] = start[self.at[1, mine]], roots[self.at[1, mine]]
            terms[k] = pa.array(paths[self.at[1, mine]]).cast(pa.binary())
        of = np.concatenate([np.flatnonzero(self.at[0] == k) for k in range(len(size))])
        order = np.lexsort((self.at[2, of], position[of]))
        term, of = pa.concat_arrays(terms).take(pa.array(order)).cast(pa.string()), of[order]
        names = [pa.array(list(x), pa.string()).take(pa.array(code[of])) for x, code in ((self.langs, lang), (self.sources, self.at[2]))]
        return pa.table([names[0], term, names[1], pa.array(self.counts[0, of]), pa.array(self.counts[1, of])], schema=LEAF)


def numbered(column: pa.ChunkedArray, names: dict[str, int]) -> np.ndarray:
    """The number of each value among names, which grows by those that are new."""
    some = pa.concat_arrays(column.chunks).dictionary_encode()
    return np.array([names.setdefault(x, len(names)) for x in some.dictionary.to_pylist()], np.int64)[np.asarray(some.indices)]


def width(level: int) -> int:
    """Bytes that a level's labels take: 8, 8, 16, 32 and so on, so that long terms take few levels."""
    return 8 << max(level - 1, 0)


def labels(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
    """The next bytes of each term, as numbers that order as the bytes do, or as bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64 if wide == 8 else f"S{wide}")
    column = np.arange(wide)
    out = np.where(column < size[:, None], raw[np.minimum(begin[:, None] + column, len(raw) - 1)], 0).astype(np.uint8)
    return out.view(">u8").ravel().astype(np.uint64) if wide == 8 else out.view(f"S{wide}").ravel()


def distinct(minor: np.ndarray, major: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair is first met, in order, and the number of each pair among them."""
    order = np.lexsort((minor, major))
    a, b = minor[order], major[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def sums(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, counts)
    return out


def counted(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.Table:
    """The terms of some documents, with their counts by language and source."""
    raw, at = bytes_of(texts)
    inside = TERM[raw]
    if not inside.any():
        return LEAF.empty_table()
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    letters = FOLD[raw[inside]]
    offsets = np.append((np.cumsum(inside) - 1)[starts], len(letters)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    size = len(terms.dictionary)
    doc = np.searchsorted(at, starts, side="right") - 1
    # Occurrences by document and term, then by group and term.
    key, n = np.unique(doc * size + np.asarray(terms.indices, np.int64), return_counts=True)
    groups_, of = np.unique(np.asarray(langs.dictionary_encode().indices, np.int64) << 32 | np.asarray(sources.dictionary_encode().indices, np.int64), return_inverse=True)
    key, which = np.unique(of[key // size] * size + key % size, return_inverse=True)
    total, docs = np.bincount(which, n).astype(np.int64), np.bincount(which)
    names = [x.dictionary_encode().dictionary.take(pa.array(code)) for x, code in ((langs, groups_ >> 32), (sources, groups_ & 0xFFFFFFFF))]
    group, term = pa.array(key // size), pa.array(key % size)
    return pa.table([names[0].take(group), terms.dictionary.take(term).cast(pa.string()), names[1].take(group), pa.array(total), pa.array(docs.astype(np.int64))], schema=LEAF)


def leaves(docs: DataFrame) -> DataFrame:
    """The leaves of each task's tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = Trie(), [], 0

        def count() -> None:
            nonlocal held, size
            if held:
                trie.insert(counted(*[pa.concat_arrays([x.column(k) for x in held]) for k in range(3)]))
            held, size = [], 0

        for batch in batches:
            for a, b in groups(batch.column(0)):
                held.append(batch.slice(a, b - a))
                size += int(pc.sum(pc.binary_length(held[-1].column(0))).as_py())
                if size > TEXT_BYTES:
                    count()
                if trie.at.shape[1] > LEAVES:
                    yield from trie.walk().to_batches(max_chunksize=50_000)
                    trie = Trie()
        count()
        yield from trie.walk().to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, "lang string, term string, source string, n long, docs long")


def merged(found: DataFrame, least: int) -> DataFrame:
    """Merged leaves in least documents of their language or more, and the block that each is in.

    first: true for one counter of each term.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Runs of leaves; no leaf is in two of them."""
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            if size > PIECE:
                last = held[-1].slice(len(held[-1]) - 1)
                same = pc.and_(pc.equal(batch.column(0), last.column(0)[0]), pc.equal(batch.column(1), last.column(1)[0]))
                end = pc.index(same, False).as_py()
                if end != -1:
                    yield pa.Table.from_batches([*held, batch.slice(0, end)])
                    held, size, batch = [], 0, batch.slice(end)
            held.append(batch)
            size += len(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for piece in pieces(batches):
            trie = Trie()
            trie.insert(piece)
            leaf = trie.walk()
            lang, term = (np.asarray(pa.concat_arrays(leaf.column(c).chunks).dictionary_encode().indices) for c in ("lang", "term"))
            first = np.ones(len(leaf), bool)
            first[1:] = (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])
            number = np.cumsum(first) - 1
            stay = np.bincount(number, leaf.column("docs").to_numpy())[number] >= least
            out = leaf.append_column("first", pa.array(first)).append_column("block", pa.array(np.full(len(leaf), block))).drop_columns("docs").filter(pa.array(stay))
            yield from out.to_batches(max_chunksize=50_000)
            block += 1

    return found.mapInArrow(run, "lang string, term string, source string, n long, first boolean, block long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / total), exactly: the quotient three digits at a time."""
    out, rest = np.divmod(count + PRIOR, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def compared(key: tuple, counts: pd.DataFrame, groups_: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """What a block's terms add to the distance of each two sources, and each source's candidates in it."""
    groups_ = groups_.sort_values("source", ignore_index=True)
    sources, lang, size = groups_["source"].to_numpy(), groups_["lang"].iloc[0], len(groups_)
    terms = sorted(counts["term"].unique())  # code points sort as UTF-8 does
    place = {t: i for i, t in enumerate(terms)}
    row, col = counts["term"].map(place).to_numpy(np.int64), np.searchsorted(sources, counts["source"].to_numpy()) if len(counts) else np.zeros(0, np.int64)
    n, v = counts["n"].to_numpy(np.int64), int(groups_["v"].iloc[0])
    totals = groups_["total"].to_numpy(np.int64)
    names = np.array(terms, object)
    step, near = max(CELLS // size, 1), [[] for _ in sources]
    away = lambda a: pd.DataFrame({"lang": lang, "source": sources[a], "part": "pair", "item": np.delete(sources, a), "value": np.delete(total, a)})
    if not terms:
        total = np.zeros(size, np.int64)
        for a in range(size):
            yield away(a)
        return
    for k in range(0, len(terms), step):
        end = min(k + step, len(terms))
        here = (row >= k) & (row < end)
        count = np.zeros((end - k, size), np.int64)
        np.add.at(count, (row[here] - k, col[here]), n[here])
        p, q = shares(count, totals + PRIOR * v), shares(count.sum(axis=1), totals.sum() + PRIOR * v)
        for a in range(size):
            total = np.abs(p - p[:, a : a + 1]).sum(axis=0)
            yield away(a)
            gain = p[:, a] - q
            up = np.flatnonzero((count[:, a] > 0) & (gain > 0))
            near[a] = sorted(near[a] + [(-int(g), t) for g, t in zip(gain[up], names[k + up], strict=True)])[:most]
    for a in range(size):
        if near[a]:
            yield pd.DataFrame({"lang": lang, "source": sources[a], "part": "term", "item": [t for _, t in near[a]], "value": [-g for g, _ in near[a]]})


def divergence(spark: SparkSession, docs: DataFrame, least: int = 30, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Each source's distance to the other sources of its language, and the terms that it has more of than its language.

    least: documents of a language that a term must be in. most: candidates given of each source.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    found = stored(spark, leaves(docs), "leaves")
    rows = found.count()
    ranges = found.repartitionByRange(max(-(-rows // (8 * PIECE)), 1) if rows < 64 * PIECE else -(-rows // PIECE), "lang", "term")
    kept = stored(spark, merged(ranges.sortWithinPartitions("lang", "term"), least), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count_if("first").alias("v"))
    every = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    every = stored(spark, every.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    # A block without terms for each language, so that every pair has a distance.
    blocks = kept.select("lang", "block").distinct().union(every.select("lang", F.lit(-1).cast("long")).distinct())
    beside = every.join(blocks, "lang").select(*[F.col(c).alias(c) for c in ("lang", "block", "source", "total", "v")])  # both sides come from one table
    keys = ("lang", "block")
    parts = kept.select("lang", "block", "term", "source", "n").groupBy(*keys).cogroup(beside.groupBy(*keys))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(compared(key, left, right, most)) if len(right) > 1 or len(left) else pd.DataFrame(columns=["lang", "source", "part", "item", "value"])

    values = parts.applyInPandas(run, "lang string, source string, part string, item string, value long")
    values = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= most)).select("lang", "source", "part", "item", "value", "rank")
