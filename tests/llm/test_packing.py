"""Packing against the library's ids, and the tree against plain search."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = "word_bpe_49k.json"
TEXTS = [
    None, "", "   \n\t", "one two", "one two", "Don't stop,'s \"it's\" x,y 12-34 a1b2 <|endoftext|>x<|startoftext|> end<|nothing|>", "ñandú ÜBER İstanbul ΣΑΣ. ΑΣ, áb é", "a b c\u0085d \x1c\x1fz \x00 tab\tx",
    "漢字 仮名交じり文 " * 50, "🎉🎉 a🎉b", "word " * 9000, "x" * 30_000, "'s't're 'LL I'LL", "a-b_c d.e,f;g", "1234567890 " * 700, *[" ".join(f"Tok{i}en{j}" for j in range(i)) for i in range(60)],
]


def library_ids(text):
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(VOCABULARY)).encode(text or "", add_special_tokens=False).ids + [2]


def held_by(rows, ids):
    """Checks every piece and every sequence; the padding of all sequences."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for (i, n), pieces in docs.items():
        assert n == len(ids[i])
        assert [k for p in sorted(pieces, key=lambda p: p.start) for k in range(p.start, p.start + p.length)] == list(range(n))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    return padding


def test_pieces_hold_the_librarys_ids(spark):
    ids = {i: library_ids(t) for i, t in enumerate(TEXTS)}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"key": F.lit("x"), "sums": F.lit(1), "part": F.lit(0)})
    rows = packing.pack_documents(spark, docs.repartition(3), public_tokenizers.path(VOCABULARY)).collect()
    assert {r.doc_id for r in rows} == set(ids)
    assert held_by(rows, ids) <= 16 * len({r.sequence_id for r in rows})


def test_repeats_nulls_and_nothing(spark):
    path = public_tokenizers.path(VOCABULARY)
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, None)], "doc_id long, text string")
    rows = packing.pack_documents(spark, docs, path).collect()
    assert sorted((str(r.doc_id), r.start, r.doc_tokens) for r in rows if r.start == 0) == [("1", 0, 1), ("1", 0, 2), ("1", 0, 2), ("None", 0, 3), ("None", 0, 3)]
    assert sum(r.length for r in rows) == 11
    assert packing.pack_documents(spark, docs.limit(0), path).isEmpty()


def test_tree_finds_the_tightest_window():
    random.seed(5)
    tree, plain = packing.Capacities(256), []
    for step in range(4000):
        if random.random() < 0.5:
            room = random.randint(1, 256)
            tree.put(step, room)
            plain.append(room)
        else:
            need = random.randint(1, 256)
            found, best = tree.take(need), min((r for r in plain if r >= need), default=None)
            assert (found and found[1]) == best
            if best is not None:
                plain.remove(best)


@pytest.mark.parametrize("sizes", [[2049] * 101, [4096] * 3, [1] * 10, [4095, 2, 3000, 1500] * 7, [100_000, 5], [random.Random(1).randint(1, 9000) for _ in range(2000)]])
def test_every_token_is_in_one_place_with_little_padding(sizes):
    pieces = packing.pack(sizes, 4096, 16)
    place, used = {}, {}
    for i, start, size, which, sequence, offset in pieces:
        cuts = [(k, 4096) for k in range(0, sizes[i] - sizes[i] % 4096, 4096)]
        left, at = sizes[i] % 4096, sizes[i] - sizes[i] % 4096
        cuts += [(at, left)] * (left > 0)
        for b in packing.binary(left):
            cuts.append((at, b))
            at += b
        assert cuts[which] == (start, size)
        place.setdefault(i, []).append((start, size))
        used.setdefault(sequence, []).append((offset, size))
    for i, n in enumerate(sizes):
        at = 0
        for start, size in sorted(place[i]):
            assert start == at
            at += size
        assert at == n
    for held in used.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 4096 and (4096 - at <= 16 or not at & (at - 1))
