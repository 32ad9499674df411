"""Source divergence against plain Python, and its SQL on small planted tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield.llm import divergence as dv
from loomfield.llm import oracle

WORDS = ["a", "ab", "abc", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "é", "zß", "漢字", "Straße", "ABC", "🎉", " "]


def documents():
    random.seed(11)
    rows = [(i, random.choice([None, "", "x9y"]) if i % 17 == 0 else " ".join(random.choices(WORDS, range(1, len(WORDS) + 1), k=random.randint(0, 12))) + f" own{i}", random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "sé", None])) for i in range(300)]
    return [*rows, *rows[:40], (None, "a ab é", "fr", "alone"), (1, None, "xx", "s1"), (2, "", "xx", "s2"), (3, "q" * 5000 + "ö", "en", "s1")]


def plain(rows, least, most):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: counts[lang, s] for x, s in groups if x == lang}
        every = sum((of[s] for s in of), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        share, q = {s: p(c) for s, c in of.items()}, p(every)
        for s in of:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in of if o != s]
            terms = [(share[s][t] - q[t], t) for t in kept if of[s][t] and share[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= most:
                        out.add((lang, s, part, item, v, rank))
    return out


@pytest.mark.parametrize(("least", "most", "leaves", "piece", "cells"), [(30, 50, 500_000, 200_000, 1 << 20), (2, 3, 40, 10, 8), (1000, 50, 1, 1, 1)])
def test_against_plain_counts(spark, monkeypatch, least, most, leaves, piece, cells):
    for name, value in (("LEAVES", leaves), ("PIECE", piece), ("CELLS", cells), ("TEXT_BYTES", leaves)):
        monkeypatch.setattr(dv, name, value)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "block": F.lit(3), "total": F.lit(4), "v": F.lit(5)})
    got = [tuple(r) for r in dv.divergence(spark, docs.repartition(4), least, most).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, least, most)


def test_nothing(spark):
    assert dv.divergence(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string")).isEmpty()


def test_trie_walks_and_merges_in_order():
    random.seed(3)
    terms = sorted({"".join(random.choices("abé漢", k=random.choice([1, 2, 7, 8, 9, 16, 17, 40, 300]))) for _ in range(400)})
    trie, every = dv.Trie(), Counter()
    for _ in range(6):
        some = random.choices(terms, k=200)
        each = [(random.choice("xy"), t, random.choice("pqr"), random.randint(1, 9), 1) for t in some]
        for lang, t, s, n, d in each:
            every[lang, t, s] += n
        trie.insert(pa.table([list(c) for c in zip(*each, strict=True)], schema=dv.LEAF))
    leaf = trie.walk().to_pylist()
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in leaf} == every and len(leaf) == len(every)
    for lang in "xy":
        walked = [r["term"].encode() for r in leaf if r["lang"] == lang]
        assert walked == sorted(walked)


def test_shares_are_exact():
    import numpy as np

    counts, totals = np.array([0, 1, 10**12, 4 * 10**14 + 7]), np.array([5, 13, 10**13 + 1, 10**15 + 3])
    assert dv.shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(counts, totals, strict=True)]


def test_sql_gives_the_plain_rows():
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", documents())
    assert set(con.sql(oracle.DIVERGENCE).fetchall()) == plain(documents(), 30, 50)
