"""License scans as an exact set-similarity join of templates and text blocks.

A text is cut into blocks of words that overlap by half, so that every notice of up
to half a block stands whole in one. A block holds a template when it has at least
the threshold's share of the template's distinct words and, where the template has the
key phrase of its label, that phrase too. Words of all templates are
ordered by the number of texts that hold them, over the whole table, rarest first;
a block and a template that meet the threshold then share a word of short prefixes,
and lengths and positions in that order rule out most of the rest. What passes is
counted exactly. The templates are a fixed small set, so the join needs no shuffle:
its index is part of the plan.

Exact phrases are found beside it in the whole text and always count.

Null and empty texts have no words and no labels; texts of any length are cut into
blocks whole. Words that tie in their counts are ordered by themselves, of blocks that
tie the score is the same. Repeated rows each give a row; extra columns, of whatever
name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.common import ascii_lower

#: Label of each phrase (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as words, by label; the texts are those of the public licenses.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: What tells a label's short notices from others, by label, and words that may not follow it.
KEYS = {"apache": "apache license", "cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa", "gpl": "general public license", "mit": "mit license", "mpl": "mozilla public license"}
OTHER = ("nd", "sa")
BLOCK = 80
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _need(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, percent: int = 80, block: int = BLOCK
) -> DataFrame:
    """Labels of every whole text.

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word (their
    smallest and largest start), base_labels, labels, score: 1 with a phrase, else the
    largest share of a template that a block holds, 0 below the threshold.
    """
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS), "")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))

    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    counted = {r["w"]: r["count"] for r in docs.select(F.explode_outer(held).alias("w")).where("w is not null").groupBy("w").count().collect()}  # a row for each template word
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    sets = [(label, sorted({order[w] for w in t.split()})) for label, t in templates]
    prefixes = [t[: len(t) - _need(len(t), percent) + 1] for _, t in sets]
    starters = sorted({w for w, i in order.items() if any(i in p for p in prefixes)})

    rank = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    spans = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(block // 2)), lambda s: F.slice("words", s, F.lit(block)))
    blocks = F.transform(spans, lambda b: F.array_sort(F.transform(F.array_intersect(b, F.array(*map(F.lit, vocabulary))), lambda w: F.element_at(rank, w))))
    some = F.arrays_overlap("words", F.array(*map(F.lit, starters)))
    texts = texts.withColumn("blocks", F.when(some & (F.size("words") > 0), blocks).otherwise(F.array().cast("array<array<int>>")))

    def starts(phrase: str):
        parts = phrase.split()
        def here(i):
            ok = F.lit(True)
            for k, p in enumerate(parts):
                ok &= F.coalesce(F.get("words", i + k) == p, F.lit(False))
            return ok
        found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        return F.when(F.array_contains("words", parts[-1]), found).otherwise(F.array().cast("array<int>"))

    keys = [KEYS[label] if f" {KEYS.get(label, '-')} " in f" {t} " else None for label, t in templates]
    distinct = sorted({k for k in keys if k})

    def alone(key: str):
        """Starts of a key phrase that no word of OTHER follows."""
        after = lambda p: F.coalesce(F.get("words", p + len(key.split())), F.lit(""))
        return F.filter(starts(key), lambda p: ~after(p).isin(*OTHER))

    def share(which: int):
        """The largest share of a template in a block that meets the threshold, else 0."""
        t, head = sets[which][1], prefixes[which]
        need = _need(len(t), percent)

        def meets(b):
            front = F.slice(b, 1, F.greatest(F.size(b) - need + 1, F.lit(1)))
            shared = F.array_intersect(front, F.array(*map(F.lit, head)))
            i, j = F.array_position(F.array(*map(F.lit, t)), F.get(shared, F.lit(0))), F.array_position(b, F.get(shared, F.lit(0)))
            room = F.least(F.lit(len(t)) - i, F.size(b) - j) + 1
            return (F.size(b) >= need) & (F.size(shared) > 0) & (room >= need)

        def keyed(i):
            if (key := keys[which]) is None:
                return F.lit(True)
            first, last = i * (block // 2), i * (block // 2) + block - len(key.split())
            return F.exists(F.get("keys", F.lit(distinct.index(key))), lambda p: p.between(first, last))

        kept = F.filter("blocks", lambda b, i: meets(b) & keyed(i))
        sizes = F.transform(kept, lambda b: F.size(F.array_intersect(b, F.array(*map(F.lit, t)))))
        best = F.coalesce(F.array_max(sizes), F.lit(0))
        return F.when(best >= need, best / F.lit(len(t))).otherwise(F.lit(0.0))

    shares = F.when(F.size("blocks") > 0, F.array(*[share(i) for i in range(len(sets))])).otherwise(F.array(*[F.lit(0.0)] * len(sets)))

    texts = texts.withColumn("places", F.array(*map(starts, phrases))).withColumn("keys", F.array(*map(alone, distinct)).cast("array<array<int>>")).withColumn("shares", shares)
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    more = F.array_compact(F.array(*[F.when(F.get("shares", F.lit(k)) > 0, F.lit(label)) for k, (label, _) in enumerate(sets)]))
    every = F.flatten("places")
    return texts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.array_max("shares")).cast("double").alias("score"),
    )
