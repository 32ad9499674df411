"""N-gram Jaccard join by a token-group matrix.

Texts are sets of word shingles. Equal sets form one class, and only classes are
compared. Every class has an order of its tokens (those that few classes hold
first, by hash, hot ones last, by count) and a prefix of it; two classes of
Jaccard similarity t or more share a token of their prefixes, so a matrix of
prefix tokens and groups is enough to bound how much of a query a group can hold.

* Tokens held by few classes are joined directly; lengths, and the number and places
  of the tokens that a pair shares, bound its similarity.
* For hot tokens the matrix has one row for each group instead of one for each
  class. The first groups gather around a leader (the member with the fewest rare
  tokens), whose members are verified against it; verified links make components,
  and these are the groups then. The matrix holds the union of a group's tokens; how
  much of it a query class shares, and their lengths, bound the similarity to every
  member, and a group is opened only where the bound leaves room for t.
* Pairs inside one component need no further look: they are connected already.

Every candidate is verified on the whole sets. No candidate is capped, and no step
compares all pairs of a group of copies: copies cost one row each.

Null, empty and blank texts have an empty set and link with nothing. Texts of any
length are read whole. Repeated ids with one text fall into one class; an id with two
texts must be told apart by its caller. Of leaders that tie the smallest id leads. Extra
columns of the input, of whatever name, are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.arrays import SPACE, groups, lists, mix, ragged, shingles_of, words_of
from loomfield.llm.common import components, discard, stored

SET_SCHEMA = "id long, n long, d1 long, d2 long, tokens array<long>"
POSTING_SCHEMA = "t long, id long, n long, pos int, rare int, hot boolean"


def prefix(n, percent: int):
    """Tokens of a set of n that a set of similarity percent or more must meet."""
    return n - -(-n * percent // 100) + 1


def short_prefix(n, percent: int):
    """The same for partners of at least n tokens."""
    return n - -(-n * 2 * percent // (100 + percent)) + 1


def _stored_tokens(n, percent: int):
    return np.minimum(n, prefix(n, percent) * 3 // 2 + 8)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, .. values, modulo 2 ** 64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums


def _sets(percent: int, width: int, whole: bool):
    """Batches (id, text) to SET_SCHEMA; whole: with all tokens, else with the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in groups(texts):
                s, at = shingles_of(*words_of(texts.slice(a, b - a), SPACE), width)
                n = np.diff(at)
                d1, d2 = (_sums(mix(x)) for x in (s + np.uint64(11), s ^ np.uint64(0x5DEECE66D)))
                digest = [pa.array((d[at[1:]] - d[at[:-1]]).view(np.int64)) for d in (d1, d2)]
                if not whole:
                    keep = np.where(n > 0, _stored_tokens(n, percent), 0)
                    row = np.repeat(np.arange(len(n)), n)
                    s = s[np.arange(len(s)) - at[row] < keep[row]]
                    at = np.concatenate([[0], np.cumsum(keep)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(n), *digest, lists(s, at)], ["id", "n", "d1", "d2", "tokens"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that arrays over tokens stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _postings(hot: tuple[np.ndarray, np.ndarray], percent: int, whole: bool):
    """Batches (id, n, tokens) to POSTING_SCHEMA; a row t = null asks for the whole set. hot: tokens and their counts."""
    hot, counts = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            s, at = ragged(batch.column(2))
            size = np.diff(at)
            row = np.repeat(np.arange(len(ids)), size)
            at_hot = np.minimum(np.searchsorted(hot, s), max(len(hot) - 1, 0))
            is_hot = hot[at_hot] == s if len(hot) else np.zeros(len(s), bool)
            order = np.lexsort((s, np.where(is_hot, counts[at_hot], 0) if len(hot) else is_hot, row))
            s, is_hot = s[order], is_hot[order]
            pos = np.arange(len(s)) - at[row]
            rare = np.bincount(row[~is_hot], minlength=len(ids))
            need = prefix(n, percent)
            lacks = (rare < need) & (size < n) & (not whole)
            keep = (pos < need[row]) & ~lacks[row]
            r = row[keep]
            out = [s[keep].view(np.int64), ids[r], n[r], pos[keep].astype(np.int32), np.minimum(rare, need)[r].astype(np.int32), is_hot[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["t", "id", "n", "pos", "rare", "hot"])
            if lacks.any():
                k, x = int(lacks.sum()), lacks
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(ids[x]), pa.array(n[x]), pa.array(np.zeros(k, np.int32)), pa.array(np.zeros(k, np.int32)), pa.array(np.zeros(k, bool))], ["t", "id", "n", "pos", "rare", "hot"])

    return run


def _overlap(percent: int, x: str, y: str):
    """Tokens that sets of these sizes must share."""
    return F.ceil((F.col(x) + F.col(y)) * percent / F.lit(100 + percent))


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of met (a, b, na, nb, pa, pb: a row for each shared prefix token) that the counts leave room for.

    Both sets have one order of tokens, so all that they share up to the last shared
    token of their prefixes is counted, and the rest stands behind it in both.
    """
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    return pairs.where(F.col("k") - 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _overlap(percent, "na", "nb")).select("a", "b")


def _met(x: str, y: str) -> list:
    """The columns that _candidates reads, with the smaller id as b."""
    first = F.col(f"{x}.id") > F.col(f"{y}.id")
    pick = lambda p, q, name: F.when(first, F.col(f"{p}.{name}")).otherwise(F.col(f"{q}.{name}"))
    return [pick(p, q, name).alias(alias) for alias, p, q, name in (("a", x, y, "id"), ("b", y, x, "id"), ("na", x, y, "n"), ("nb", y, x, "n"), ("pa", x, y, "pos"), ("pb", y, x, "pos"))]


def _near_sizes(percent: int, x: str, y: str):
    return F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(shared * 100 >= (F.size("ta") + F.size("tb") - shared) * percent).select("a", "b")


def _hottest(sets: DataFrame, few: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that more than few sets hold, the most frequent first up to a limit, in ascending order, and their counts."""
    counts = sets.select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") > few)
    found = counts.orderBy(F.desc("count"), "t").limit(limit).toPandas()
    return _merged(found["t"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64))


def _merged(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in ascending order, each with its largest count."""
    order = np.lexsort((-counts, tokens))
    tokens, first = np.unique(tokens[order], return_index=True)
    return tokens, np.minimum(counts[order][first], np.iinfo(np.int32).max).astype(np.int32)


def _leaves_room(percent: int, low: str, high: str, other_low: str, other_high: str):
    """Whether k shared prefix tokens leave room for a pair of sizes in these ranges.

    Up to the end of one of the two prefixes all shared tokens are counted; behind it
    that set has its size less its prefix.
    """
    least = lambda x, y: F.greatest(F.col(x), F.ceil(F.col(y) * percent / F.lit(100)))
    most = lambda x, y: F.least(F.col(x), F.floor(F.col(y) * 100 / F.lit(percent)))
    behind = F.ceil(F.greatest(most(high, other_high), most(other_high, high)) * percent / F.lit(100)) - 1
    need = F.ceil((least(low, other_low) + least(other_low, low)) * percent / F.lit(100 + percent))
    return F.col("k") + behind >= need


def _opened(spark: SparkSession, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups that rows (t, id, n, pos, g) of hot prefix tokens leave room for.

    A pair that shares a rare prefix token is not looked for here: the direct way has
    it. Others share hot tokens only, so counts of these bound them: where two groups
    meet, for each class of the smaller one against the union of the larger one, and
    then for the members of the groups that are opened.
    """
    held = F.col("pos") < F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)) + 1
    matrix = rows.groupBy("t", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.bool_or(held).alias("held"))
    several = matrix.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
    matrix = stored(spark, matrix.join(several, "t", "left_semi"), "matrix")

    # The first token that two sets share stands in the short prefix of the smaller one.
    sizes = (F.col("h.low") <= F.col("q.high")) & (F.col("h.high") * 100 >= F.col("q.low") * percent)
    met = matrix.alias("q").join(matrix.where("held").alias("h"), (F.col("q.t") == F.col("h.t")) & (F.col("q.g") != F.col("h.g")) & sizes)
    met = stored(spark, met.select(F.least("q.g", "h.g").alias("gx"), F.greatest("q.g", "h.g").alias("gy")).distinct(), "met")

    # A class: its hot prefix tokens (one document's), in place of a row for each.
    classes = stored(spark, rows.groupBy("id", "n", "g").agg(F.collect_list("t").alias("hot")), "hot_sets")
    many = classes.groupBy("g").agg(F.count("*").alias("m"))
    met = met.join(many.select(F.col("g").alias("gx"), F.col("m").alias("mx")), "gx").join(many.select(F.col("g").alias("gy"), F.col("m").alias("my")), "gy")
    swap = F.col("mx") > F.col("my")
    met = met.select(F.when(swap, F.col("gy")).otherwise(F.col("gx")).alias("g"), F.when(swap, F.col("gx")).otherwise(F.col("gy")).alias("big"))
    query = met.join(rows.select("g", "t", "id", "n"), "g").join(matrix.select(F.col("g").alias("big"), "t", "low", "high"), ["big", "t"])
    query = query.groupBy("id", "n", "big").agg(F.count("*").alias("k"), F.min("low").alias("low"), F.max("high").alias("high")).where(_leaves_room(percent, "n", "n", "low", "high")).select("id", "big")

    x = query.join(classes.drop("g"), "id").select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("hot").alias("hx"), "big")
    y = classes.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("hot").alias("hy"), F.col("g").alias("big"))
    k = F.size(F.array_intersect("hx", "hy"))
    near = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    room = k + F.ceil(F.greatest("nx", "ny") * percent / F.lit(100)) - 1 >= _overlap(percent, "nx", "ny")
    pairs = x.join(y, "big").where(near & (k > 0) & room)
    return stored(spark, pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "opened")


def ngram_join(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, few: int = 4, hot_limit: int = 1 << 20
) -> DataFrame:
    """Each document with its set size, the class of equal sets and the component of links.

    Two documents link when 100 * intersection >= percent * union of their shingle
    sets of width words. few: classes up to which a token counts as rare;
    such tokens give few pairs each, whatever the size of the input. hot_limit
    bounds the hottest tokens of each count that are sent to the executors (12 bytes each); it
    only orders tokens, and any order gives the same links.

    Returns doc_id, n_shingles, class_id, component_id.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stored(spark, texts.mapInArrow(_sets(percent, width, False), SET_SCHEMA), "prefixes")
    classes = stored(spark, sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("cls")), "classes")
    members = sets.select("id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left").select("id", "n", "cls")
    members = stored(spark, members, "members")
    chosen = stored(spark, sets.join(classes.select("cls", "d1", "d2"), (F.col("id") == F.col("cls")) & (sets.d1 == classes.d1) & (sets.d2 == classes.d2), "left_semi").select("id", "n", "tokens").dropDuplicates(["id"]), "chosen")
    discard(spark, sets)

    hot = _hottest(chosen, few, hot_limit)

    # Sets without enough rare tokens among their first are read whole; what is frequent among these is hot, too.
    def whole_sets(ids: DataFrame) -> DataFrame:
        own = texts.join(ids, "id", "left_semi").dropDuplicates(["id"])
        return stored(spark, own.mapInArrow(_sets(percent, width, True), SET_SCHEMA).select("id", "n", "tokens"), "whole")

    crowded = whole_sets(stored(spark, chosen.mapInArrow(_postings(hot, percent, False), POSTING_SCHEMA).where("t is null").select("id"), "crowded"))
    hot = _merged(*(np.concatenate(x) for x in zip(hot, _hottest(crowded, few, hot_limit), strict=True)))
    discard(spark, crowded)

    some = stored(spark, chosen.mapInArrow(_postings(hot, percent, False), POSTING_SCHEMA), "postings")
    rest = whole_sets(some.where("t is null").select("id"))
    rest = stored(spark, rest.mapInArrow(_postings(hot, percent, True), POSTING_SCHEMA), "postings")
    discard(spark, chosen)
    postings = some.where("t is not null").unionByName(rest)

    rare = postings.where("not hot").select("t", "id", "n", "pos")
    direct = _candidates(rare.alias("x").join(rare.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.id") > F.col("y.id")) & _near_sizes(percent, "x", "y")).select(*_met("x", "y")), percent)

    warm = stored(spark, postings.where("hot").select("t", "id", "n", "pos", "rare"), "hot")
    lead = warm.groupBy("t").agg(F.min(F.struct("rare", "id", "n", "pos")).alias("m")).select("t", "m.id", "m.n", "m.pos")
    around = warm.alias("x").join(lead.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.id") != F.col("y.id")) & _near_sizes(percent, "x", "y")).select(*_met("x", "y")).select("a", "b")
    first = stored(spark, direct.union(around).distinct(), "pairs")
    discard(spark, some, rest)
    wanted = first.select(F.col("a").alias("id")).union(first.select("b")).union(warm.select("id")).distinct()
    whole = stored(spark, texts.join(wanted, "id", "left_semi").mapInArrow(_sets(percent, width, True), SET_SCHEMA).select("id", "tokens").dropDuplicates(["id"]), "sets")
    links = stored(spark, _verified(first, whole, percent), "verified")
    groups_ = components(spark, links)

    # The matrix of hot tokens and groups: each group's union of prefix tokens. Only groups that leave room are opened.
    rows = stored(spark, warm.join(groups_.withColumnRenamed("v", "id"), "id", "left").withColumn("g", F.coalesce("l", "id")).drop("l", "rare"), "grouped")
    if not (more := _opened(spark, rows, percent)).isEmpty():
        more = stored(spark, more.join(first, ["a", "b"], "left_anti"), "more")
        if not (found := stored(spark, _verified(more, whole, percent), "verified")).isEmpty():
            groups_ = components(spark, links.union(found))
    discard(spark, whole)

    # A component's smallest document is its smallest class: a class is named by its smallest member.
    found = members.join(groups_.withColumnRenamed("v", "cls"), "cls", "left")
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("cls", "id").alias("class_id"), F.coalesce("l", "cls", "id").alias("component_id")
    )
