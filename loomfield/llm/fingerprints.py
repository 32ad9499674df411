"""Document fingerprints by SpotSigs.

A signature is an anchor (a common word) with the two content words that follow it,
anchors between them left out. A text's fingerprint is the ordered set of its
signatures' hashes. Two fingerprints are compared by Jaccard similarity.

search() finds the fingerprints that are alike to given ones: sets are partitioned by
length so that only a set's own partition and its neighbours can reach the threshold;
inside these, sets of that likeness share one of their rarest signatures (a prefix in
the order of how many sets hold each), and pairs whose lengths keep them under the
threshold are pruned before sets are read.

The next document in the order of ids is found inside ranges of ids, each a group of
its own; only the first row of each range crosses over to the range before. A text is
held by one row at a time, no range is collected.

Only DataFrame functions are used. Null is taken as an empty text, texts of any length
are read whole. A text without signatures has an empty fingerprint; two such texts are
alike to 1 if they are equal, else to 0, and search() finds none for it. Rows that
repeat an id follow one another in the order of their texts. An empty table gives an
empty result; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.llm.common import stored

#: Anchors: common words of the languages at hand (fixed values).
ANCHORS = (
    "a an and are as at be by das de del den der des die du ein eine el en est et for from ich il in is ist it la las le les los mit nicht of on or para "
    "pas por que qui se sich sur that the this to un una und une von was with y zu"
).split()
#: Bytes of text in a range of ids, about.
RANGE_BYTES = 64 << 20
#: Ranges for that many bytes each at most; a larger table takes twice the session's shuffle partitions if that is more.
RANGES = 10_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def with_signatures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the ordered set of signature hashes of a text column."""
    df = df.withColumn("_w", words_of(F.col(text_col)))
    df = df.withColumn("_at", F.filter(F.transform("_w", lambda w, i: F.when(w.isin(ANCHORS), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_c", F.filter("_w", lambda w: ~w.isin(ANCHORS)))
    # The k-th anchor stands behind k others: content words before it are its place less k.
    each = F.transform("_at", lambda i, k: F.when(i - k + 1 < F.size("_c"), F.xxhash64(F.get("_w", i), F.get("_c", i - k), F.get("_c", i - k + 1))))
    return df.withColumn(name, F.sort_array(F.array_distinct(F.array_compact(each)))).drop("_w", "_at", "_c")


def likeness(a: Column, b: Column, same: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without reading them where their lengths keep it under least."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    value = shared / (F.size(a) + F.size(b) - shared)
    return F.when(large == 0, F.when(same, 1.0).otherwise(0.0)).when((small == 0) | (small < large * least), 0.0).otherwise(value).cast("double")


def as_text(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))), "")


def search(spark: SparkSession, prints: DataFrame, queries: DataFrame, least: float = 0.8) -> DataFrame:
    """query_id, doc_id and likeness of all fingerprints alike to a query's to least or more.

    prints and queries have doc_id and s, the signature set. A query finds itself where
    prints has it. Equal sets are compared once and stand for all of their ids.
    """
    part = lambda n: F.floor(F.log(n.cast("double")) / F.lit(-math.log(least)) + 1e-9).cast("int")
    sets = stored(spark, prints.where("size(s) > 0").select("doc_id", "s", F.xxhash64("s").alias("k")), "sets")
    asked = stored(spark, queries.where("size(s) > 0").select("doc_id", "s", F.xxhash64("s").alias("k")), "asked")
    classes = stored(spark, sets.select("k", "s").union(asked.select("k", "s")).distinct(), "classes")
    # Of a set only its key travels with a signature, never the set itself.
    held = classes.select("k", F.explode("s").alias("g"))
    counts = held.groupBy("g").agg(F.count("*").alias("n"))
    # A signature of one set alone only meets itself.
    ranked = held.join(counts.where("n > 1"), "g", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "g"))).alias("r"))
    need = F.size("r") - F.ceil(F.size("r") * F.lit(least) - 1e-9).cast("int") + 1
    front = ranked.select("k", F.size("r").alias("n"), part(F.size("r")).alias("part"), F.explode(F.slice("r", F.lit(1), need)).alias("r")).where("r.n > 1")
    front = stored(spark, front.select("k", "n", "part", F.col("r.g").alias("g")), "index")
    own = front.join(asked.select("k").distinct(), "k", "left_semi")
    own = own.select(F.col("k").alias("qk"), F.col("n").alias("qn"), "g", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    near = F.least("n", "qn") >= F.greatest("n", "qn") * F.lit(least) - 1e-9
    pairs = own.join(front, ["part", "g"]).where(near & (F.col("qk") != F.col("k"))).select("qk", "k").distinct()
    both = pairs.join(classes, "k").join(classes.select(F.col("k").alias("qk"), F.col("s").alias("qs")), "qk")
    found = both.select("qk", "k", likeness(F.col("qs"), F.col("s"), F.lit(False), least).alias("likeness")).where(F.col("likeness") >= least - 1e-12)
    found = found.unionByName(asked.select(F.col("k").alias("qk"), "k", F.lit(1.0).alias("likeness")).distinct())
    return found.join(asked.select(F.col("k").alias("qk"), F.col("doc_id").alias("query_id")), "qk").join(sets.select("k", "doc_id"), "k").select("query_id", "doc_id", "likeness")


def with_next(spark: SparkSession, docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text) with s, next_text and next_s: its signature set, and those of the row that follows by id; the last is followed by the first."""
    docs = docs.select("doc_id", "text")
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8, min(-(-size // RANGE_BYTES), RANGES))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10000).alias("b")).first()["b"] or []  # a number for each range
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))))
    placed = docs.withColumn("r", part)
    own = Window.partitionBy("r").orderBy("doc_id", "text")
    # Only texts are shuffled; sets are made where a range lies, before the window that needs it there.
    inside = with_signatures(placed.repartition("r"), "text", "s").withColumn("after", F.lead(F.struct("text", "s")).over(own))
    firsts = with_signatures(placed.groupBy("r").agg(F.min(F.struct("doc_id", "text")).alias("f")).select("r", "f.text"), "text", "s").select("r", F.struct("text", "s").alias("over"))
    present = sorted(x["r"] for x in placed.select("r").distinct().collect())  # a number for each range
    follows = F.create_map(*[F.lit(x) for a, b in zip(present, present[1:] + present[:1], strict=True) for x in (b, a)]) if present else F.create_map(F.lit(0), F.lit(0))
    firsts = firsts.select(follows[F.col("r")].alias("r"), F.lit(True).alias("last"), "over")
    found = inside.withColumn("last", F.col("after").isNull()).join(firsts, ["r", "last"], "left").withColumn("after", F.coalesce("after", "over"))
    return found.select("doc_id", "text", "s", F.col("after.text").alias("next_text"), F.col("after.s").alias("next_s"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def prints_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and s, the signature set, of every document."""
    return with_signatures(_texts(docs, id_col, text_col), "text", "s")


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last half (rounded down) replaced by as much of the start of
    the next document, or all of it.
    """
    df = with_next(spark, _texts(docs, id_col, text_col)).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    df = with_signatures(df, "edited", "edited_s")
    return df.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("edited_s")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("edited_s"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("s"), F.col("next_s"), F.col("text") == F.col("next_text")).alias("near_next"),
    )
