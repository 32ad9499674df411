"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity says little and containment
counts: the share of an item's word shingles that a document holds. An item is
queried by the shingles that are its MinHash values under several permutations; each
is in a document with the probability of the containment. Documents are partitioned
by the power of two of their set size, and an item looks only into partitions that
are large enough to hold the threshold's share of it. Every candidate is then
verified by exact containment on the whole sets.

With 16 permutations an item that is contained to 0.8 is missed with probability
0.2 ** 16 = 7e-12.

Only DataFrame functions are used. Null, empty and blank texts have no shingles and
match nothing; a text of fewer words than the width is one shingle. Texts of any length
are read whole. Rows that repeat a document or an item give one row; an id with several
texts holds what any of them holds, and so do rows without an id, together. Shingles that tie for a minimum give one query row.
Extra columns, of whatever name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Signature rows up to so many are sent to the executors; more are joined by a shuffle.
SENT = 200_000


def plain_words(text):
    """Words of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """A row of keep, n (words, less width - 1) and s for each run of width words in df.words; one for a shorter text.

    A text without words has one row with s null. Places are exploded before the hash,
    so that hashing is compiled and needs no array of them.
    """
    last = F.when(F.size("words") > 0, F.greatest(F.size("words") - width, F.lit(0)))
    at = df.select(*keep, "words", F.explode_outer(F.sequence(F.lit(0), last)).alias("i"))
    s = F.xxhash64(*[F.get("words", F.col("i") + k) for k in range(width)])
    return at.select(*keep, F.greatest(F.size("words") - width + 1, F.lit(1)).alias("n"), F.when(F.col("i").isNotNull(), s).alias("s"))


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 80, width: int = 5, permutations: int = 16) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every item that a document holds to percent or more."""
    words = items.select(F.col(item_col).alias("item_id"), plain_words(F.col("text")).alias("words"))
    own = shingles(words, ["item_id"], width).where("s is not null").groupBy("item_id").agg(F.collect_set("s").alias("sh"))
    own = stored(spark, own, "items")
    need = F.ceil(F.size("sh") * percent / F.lit(100))
    least = F.array(*[F.array_min(F.transform("sh", lambda s, k=k: F.struct(F.xxhash64(s, F.lit(k)).alias("h"), s.alias("s")))).getField("s") for k in range(permutations)])
    query = stored(spark, own.select("item_id", F.explode(F.array_distinct(least)).alias("s"), F.floor(F.log2(need)).cast("int").alias("part")).distinct(), "query")
    query = F.broadcast(query) if query.count() <= SENT else query

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = texts.select("doc_id", plain_words(F.col("text")).alias("words"))
    index = shingles(words, ["doc_id"], width).select("doc_id", F.floor(F.log2("n")).cast("int").alias("size_part"), "s")
    found = index.join(query, (index.s == query.s) & (index.size_part >= query.part)).select("doc_id", "item_id").distinct()
    found = stored(spark, found, "candidates")

    # Verified on every shingle of the items found, counted where the candidates' documents hold them.
    wanted = found.join(own.select("item_id", F.size("sh").cast("long").alias("n_item"), F.explode("sh").alias("s")), "item_id")
    met = found.select(F.col("doc_id").alias("met")).distinct()
    held = texts.join(met, F.col("doc_id").eqNullSafe(F.col("met")), "left_semi").select(F.col("doc_id").alias("held"), plain_words(F.col("text")).alias("words"))
    pairs = shingles(held, ["held"], width).withColumnRenamed("s", "own").join(wanted, F.col("held").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("s")))
    shared = pairs.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("s").alias("n_shared"))
    kept = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return kept.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
