"""A training corpus in five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared folder and reads it back as the next one's docs. All but the
last keep the columns of documents.

In every stage null texts count as empty ones, texts of any length are read whole, extra
columns are dropped, and empty tables give empty results. Filtering stages decide by a
key of id and text, so that rows with null or repeated ids are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import stored, table
from loomfield.llm.decontaminate import contained
from loomfield.llm.mixing import mix
from loomfield.llm.ngram_join import ngram_join
from loomfield.llm.pii import sanitise
from loomfield.llm.queries import TARGETS
from loomfield.llm.toxicity import classify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key, by which a stage decides: rows of one id and text share it, null or not, no others do."""
    return docs.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from all labels. Rows of one text share its fate; repeats stay."""
    judged = classify(spark, keyed(docs), table(spark, sf_dir, "labels"), key_col="key")
    rejected = judged.where("predicted = 1").select("key").distinct()
    return keyed(docs).join(rejected, "key", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect, of the smallest id (null last, ties by key); of repeated rows one. Texts without words stay, one a key."""
    rows = keyed(docs)
    groups = ngram_join(spark, rows.select("key", "text"), id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", "doc_id").distinct().join(groups, "key")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key")
    kept = ids.groupBy("component_id").agg(F.min(order)["key"].alias("key")).select("key")
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 %; repeats stay. Items that are null or empty reject nothing."""
    rows = keyed(docs)
    own = rows.select(F.col("key").alias("doc_id"), "text")
    found = contained(spark, own, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return rows.join(found, "key", "left_anti").select(*COLUMNS)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeats too, with personal data generalised in their texts; a null text becomes an empty one."""
    clean = sanitise(spark, docs, keep=("lang", "source"))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampling rate for each document, repeats too, that brings languages to their target shares; without tokens any rate serves."""
    return mix(spark, docs, table(spark, sf_dir, "labels"), TARGETS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise_personal_data),
    ("mixing", mix_sources),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
