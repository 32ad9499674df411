"""What the text operators share: reading, tables in the shared folder, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set while a table is written: the shuffle files of a query go when it ends, not when the
#: driver collects its garbage, and batches sent to Python stay small, as texts can be long.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a temporary one only where the session names none and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomfield-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/loomfield-{uuid.uuid4().hex}/{name}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """A-Z to lower case, everything else as it is."""
    return F.translate(col, UPPER, LOWER)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): every node v with l, the smallest node that it reaches.

    Labels spread over the edges and then jump along label pointers, so the rounds
    follow the logarithm of the longest path. Links and labels stay in tables.
    """
    both = stored(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("v", "l").alias("l"))
    labels = stored(spark, labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        near = labels.join(seen, "v").select("v", F.col("l").alias("before"), F.least("l", "m").alias("l"))
        up = near.select(F.col("v").alias("l"), F.col("l").alias("top"))
        after = stored(spark, near.join(up, "l").select("v", "before", F.least("l", "top").alias("l")), "labels")
        discard(spark, labels)
        labels = after.select("v", "l")
        if after.where("before <> l").isEmpty():
            discard(spark, both)
            return labels
