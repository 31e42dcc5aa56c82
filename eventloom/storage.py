"""Tables in the folder that all executors share, to cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one of our own only in local mode, where the setting is unset (tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of a partition, about, where an operator chooses the number of partitions.
PIECE_ROWS = 1 << 20


def pieces(df: DataFrame) -> int:
    """Spark's own number of shuffle partitions, or more, so that a partition of df has PIECE_ROWS rows on average."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PIECE_ROWS))


def numbered(df: DataFrame, order: list[str], column: str, first: int = 1) -> DataFrame:
    """df with successive numbers in an order: ranges are sorted apart, and shifted by the sizes of those
    before them (a row for each range)."""
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    rows = stage(own, "numbered")
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    before = F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    shift = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(before, F.lit(0)).alias("__shift"))
    return rows.withColumn("__at", within).join(shift, "__range").withColumn(column, (F.col("__at") + F.col("__shift") + (first - 1)).cast("long")).drop("__range", "__at", "__shift")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
