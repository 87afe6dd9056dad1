"""Session helpers that the operators share: partition counts, tables written between steps, small-table checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of stored input that one partition of a packed exchange should take.
TARGET_BYTES = 12 << 20
#: Rows of a few numbers that one file of a table between steps should take.
ROWS_A_FILE = 1 << 18
#: Estimates from here on mean that Catalyst does not know.
UNKNOWN_BYTES = 1 << 60


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared spark.checkpoint.dir. Only a local session (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/folioframe-{uuid.uuid4().hex}"


def persisted(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back, which cuts lineage and survives lost executors."""
    spark = spark_of(df)
    path = f"{scratch_dir(spark)}-{label}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """`df` of at most `rows` narrow rows in no more partitions than they need, so that rounds over small tables do not
    write a file for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan; for scans, the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame) -> int:
    """Partitions for `df`: the session's shuffle partitions, or more where the stored size asks for more.

    They grow with the table, so that buckets and key ranges keep their size; from a few hundred GB on, the blocks between
    two buckets hold few keys each, and at 100 TB a packed exchange is a plain shuffle of keys."""
    spark = spark_of(df)
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    size = stored_bytes(df)
    if size >= UNKNOWN_BYTES:
        return max(1, least)
    return max(1, least, -(-size // TARGET_BYTES))


def bucketed(df: DataFrame, key: str, extra: str, parts: int, name: str = "src") -> DataFrame:
    """`df` with a bucket number from (key, length of extra), dealt out by that bucket. There are two buckets a
    partition, so that no partition is far above the mean."""
    n = 2 * parts
    bucket = F.pmod(F.xxhash64(F.col(key), F.octet_length(F.col(extra))), F.lit(n)).cast("int")
    return df.withColumn(name, bucket).repartition(parts, name)
