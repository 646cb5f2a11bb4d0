"""What the operators share: the shared folder, words, and work on Arrow batches.

Texts reach Python as UTF-8 bytes (``cast('binary')``), so no string objects are made for them, and
``bytes.split()`` cuts at exactly the characters of ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normalog.sources import scratch

#: White space of every word contract: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that one step in Python holds at once.
STEP_BYTES = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it again: no lineage, one evaluation, safe against lost executors."""
    spark = df.sparkSession
    path = scratch.folder(spark, "cut")
    # the write's shuffle files are of no use afterwards; with this on, Spark drops them when the write ends
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, limit: int = 2 * STEP_BYTES) -> None:
    """Bound the bytes of an Arrow batch: ten thousand long texts in one would be any size."""
    spark.conf.set(BATCH, str(limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def steps(lengths, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) row ranges of about ``limit`` bytes each; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
