"""Pages of a stored, ranked list by position, whatever their depth.

``write_ranked`` range-partitions a list by its order and writes a folder per
range, each row with its place in the range, and beside them the number of
rows before every range. A page reads that index and the ranges its positions
fall into: the cost of page 10 and of page 10 million is the same, where
``orderBy().offset()`` sorts and carries all rows before the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

_LOW = (1 << 33) - 1


def write_ranked(df: DataFrame, order: Sequence[Column], path: str, rows_per_range: int = 1_000_000) -> None:
    """Store ``df`` for ``page`` under ``path``. ``order`` should end in a unique column: rows that it does not part have any order."""
    ranges = max(1, -(-df.count() // rows_per_range))
    (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
     .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(_LOW)).withColumn("_range", F.spark_partition_id())
     .write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows"))
    stored = df.sparkSession.read.schema("_range int").parquet(f"{path}/rows")
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row a range: its place in the order of all, summed in one small task.
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("_first", F.coalesce(before, F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def ranked_rows(spark: SparkSession, path: str) -> int:
    """Number of rows of a stored list."""
    return spark.read.schema("_n bigint").parquet(f"{path}/index").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, offset: int, limit: int, schema: StructType) -> DataFrame:
    """Rows at the positions offset + 1 to offset + limit of a stored list, with ``rank``, their position.

    ``schema`` is that of the list, since an empty one has no files. A page
    beyond the end is short or empty. Only the ranges that hold these
    positions are read: ``limit`` of them at most, as none is empty.
    """
    index = spark.read.schema("_range int, _n bigint, _first bigint").parquet(f"{path}/index")
    hit = index.where((F.col("_first") < offset + limit) & (F.col("_first") + F.col("_n") > offset)).select("_range", "_first").collect() if limit > 0 else []
    stored = StructType([*schema.fields, StructField("_at", LongType()), StructField("_range", IntegerType())])
    rows = spark.read.schema(stored).parquet(f"{path}/rows").where(F.col("_range").isin([r["_range"] for r in hit]))
    firsts = spark.createDataFrame([tuple(r) for r in hit], "_range int, _first bigint")
    ranked = rows.join(firsts, "_range").withColumn("rank", F.col("_first") + F.col("_at") + 1)
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop("_range", "_at", "_first")
