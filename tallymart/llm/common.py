"""Helpers shared by the training-data operators: tables, batches, values bound once, words.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``, so that losing an
executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401
from ..sources.scratch import forget, shared_folder, written  # noqa: F401

WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(parts, rows: int = 1000, size: int = 8 << 20):
    """A task's Arrow batches (which Spark cuts at 64 MB) in slices of about so many rows and bytes; a longer row is one slice."""
    for part in parts:
        step = max(1, min(rows, part.num_rows * size // max(part.nbytes, 1)))
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row: inside lambdas, a column put in place would be computed again each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Splitting at the gaps takes a quarter of the time of counting matches."""
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITE), "")).cast("long")


def before(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """rows with, for each name=column, the sum of the column over all rows that come earlier in the order.

    The rows are dealt by ranges of the order; what earlier ranges hold is added to a running sum inside the range, so that no
    task sees more than a range. The sums of the ranges are one row for each.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    both = own.join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    return both.select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])
