"""Running sums and places within keys, over range blocks.

Rows are sorted by key and order into range blocks and written once with their block.  Sums run within (block, key);
what earlier blocks of the key add up to is a row a block and key, and is added.  A key that holds all rows is
spread over all blocks, so no task holds more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

C = F.col


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, least: bool = False) -> DataFrame:
    """Add the sum (``least``: the least) of ``value`` over the rows of the key up to each row, in a total order, and ``<name>_all`` over all rows of the key."""
    total, nothing = (F.min, None) if least else (F.sum, 0)
    rows = df.withColumn("_v", value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    rows, _ = graph.stored(rows)
    per = rows.groupBy(*keys, "_part").agg(total("_v").alias("_sum"))
    before, whole = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    per = per.withColumn("_before", F.coalesce(total("_sum").over(before), F.lit(nothing))).withColumn("_all", total("_sum").over(whole)).drop("_sum")
    local = total("_v").over(Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("_local", local).join(per, [*[rows[k].eqNullSafe(per[k]) for k in keys], rows["_part"] == per["_part"]]).drop(*[per[k] for k in keys], per["_part"])
    upto = F.least("_local", "_before") if least else C("_local") + C("_before")
    return met.withColumn(name, upto).withColumn(f"{name}_all", C("_all")).drop("_v", "_part", "_row", "_local", "_before", "_all")


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of each row in its key, from 1, and the number of rows of the key as ``<name>_all``."""
    return running(df, keys, order, F.lit(1).cast("long"), name)
