"""Places of turns within conversations, whatever a conversation's length.

Rows are dealt by range over (conversation, order, a row's own number), so a
long conversation lies over several ranges and no task gets it whole; rows are
numbered inside a range, and a range's first conversation starts where the
ranges before it left off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import cut_lineage, null_safe_join, shuffle_partitions


def numbered_turns(rows: DataFrame, conv: str, order: list[Column], *, column: str = "pos") -> DataFrame:
    """``rows`` with their place (from 1) in their conversation, stored.

    ``order`` has to tell apart all rows that differ; equal rows are
    interchangeable. A null conversation is a conversation.
    """
    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, F.col(conv).asc_nulls_first(), *order, F.col("__row")).drop("__row")
    dealt = cut_lineage(dealt.withColumn("__range", F.spark_partition_id()), "turn_ranges")

    # a conversation that more than one range has ends or begins a range: one row a range at most
    sizes = dealt.groupBy(conv, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = W.partitionBy(conv).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.sum("__rows").over(earlier)).where("__before IS NOT NULL").drop("__rows")
    before = F.broadcast(cut_lineage(before, "turn_carries"))

    placed = dealt.withColumn("__local", F.row_number().over(W.partitionBy("__range", conv).orderBy(*order)))
    placed = null_safe_join(placed, before, [conv, "__range"], "left")
    place = (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long")
    return cut_lineage(placed.withColumn(column, place).drop("__local", "__before", "__range"), "turn_places")
