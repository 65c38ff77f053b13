"""Running numbers over a whole table without all of it in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with the column name: start, start + 1, … in the order of the columns. Rows are dealt out by range; each
    part counts from where the parts before it end. One number a part comes to the driver."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    ends = accumulate((n for _, n in counts), initial=start - 1)
    before = rows.sparkSession.createDataFrame([(p, e) for (p, _), e in zip(counts, ends)], "__part int, __before long")
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__before")
