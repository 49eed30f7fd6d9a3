"""Running totals over a whole table in a given order, without a task that sees it all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import cut


def running_totals(df: DataFrame, order: list, values: dict[str, str]) -> DataFrame:
    """Adds for each {out: column} of longs the inclusive running total of the column in the order given.

    The rows are range-partitioned and sorted; each partition adds up its own rows, after the totals of the partitions
    before it. Only a row for each partition is broadcast.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*(F.sum(c).alias(out) for out, c in values.items()))
    starts = sums.select("__part", *(F.coalesce(F.sum(out).over(before), F.lit(0)).alias(f"__before_{out}") for out in values))

    names, outs = [*df.columns, "__part"], list(values.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {out: 0 for out, _ in outs}
        for batch in batches:
            added = []
            for out, c in outs:
                own = np.cumsum(batch.column(names.index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + total[out]
                total[out] = int(own[-1]) if len(own) else total[out]
                added.append(pa.array(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *(out for out, _ in outs)])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields), *(f"`{out}` bigint" for out in values)])
    summed = ranged.mapInArrow(run, fields).join(F.broadcast(starts), "__part")
    return summed.select(*df.columns, *((F.col(out) + F.col(f"__before_{out}")).alias(out) for out in values))
