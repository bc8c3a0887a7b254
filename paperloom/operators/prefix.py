"""Running sums over all rows in an order, without one task that sees them all.

Rows are dealt out by ranges of (keys, order) and sorted inside each range; a task adds up its own rows and
writes them with sums from its range's start. Each range then has one small summary for each key it holds:
the number of its rows, their sum and the least sum on the way. A scan over the summaries of a key gives
what lies before each range, which is added to the rows. The summaries of one key are a row for each range
that it reaches into, so no window group grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL = ("local_no", "local_sum", "local_least")
_LONG = T.LongType()


def _own_sums(keys: int):
    """Adds the range's number and the sums from its start (from each key's first row in it) to sorted rows; the last column is what is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, no, total, least = None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = [batch.column(k) for k in range(keys)]
            new = np.zeros(n, dtype=bool)
            new[0] = held is None or held != [c[0].as_py() for c in own]
            for c in own:
                if n > 1:
                    one, two = c.slice(0, n - 1), c.slice(1)
                    equal = pc.fill_null(pc.equal(one, two), False).to_numpy(zero_copy_only=False) | (pc.is_null(one).to_numpy(zero_copy_only=False) & pc.is_null(two).to_numpy(zero_copy_only=False))
                    new[1:] |= ~equal
            value = pc.fill_null(batch.column(batch.num_columns - 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(new)
            bounds = np.unique(np.concatenate([[0], starts, [n]]))
            numbers, sums, leasts = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if new[a]:
                    no, total, least = 0, 0, np.iinfo(np.int64).max
                numbers[a:b] = no + 1 + np.arange(b - a)
                sums[a:b] = total + np.cumsum(value[a:b])
                leasts[a:b] = np.minimum(least, np.minimum.accumulate(sums[a:b]))
                no, total, least = int(numbers[b - 1]), int(sums[b - 1]), int(leasts[b - 1])
            held = [c[n - 1].as_py() for c in own]
            more = [pa.array(np.full(n, part, dtype=np.int64)), pa.array(numbers), pa.array(sums), pa.array(leasts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", *_LOCAL])

    return run


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, path: str) -> DataFrame:
    """rows with line_no, running and least: number, sum of value and least such sum so far, within keys, in order.

    value is a whole number, null counts as 0. Without keys, all rows are one sequence. Rows that order
    doesn't tell apart come in any order. path is a new folder that all executors share: the rows are
    written there once, so that ranges stay what they are.
    """
    columns = [c for c in rows.columns if c not in keys]
    sorted_rows = rows.select(*keys, *columns, value.cast("long").alias("summed")).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*sorted_rows.schema, T.StructField("part", _LONG), *(T.StructField(c, _LONG) for c in _LOCAL)])
    sorted_rows.mapInArrow(_own_sums(len(keys)), schema).write.parquet(path)
    told = rows.sparkSession.read.schema(schema).parquet(path)

    summaries = told.groupBy("part", *keys).agg(F.max("local_no").alias("n"), F.max_by("local_sum", "local_no").alias("total"), F.min("local_least").alias("low"))
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = summaries.select("part", *keys, "total", "n", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("sum_before"))
    ahead = ahead.withColumn("least_before", F.min(F.col("sum_before") + F.col("low")).over(before))
    # A range goes on from another one with its first key only: a row for each range at most.
    ahead = ahead.where("n_before > 0").select(F.col("part").alias("at_part"), *[F.col(k).alias(f"at_{k}") for k in keys], "n_before", "sum_before", "least_before")
    same = F.col("part") == F.col("at_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"at_{k}"))
    joined = told.join(F.broadcast(ahead), same, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    running_sum = F.col("local_sum") + zero("sum_before")
    least = F.least(F.col("local_least") + zero("sum_before"), F.col("least_before"))
    return joined.select(*rows.columns, (F.col("local_no") + zero("n_before")).alias("line_no"), running_sum.alias("running"), least.alias("least"))
