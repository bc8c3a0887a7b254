"""As-of joins: to each row the newest row of another table at or before it, without a range join.

Both tables go into one order by ranges of (keys, time), so no key has to fit into a task. A task walks its
range once and carries the last right row along. What reaches over the border of ranges are one row a range,
the last right row before it with the key that the range begins with; it fills what the walk left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of written rows: a left row, the last right row of a key in a range, the key that a range begins with.
_LEFT, _LAST, _FIRST = 0, 1, 2


def _equal_before(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has the keys of the row before it; nulls are equal."""
    n = len(columns[0])
    same = np.ones(max(0, n - 1), dtype=bool)
    for c in columns:
        one, two = c.slice(0, n - 1), c.slice(1)
        equal = pc.fill_null(pc.equal(one, two), False).to_numpy(zero_copy_only=False)
        same &= equal | (pc.is_null(one).to_numpy(zero_copy_only=False) & pc.is_null(two).to_numpy(zero_copy_only=False))
    return same


def _walked(keys: int):
    """Rows (keys, is_left, left struct, right struct) in order, as rows (part, kind, keys, left struct, right struct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own, is_left, left, right = [batch.column(k) for k in range(keys)], batch.column(keys), batch.column(keys + 1), batch.column(keys + 2)
            now = [c[0].as_py() for c in own]
            new = np.concatenate([[held is None or held != now], ~_equal_before(own)])
            out = []

            def row(kind: int, key: list, value, own=own, left=left, right=right) -> list[pa.Array]:
                return [pa.array([part], pa.int64()), pa.array([kind], pa.int32()), *[pa.array([k], c.type) for k, c in zip(key, own, strict=True)], pa.nulls(1, left.type), pa.array([value], right.type)]

            if held is None:
                out.append(row(_FIRST, now, None))
            elif new[0] and last is not None:
                out.append(row(_LAST, held, last))
            if new[0]:
                last = None
            # The place of the newest right row at or before each row, within its key; -1: the one carried, -2: none.
            at = np.where(is_left.to_numpy(zero_copy_only=False).astype(bool), -1, np.arange(n))
            key_start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            newest = np.maximum.accumulate(at)
            first_key = np.cumsum(new) - new[0] == 0
            newest = np.where(newest >= key_start, newest, np.where(first_key, -1, -2)) if n else newest
            lefts = np.flatnonzero(at == -1)
            pool = pa.concat_arrays([right, pa.array([last], right.type)])
            index = newest[lefts]
            taken = pool.take(pa.array([n if i == -1 else None if i == -2 else i for i in index.tolist()], pa.int64()))
            rows = [pa.array(np.full(len(lefts), part, dtype=np.int64)), pa.array(np.full(len(lefts), _LEFT, dtype=np.int32)), *[c.take(pa.array(lefts)) for c in own], left.take(pa.array(lefts)), taken]
            out.append(rows)
            # The last right row of each key that ends in this batch.
            for end in np.flatnonzero(new[1:]).tolist():
                i = int(newest[end])
                value = last if i == -1 else None if i == -2 else right[i].as_py()
                if value is not None:
                    out.append(row(_LAST, [c[end].as_py() for c in own], value))
            i = int(newest[n - 1])
            last = last if i == -1 else None if i == -2 else right[i].as_py()
            held = [c[n - 1].as_py() for c in own]
            names = ["part", "kind", *batch.schema.names[:keys], "l", "r"]
            yield from pa.Table.from_batches([pa.RecordBatch.from_arrays(o, names=names) for o in out]).combine_chunks().to_batches()
        if held is not None and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([_LAST], pa.int32()), *[pa.array([k], c.type) for k, c in zip(held, own, strict=True)], pa.nulls(1, left.type), pa.array([last], right.type)], names=names)

    return run


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: list[str], path: str) -> DataFrame:
    """Each row of left with the newest row of right with the same keys whose `time` isn't later: left's columns, and right's as right_<name>.

    keys and time are columns of both. Of right rows at the same time the greatest by the columns `tie`
    counts. Nulls are equal keys; rows of left with a null time match nothing, and right rows with one are never found.
    Left rows that find nothing have nulls. path is a new folder that all executors share; rows are written
    there once, so that ranges stay what they are.
    """
    stamped = right.where(F.col(time).isNotNull())
    shape = T.StructType([left.schema[k] for k in keys])
    lefts = left.select(*keys, F.col(time).alias("_at"), F.lit(True).alias("is_left"), F.struct(*left.columns).alias("l"), F.lit(None).cast(_struct(right)).alias("r"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{k}") for k, t in enumerate(tie)])
    rights = stamped.select(*[F.col(k).cast(left.schema[k].dataType).alias(k) for k in keys], F.col(time).alias("_at"), F.lit(False).alias("is_left"), F.lit(None).cast(_struct(left)).alias("l"), F.struct(*right.columns).alias("r"), *[F.col(t).alias(f"_tie{k}") for k, t in enumerate(tie)])
    order = [*keys, "_at", "is_left", *[f"_tie{k}" for k in range(len(tie))]]
    both = lefts.unionByName(rights).repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, "is_left", "l", "r")
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()), *[T.StructField(f.name, f.dataType) for f in shape], T.StructField("l", _struct(left)), T.StructField("r", _struct(right))])
    both.mapInArrow(_walked(len(keys)), schema).write.parquet(path)
    told = left.sparkSession.read.schema(schema).parquet(path)

    # A row for each range and for each key that has right rows in it.
    ends = told.where(F.col("kind").isin(_LAST, _FIRST)).select("part", "kind", *keys, "r")
    ends = ends.withColumn("before", F.last(F.when(F.col("kind") == _LAST, F.struct("part", "r")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)))
    carried = ends.where((F.col("kind") == _FIRST) & F.col("before").isNotNull()).select(F.col("part").alias("at_part"), *[F.col(k).alias(f"at_{k}") for k in keys], F.col("before.r").alias("carried"))
    same = F.col("part") == F.col("at_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"at_{k}"))
    rows = told.where(F.col("kind") == _LEFT).join(F.broadcast(carried), same, "left")
    found = F.when(F.col(f"l.{time}").isNotNull(), F.coalesce("r", "carried"))
    return rows.select("l.*", found.alias("found")).select(*left.columns, *[F.col(f"found.{c}").alias(f"right_{c}") for c in right.columns])


def _struct(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
