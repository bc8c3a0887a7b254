"""A stored substring index: for each trigram of characters the ids of the documents that hold it.

Documents are read in blocks. A block writes one row for each of its trigrams, with the ids as differences in
as few bytes as they need, so the index has a row per trigram and block, not per trigram and document. Rows
lie sorted by trigram: a search reads the row groups of the needle's trigrams only, intersects the rarest
lists block by block, and compares just the documents that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import search

#: Characters of text in a block.
BLOCK_CHARS = 4_000_000
#: Trigrams of a needle whose lists are counted, and of these the rarest that are intersected.
ASKED, INTERSECTED = 16, 4
#: Bytes of a row group of the index.
GROUP_BYTES = 1 << 20

INDEX = "trigram long, block long, n int, ids binary"


def packed(ids: np.ndarray) -> bytes:
    """Ascending distinct ids: the width of a difference, the first id, the differences."""
    steps = np.diff(ids).astype(np.uint64)
    most = int(steps.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + np.int64(ids[0]).tobytes() + steps.astype(f"<u{width}").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    first = np.frombuffer(held, dtype="<i8", count=1, offset=1)
    steps = np.frombuffer(held, dtype=f"<u{held[0]}", offset=9).astype(np.uint64)
    return np.concatenate([first, first + np.cumsum(steps).view(np.int64)])


def trigrams(text: str) -> np.ndarray:
    """The codes of all trigrams, in order: three code points of 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:] if len(points) > 2 else np.zeros(0, dtype=np.int64)


def _lists(ids: np.ndarray, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(trigram, ascending ids) of a block, trigrams ascending."""
    each = [np.unique(trigrams(t)) for t in texts]
    codes, own = np.concatenate(each), np.repeat(ids, [len(e) for e in each])
    order = np.lexsort((own, codes))
    codes, own = codes[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=False):
        yield int(codes[a]), np.unique(own[a:b])


def build(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> None:
    """Writes the index over filename and text of docs (id, filename, text), in lower case, to a new folder.

    Rows with null ids aren't indexed; find() looks at them one by one. Repeated ids share their lists.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, texts, chars = [], [], 0

        def block() -> pa.RecordBatch:
            rows = [(code, (task << 32) | number, len(own), packed(own)) for code, own in _lists(np.array(ids, dtype=np.int64), texts)]
            parts = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["trigram", "block", "n", "ids"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars >= block_chars:
                    yield block()
                    ids, texts, chars, number = [], [], 0, number + 1
        if ids:
            yield block()

    said = F.lower(F.concat_ws("\n", "filename", "text"))
    rows = docs.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), said.alias("said")).mapInArrow(indexed, INDEX)
    rows.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block").write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def lists(spark: SparkSession, path: str, codes: list[int]) -> DataFrame:
    """The index's rows of some trigrams. Each is a filter of its own, which the scan's statistics can use."""
    wanted: Column = reduce(lambda a, b: a | b, [F.col("trigram") == c for c in codes])
    return spark.read.schema(INDEX).parquet(path).where(wanted)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [reduce(np.intersect1d, sorted(map(unpacked, held), key=len)) for held in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))], names=["id"])


def candidates(spark: SparkSession, path: str, codes: list[int]) -> DataFrame:
    """Distinct ids of documents that hold the rarest of the trigrams."""
    step = max(1, len(codes) // ASKED)
    asked = codes[::step][:ASKED]
    counts = {r["trigram"]: r["n"] for r in lists(spark, path, asked).groupBy("trigram").agg(F.sum("n").alias("n")).collect()}
    if any(c not in counts for c in asked):
        return spark.createDataFrame([], "id long")
    rarest = sorted(asked, key=lambda c: (counts[c], c))[:INTERSECTED]
    # A block has a list of each trigram at most, so the lists brought together are INTERSECTED at most.
    blocks = lists(spark, path, rarest).groupBy("block").agg(F.collect_list("ids").alias("held")).where(F.size("held") == len(rarest))
    return blocks.select("held").mapInArrow(_shared, "id long").distinct()


def find(docs: DataFrame, path: str, needle: str) -> DataFrame:
    """search.history() by the index: the same rows. A needle under three characters reads all documents."""
    spark = docs.sparkSession
    low = spark.range(1).select(F.lower(F.lit(needle))).first()[0]
    codes = list(dict.fromkeys(trigrams(low).tolist()))
    if not codes:
        return search.history(docs, needle)
    near = docs.join(candidates(spark, path, codes), "id", "left_semi").select(*docs.columns)
    return search.history(near, needle).unionByName(search.history(docs.where("id IS NULL"), needle))
