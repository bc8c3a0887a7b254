"""Token-id files: canonical length-limited Huffman blocks with bit-offset checkpoints, in doc_id order.

A file set is a folder with two Parquet tables, so it lies in any store that Spark writes to:

``codebook``  one row per used id: id, bits (the length of its code; canonical codes follow from it).
``blocks``    one row per block: part, block, tokens_before (in the part), n_docs, n_tokens,
              doc_ids, doc_tokens, offsets (uint64: the bit offset of every 256th id)
              and payload (the bit string). A block decodes on its own, and each offset starts a
              stretch that decodes on its own.

Parts cover ascending ranges of doc_id, and so do the blocks of a part. Texts are tokenised where
they are read; what Spark shuffles into doc_id order are packed ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from .common import drop_table, scratch_path, written
from .tokens import encoder, ranges, text_ranges

END_ID = 0
#: Ids that go into one block; a longer text is a block of its own.
BLOCK_TOKENS = 250_000

_BLOCK = "part int, block int, tokens_before long, n_docs int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, offsets binary, payload binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("tokens_before", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("offsets", pa.binary()), ("payload", pa.binary())])


def _tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """A row (doc_id, n_tokens, ids) per document, and after a task's documents one row with its counts by id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for first, last in text_ranges(batch.column("text")):
                ids, sizes = encoder(vocabulary).encode(batch.column("text")[first:last])
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                counted = huffman.added(counted, ids)
                packed = np.ascontiguousarray(ids, dtype="<u4" if ids.max() > 65535 else "<u2")
                ends = packed.itemsize * np.concatenate([[0], np.cumsum(sizes)])
                binary = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:last], pa.array(sizes), binary, pa.nulls(len(sizes), pa.binary())], names=["doc_id", "n_tokens", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counted.tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids", "counts"])

    return docs.mapInArrow(rows, "doc_id long, n_tokens long, ids binary, counts binary")


def _plain(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4")


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for counts in frame["counts"]:
            total = np.frombuffer(counts, dtype=np.int64)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"id": used, "n": total[used]})


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the file set to path. Global counts come first, so ids are kept in the shared folder between."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = scratch_path(spark, "token-ids")
    plain = written(_tokenised(source, vocabulary, end_id), "token-ids", kept)
    # At most one row per id of the vocabulary reaches the driver.
    found = plain.select("counts").where("counts IS NOT NULL").mapInPandas(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"]] = found["n"]
    lengths = huffman.code_lengths(counts)
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id long, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, code = TaskContext.get().partitionId(), 0, 0, huffman.codes(lengths)
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            for first, last in ranges(sizes, BLOCK_TOKENS):
                own, n = batch.slice(first, last - first), int(sizes[first:last].sum())
                ids = np.concatenate([_plain(i, k) for i, k in zip(own.column("ids").to_pylist(), sizes[first:last].tolist(), strict=True)])
                payload, offsets = huffman.encode(ids, lengths, code)
                row = {"part": part, "block": block, "tokens_before": before, "n_docs": last - first, "n_tokens": n, "doc_ids": own.column("doc_id").to_pylist(), "doc_tokens": sizes[first:last].tolist(), "offsets": offsets.tobytes(), "payload": payload}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)
                block, before = block + 1, before + n

    # The row's place parts rows of one id, of which there may be many.
    rows = plain.where("counts IS NULL").select("doc_id", "n_tokens", "ids", F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    # The payload is dense already.
    ordered.mapInArrow(blocks, _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_table(spark, kept)


def read_tokens(spark: SparkSession, path: str, digest) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and digest(ids) as ids_crc32, decoded from the files."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # at most one row per id of the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.uint8)
    lengths[book["id"]] = book["bits"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = huffman.table(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("part", "tokens_before", "n_tokens", "offsets", "payload", "doc_ids", "doc_tokens")}
                offsets = np.frombuffer(row["offsets"].as_buffer(), dtype=np.uint64)
                ids = huffman.decode(row["payload"].as_buffer(), offsets, row["n_tokens"].as_py(), decoder).astype("<u4")
                sizes = row["doc_tokens"].values.to_numpy()
                ends = np.cumsum(sizes)
                digests = [digest(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                parts = pa.array(np.full(len(sizes), row["part"].as_py(), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, parts, pa.array(row["tokens_before"].as_py() + ends - sizes), pa.array(sizes), pa.array(digests, pa.int64())], names=["doc_id", "part", "in_part", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per written partition, whose number the writer's shuffle setting bounds.
    starts = F.broadcast(parts.select(F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("part_start")))
    rows = blocks.mapInArrow(documents, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long")
    return rows.join(starts, F.col("part") == F.col("of_part")).select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def round_trip(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """Writes docs as token files and returns one row per document from them: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. A null doc_id sorts first; repeated doc_ids follow each
    other in no set order. Other columns are not read, and an empty table gives empty files and rows.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, **options)
    return read_tokens(docs.sparkSession, path, crc32)
