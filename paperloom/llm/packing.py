"""Packing documents into fixed windows by non-negative least squares over length combinations.

Documents are cut into whole windows and a tail. Tails are counted by length in steps; shallow
combinations of steps that fill a window exactly are enumerated, and non-negative least squares
finds how often to use each so that the histogram is met. Counts are rounded down, and a greedy
pass packs the residual histogram. The driver sees the histogram only, WINDOW / STEP rows at any
size of the input; the pieces are ranked inside their length and joined to the plan by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, text_ranges

WINDOW = 2048
STEP = 16
#: Most tails in an enumerated combination.
DEPTH = 3
END_ID = 1
#: Pieces that one task ranks at a time.
CELL_ROWS = 1000


def combinations_filling(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of 1 to depth positive steps with the sum `units`."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        out.append((*head, left))
        if len(head) + 1 < depth:
            for n in range(head[-1] if head else 1, left // 2 + 1):
                extend((*head, n), left - n)

    extend((), units)
    return [c for c in out if list(c) == sorted(c)]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active set method of Lawson and Hanson."""
    columns = a.shape[1]
    x, free = np.zeros(columns), np.zeros(columns, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * len(b)):
        gradient = np.where(free, -np.inf, a.T @ (b - a @ x))
        if gradient.max(initial=-np.inf) <= tolerance:
            break
        free[int(gradient.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solved > 0).all():
                break
            low = solved <= 0
            old = x[at]
            step = (old[low] / np.maximum(old[low] - solved[low], 1e-300)).min()
            x[at] = old + step * (solved - old)
            x[at[x[at] <= 1e-12]] = 0
            free &= x > 0
            if not free.any():
                solved, at = np.zeros(0), np.zeros(0, dtype=int)
                break
        x[:] = 0
        x[at] = solved
    return x


def plan(histogram: dict[int, int], units: int = WINDOW // STEP, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(steps of the slots, number of windows) that use each step exactly as often as the histogram has it."""
    left = np.zeros(units + 1, dtype=np.int64)
    for step, n in histogram.items():
        left[step] = n
    chosen = [((units,), int(left[units]))] if left[units] else []
    left[units] = 0
    combos = [c for c in combinations_filling(units, depth) if len(c) > 1 and all(left[s] for s in c)]
    if combos:
        a = np.zeros((units + 1, len(combos)))
        for j, c in enumerate(combos):
            np.add.at(a[:, j], list(c), 1)
        scale = np.sqrt(np.maximum(left, 1))[:, None]
        counts = np.floor(nnls(a / scale, (left / scale[:, 0])) + 1e-6).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            n = int(min(counts[j], *(left[s] // combos[j].count(s) for s in set(combos[j]))))
            if n > 0:
                chosen.append((combos[j], n))
                np.subtract.at(left, list(combos[j]), n)
    # The residual: the longest tail first, then each time the longest that fits, repeated while it lasts.
    while left.any():
        room, slots, rest = units, [], left.copy()
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            step = int(fits[-1])
            slots.append(step)
            rest[step] -= 1
            room -= step
        n = int(min(left[s] // slots.count(s) for s in set(slots)))
        chosen.append((tuple(slots), n))
        np.subtract.at(left, slots, n)
    return chosen


def cut(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """Pieces of at most a window: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_ranges(batch.column("text")):
                ids, sizes = encoder(vocabulary).encode(batch.column("text")[first:last])
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), sizes + 1
                counts = -(-sizes // window)
                row = np.repeat(np.arange(last - first), counts)
                start = window * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
                length = np.minimum(window, sizes[row] - start)
                at, whole = np.cumsum(length) - length, memoryview(ids).cast("B")
                digests = [zlib.crc32(whole[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                own = batch.column("doc_id")[first:last].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own, pa.array(start), pa.array(length), pa.array(digests, pa.int64()), pa.array(sizes[row])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; equal
    pieces may trade places. Null ids pass through, other columns are not read, and an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, vocabulary, id_col, text_col, window, end_id).withColumn("step", F.ceil(F.col("length") / step).cast("int")).withColumn("place", F.monotonically_increasing_id()), "pieces")
    histogram = {r["step"]: r["n"] for r in pieces.groupBy("step").agg(F.count("*").alias("n")).collect()}

    slots, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for steps, n in plan(histogram, window // step):
        for slot, s in enumerate(steps):
            slots.append((s, taken[s], taken[s] + n, sequence, slot))
            taken[s] += n
        sequence += n
    plan_rows = spark.createDataFrame(slots, "plan_step int, first_rank long, end_rank long, first_sequence long, slot int")

    cells = max(1, -(-max(histogram.values(), default=0) // CELL_ROWS))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("place"), F.lit(cells)))
    before = Window.partitionBy("step").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("step", "cell").agg(F.count("*").alias("n")).select(F.col("step").alias("of_step"), F.col("cell").alias("of_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked_before"))
    inside = Window.partitionBy(F.xxhash64("step", "cell"), "step", "cell").orderBy("place")
    ranked = (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, (F.col("step") == F.col("of_step")) & (F.col("cell") == F.col("of_cell")))
        .withColumn("rank", F.col("ranked_before") + F.col("inside"))
    )
    # The plan has at most a few hundred rows whatever the input: steps times combinations in use.
    placed = ranked.join(F.broadcast(plan_rows), (F.col("step") == F.col("plan_step")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    inside_sequence = Window.partitionBy("sequence_id").orderBy("slot")
    return (
        placed.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
        .withColumn("offset", F.sum("length").over(inside_sequence) - F.col("length"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    )
