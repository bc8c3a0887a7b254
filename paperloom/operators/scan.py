"""Dictionary scans: where phrases of a dictionary occur in texts, by an Aho-Corasick automaton, one pass a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of phrases that one automaton takes; a larger dictionary is dealt into blocks, a pass each.
SCAN_CHARS = 2_000_000
#: Found rows that a task hands on at a time.
BATCH_ROWS = 100_000

#: Our own coded phrases of reference letters: phrase, what it stands for, grade.
LETTER_CODES = (
    ("stets zu unserer vollsten Zufriedenheit", "performance", 1), ("zu unserer vollsten Zufriedenheit", "performance", 2), ("stets zu unserer vollen Zufriedenheit", "performance", 2), ("zu unserer vollen Zufriedenheit", "performance", 3),
    ("zu unserer Zufriedenheit", "performance", 4), ("im Großen und Ganzen", "performance", 5), ("hat sich bemüht", "performance", 5), ("war stets bemüht", "performance", 5), ("jederzeit vorbildlich", "conduct", 1), ("stets einwandfrei", "conduct", 2),
    ("ohne Tadel", "conduct", 3), ("gesellig", "conduct", 5), ("im gegenseitigen Einvernehmen", "leaving", 4), ("bedauern sein Ausscheiden sehr", "leaving", 1), ("bedauern ihr Ausscheiden sehr", "leaving", 1), ("wünschen alles Gute", "leaving", 3),
)

_built: list = [None, None]


def _automaton(entries: Broadcast):
    """The automaton of a broadcast dictionary [(phrase, [ids])], built once per worker process; the last one is kept."""
    import ahocorasick

    if _built[0] is not entries.value:
        automaton = ahocorasick.Automaton()
        for phrase, ids in entries.value:
            automaton.add_word(phrase, (len(phrase), ids))
        automaton.make_automaton()
        _built[:] = entries.value, automaton
    return _built[1]


def _scan(docs: DataFrame, id_col: str, text_col: str, entries: Broadcast, found: Callable, columns: list[T.StructField]) -> DataFrame:
    """found(automaton, text) gives the columns' values of each hit of a text."""
    kinds = [pa.int64() if isinstance(c.dataType, T.LongType) else None for c in columns]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(entries)

        def packed(own: list, rows: list, ids: pa.Array) -> pa.RecordBatch:
            parts = list(zip(*rows, strict=True)) or [()] * len(columns)
            arrays = [pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())), *arrays], names=[id_col, *(c.name for c in columns)])

        for batch in given:
            ids, own, rows = batch.column(0), [], []
            for k, text in enumerate(batch.column(1)):
                for row in found(automaton, text.as_py() or ""):
                    own.append(k)
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield packed(own, rows, ids)
                        own, rows = [], []
            if rows:
                yield packed(own, rows, ids)

    source = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(batches, T.StructType([source.schema[id_col], *columns]))


def _blocks(phrases: DataFrame, id_col: str, phrase_col: str) -> Iterator[list]:
    """The dictionary's phrases with their ids, in blocks of about SCAN_CHARS characters."""
    told = phrases.select(F.col(id_col).cast("long").alias("id"), F.col(phrase_col).alias("phrase")).where("phrase <> ''")
    chars = told.agg(F.coalesce(F.sum(F.length("phrase") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // SCAN_CHARS))
    for k in range(blocks):
        ids: dict[str, list[int]] = {}
        for row in told.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect():
            ids.setdefault(row["phrase"], []).append(row["id"])
        yield list(ids.items())


def _all(docs: DataFrame, phrases: DataFrame, ids: tuple[str, str, str, str], found: Callable, columns: list[T.StructField]) -> DataFrame:
    id_col, text_col, phrase_id, phrase = ids
    out = None
    for entries in _blocks(phrases, phrase_id, phrase):
        part = _scan(docs, id_col, text_col, docs.sparkSession.sparkContext.broadcast(entries), found, columns)
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase_id: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """Every occurrence, overlaps included, of every phrase: id_col, phrase_id, start, stop (code points from 0, stop exclusive).

    Phrases are compared as they are written; equal phrases are all told, null and empty ones never
    occur, and null texts hold nothing. Nothing is shuffled: a text is read once, in time in proportion to
    its length and its hits. The dictionary reaches the tasks in blocks of SCAN_CHARS characters, so what a task holds
    is bounded; k blocks are k passes over the texts, and the driver holds the dictionary until the result is read.
    """

    def found(automaton, text: str) -> Iterator[tuple]:
        if len(automaton):
            for last, (size, ids) in automaton.iter(text):
                yield from ((i, last + 1 - size, last + 1) for i in ids)

    long = T.LongType()
    columns = [T.StructField(phrase_id, long), T.StructField("start", long), T.StructField("stop", long)]
    return _all(docs, phrases, (id_col, text_col, phrase_id, phrase), found, columns)


def holds(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase_id: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """Which texts hold which phrases: rows (id_col, phrase_id) once per row of docs; else as matches()."""

    def found(automaton, text: str) -> set[tuple]:
        return {(i,) for _, (_, ids) in automaton.iter(text) for i in ids} if len(automaton) else set()

    return _all(docs, phrases, (id_col, text_col, phrase_id, phrase), found, [T.StructField(phrase_id, T.LongType())])
