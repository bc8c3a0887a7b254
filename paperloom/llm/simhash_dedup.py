"""SimHash near-dedup: fingerprints, a byte-position inverted index with count filtering, components.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight
bytes, so they share at least four positional bytes. Posting lists over single positional bytes
would hold 1/256 of all fingerprints each; lists here are keyed by three positional bytes, and
KEYS is a set of 20 position triples of which every four positions contain one. So no pair that
reaches the guaranteed minimum is missed, and a list holds about 2**-24 of the fingerprints. In a
list, the shared positional bytes of each pair are tallied, pairs below four matches are dropped,
and the rest is verified by its differing bits.

Equal fingerprints are one node, and a list yields a spanning forest of its links, at most one
link less than it has nodes. So neither copies nor large near-copy groups expand into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, text_of, written
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_MATCHES = 4
#: Posting lists of more fingerprints are searched by a fourth byte.
LONG_LIST = 4096

_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions so that every 4 positions contain one.

    Positions form three parts; a triple lies inside a part, or has two positions in a part and one
    in the next part round.
    """
    part = {p: k for k, positions in enumerate(_PARTS) for p in positions}

    def counts(triple: tuple[int, ...]) -> bool:
        inside = [sum(part[p] == k for p in triple) for k in range(3)]
        return any(inside[k] == 3 or (inside[k] == 2 and inside[(k + 1) % 3] == 1) for k in range(3))

    return [t for t in combinations(range(8), 3) if counts(t)]


KEYS = covering_triples()


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (of its UTF-8 if bytes); 0 without words."""
    words = (text.encode("utf-8", "replace") if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
        others = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(prints.view(np.int64))], names=[*others, "print"])


def _row_key(id_col: str, text_col: str) -> Column:
    """The digest of the text (null as empty), then the id unless it is null: equal for rows that repeat both, never null."""
    key = F.concat(F.sha2(text_of(F.col(f"`{text_col}`")), 256), F.coalesce(F.concat(F.lit(":"), F.col(f"`{id_col}`").cast("string")), F.lit("")))
    # Said to be never null, it needs no guard in joins, which would take the digests twice.
    return F.coalesce(key, F.lit(""))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_keys: bool = False) -> DataFrame:
    """Rows (doc_id, print), print being the fingerprint as a signed long; with row_keys, rows (doc_id, row_key, print)."""
    keys = [_row_key(id_col, text_col).alias("row_key")] if row_keys else []
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *keys)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_fingerprints, f"doc_id {kind}, row_key string, print long" if row_keys else f"doc_id {kind}, print long")


def linked(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether fingerprints (unsigned) share MIN_MATCHES positional bytes and differ in at most MAX_BITS bits."""
    differing = one ^ other
    matches = (differing[..., None].view(np.uint8).reshape(*differing.shape, 8) == 0).sum(axis=-1)
    return (matches >= MIN_MATCHES) & (np.bitwise_count(differing) <= MAX_BITS)


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one posting list, by breadth-first search.

    Links share a byte beyond the three of the list, so a long list is searched byte by byte at each
    other position, unless a fourth byte is the same in all of it.
    """
    if len(prints) > LONG_LIST:
        octets = prints[:, None].view(np.uint8)
        others = np.flatnonzero((octets != octets[0]).any(axis=0))
        if len(others) >= 8 - (MIN_MATCHES - 1):
            parts = [prints[octets[:, p] == value] for p in others for value in np.unique(octets[:, p])]
            return [link for part in parts for link in _forest(part)]
    rest, links = prints, []
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = linked(np.full(len(rest), at), rest)
            if near.any():
                links += [(int(at), int(x)) for x in rest[near]]
                reached += list(rest[near])
                rest = rest[~near]
    return links


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of posting lists; rows come sorted by list, and a list may span batches."""
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> pd.DataFrame:
        edges = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
        starts, sizes = np.concatenate([[0], edges]), np.diff(np.concatenate([[0], edges, [len(rows)]]))
        prints = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        a, b = prints[starts[sizes == 2]], prints[starts[sizes == 2] + 1]
        near = linked(a, b) if len(a) else np.zeros(0, dtype=bool)
        pairs = [np.stack([a[near], b[near]], axis=1)]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if found := _forest(prints[start : start + size]):
                pairs.append(np.array(found, dtype=np.uint64))
        out = np.concatenate(pairs).view(np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    for frame in frames:
        rows = frame[["part", "post", "print"]].to_numpy(dtype=np.int64)
        if not len(rows):
            continue
        # The last list of a batch may go on in the next one.
        last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if held and (cut or np.any(held[-1][-1, :2] != rows[0, :2])):
            yield done(np.concatenate([*held, rows[:cut]]))
            held = []
        elif cut:
            yield done(rows[:cut])
        held.append(rows[cut:])
    if held:
        yield done(np.concatenate(held))


def near_links(nodes: DataFrame) -> DataFrame:
    """From rows (print) without repeats: link rows (u, v) that span every group of linked fingerprints."""
    byte = [F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    posts = [F.struct(F.lit(k).alias("part"), (byte[a] * 65536 + byte[b] * 256 + byte[c]).cast("long").alias("post")) for k, (a, b, c) in enumerate(KEYS)]
    postings = nodes.select("print", F.inline(F.array(*posts)))
    return postings.repartition("part", "post").sortWithinPartitions("part", "post").mapInPandas(_links, "u long, v long")


def _rooted(prints: DataFrame, first: Column) -> DataFrame:
    """Rows (print, n, first, root) without repeated fingerprints; `first` aggregates the n rows of a fingerprint."""
    nodes = prints.groupBy("print").agg(F.count("*").alias("n"), first.alias("first"))
    roots = components(near_links(nodes.select("print")))
    return nodes.join(roots, F.col("print") == F.col("node"), "left").select("print", "n", "first", F.coalesce("root", "print").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Null texts and texts without words have fingerprint zero, which links like any other. Repeated
    rows share a fingerprint. Null ids are never the smallest; a component of null ids only has a
    null component_id. Other columns are not read. An empty table gives an empty result. A very long
    text is held whole with the hashes of its shingles while its fingerprint is made, and only its
    fingerprint goes on; very many different fingerprints that share a posting list are compared in one task.
    """
    prints = written(with_fingerprints(docs, id_col, text_col), "simhash")
    rooted = written(_rooted(prints, F.min("doc_id")), "roots")
    heads = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = spread_join(rooted, heads, "root", "members").select("print", "n", "component_id")
    return spread_join(prints, named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs that stays of each component, with all its columns.

    It is the row with the smallest id, of equal ids the one with the smallest text digest; a null
    id stays only in a component without other ids. Rows meet their verdict by id and digest, so
    rows that share an id are judged by their own texts; of rows that repeat both, one stays.
    """
    prints = written(with_fingerprints(docs, id_col, text_col, row_keys=True), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    kept = _rooted(prints, F.min(order)).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("row_key"))
    rows = docs.select(F.struct("*").alias("row"), _row_key(id_col, text_col).alias("row_key")).join(kept, "row_key", "left_semi")
    repeats = Window.partitionBy("row_key").orderBy("row_key")
    return rows.withColumn("repeat", F.row_number().over(repeats)).where("repeat = 1").select("row.*")
