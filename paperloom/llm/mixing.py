"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. Targets come from rows of sizes; what is dealt out are rows of a cell, a
bounded part of a source. The one unpartitioned window runs over one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, words_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Rows of a cell, the unit in which fractional repetitions are dealt out.
CELL_ROWS = 4096
#: The same where whole rows are carried through the deal.
CARRIED_ROWS = 512


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to rows (source, source_size): min(cap, level * weight), which uses share of all sizes.

    Weights repeat over the sources by code point, null last. With sources ordered by cap over
    weight, the level that is left once all earlier ones are full is largest at the true level, so
    one pass of running sums replaces the rounds of clamping and resharing.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(named) - 1) % len(weights))
    cap = (max_epochs * F.col("source_size")).cast("long")
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    room = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("level", room / F.sum("weight").over(after))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
        .drop("cap", "level", "weight")
    )


def _hash_part(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _sized(docs: DataFrame, carried: Column, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Rows (row, source, size, draw, place); `row` is what is carried along, so names can't clash."""
    return docs.select(
        carried.alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        F.size(words_of(text_of(F.col(f"`{text_col}`")))).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))).alias("draw"),
        F.monotonically_increasing_id().alias("place"),
    )


def _dealt(rows: DataFrame, sizes: DataFrame, cell_rows: int, **fill) -> DataFrame:
    """Adds source_size, target and taken to rows (row, source, size, draw, place), whose (source, size, draw) are those of sizes."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rates = water_fill(totals, **fill).withColumnRenamed("source", "rate_source")
    # An id (or null) that fills cells by itself is dealt over several by the places of its rows.
    often = sizes.groupBy("source", "draw").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
    often = often.select(F.col("source").alias("often_source"), F.col("draw").alias("often_draw"), F.ceil(F.col("n") / cell_rows).alias("salts"))
    cells = (
        rows.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
        .join(often, F.col("source").eqNullSafe(F.col("often_source")) & (F.col("draw") == F.col("often_draw")), "left")
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("cell", _hash_part(F.col("draw")) % F.ceil(F.col("source_rows") / cell_rows))
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("place"), "salts"), F.lit(-1).cast("long")))
        .select("row", "source", "size", "source_size", "target", "draw", "place", "rate", "cell", "salt")
    )
    cell = Window.partitionBy("source", "cell", "salt")
    dealt = cell.orderBy("draw", "size", "place").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.floor("rate")
    share = F.floor((F.col("rate") - whole) * F.sum("size").over(cell) + 0.5)
    part = F.greatest(F.lit(0), F.least(F.col("size"), share - (F.sum("size").over(dealt) - F.col("size"))))
    return cells.select("row", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, cell_rows: int = CELL_ROWS, **fill) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    A source with rate r = target / source_size repeats every row floor(r) times. The fraction left
    is dealt out inside cells of about cell_rows rows of a source: in seeded order, rows are taken
    until the cell's share of words is reached; the row at the boundary is taken in part. So each
    source meets its target to within half a word a cell, and hot sources split into many cells, as
    do ids that repeat more than cell_rows times. Null texts and texts without words have size 0 and
    take 0; a null source is a source of its own, last in order. Repeated rows are rows like others;
    rows equal in id, source and size take interchangeable parts. Other columns are not read. An
    empty table gives an empty result.
    """
    sizes = written(_sized(docs, F.struct(F.col(f"`{id_col}`").alias("doc_id")), id_col, text_col, source_col, seed), "mix-sizes")
    return _dealt(sizes, sizes, cell_rows, **fill).select("row.doc_id", "source", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, cell_rows: int = CARRIED_ROWS, **fill) -> DataFrame:
    """The mix itself: docs with all its columns, each row as often as the mix takes it.

    Each row is carried through the deal, so its copies are its own takes, whatever other rows share
    its id; reruns on the same rows agree. A row taken in part counts as taken once more when at
    least half of it is. Rows without words follow their source's whole repetitions. Null ids and
    sources, repeated rows, other columns and empty tables are as in mix().
    """
    names = (id_col, text_col, source_col, seed)
    sizes = written(_sized(docs, F.lit(None).cast("string"), *names).select("source", "size", "draw"), "mix-sizes")
    dealt = _dealt(_sized(docs, F.struct("*"), *names), sizes, cell_rows, **fill)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    return dealt.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS draw,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, {MAX_EPOCHS} * source_size AS cap FROM totals),
levels AS (SELECT *, ({SHARE} * (sum(source_size) OVER ())::DOUBLE
                      - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                     / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
rates AS (SELECT source, source_size, source_rows, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
cells AS (SELECT doc_id, s.source, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                 ('0x' || substr(draw, 1, 8))::BIGINT % ceil(source_rows / {CELL_ROWS}.0)::BIGINT AS cell
          FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
dealt AS (SELECT *, floor((rate - floor(rate)) * (sum(size) OVER (PARTITION BY source, cell))::DOUBLE + 0.5)
                    - (sum(size) OVER (PARTITION BY source, cell ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS room FROM cells)
SELECT doc_id, source, size, source_size, target, (floor(rate) * size + greatest(0, least(size, room)))::BIGINT AS taken FROM dealt"""
