"""Fill-in-the-middle transformation by relational units.

A text is cut at two places between its units (runs of letters, and single other characters) into
prefix, middle and suffix, which are put together anew round three marks. The cuts are drawn as unit
ordinals from a hash of doc_id; where they lie in the text is found by joins:

1. Each document states its two cut requests: the ordinal of the last unit before the cut.
2. posexplode makes rows of a text's units, UNITS_A_BLOCK at a time, so that a row stands for many; a
   window's running sum over the lengths of the blocks says where each begins. Requests are joined to
   the block that holds their ordinal.
3. posexplode makes rows of the units of these blocks, a running sum of their lengths says where each
   ends, and the row with the request's ordinal is the cut. The offsets of a document are aggregated.
4. Offsets meet the texts, and substring cuts them.

Documents are known by a key of doc_id and text, because doc_id may be null or repeated; equal rows
have equal cuts, so the small tables have each key once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, text_of, written

#: Marks of prefix, suffix and middle; a text with one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of these the percent that begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units that share a row until their block is asked for.
UNITS_A_BLOCK = 64
#: Possessive: a text is cut without a step back and without recursion.
_BLOCK = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{UNITS_A_BLOCK}}}+"


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, text, the key of both, and what the id draws."""
    text = text_of(F.col("text"))
    known = F.concat_ws("/", F.sha2(text, 256), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")))
    key = F.unhex(F.substring(F.sha2(known, 256), 1, 32))
    return docs.select("doc_id", text.alias("text"), key.alias("key"), *(d.alias(f"h{k}") for k, d in enumerate(_draws(F.col("doc_id"), seed), start=1)))


def _requests(keyed: DataFrame) -> DataFrame:
    """The form of each row, its number of units, and after how many units it is cut."""
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (F.col("h3") % 100 >= TRANSFORMED), "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    units = keyed.withColumn("form", form).withColumn("n", F.length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    return units.withColumns({"low": F.least(one, two), "high": F.greatest(one, two)})


def _offsets(requests: DataFrame) -> DataFrame:
    """key, prefix_chars, middle_chars of every document that is transformed."""
    cut = requests.where("form != 'plain'")
    asked = cut.select("key", F.explode(F.array("low", "high")).alias("units")).distinct().withColumn("unit", F.col("units") - 1)

    wanted = F.array_contains(F.array(*(F.floor((F.col(c) - 1) / UNITS_A_BLOCK) for c in ("low", "high"))), F.col("block").cast("long"))
    blocks = cut.select("key", "low", "high", F.posexplode(F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(0))).alias("block", "piece"))
    blocks = blocks.select("key", "block", F.length("piece").alias("chars"), F.when(wanted, F.col("piece")).alias("piece")).distinct()
    by_block = Window.partitionBy("key").orderBy("block")
    start = (F.sum("chars").over(by_block) - F.col("chars")).alias("start")
    first = F.col("block").cast("long") * UNITS_A_BLOCK
    placed = blocks.select("key", "piece", start, first.alias("first")).where("piece IS NOT NULL")
    # Within its key a request lies in one block; the join keeps the blocks' partitions by key.
    held = placed.join(asked, (placed["key"] == asked["key"]) & asked["unit"].between(placed["first"], placed["first"] + UNITS_A_BLOCK - 1))
    held = held.select(placed["key"], "start", "units", (F.col("unit") - F.col("first")).alias("ordinal"), "piece")

    units = held.select("key", "start", "units", "ordinal", F.posexplode(F.regexp_extract_all("piece", F.lit(UNIT), F.lit(0))).alias("place", "unit"))
    by_unit = Window.partitionBy("key", "units").orderBy("place")
    ends = units.select("key", "units", "ordinal", "place", (F.col("start") + F.sum(F.length("unit")).over(by_unit)).alias("end")).where("ordinal = place")

    cuts = asked.join(ends.select("key", "units", "end"), ["key", "units"], "left").withColumn("end", F.coalesce("end", F.lit(0)).cast("long"))
    return cuts.groupBy("key").agg(F.min("end").alias("prefix_chars"), (F.max("end") - F.min("end")).alias("middle_chars"))


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the text as it is put together, of each row of docs.

    A null text counts as empty, and an empty text is plain, as is one that contains a mark; plain rows
    have null prefix_chars and middle_chars. A null id draws as the empty string. Repeated rows, ties of
    ids with other texts and an empty table come back row by row; other columns are ignored. A very long
    text costs a row for each UNITS_A_BLOCK units, 2 * UNITS_A_BLOCK rows more, and one pass through a
    shuffle; the blocks of one text are one window group. Rows that are repeated very often stay where
    they are (spread_join), so no task gets all of them.
    """
    keyed = _keyed(docs, seed)
    requests = _requests(keyed)
    stated = requests.groupBy("key", "form", "n").agg(F.count(F.lit(1)).alias("rows"))
    found = written(stated.join(_offsets(requests), "key", "left"), "fim-offsets")
    rows = spread_join(keyed.select("doc_id", "text", "key"), found, "key", "rows")
    text, low, middle = F.col("text"), F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, inner, rest = F.substring(text, F.lit(1), low), F.substring(text, low + 1, middle), F.substring(text, low + middle + 1, F.length(text))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), rest, F.lit(MIDDLE), inner), F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), prefix, F.lit(MIDDLE), inner)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; the marks occur once in it unless it is plain."""

    def between(start: str, stop: str) -> Column:
        begin = F.instr(output, start) + len(start)
        return F.substring(output, begin, F.instr(output, stop) - begin)

    last = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """The rows of fill_in_middle() with digests of the output and of the text rebuilt from it."""
    output, back = F.col("output"), restored(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: The same digests; offsets by the lengths of the first units of a list, so no step is shared with the query.
ORACLE_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM drawn),
forms AS (SELECT *, len(units)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high FROM forms),
parts AS (SELECT *, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM cuts),
outputs AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM outputs
"""
