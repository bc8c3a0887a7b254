"""Evidence: which quotes occur in which documents, after both are normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.functions.patterns import MIN_EVIDENCE
from paperloom.operators import scan

#: Quotes of no more characters in all are looked for by one automaton.
BROADCAST_CHARS = scan.SCAN_CHARS


def find_quotes(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """From (doc_id, text) and (item_id, quote): rows (doc_id, item_id) where the document contains the quote.

    A set of quotes of a checked size goes through texts as one automaton, in one pass. In a larger set the
    quotes of three words and more meet documents by their longest inner word, which is a whole word of any
    text that contains them: an equi-join on keys, in which texts don't take part, and only the pairs it finds
    are compared. Shorter ones still go through the texts as automata, in blocks.
    """
    normal = docs.select("doc_id", text.normalise(F.col("text")).alias("norm"))
    asked = quotes.where(text.js_length(F.col("quote")) >= MIN_EVIDENCE).select(F.col("item_id"), text.normalise(F.col("quote")).alias("needle")).where(text.js_length(F.col("needle")) >= MIN_EVIDENCE)
    scanned = lambda needles: scan.holds(normal, needles, text_col="norm", phrase_id="item_id", phrase="needle")
    if asked.agg(F.coalesce(F.sum(F.length("needle") + 8), F.lit(0))).first()[0] <= BROADCAST_CHARS:
        return scanned(asked)
    words = F.split("needle", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchored = asked.select("item_id", "needle", longest.alias("key"))
    in_docs = normal.select("doc_id", F.explode(F.array_distinct(F.split("norm", " "))).alias("key"))
    pairs = in_docs.join(anchored.where("key IS NOT NULL"), "key").select("doc_id", "item_id", "needle")
    long = normal.join(pairs, "doc_id").where(F.contains("norm", "needle")).select("doc_id", F.col("item_id").cast("long").alias("item_id"))
    return long.unionByName(scanned(anchored.where("key IS NULL")))
