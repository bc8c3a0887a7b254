"""Chat about a document: history, the window of it that is sent along, message lists, stored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.functions.patterns import CHAT_DOCUMENT_TOKENS, HISTORY_MAX

GERMAN = ("Du beantwortest Fragen zu diesem Dokument.\n\n--- DOKUMENT ---\n", "\n--- ENDE ---")
ENGLISH = ("You answer questions about this document.\n\n--- DOCUMENT ---\n", "\n--- END ---")
ABORTED = "[stopped]"


def system_prompt(document: Column, code: Column) -> Column:
    """German for German documents, English for all others, round the document."""
    wrap = lambda marks: F.concat(F.lit(marks[0]), document, F.lit(marks[1]))
    return F.when(code == "de", wrap(GERMAN)).otherwise(wrap(ENGLISH))


def fitted_system(document: Column, code: Column) -> Column:
    return system_prompt(text.fit(document, F.lit(CHAT_DOCUMENT_TOKENS))["text"], code)


def window(history: DataFrame, base_chars: Column, key: str = "conv_id", order: str = "turn", content: str = "text") -> DataFrame:
    """Rows of history that are sent along.

    The oldest rows drop out while everything exceeds the limit and more than one is left: a row stays
    if it and all later ones fit beside base_chars (the system prompt and the new message), or if it
    is the last. System rows are never part of it.
    """
    rows = history.where(F.col("role") != "system")
    later = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    sized = rows.withColumn("chars_from_here", F.sum(text.js_length(F.col(content))).over(later)).withColumn("from_end", F.row_number().over(last))
    return sized.where((base_chars + F.col("chars_from_here") <= HISTORY_MAX) | (F.col("from_end") == 1))


def parents(docs: DataFrame, key: str = "doc_id", content: str = "text", code: str = "lang") -> DataFrame:
    """Rows (key, system) of the documents that can be chatted about: those with a text that isn't empty."""
    return docs.where(F.length(content) > 0).select(key, fitted_system(F.col(content), F.col(code)).alias("system"))


def messages(documents: DataFrame, kept: DataFrame, new_message: Column, key: str = "conv_id", order: str = "turn", content: str = "text") -> DataFrame:
    """One row per document (key, system): the system prompt, the kept history in order if there is any, the new message."""
    entry = lambda role, said: F.struct(role.alias("role"), said.alias("content"))
    grouped = kept.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("role").alias("role"), F.col(content).alias("content")))).alias("history")
    )
    past = F.transform("history", lambda m: entry(m["role"], m["content"]))
    past = F.coalesce(past, F.array().cast("array<struct<role:string,content:string>>"))
    return documents.join(grouped, key, "left").select(key, F.concat(F.array(entry(F.lit("system"), F.col("system"))), past, F.array(entry(F.lit("user"), new_message))).alias("messages"))


def stored_pair(turns: DataFrame) -> DataFrame:
    """From rows (conv_id, turn, question, answer, status): the question and its answer as two rows.

    Nothing is stored for a failed turn; an aborted answer gets a mark, or is the mark if empty.
    """
    done = turns.where(F.col("status").isin("complete", "aborted"))
    said = F.when(F.col("status") == "aborted", F.when(F.coalesce(F.length("answer"), F.lit(0)) == 0, ABORTED).otherwise(F.concat("answer", F.lit(f"\n\n{ABORTED}")))).otherwise(F.col("answer"))
    ask = done.select("conv_id", "turn", F.lit("user").alias("role"), F.col("question").alias("text"))
    return ask.unionByName(done.select("conv_id", "turn", F.lit("assistant").alias("role"), said.alias("text")))


def cleared(history: DataFrame, documents: DataFrame, key: str = "conv_id") -> DataFrame:
    """History without the chats of the given documents (one column, the key); chats of others stay."""
    return history.join(documents.select(key).distinct(), key, "left_anti")
