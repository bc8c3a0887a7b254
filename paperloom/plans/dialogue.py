"""Queries over prompts, chats and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.functions.patterns import IMPRESSION_SAMPLE, LANGUAGES, MODES, TEMPERATURES
from paperloom.operators import chat, evidence, inference, prompts, scan

from .base import norm_sql, sql_value, table, tokens_sql

_BUDGET = 1200


def _last_sql(t: str, needle: str) -> str:
    """Zero-based place of the last needle, -1 without one."""
    return f"CASE WHEN contains({t}, {needle}) THEN length({t}) - (strpos(reverse({t}), reverse({needle})) - 1) - length({needle}) ELSE -1 END"


def _fit_sql(source: str, budget: str, keep: str) -> str:
    """A subquery of source(t, ...) with fitted and truncated."""
    return f"""(SELECT {keep}, CASE WHEN over THEN (CASE WHEN last > most - 500 THEN substring(cut, 1, last + 1) ELSE cut END) || {sql_value(text.MARKER)} ELSE t END AS fitted, over AS truncated
 FROM (SELECT *, greatest({_last_sql("cut", "chr(10) || chr(10)")}, {_last_sql("cut", "'. '")}) AS last
  FROM (SELECT *, substring(t, 1, most) AS cut FROM (SELECT *, {tokens_sql("length(t)")} > {budget} AS over, greatest(0, floor({budget} * 3.5::DOUBLE)::BIGINT - {len(text.MARKER)}) AS most FROM {source}))))"""


def token_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = text.fit(F.col("text"), F.lit(_BUDGET))
    return table(spark, sf_dir, "documents").select("doc_id", fitted.alias("f")).select("doc_id", "f.truncated", F.length("f.text").alias("chars"), F.md5("f.text").alias("digest"))


FIT_SQL = f"SELECT doc_id, truncated, length(fitted) AS chars, md5(fitted) AS digest FROM {_fit_sql('(SELECT doc_id, text AS t FROM documents)', str(_BUDGET), 'doc_id')}"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.get(F.array(*[F.lit(m) for m in MODES]), (F.col("doc_id") % 5).cast("int"))
    question = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Frage "), F.col("doc_id").cast("string")))
    # Longer documents than the tables hold, so that the context window is exceeded.
    long = F.when(F.col("doc_id") % 3 == 0, F.repeat("text", 6)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", mode.alias("mode"), long.alias("text"), "lang", question.alias("question"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.prompt(F.col("mode"), F.col("text"), F.col("lang"), F.col("question"))
    asked = _requests(spark, sf_dir).select("doc_id", "mode", built.alias("p"))
    return asked.select("doc_id", "mode", "p.temperature", "p.context", "p.truncated", F.md5("p.system").alias("system_digest"), F.md5("p.user").alias("user_digest"))


def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = prompts.prompt(F.col("mode"), F.col("text"), F.col("lang"), F.col("question"))
    asked = _requests(spark, sf_dir).select("mode", built.alias("p"))
    return asked.groupBy("mode").agg(F.count_if("p.truncated").alias("truncated"), F.max(text.tokens(F.col("p.system")) + text.tokens(F.col("p.user"))).alias("most_tokens"))


def _system_sql() -> str:
    head, tail = prompts.DIRECTIVE.split("{}")
    names = " ".join(f"WHEN '{c}' THEN {sql_value(n)}" for c, _, n, _ in LANGUAGES)
    directive = f"CASE WHEN lang IN ('de', 'en') THEN '' ELSE {sql_value(head)} || (CASE lang {names} ELSE 'English' END) || {sql_value(tail)} END"
    cases = [f"WHEN '{m}' THEN " + (f"(CASE WHEN lang = 'de' THEN {sql_value(g)} ELSE {sql_value(e)} END) || {directive}" if e else sql_value(g)) for m, (g, e) in prompts.SYSTEM.items()]
    return f"CASE mode {' '.join(cases)} END"


_ASKED = f"CASE WHEN mode = 'freeform' THEN chr(10) || chr(10) || coalesce(question, {sql_value(prompts.DEFAULT_QUESTION)}) ELSE '' END"
_TEMPERATURE = "CASE mode " + " ".join(f"WHEN '{m}' THEN {t}::DOUBLE" for m, t in TEMPERATURES.items()) + " END"
_USER = f"{sql_value(prompts.BEFORE)} || {{}} || {sql_value(prompts.AFTER)} || {_ASKED}"
BUILT_SQL = f"""
WITH r AS (SELECT doc_id, {list(MODES)}[1 + doc_id % 5] AS mode, CASE WHEN doc_id % 3 = 0 THEN repeat(text, 6) ELSE text END AS t, lang, CASE WHEN doc_id % 2 = 0 THEN 'Frage ' || doc_id END AS question FROM documents),
s AS (SELECT *, {_system_sql()} AS system, {_USER.format("t")} AS whole FROM r),
b AS (SELECT *, {tokens_sql("length(system)")} + {tokens_sql("length(whole)")} AS fixed FROM s),
f AS (SELECT doc_id, mode, system, whole, question, fixed + 1500 > 8192 AS beyond, fitted, truncated FROM
      {_fit_sql(f"(SELECT *, 8192 - 1500 - (fixed - {tokens_sql('length(t)')}) AS budget FROM b)", "budget", "doc_id, mode, system, whole, question, fixed")}),
built AS (SELECT doc_id, mode, {_TEMPERATURE} AS temperature, 8192 AS context, beyond AND truncated AS truncated, system, CASE WHEN beyond THEN {_USER.format("fitted")} ELSE whole END AS usr FROM f)"""
PROMPT_SQL = BUILT_SQL + " SELECT doc_id, mode, temperature, context, truncated, md5(system) AS system_digest, md5(usr) AS user_digest FROM built"
PROMPT_BUDGET_SQL = BUILT_SQL + f" SELECT mode, count(*) FILTER (WHERE truncated) AS truncated, max({tokens_sql('length(system)')} + {tokens_sql('length(usr)')}) AS most_tokens FROM built GROUP BY mode"

_NEW = "Which points are still open?"


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id = 3").orderBy("turn").select("turn", "role", F.md5("text").alias("digest"))


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; every thirteenth stands for one whose text could not be extracted."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 13 == 12, "").otherwise(F.col("text")))
    return chat.parents(docs).withColumnRenamed("doc_id", "conv_id")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parents(spark, sf_dir)
    sized = table(spark, sf_dir, "conversations").join(docs.select("conv_id", text.js_length(F.col("system")).alias("system_chars")), "conv_id")
    kept = chat.window(sized, F.col("system_chars") + len(_NEW))
    return kept


def chat_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("conv_id", "turn", "role", "chars_from_here")


def chat_messages_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = chat.messages(_parents(spark, sf_dir), _kept(spark, sf_dir), F.lit(_NEW))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return built.select("conv_id", F.size("messages").alias("n"), F.md5(said).alias("digest"))


_WRAP = f"CASE WHEN lang = 'de' THEN {sql_value(chat.GERMAN[0])} || fitted || {sql_value(chat.GERMAN[1])} ELSE {sql_value(chat.ENGLISH[0])} || fitted || {sql_value(chat.ENGLISH[1])} END"
KEPT_SQL = f"""
WITH d AS (SELECT doc_id AS conv_id, {_WRAP} AS system FROM {_fit_sql("(SELECT doc_id, lang, text AS t FROM documents WHERE text <> '' AND doc_id % 13 <> 12)", "3500", "doc_id, lang")}),
h AS (SELECT c.*, system, length(system) + {len(_NEW)} AS base FROM conversations c JOIN d USING (conv_id) WHERE role <> 'system'),
w AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS chars_from_here, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM h),
kept AS (SELECT * FROM w WHERE base + chars_from_here <= 8000 OR from_end = 1)"""
MESSAGES_SQL = KEPT_SQL + f"""
SELECT conv_id, (count(k.role) + 2)::INT AS n, md5('system:' || any_value(d.system) || chr(10) || coalesce(string_agg(role || ':' || text, chr(10) ORDER BY turn) || chr(10), '') || 'user:' || {sql_value(_NEW)}) AS digest
FROM d LEFT JOIN (SELECT conv_id, role, text, turn FROM kept) k USING (conv_id) GROUP BY conv_id"""


def chat_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats left once those of low-quality documents are cleared."""
    gone = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("conv_id"))
    return chat.cleared(table(spark, sf_dir, "conversations"), gone).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


CLEAR_SQL = "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"


def chat_pair_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    status = F.get(F.array(F.lit("complete"), F.lit("aborted"), F.lit("failed")), (F.col("turn") % 3).cast("int"))
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("re: "), "text")).otherwise("")
    pairs = chat.stored_pair(turns.select("conv_id", "turn", F.col("text").alias("question"), answer.alias("answer"), status.alias("status")))
    return pairs.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


PAIR_SQL = f"""
WITH t AS (SELECT conv_id, turn, text AS question, CASE WHEN conv_id % 2 = 0 THEN 're: ' || text ELSE '' END AS answer, ['complete', 'aborted', 'failed'][1 + turn % 3] AS status FROM conversations WHERE role = 'user')
SELECT conv_id, turn, 'user' AS role, md5(question) AS digest FROM t WHERE status <> 'failed'
UNION ALL SELECT conv_id, turn, 'assistant', md5(CASE WHEN status = 'complete' THEN answer WHEN answer = '' THEN '{chat.ABORTED}' ELSE answer || chr(10) || chr(10) || '{chat.ABORTED}' END) FROM t WHERE status <> 'failed'"""


def chat_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the default backend to whole message lists."""
    built = chat.messages(_parents(spark, sf_dir), _kept(spark, sf_dir), F.lit(_NEW))
    return inference.infer_messages(built).select("conv_id", "answer", "aborted", "error")


ANSWER_SQL = KEPT_SQL + f"""
SELECT conv_id, (count(k.role) + 2) || ':' || any_value(length(d.system)) || ':' || {sql_value(_NEW)} AS answer, false AS aborted, NULL::VARCHAR AS error
FROM d LEFT JOIN (SELECT conv_id, role FROM kept) k USING (conv_id) GROUP BY conv_id"""


def impression_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = prompts.first_impression(F.col("text"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", asked.alias("p")).select("doc_id", "p.temperature", "p.context", F.md5("p.system").alias("system_digest"), F.md5("p.user").alias("user_digest"))


_IMPRESSION = " || ".join((sql_value(prompts.IMPRESSION.split("{}")[0]), f"(CASE lang {' '.join(f'WHEN {sql_value(c)} THEN {sql_value(n)}' for c, _, n, _ in LANGUAGES)} ELSE 'English' END)", sql_value(prompts.IMPRESSION.split("{}")[1])))
IMPRESSION_SQL = f"""SELECT doc_id, 0.1::DOUBLE AS temperature, 2048 AS context, md5({_IMPRESSION}) AS system_digest,
 md5({sql_value(prompts.BEFORE)} || substring(text, 1, {IMPRESSION_SAMPLE}) || {sql_value(prompts.AFTER)}) AS user_digest FROM documents"""


def verify_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass over a first answer, which here is the document's source as JSON."""
    first = F.to_json(F.struct("source"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.verification(F.col("text"), first).alias("p")).select("doc_id", F.md5("p.system").alias("system_digest"), F.md5("p.user").alias("user_digest"))


_VERIFY = prompts.VERIFY_USER.split("{}")
VERIFY_SQL = f"""SELECT doc_id, md5({sql_value(prompts.VERIFY)}) AS system_digest, md5({sql_value(_VERIFY[0])} || text || {sql_value(_VERIFY[1])} || '{{"source":"' || source || '"}}' || {sql_value(_VERIFY[2])}) AS user_digest FROM documents"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    # Whole passages, and their second and third words as a short quote.
    short = F.array_join(F.slice(F.split("text", " "), 2, 2), " ")
    return items.select("item_id", F.col("text").alias("quote")).unionByName(items.select((F.col("item_id") + 1_000_000).alias("item_id"), short.alias("quote")))


def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.find_quotes(table(spark, sf_dir, "documents"), _quotes(spark, sf_dir))


def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = evidence_join(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))
    asked = _quotes(spark, sf_dir).select("item_id")
    return asked.join(hits, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_id")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary: own coded phrases, and the first three words and the last two of each passage of benchmark."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    first = items.select((F.col("item_id") * 2 + 1000).alias("phrase_id"), F.array_join(F.slice("w", 1, 3), " ").alias("phrase"))
    last = items.select((F.col("item_id") * 2 + 1001).alias("phrase_id"), F.array_join(F.slice("w", -2, 2), " ").alias("phrase"))
    codes = spark.createDataFrame([(k, phrase) for k, (phrase, _, _) in enumerate(scan.LETTER_CODES)], "phrase_id long, phrase string")
    return codes.unionByName(first).unionByName(last)


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every phrase in every document."""
    return scan.matches(table(spark, sf_dir, "documents"), _phrases(spark, sf_dir))


_CODES = ", ".join(f"({k}, {sql_value(phrase)})" for k, (phrase, _, _) in enumerate(scan.LETTER_CODES))
CODE_SCAN_SQL = f"""
WITH RECURSIVE w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
p AS (SELECT * FROM (VALUES {_CODES}) AS c(phrase_id, phrase) UNION ALL SELECT item_id * 2 + 1000, array_to_string(w[:3], ' ') FROM w UNION ALL SELECT item_id * 2 + 1001, array_to_string(w[-2:], ' ') FROM w),
hits AS (
  SELECT doc_id, text, phrase_id, phrase, instr(text, phrase) AS place FROM documents JOIN p ON contains(text, phrase) WHERE phrase <> ''
  UNION ALL SELECT doc_id, text, phrase_id, phrase, place + instr(substr(text, place + 1), phrase) FROM hits WHERE instr(substr(text, place + 1), phrase) > 0)
SELECT doc_id, phrase_id::BIGINT AS phrase_id, place - 1 AS start, place - 1 + length(phrase) AS stop FROM hits"""

QUOTES_SQL = f"""
WITH q AS (SELECT item_id, text AS quote FROM benchmark UNION ALL SELECT item_id + 1000000, array_to_string(string_split(text, ' ')[2:3], ' ') FROM benchmark),
n AS (SELECT item_id, {norm_sql("quote")} AS needle FROM q WHERE length(quote) >= 4),
d AS (SELECT doc_id, {norm_sql("text")} AS norm FROM documents),
hits AS (SELECT doc_id, item_id FROM d JOIN n ON contains(norm, needle) WHERE length(needle) >= 4)"""

QUERIES = {
    "token_fit": (token_fit, FIT_SQL),
    "prompt_build": (prompt_build, PROMPT_SQL),
    "prompt_budget": (prompt_budget, PROMPT_BUDGET_SQL),
    "chat_history": (chat_history, "SELECT turn, role, md5(text) AS digest FROM conversations WHERE conv_id = 3 ORDER BY turn"),
    "chat_context_window": (chat_context_window, KEPT_SQL + " SELECT conv_id, turn, role, chars_from_here FROM kept"),
    "chat_messages_build": (chat_messages_build, MESSAGES_SQL),
    "chat_pair_persist": (chat_pair_persist, PAIR_SQL),
    "chat_clear": (chat_clear, CLEAR_SQL),
    "chat_answer": (chat_answer, ANSWER_SQL),
    "impression_prompt": (impression_prompt, IMPRESSION_SQL),
    "verify_prompt": (verify_prompt, VERIFY_SQL),
    "code_scan": (code_scan, CODE_SCAN_SQL),
    "evidence_join": (evidence_join, QUOTES_SQL + " SELECT doc_id, item_id FROM hits"),
    "evidence_counts": (evidence_counts, QUOTES_SQL + " SELECT item_id, count(doc_id) AS documents, min(doc_id) AS first_id FROM q LEFT JOIN hits USING (item_id) GROUP BY item_id"),
}
