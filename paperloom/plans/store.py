"""Queries over stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import classify, markdown, text
from paperloom.operators import prompts, store

from .base import STORED_SQL, scratch, sql_value, stored, table


def store_insert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = stored(spark, sf_dir).select("id", "filename", "text", "created_at")
    changes = current.where("id % 3 = 0").select("id", F.concat(F.lit("again: "), "text").alias("text"), F.when(F.col("id") % 2 == 0, F.lit("renamed")).alias("filename"))
    return store.update(current, changes, "id").select("id", "filename", F.md5("text").alias("digest"))


UPDATE_SQL = f"""WITH {STORED_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN 'renamed' ELSE filename END AS filename, md5(CASE WHEN id % 3 = 0 THEN 'again: ' || text ELSE text END) AS digest FROM stored"""


def store_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    deleted = docs.where("doc_id % 5 = 0").select("doc_id").unionByName(spark.range(10_000_000, 10_000_003).withColumnRenamed("id", "doc_id"))
    children = {"conversations": (table(spark, sf_dir, "conversations"), "conv_id"), "labels": (table(spark, sf_dir, "labels"), "doc_id")}
    left = store.delete_cascade(docs, "doc_id", children, deleted)
    keys = {"parent": "doc_id", "conversations": "conv_id", "labels": "doc_id"}
    counts = [df.agg(F.count("*").alias("n"), F.min(keys[name]).alias("first_id")).select(F.lit(name).alias("name"), "n", "first_id") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


CASCADE_SQL = """
WITH gone AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)
SELECT 'parent' AS name, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (FROM gone)
UNION ALL SELECT 'conversations', count(*), min(conv_id) FROM conversations WHERE conv_id NOT IN (FROM gone)
UNION ALL SELECT 'labels', count(*), min(doc_id) FROM labels WHERE doc_id NOT IN (FROM gone)"""


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    existing = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("old").alias("impression"))
    new = docs.select("doc_id", F.concat(F.lit("new "), "source").alias("impression"))
    return store.insert_absent(existing, new, "doc_id")


UPSERT_SQL = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'new ' || source END AS impression FROM documents"


def latest_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return store.newest_per(events, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


LATEST_SQL = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some analyses belong to documents that are gone.
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("analysis_id"), (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 10_000_000).otherwise(0)).alias("document_id"), F.when(F.col("quality") == 1, "grammar").otherwise("summary").alias("mode"))


def analysis_export_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _analyses(spark, sf_dir).join(stored(spark, sf_dir).select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    return joined.select("analysis_id", F.coalesce("filename", F.lit("Dokument")).alias("document"), classify.mode_label(F.col("mode")).alias("label"))


EXPORT_SQL = f"""WITH {STORED_SQL} SELECT l.doc_id AS analysis_id, coalesce(s.filename, 'Dokument') AS document, CASE WHEN quality = 1 THEN 'Rechtschreibung' ELSE 'Zusammenfassung' END AS label
FROM labels l LEFT JOIN stored s ON s.id = l.doc_id + CASE WHEN l.doc_id % 3 = 0 THEN 10000000 ELSE 0 END"""


def export_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit(" / über: "), F.col("doc_id").cast("string"), F.lit(".v2.pdf"))
    mode = F.when(F.col("doc_id") % 2 == 0, "arbeitszeugnis").otherwise("unknown")
    return table(spark, sf_dir, "documents").select("doc_id", classify.export_name(name, mode, F.lit("2024-05-06")).alias("name"))


NAME_SQL = "SELECT doc_id, source || ' _ über_ ' || doc_id || '.v2 - ' || CASE WHEN doc_id % 2 = 0 THEN 'Zeugnis-Decoder' ELSE 'Analyse' END || ' - 2024-05-06.pdf' AS name FROM documents"


def analysis_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of one document, newest first."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("mode"), "ts")
    return rows.where("document_id = 7").orderBy(F.desc("ts"), "id").select("id", "mode")


def analysis_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("mode"))


def first_impression_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    impressions = store_upsert(spark, sf_dir)
    return impressions.where("doc_id = 18")


def analysis_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows: the mark of aborted answers, the notice of shortened documents, no structured result."""
    rows = _analyses(spark, sf_dir)
    answer = prompts.with_notice(F.concat(F.lit("answer "), F.col("analysis_id").cast("string")), F.col("analysis_id") % 5 == 0, F.col("mode"))
    return rows.select("analysis_id", F.md5(store.finished(answer, F.col("analysis_id") % 7 == 0)).alias("digest"), F.lit(None).cast("string").alias("structured_result"))


APPEND_SQL = f"""SELECT doc_id AS analysis_id, md5('answer ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN {sql_value(text.NOTICE)} ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || '[stopped]' ELSE '' END) AS digest,
 NULL::VARCHAR AS structured_result FROM labels"""


def store_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and, as new ones, pages: appended to a stored table, which is read back."""
    path = scratch(spark, "documents")
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("filename"), F.col("text").alias("extracted_text"), F.lit("text/plain").alias("mime_type"))
    new = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("filename"), F.col("html").alias("extracted_text"))
    empty = spark.createDataFrame([], store.DOCUMENTS)
    store.append(store.insert(empty, old), path)
    store.append(store.insert(empty, new), path)
    return spark.read.schema(store.DOCUMENTS).parquet(path).select("id", "filename", "mime_type", F.md5("extracted_text").alias("digest"))


INSERT_SQL = """SELECT doc_id::VARCHAR AS id, source AS filename, 'text/plain' AS mime_type, md5(text) AS digest FROM documents
UNION ALL SELECT 'p' || page_id, url, NULL, md5(html) FROM pages"""

#: Steps of a table's schema: a text length, then a flag, then the length renamed.
_STEPS = [lambda df: df.withColumn("chars", F.length("text")), lambda df: df.withColumn("long", F.col("chars") > 1000), lambda df: df.withColumnRenamed("chars", "text_chars")]


def store_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table migrated by one step, then by all: rows at the newest version, with its number and the columns of the backups."""
    path = scratch(spark, "migrated")
    store.write_version(table(spark, sf_dir, "documents").select("doc_id", "text"), path, 1)
    store.run_migrations(spark, path, _STEPS[:1])
    version = store.run_migrations(spark, path, _STEPS)
    rows = spark.read.parquet(f"{path}/version={store.newest_version(spark, path):06d}")
    backups = [",".join(spark.read.parquet(f"{path}/backup-{n}").columns) for n in (1, 2)]
    return rows.select("doc_id", "text_chars", "long", F.lit(version).alias("version"), F.lit(";".join(backups)).alias("backups"))


MIGRATE_SQL = "SELECT doc_id, length(text)::INT AS text_chars, length(text) > 1000 AS long, 3 AS version, 'doc_id,text,chars;doc_id,text,chars,long' AS backups FROM documents"


def export_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as HTML pages and read back."""
    path = scratch(spark, "pages")
    body = F.concat(F.lit("# "), "source", F.lit("\n\n**"), F.col("doc_id").cast("string"), F.lit("**"))
    markdown.write_pages(table(spark, sf_dir, "documents").select(F.col("source").alias("title"), body.alias("md")), path)
    return spark.read.text(path, wholetext=False, lineSep=markdown.PAGE_END).select(F.md5("value").alias("digest"))


EXPORT_PAGE_SQL = f"""SELECT md5({" || ".join(x if i % 2 else sql_value(x) for i, x in enumerate((markdown.PAGE[0], "source", markdown.PAGE[1], "'<h1>' || source || '</h1>' || chr(10) || '<br>' || chr(10) || '<p><strong>' || doc_id || '</strong></p>'", markdown.PAGE[2])))}) AS digest FROM documents"""


_ROW = "id long, filename string, text string, created_at timestamp"


def store_update_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_insert_update on a stored table that is rewritten part by part."""
    path = scratch(spark, "parts")
    current = stored(spark, sf_dir).select("id", "filename", "text", "created_at")
    store.write_parts(current, path, "id")
    changes = current.where("id % 3 = 0").select("id", F.concat(F.lit("again: "), "text").alias("text"), F.when(F.col("id") % 2 == 0, F.lit("renamed")).alias("filename"))
    store.update_parts(spark, path, _ROW, changes, "id")
    return store.read_parts(spark, path, _ROW).select("id", "filename", F.md5("text").alias("digest"))


def store_cascade_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents deleted with their conversations and labels, each table by the parts of the deleted ids; then documents come back as new ones."""
    docs, turns, labels = (table(spark, sf_dir, n) for n in ("documents", "conversations", "labels"))
    tables = {"documents": (docs.select("doc_id", "source"), "doc_id"), "conversations": (turns.select("conv_id", "turn", "role"), "conv_id"), "labels": (labels.select("doc_id", "quality"), "doc_id")}
    told = {}
    for name, (rows, key) in tables.items():
        told[name] = (scratch(spark, name), rows._jdf.schema().toDDL(), key)
        store.write_parts(rows, told[name][0], key)
    store.delete_parts(spark, told, docs.where("doc_id % 5 = 0").select("doc_id"))
    path, schema, key = told["documents"]
    store.insert_absent_parts(spark, path, schema, docs.where("doc_id % 10 < 6").select("doc_id", F.lit("back").alias("source")), key)
    left = [store.read_parts(spark, p, s) for p, s, _ in told.values()]
    return left[0].select(F.lit("documents").alias("name"), F.col("doc_id").alias("id"), F.col("source").alias("value")).unionByName(left[1].select(F.lit("conversations").alias("name"), F.col("conv_id").alias("id"), F.concat_ws(":", "turn", "role").alias("value"))).unionByName(left[2].select(F.lit("labels").alias("name"), F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("value")))


CASCADE_PARTS_SQL = """
SELECT 'documents' AS name, doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'back' ELSE source END AS value FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 < 6
UNION ALL SELECT 'conversations', conv_id, turn || ':' || role FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)
UNION ALL SELECT 'labels', doc_id, quality::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0)"""


def document_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document's row out of a table that lies by time, found by the Bloom filter on its id, and its turns out of one that lies by turn."""
    docs, turns = scratch(spark, "by-time"), scratch(spark, "by-turn")
    store.write_sorted(stored(spark, sf_dir).select("id", "filename", "text", "created_at"), docs, ["created_at"], {"id": 100_000})
    store.write_sorted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), turns, ["turn", "role"], {"conv_id": 100_000})
    said = store.look_up(spark, turns, "conv_id long, turn long, role string, text string", "conv_id", 19).select("turn", "role", F.md5("text").alias("digest"))
    own = store.look_up(spark, docs, _ROW, "id", 19).select(F.lit(None).cast("long").alias("turn"), F.col("filename").alias("role"), F.md5("text").alias("digest"))
    return own.unionByName(said)


LOOK_UP_SQL = "SELECT NULL::BIGINT AS turn, source AS role, md5(text) AS digest FROM documents WHERE doc_id = 19 UNION ALL SELECT turn, role, md5(text) FROM conversations WHERE conv_id = 19"

QUERIES = {
    "store_update_parts": (store_update_parts, UPDATE_SQL),
    "store_cascade_parts": (store_cascade_parts, CASCADE_PARTS_SQL),
    "document_look_up": (document_look_up, LOOK_UP_SQL),
    "store_insert": (store_insert, INSERT_SQL),
    "store_migrate": (store_migrate, MIGRATE_SQL),
    "export_page": (export_page, EXPORT_PAGE_SQL),
    "store_insert_update": (store_insert_update, UPDATE_SQL),
    "store_delete_cascade": (store_delete_cascade, CASCADE_SQL),
    "store_upsert": (store_upsert, UPSERT_SQL),
    "latest_per_doc": (latest_per_doc, LATEST_SQL),
    "analysis_export_join": (analysis_export_join, EXPORT_SQL),
    "export_filename": (export_filename, NAME_SQL),
    "analysis_list_newest": (analysis_list_newest, "SELECT event_id, user_id AS document_id, event_type AS mode FROM events ORDER BY ts DESC, event_id"),
    "first_impression_lookup": (first_impression_lookup, UPSERT_SQL + " WHERE doc_id = 18"),
    "analysis_append": (analysis_append, APPEND_SQL),
    "analysis_history": (analysis_history, "SELECT event_id AS id, event_type AS mode FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id"),
}
