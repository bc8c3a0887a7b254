"""Queries over stored documents: quality, language, search, lists, import gates."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import classify, tables, text
from paperloom.functions.patterns import CHAT_MAX, CONTROL, GERMAN_WORDS, LEGACY_EXTENSIONS, MAX_FILE_BYTES, MIME_TYPES, OTHER_MIME, PRINTABLE_RE2, QUESTION_MAX, WS_RE2
from paperloom.operators import search, sketches, trigram
from paperloom.sources import files as importer
from paperloom.sources import office

from .base import STORED_SQL, iso, iso_sql, literal_rows, scratch, stored, table, tokens_sql, values_sql, words_sql


def profile(docs: DataFrame) -> DataFrame:
    """Per document: lengths, character classes, words, tokens, language and the import gate's verdict."""
    counted = docs.select(
        "doc_id",
        text.js_length(F.col("text")).alias("chars"),
        text.printable_chars(F.col("text")).alias("printable"),
        text.control_chars(F.col("text")).alias("control"),
        text.word_count(F.col("text")).alias("words"),
        text.tokens(F.col("text")).alias("tokens"),
        text.language(F.col("text")).alias("language"),
    )
    return counted.withColumn("verdict", text.print_verdict(F.col("chars"), F.col("printable"), F.col("control")))


def doc_quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(table(spark, sf_dir, "documents"))


def _class_sql(inside: str, t: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '[{inside}]+', '', 'g')))::BIGINT"


_GERMAN = ", ".join(f"'{w}'" for w in GERMAN_WORDS)
_VERDICT = "CASE WHEN chars = 0 THEN 'empty' WHEN control::DOUBLE / chars > 0.05 THEN 'control' WHEN printable::DOUBLE / chars < 0.8 THEN 'unprintable' ELSE 'ok' END"

PROFILE_SQL = f"""
WITH w AS (SELECT *, regexp_split_to_array(lower(text), '[{WS_RE2}]+') AS parts FROM documents),
c AS (SELECT doc_id, length(text)::BIGINT AS chars, {_class_sql(PRINTABLE_RE2, "text")} AS printable, {_class_sql(CONTROL, "text")} AS control,
             len({words_sql("text")})::BIGINT AS words, {tokens_sql("length(text)")} AS tokens,
             CASE WHEN length(text) > 50 THEN CASE WHEN len(list_filter(parts, lambda x: x IN ({_GERMAN})))::DOUBLE / greatest(len(parts), 1) > 0.02 THEN 'de' ELSE 'en' END END AS language
      FROM w)
SELECT *, {_VERDICT} AS verdict FROM c"""


def doc_garbled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_garbled(F.col("text")).alias("garbled"))


GARBLED_SQL = f"""
WITH s AS (SELECT doc_id, substring(text, 1, 5000) AS t FROM documents),
c AS (SELECT doc_id, length(t) AS chars, {_class_sql(PRINTABLE_RE2, "t")} AS printable, {_class_sql(CONTROL, "t")} AS control FROM s)
SELECT doc_id, chars > 0 AND ({_VERDICT}) <> 'ok' AS garbled FROM c"""


def doc_language_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", text.language(F.col("text")).alias("detected"))
    return docs.groupBy("lang", "detected").agg(F.count("*").alias("n"))


LANGUAGE_SQL = f"SELECT lang, language AS detected, count(*) AS n FROM ({PROFILE_SQL}) JOIN documents USING (doc_id) GROUP BY ALL"

_NEEDLE = "TheA"


def doc_search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.history(stored(spark, sf_dir), _NEEDLE).select("id", "filename")


SEARCH_SQL = f"WITH {STORED_SQL} SELECT id, filename FROM stored WHERE contains(lower(filename), lower('{_NEEDLE}')) OR contains(lower(text), lower('{_NEEDLE}'))"


def doc_search_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.palette(stored(spark, sf_dir), f"  {_NEEDLE} ").select("id", "filename", iso(F.col("created_at")).alias("created"))


PALETTE_SQL = f"""WITH {STORED_SQL} SELECT id, filename, {iso_sql("created_at")} AS created FROM stored
WHERE contains(lower(filename), 'thea') OR contains(lower(text), 'thea') ORDER BY created_at DESC, id LIMIT 15"""

_COMMANDS = [("Import a file", "upload add"), ("History", "list Thea archive"), ("Settings", "theme language"), ("Theatre mode", "dark")]


def command_search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = literal_rows(spark, _COMMANDS, "label string, words string").select("label", F.split("words", " ").alias("keywords"))
    return search.commands_and_documents(commands, stored(spark, sf_dir), _NEEDLE)


COMMANDS_SQL = f"""WITH {STORED_SQL},
c AS (SELECT label FROM {values_sql(_COMMANDS, "label, words")} WHERE contains(lower(label), 'thea') OR len(list_filter(string_split(words, ' '), lambda k: contains(lower(k), 'thea'))) > 0),
d AS (SELECT id, filename FROM stored WHERE contains(lower(filename), 'thea') OR contains(lower(text), 'thea') ORDER BY created_at DESC, id LIMIT 15)
SELECT 0 AS part, label, NULL::BIGINT AS id FROM c UNION ALL SELECT 1, filename, id FROM d"""


def doc_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).where(F.col("id") == 17).select("id", "filename", F.md5("text").alias("digest"))


def doc_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).orderBy(F.desc("created_at"), "id").select("id", "filename", "text", "lang", iso(F.col("created_at")).alias("created"))


NEWEST_SQL = f"WITH {STORED_SQL} SELECT id, filename, text, lang, {iso_sql('created_at')} AS created FROM stored ORDER BY created_at DESC, id"

#: One stand-in file per document: its type and size come from the id.
_KINDS = (".pdf", ".DOCX", ".xlsx", ".png", ".doc", ".xls", ".txt", ".webp")
_SIZES = (0, 1, 4096, MAX_FILE_BYTES, MAX_FILE_BYTES + 1)


def _files(docs: DataFrame) -> DataFrame:
    ext = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 8).cast("int"))
    size = F.get(F.array(*[F.lit(s).cast("long") for s in _SIZES]), (F.col("doc_id") % 5).cast("int"))
    return docs.select("doc_id", F.concat("source", ext).alias("filename"), size.alias("file_size"), (F.col("doc_id") % 11 != 0).alias("regular"), "text")


def _judged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, filename, text, reason); no reason for what is imported."""
    files = _files(table(spark, sf_dir, "documents"))
    gate = classify.file_reject(classify.extension(F.col("filename")), F.col("file_size"), F.col("regular"), MAX_FILE_BYTES)
    return files.select("doc_id", "filename", "text", F.coalesce(gate, text.text_reject(text.trim_ws(F.col("text")))).alias("reject_reason"))


def bulk_import_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce("reject_reason", F.lit("accepted"))
    return _judged_files(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def bulk_import_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outputs of a load: what is stored of the accepted files, and a message for each other one."""
    return importer.outcomes(_judged_files(spark, sf_dir), doc_id=F.col("doc_id"), filename=F.col("filename"), word_count=text.word_count(F.col("text")))


#: What XML forbids in a text, and carriage returns, which it reads as line feeds; and white space at a text's ends, which extraction drops.
_FORBIDDEN = r"[\x00-\x08\x0B-\x1F\uFFFE\uFFFF]"
_ENDS = r"[\t\n \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _office(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text document per row, as its office file."""
    for batch in batches:
        made = ((doc_id.as_py(), ".docx", _docx_bytes(body.as_py().split("\n"))) for doc_id, body in zip(batch.column("doc_id"), batch.column("text"), strict=True))
        for rows in importer.by_length(made, 2, batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "ext", "content"])


def extract_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through an office file and its extractor."""
    plain = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", _FORBIDDEN, "").alias("text"))
    done = importer.extract(plain.mapInArrow(_office, "doc_id long, ext string, content binary"))
    return done.select("doc_id", F.md5(F.regexp_replace("text", rf"^{_ENDS}|{_ENDS}\z", "")).alias("digest"), "error")


_RE2_ENDS, _RE2_FORBIDDEN = (re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", p) for p in (_ENDS, _FORBIDDEN))
EXTRACT_SQL = rf"""SELECT doc_id, md5(regexp_replace(replace(regexp_replace(text, '{_RE2_FORBIDDEN}', '', 'g'), chr(10), chr(10) || chr(10)), '^{_RE2_ENDS}|{_RE2_ENDS}\z', '', 'g')) AS digest, NULL::VARCHAR AS error FROM documents"""


_LEGACY = ", ".join(f"'{e}'" for e in LEGACY_EXTENSIONS)
_KNOWN = ", ".join(f"'{e}'" for e in MIME_TYPES)
REJECTS_SQL = f"""
WITH f AS (SELECT doc_id, lower({list(_KINDS)}[1 + doc_id % 8]) AS ext, ({list(_SIZES)}::BIGINT[])[1 + doc_id % 5] AS size, doc_id % 11 <> 0 AS regular,
                  regexp_replace(text, '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g') AS t FROM documents),
c AS (SELECT *, length(t) AS chars, {_class_sql(PRINTABLE_RE2, "t")} AS printable, {_class_sql(CONTROL, "t")} AS control FROM f),
r AS (SELECT doc_id, CASE WHEN ext IN ({_LEGACY}) THEN 'legacy_format' WHEN ext NOT IN ({_KNOWN}) THEN 'unsupported_type' WHEN NOT regular THEN 'not_found'
                  WHEN size > {MAX_FILE_BYTES} THEN 'too_large' WHEN size = 0 THEN 'empty_file' WHEN ({_VERDICT}) <> 'ok' THEN ({_VERDICT}) ELSE 'accepted' END AS reason FROM c)
SELECT reason, count(*) AS n, min(doc_id) AS first_id FROM r GROUP BY reason"""
OUTPUTS_SQL = REJECTS_SQL[: REJECTS_SQL.rindex("SELECT")] + f"""SELECT CASE WHEN reason = 'accepted' THEN r.doc_id END AS doc_id, CASE WHEN reason = 'accepted' THEN name END AS filename,
 CASE WHEN reason = 'accepted' THEN len({words_sql("text")}) END AS word_count, CASE WHEN reason <> 'accepted' THEN name || ': ' || reason END AS message
FROM r JOIN (SELECT doc_id, text, source || {list(_KINDS)}[1 + doc_id % 8] AS name FROM documents) d USING (doc_id)"""


def mime_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(table(spark, sf_dir, "documents"))
    ext = classify.extension(F.col("filename"))
    return files.select("doc_id", classify.mime_type(ext).alias("mime"), classify.is_image(ext).alias("image"), classify.icon(classify.mime_type(ext)).alias("icon"), classify.file_size(F.col("file_size")).alias("shown_size"))


MIME_SQL = f"""
WITH f AS (SELECT doc_id, lower({list(_KINDS)}[1 + doc_id % 8]) AS ext, ({list(_SIZES)}::BIGINT[])[1 + doc_id % 5] AS size FROM documents),
m AS (SELECT doc_id, ext, size, CASE {" ".join(f"WHEN ext = '{e}' THEN '{m}'" for e, m in MIME_TYPES.items())} ELSE '{OTHER_MIME}' END AS mime FROM f)
SELECT doc_id, mime, ext IN ('.jpg', '.jpeg', '.png', '.tiff', '.tif', '.bmp', '.webp') AS image,
       CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN contains(mime, 'spreadsheet') OR contains(mime, 'excel') THEN 'table' ELSE 'text' END AS icon,
       CASE WHEN size > 1048576 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.0f KB', size / 1024.0) END AS shown_size
FROM m"""

_IDS = [("123e4567-e89b-12d3-a456-426614174000",), ("123E4567-E89B-12D3-A456-426614174000",), ("123e4567e89b12d3a456426614174000",), ("123e4567-e89b-12d3-a456-426614174000\n",), ("",), (None,), ("g23e4567-e89b-12d3-a456-426614174000",)]
_MODES = [("grammar",), ("summary",), ("freeform",), ("Grammar",), ("chat",), ("",), (None,), ("arbeitszeugnis",), ("formulation",)]


def id_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark, _IDS, "value string").select("value", classify.is_id(F.col("value")).alias("valid"))


def mode_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark, _MODES, "value string").select("value", classify.is_mode(F.col("value")).alias("valid"), classify.mode_label(F.col("value")).alias("label"))


def input_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.within(F.col("text"), QUESTION_MAX).alias("question_ok"), classify.within(F.col("text"), CHAT_MAX).alias("chat_ok"))


#: Needles of the stored index: none, few and many hits, one that is too short for it, one of another case.
_NEEDLES = ("theha", "er the", "S3", "zq", "the", "xyzzy qq", "Ö", "ing and")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles searched in documents by a stored trigram index."""
    path, docs = scratch(spark, "trigrams"), stored(spark, sf_dir).select("id", "filename", "text")
    trigram.build(docs, path)
    found = [trigram.find(docs, path, needle).select(F.lit(needle).alias("needle"), "id") for needle in _NEEDLES]
    return reduce(DataFrame.unionByName, found)


INDEX_SQL = f"SELECT needle, doc_id AS id FROM documents, (VALUES {', '.join(f"('{n}')" for n in _NEEDLES)}) AS v(needle) WHERE contains(lower(source), lower(needle)) OR contains(lower(text), lower(needle))"

def text_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by source and day, merged to sources, and whether each estimate lies within its bound of the exact value."""
    docs = stored(spark, sf_dir).select(F.col("filename").alias("source"), F.to_date("created_at").alias("day"), "text")
    told = sketches.estimates(sketches.merged(sketches.summarise(docs, ["source", "day"]), ["source"]), ["source"])
    exact = docs.groupBy("source").agg(F.count_distinct(F.sha2("text", 256)).alias("exact"))
    # Texts don't meet their source's estimates, a histogram of their lengths does.
    lengths = docs.groupBy("source", F.length("text").alias("chars")).agg(F.count("*").alias("n")).join(told.select("source", "q50", "q90"), "source")
    share = lambda held: F.sum(F.when(held, F.col("n")).otherwise(0)) / F.sum("n")
    ranks = lengths.groupBy("source").agg(*[share(F.col("chars") < F.col(q)).alias(f"below_{q}") for q in ("q50", "q90")], *[share(F.col("chars") <= F.col(q)).alias(f"to_{q}") for q in ("q50", "q90")])
    words = docs.select("source", "day", F.explode(F.array_remove(F.split("text", r"\s+"), "")).alias("word"))
    path = scratch(spark, "sketches")
    sketches.count_min(words, ["source", "day"], "word").write.parquet(path)
    cells = spark.read.parquet(path).groupBy("source", "row", "cell").agg(F.sum("n").alias("n"))
    # Asked for are the words of benchmark, whose exact counts are taken beside the sketches; a row of counters holds all words.
    asked = table(spark, sf_dir, "benchmark").select(F.explode(F.array_remove(F.split("text", r"\s+"), "")).alias("word")).distinct()
    counts = words.join(asked, "word", "left_semi").groupBy("source", "word").agg(F.count("*").alias("exact"))
    total = cells.where("row = 0").groupBy("source").agg(F.sum("n").alias("words"))
    over = sketches.count_estimates(cells, counts.select("source", "word"), ["source"], "word").join(counts, ["source", "word"]).join(total, "source")
    # An estimate is never under; over by more than e / COUNTERS of all words it is for one word in e ** DEPTH at most, on average.
    bound = F.col("words") * 2.7183 / sketches.COUNTERS
    held = over.groupBy("source").agg(F.min(F.col("estimate") >= F.col("exact")).alias("never_under"), (F.avg(F.when(F.col("estimate") - F.col("exact") > bound, 1).otherwise(0)) < 0.05).alias("seldom_over"))
    near = lambda q, share: (F.col(f"below_{q}") <= share + 0.05) & (F.col(f"to_{q}") >= share - 0.05)
    return told.join(exact, "source").join(ranks, "source").join(held, "source").select("source", "texts", (F.abs(F.col("distinct_texts") - F.col("exact")) <= 0.08 * F.col("exact") + 1).alias("distinct_near"), (near("q50", 0.5) & near("q90", 0.9)).alias("quantiles_near"), "never_under", "seldom_over")


SKETCHES_SQL = "SELECT source, count(*) AS texts, true AS distinct_near, true AS quantiles_near, true AS never_under, true AS seldom_over FROM documents GROUP BY source"


def sql_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and their fields taken out of answers in SQL text; a document's first lines are its answer's blocks."""
    tables.register(spark)
    stored(spark, sf_dir).select("id", "text").createOrReplaceTempView("paperloom_answers")
    return spark.sql(r"""
        WITH answers AS (
          SELECT a.id, concat_ws('\n', 'Intro', collect_list(concat('### ', n.line_no, '. ', '\n**Text:** ', n.line, '\n**Schwere:** ', if(n.line_no % 2 = 0, 'hoch', 'niedrig'), '\n'))) AS md
          FROM paperloom_answers a, LATERAL text_lines(a.text) n WHERE trim(n.line) <> '' AND NOT contains(n.line, '*') AND NOT contains(n.line, '#') GROUP BY a.id)
        SELECT id, b.idx, md5(md_field(b.body, 'Text')) AS text_digest, md_severity(md_field(b.body, 'Schwere')) AS severity FROM answers, LATERAL md_blocks(md) b""")


SQL_BLOCKS_SQL = r"""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT id, line_no::INT AS idx, md5(trim(line, ' ')) AS text_digest, CASE WHEN line_no % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM l WHERE trim(line, ' ') <> '' AND NOT contains(line, '*') AND NOT contains(line, '#')"""

#: Documents that share an office file.
_A_FILE = 200


def _docx_bytes(lines: Iterable[str]) -> bytes:
    held, names = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(held, "w") as parts, parts.open("word/document.xml", "w") as xml:
        xml.write(f"<w:document {names}><w:body>".encode())
        for line in lines:
            xml.write(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'.encode())
        xml.write(b"</w:body></w:document>")
    return held.getvalue()


def _xlsx_bytes(rows: list[tuple]) -> bytes:
    held, main, relations = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(held, "w") as parts:
        parts.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="Documents" r:id="r1"/></sheets></workbook>')
        parts.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for v in row) + "</row>" for row in rows)
        parts.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return held.getvalue()


def _office_folder(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of office files with all documents, many to a file: texts as docx, sizes as xlsx."""
    path = scratch(spark, "office")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder)
        rows = rows.sort_values("doc_id")
        for name, content in ((f"{key[0]}.DOCX", _docx_bytes(rows["text"])), (f"{key[0]}.xlsx", _xlsx_bytes(list(rows[["doc_id", "chars"]].itertuples(index=False))))):
            with system.open_output_stream(f"{folder}/{name}") as file:
                file.write(content)
        return pd.DataFrame({"file": [key[0]]})

    # XML takes no control characters, and reads carriage returns as line feeds.
    plain = F.regexp_replace(F.regexp_replace("text", r"[\t\n\r]", " "), "[\\x00-\\x1F\uFFFE\uFFFF]", "")
    docs = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / _A_FILE)).alias("file"), "doc_id", F.concat(F.lit("["), plain, F.lit("]")).alias("text"), F.length("text").alias("chars"))
    docs.groupBy("file").applyInPandas(write, "file long").count()
    return path


def office_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office files with all documents, read back by the data source."""
    office.register(spark)
    path = _office_folder(spark, sf_dir)
    found = spark.read.format(office.NAME).load(path).where("ext IN ('.docx', '.xlsx') AND file_size > 0")
    return found.select("filename", "ext", "page_count", F.md5("text").alias("digest"), "error")


OFFICE_SQL = rf"""
WITH d AS (SELECT doc_id // {_A_FILE} AS file, doc_id, '[' || regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '[\x00-\x1F\x{{FFFE}}\x{{FFFF}}]', '', 'g') || ']' AS text, length(text) AS chars FROM documents)
SELECT file || '.DOCX' AS filename, '.docx' AS ext, NULL::INT AS page_count, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest, NULL::VARCHAR AS error FROM d GROUP BY file
UNION ALL SELECT file || '.xlsx', '.xlsx', 1, md5('--- Documents ---' || chr(10) || string_agg(doc_id || ',' || chars, chr(10) ORDER BY doc_id)), NULL FROM d GROUP BY file"""

def import_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of office files imported with its gates and copied to a managed folder; the copies are read back as office files."""
    office.register(spark)
    folder = _office_folder(spark, sf_dir)
    stored_files = importer.managed(importer.import_folder(spark, folder), copies := scratch(spark, "managed"))
    kept = scratch(spark, "imported")
    stored_files.select("filename", "ext", "mime_type", "word_count", F.md5("text").alias("digest"), classify.basename(F.col("managed_path")).alias("copy")).write.parquet(kept)
    again = spark.read.format(office.NAME).load(copies).select(F.col("filename").alias("copy"), F.md5("text").alias("copy_digest"))
    return spark.read.parquet(kept).join(again, "copy", "left").select("filename", "ext", "mime_type", "word_count", "digest", (F.col("digest") == F.col("copy_digest")).alias("copied"))


IMPORT_OFFICE_SQL = OFFICE_SQL[: OFFICE_SQL.index("SELECT file || '.DOCX'")].rstrip() + f""",
t AS (SELECT file || '.DOCX' AS filename, '.docx' AS ext, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM d GROUP BY file
      UNION ALL SELECT file || '.xlsx', '.xlsx', '--- Documents ---' || chr(10) || string_agg(doc_id || ',' || chars, chr(10) ORDER BY doc_id) FROM d GROUP BY file),
c AS (SELECT *, length(t) AS chars, {_class_sql(PRINTABLE_RE2, "t")} AS printable, {_class_sql(CONTROL, "t")} AS control FROM t)
SELECT filename, ext, CASE ext WHEN '.docx' THEN '{MIME_TYPES[".docx"]}' ELSE '{MIME_TYPES[".xlsx"]}' END AS mime_type, len({words_sql("t")}) AS word_count, md5(t) AS digest, true AS copied FROM c WHERE ({_VERDICT}) = 'ok'"""

QUERIES = {
    "import_office": (import_office, IMPORT_OFFICE_SQL),
    "office_scan": (office_scan, OFFICE_SQL),
    "text_sketches": (text_sketches, SKETCHES_SQL),
    "sql_blocks": (sql_blocks, SQL_BLOCKS_SQL),
    "search_index": (search_index, INDEX_SQL),
    "doc_quality_profile": (doc_quality_profile, PROFILE_SQL),
    "doc_garbled_sample": (doc_garbled_sample, GARBLED_SQL),
    "doc_language_table": (doc_language_table, LANGUAGE_SQL),
    "doc_search_history": (doc_search_history, SEARCH_SQL),
    "doc_search_palette": (doc_search_palette, PALETTE_SQL),
    "command_search_union": (command_search_union, COMMANDS_SQL),
    "doc_point_lookup": (doc_point_lookup, "SELECT doc_id AS id, source AS filename, md5(text) AS digest FROM documents WHERE doc_id = 17"),
    "doc_list_newest": (doc_list_newest, NEWEST_SQL),
    "bulk_import_rejects": (bulk_import_rejects, REJECTS_SQL),
    "bulk_import_outputs": (bulk_import_outputs, OUTPUTS_SQL),
    "extract_office": (extract_office, EXTRACT_SQL),
    "mime_map": (mime_map, MIME_SQL),
    "id_validate": (id_validate, rf"SELECT value, coalesce(regexp_full_match(value, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}'), false) AS valid FROM {values_sql(_IDS, 'value')}"),
    "mode_validate": (
        mode_validate,
        "SELECT value, coalesce(value IN ('grammar', 'formulation', 'arbeitszeugnis', 'summary', 'freeform'), false) AS valid, CASE value WHEN 'grammar' THEN 'Rechtschreibung' WHEN 'formulation' THEN 'Formulierungen'"
        f" WHEN 'arbeitszeugnis' THEN 'Zeugnis-Decoder' WHEN 'summary' THEN 'Zusammenfassung' ELSE 'Analyse' END AS label FROM {values_sql(_MODES, 'value')}",
    ),
    "input_limits": (input_limits, f"SELECT doc_id, length(text) <= {QUESTION_MAX} AS question_ok, length(text) <= {CHAT_MAX} AS chat_ok FROM documents"),
}
