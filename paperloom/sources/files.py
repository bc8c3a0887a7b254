"""Files as documents: folder scan, extraction by type, import gates, insertion-ready rows.

Extractors are registered by extension. Office formats need only the standard library; PDF and
image extractors are plugged in by whoever has a library or an OCR engine for them.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.functions import classify, text
from paperloom.functions.patterns import MAX_EDGE, MAX_FILE_BYTES, MAX_PIXELS, MIME_TYPES


#: Bytes of a file that are copied at a time.
COPY_BYTES = 8 << 20
#: Length of the texts or contents that a task hands on at a time, about; a longer one goes alone.
BATCH_LENGTH = 4 << 20


@dataclass(frozen=True)
class Extracted:
    text: str
    page_count: int | None = None
    #: How sure a recognition engine is of the text, 0 to 100.
    confidence: float | None = None


Extractor = Callable[[bytes], Extracted]

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def docx(content: bytes) -> Extracted:
    """Paragraphs as lines, with a blank line between; tabs and breaks stay. No page count."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        body = ElementTree.fromstring(parts.read("word/document.xml"))
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n"}
    paragraphs = ["".join(n.text or "" if n.tag == f"{_WORD}t" else marks.get(n.tag, "") for n in p.iter()) for p in body.iter(f"{_WORD}p")]
    return Extracted("\n\n".join(paragraphs))


def _column(reference: str) -> int:
    """A=0, B=1, ..., AA=26 from a cell reference."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _rows(sheet: ElementTree.Element, strings: list[str]) -> Iterator[list[str]]:
    for row in sheet.iter(f"{_SHEET}row"):
        cells: list[str] = []
        for cell in row.iter(f"{_SHEET}c"):
            at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else cell.findtext(f"{_SHEET}v", "")
            cells.append(strings[int(value)] if cell.get("t") == "s" and value else value)
        yield cells


def xlsx(content: bytes) -> Extracted:
    """A block `--- name ---` and the CSV of each sheet that isn't blank; the page count counts all sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in parts.namelist():
            strings = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(parts.read("xl/_rels/workbook.xml.rels"))}
        sheets = list(ElementTree.fromstring(parts.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
        blocks = []
        for sheet in sheets:
            target = targets[sheet.get(_RELATION)].lstrip("/").removeprefix("xl/")
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerows(_rows(ElementTree.fromstring(parts.read(f"xl/{target}")), strings))
            if body := out.getvalue().strip():
                blocks.append(f"--- {sheet.get('name')} ---\n{body}")
    return Extracted("\n\n".join(blocks), len(sheets))


_EXTRACTORS: dict[str, Extractor] = {".docx": docx, ".xlsx": xlsx}


def register_extractor(extension: str, extractor: Extractor) -> None:
    """extension with its dot, lower case. The function must be importable where tasks run."""
    _EXTRACTORS[extension] = extractor


#: Engines of this process, by the name of what makes them.
_ENGINES: dict[str, Extractor] = {}


class PerWorker:
    """An extractor whose engine is costly to start: make() is called once in each worker process, at its first file."""

    def __init__(self, make: Callable[[], Extractor]):
        self.make = make

    def __call__(self, content: bytes) -> Extracted:
        name = f"{self.make.__module__}.{self.make.__qualname__}"
        if name not in _ENGINES:
            _ENGINES[name] = self.make()
        return _ENGINES[name](content)


def extraction_error(message: Column) -> Column:
    """What an extractor's error message means."""
    said = F.lower(message)
    return (
        F.when(said.rlike("password|encrypt"), "encrypted")
        .when(said.rlike("not a zip|bad magic|badzipfile|end of central directory"), "bad_archive")
        .when(said.rlike("pixel"), "too_many_pixels")
        .when(said.rlike("invalid|corrupt|malformed|no item named|parse"), "corrupt")
        .when(said.rlike("no extractor"), "no_extractor")
        .otherwise("extraction_failed")
    )


def _empty_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and times (ms) of files without bytes, which Spark's file readers pass over; listed like Spark lists its input."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.getModificationTime()) for s in fs.listStatus(root) if s.isFile() and s.getLen() == 0]


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files right in a folder, without their bytes: path, filename, ext, file_size, modified."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length", "modificationTime")
    empty = spark.createDataFrame(_empty_files(spark, path), "path string, ms long")
    found = found.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.timestamp_millis("ms").alias("modificationTime")))
    name = classify.basename(F.col("path"))
    return found.select("path", name.alias("filename"), classify.extension(name).alias("ext"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def by_length(rows: Iterable[tuple], at: int, most_rows: int) -> Iterator[list[tuple]]:
    """Rows in lists that end with about BATCH_LENGTH of what stands at a position, so that a task needn't hold all of it."""
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += len(row[at] or "")
        if length >= BATCH_LENGTH or len(held) >= most_rows:
            yield held
            held, length = [], 0
    if held:
        yield held


def _extracted(batches: Iterator[pa.RecordBatch], extractors: dict[str, Extractor]) -> Iterator[pa.RecordBatch]:
    """Batches of extract(): a file at a time is taken out of Arrow, and texts are handed on as they add up."""

    def said(ext: str, content: bytes) -> tuple[str | None, int | None, float | None, str | None]:
        try:
            if ext not in extractors:
                raise ValueError(f"no extractor for {ext}")
            told = extractors[ext](content)
            return told.text.strip(), told.page_count, told.confidence, None
        except Exception as error:  # any extractor's error becomes the file's reject reason
            return None, None, None, f"{type(error).__name__}: {error}"

    for batch in batches:
        names, done = [n for n in batch.schema.names if n != "content"], 0
        rows = (said(ext.as_py(), content.as_py()) for ext, content in zip(batch.column("ext"), batch.column("content"), strict=True))
        for held in by_length(rows, 0, batch.num_rows):
            texts, pages, sure, errors = zip(*held, strict=True)
            same = map(batch.slice(done, len(held)).column, names)
            done += len(held)
            yield pa.RecordBatch.from_arrays([*same, pa.array(texts, pa.string()), pa.array(pages, pa.int32()), pa.array(sure, pa.float64()), pa.array(errors, pa.string())], names=[*names, "text", "page_count", "confidence", "error"])


def extract(files: DataFrame) -> DataFrame:
    """From rows with (path, ext, content): adds text, page_count, confidence and error, and drops content. One file's failure stays its own."""
    extractors = dict(_EXTRACTORS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    return files.mapInArrow(lambda batches: _extracted(batches, extractors), f"{schema}, text string, page_count int, confidence double, error string")


def _any_case(extensions: list[str]) -> str:
    """A path pattern for file names with one of the extensions, in upper or lower case."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def import_folder(spark: SparkSession, path: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    """One row per file: what is stored of it, or its reject_reason.

    Bytes are read only of files that pass the first gates: their names are matched before the scan,
    and their length is a filter that the scan itself applies.
    """
    scanned = scan_folder(spark, path).withColumn("gate", classify.file_reject(F.col("ext"), F.col("file_size"), F.lit(True), most))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", _any_case(list(MIME_TYPES)))
    name = classify.basename(F.col("path"))
    passed = reader.load(path).where((F.col("length") > 0) & (F.col("length") <= most))
    done = extract(passed.select("path", name.alias("filename"), classify.extension(name).alias("ext"), F.col("length").alias("file_size"), "content"))
    # The reason stands in a projection of its own, or it would be told anew wherever it is asked for.
    done = done.withColumn("reason", F.when(F.col("error").isNotNull(), extraction_error(F.col("error"))).otherwise(text.text_reject(F.coalesce("text", F.lit("")))))
    rows = done.select("path", "filename", "ext", "file_size", "page_count", F.when(F.col("reason").isNull(), F.col("text")).alias("text"), F.col("reason").alias("reject_reason"))
    rejected = scanned.where("gate IS NOT NULL").select("path", "filename", "ext", "file_size", F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("string").alias("text"), F.col("gate").alias("reject_reason"))
    derived = rows.unionByName(rejected)
    return derived.select("*", classify.mime_type(F.col("ext")).alias("mime_type"), text.word_count(F.col("text")).alias("word_count"), text.language(F.col("text")).alias("detected_language"))


def accepted(imported: DataFrame) -> DataFrame:
    """The rows of an import that are stored."""
    return imported.where("reject_reason IS NULL").drop("reject_reason")


def managed(imported: DataFrame, folder: str) -> DataFrame:
    """accepted(imported) with managed_path: where a copy of the file's bytes lies in folder.

    Only files that passed every gate are copied, so a failed extraction leaves nothing to take back. Tasks copy
    from file to file in pieces, to a name of their own that is put in place at the end: a task that dies leaves
    no half copy under a final name, and one that runs again writes the same names, which are digests of the
    paths. A file that has gone meanwhile stops the import; discard() then takes back what it has copied.
    """
    rows = accepted(imported)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root)
        for batch in batches:
            places = []
            for path, ext in zip(batch.column("path").to_pylist(), batch.column("ext").to_pylist(), strict=True):
                source, place = fs.FileSystem.from_uri(path)
                name = f"{root}/{hashlib.sha256(path.encode()).hexdigest()}{ext}"
                own = f"{name}.{uuid.uuid4().hex}.part"
                with source.open_input_stream(place) as bytes_in, target.open_output_stream(own) as bytes_out:
                    while piece := bytes_in.read(COPY_BYTES):
                        bytes_out.write(piece)
                target.move(own, name)
                places.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.string())], names=[*batch.schema.names, "managed_path"])

    return rows.mapInArrow(copied, StructType([*rows.schema, StructField("managed_path", StringType())]))


def discard(folder: str, names: list[str] | None = None) -> None:
    """Takes copies back: those of some names, or all with what broken copies have left."""
    system, root = fs.FileSystem.from_uri(folder)
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if names is None or info.base_name in names:
            system.delete_file(info.path)


def rejects(imported: DataFrame) -> DataFrame:
    """The others, each as `name: reason`."""
    return imported.where("reject_reason IS NOT NULL").select(F.concat("filename", F.lit(": "), "reject_reason").alias("message"))


def outcomes(imported: DataFrame, **stored: Column) -> DataFrame:
    """accepted() and rejects() in one pass, so that a file is judged once: the stored columns of an accepted file, or the message of another one; the rest is null."""
    ok = F.col("reject_reason").isNull()
    message = F.when(~ok, F.concat("filename", F.lit(": "), "reject_reason"))
    return imported.select(*[F.when(ok, value).alias(name) for name, value in stored.items()], message.alias("message"))


def readable_pixels(width: Column, height: Column) -> Column:
    """Whether a picture is small enough to be read at all."""
    return width.cast("long") * height <= MAX_PIXELS


def fitted_size(width: Column, height: Column) -> Column:
    """struct(width, height) of a picture fitted to the longest edge; small ones aren't enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(MAX_EDGE)) / F.greatest(width, height))
    fit = lambda edge: F.greatest(F.lit(1), classify.round_half_up(edge * scale)).cast("long")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def dialog_extensions() -> list[str]:
    return [e[1:] for e in MIME_TYPES]
