"""The office data source: which files it opens, how it deals them, and what failures give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

from paperloom.functions import text
from paperloom.plans.documents import _docx_bytes, _office, _xlsx_bytes, bulk_import_outputs
from paperloom.sources import files, office


@pytest.fixture
def folder(tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.docx").write_bytes(_docx_bytes([f"text {k}", "x" * 50 * k]))
    (tmp_path / "SHEET.XLSX").write_bytes(_xlsx_bytes([(1, "a,b"), (2, "c")]))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "empty.docx").write_bytes(b"")
    (tmp_path / "other.pdf").write_bytes(b"%PDF")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".hidden.docx").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.docx").write_bytes(b"x")
    return tmp_path


def test_files_of_a_folder(spark, folder):
    office.register(spark)
    rows = {r.filename: r for r in spark.read.format(office.NAME).load(str(folder)).collect()}
    assert set(rows) == {*(f"{k}.docx" for k in range(6)), "SHEET.XLSX", "broken.docx", "empty.docx", "other.pdf"}
    assert rows["3.docx"].text == "text 3\n\n" + "x" * 150 and rows["3.docx"].error is None
    assert (rows["SHEET.XLSX"].ext, rows["SHEET.XLSX"].page_count, rows["SHEET.XLSX"].text) == (".xlsx", 1, '--- Documents ---\n1,"a,b"\n2,c')
    assert rows["broken.docx"].text is None and "BadZipFile" in rows["broken.docx"].error
    assert rows["empty.docx"].file_size == 0 and rows["empty.docx"].error and "no extractor" in rows["other.pdf"].error
    listed = spark.read.format(office.NAME).option("text", "false").load(str(folder)).agg(F.count("*"), F.count("text"), F.count("error")).first()
    assert tuple(listed) == (10, 0, 0)


def test_filters_reach_the_scan_and_partitions_are_even(spark, folder):
    office.register(spark)
    found = spark.read.format(office.NAME).option("partitionBytes", "900").load(str(folder)).where("ext = '.docx' AND file_size > 100 AND filename <> '2.docx'")
    assert sorted(r.filename for r in found.collect()) == ["0.docx", "1.docx", "3.docx", "4.docx", "5.docx"]
    reader = office.OfficeReader({"path": str(folder), "partitionbytes": "900"})
    left = list(reader.pushFilters([EqualTo(("ext",), ".docx"), GreaterThan(("file_size",), 100), StringContains(("filename",), "x")]))
    assert [type(f) for f in left] == [StringContains]
    parts = reader.partitions()
    sizes = [sum(f[3] for f in p.files) for p in parts]
    assert sum(len(p.files) for p in parts) == 6 and all(s <= 900 for s in sizes) and len(parts) > 1
    assert spark.read.format(office.NAME).load(str(folder)).where("ext = '.none'").collect() == []


def test_managed_copies_are_made_of_accepted_files_only(spark, folder, tmp_path_factory):
    copies = tmp_path_factory.mktemp("managed") / "copies"
    rows = files.managed(files.import_folder(spark, str(folder)), str(copies)).collect()
    assert {r.filename for r in rows} == {*(f"{k}.docx" for k in range(6)), "SHEET.XLSX"}
    assert {p.name for p in copies.iterdir()} == {r.managed_path.rsplit("/", 1)[1] for r in rows} and len(rows) == 7
    for r in rows:
        assert open(r.managed_path, "rb").read() == (folder / r.filename).read_bytes()
    files.managed(files.import_folder(spark, str(folder)), str(copies)).collect()  # done over, it is the same
    assert len(list(copies.iterdir())) == 7
    files.discard(str(copies), [rows[0].managed_path.rsplit("/", 1)[1]])
    assert len(list(copies.iterdir())) == 6
    files.discard(str(copies))
    assert list(copies.iterdir()) == []


def _engine():
    """Counts the texts that it has read since it was started."""
    seen = []

    def read(content: bytes) -> files.Extracted:
        seen.append(content)
        return files.Extracted(content.decode(), confidence=float(len(seen)))

    return read


def test_an_engine_is_started_once_in_a_worker(spark, monkeypatch):
    monkeypatch.setitem(files._EXTRACTORS, ".png", files.PerWorker(_engine))
    rows = spark.createDataFrame([(k, ".png", bytearray(b"text")) for k in range(9)], "id int, ext string, content binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = files.extract(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = min(r.confidence for r in found)
    assert sorted(r.confidence for r in found) == [first + k for k in range(9)] and {r.text for r in found} == {"text"}


def test_texts_are_handed_on_as_they_add_up(tmp_path):
    """Twelve files of a million characters each: no batch holds them all, nor does one list what is bigger than a few."""
    for k in range(12):
        (tmp_path / f"{k:02}.docx").write_bytes(_docx_bytes([f"{k} " + "x" * 1_000_000]))
    reader = office.OfficeReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert [n for b in batches for n in b.column("filename").to_pylist()] == [f"{k:02}.docx" for k in range(12)]
    assert max(sum(map(len, b.column("text").to_pylist())) for b in batches) < files.BATCH_LENGTH + 1_000_010
    content = pa.array([(tmp_path / f"{k:02}.docx").read_bytes() for k in range(12)], pa.binary())
    given = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([".docx"] * 11 + [".none"]), content], names=["doc_id", "ext", "content"])
    batches = list(files._extracted(iter([given]), files._EXTRACTORS))
    assert [b.num_rows for b in batches] == [5, 5, 2] and [i for b in batches for i in b.column("doc_id").to_pylist()] == list(range(12))
    assert batches[1].column("text")[1].as_py() == "6 " + "x" * 1_000_000 and "no extractor" in batches[2].column("error")[1].as_py()


def test_office_files_are_made_a_few_at_a_time():
    texts = [f"{k}\n" + "y" * 1_000_000 for k in range(12)]
    batches = list(_office(iter([pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["doc_id", "text"])])))
    assert [b.num_rows for b in batches] == [5, 5, 2] and [i for b in batches for i in b.column("doc_id").to_pylist()] == list(range(12))
    assert files.docx(batches[2].column("content")[1].as_py()).text == "11\n\n" + "y" * 1_000_000


def test_outcomes_judge_a_file_once(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a.docx", None), (2, "b.doc", "legacy_format"), (3, None, "not_found"), (4, "c.docx", None)], "id int, filename string, reject_reason string")
    got = files.outcomes(rows, id=F.col("id"), filename=F.col("filename"))
    want = files.accepted(rows).unionByName(files.rejects(rows), allowMissingColumns=True)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = bulk_import_outputs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # One scan; trimming and two counts for the verdict.
    assert plan.count("FileScan") == 1 and plan.count("regexp_replace") == 3


def test_a_reject_of_a_text_is_its_verdict(spark):
    texts = spark.createDataFrame([("",), ("abc",), ("\x01\x01a",), (None,), ("" * 5 + "a",), ("\x01" + "a" * 19,)], "t string")
    t = F.col("t")
    verdict = text.print_verdict(text.js_length(t), text.printable_chars(t), text.control_chars(t))
    got = texts.select(text.text_verdict(t), verdict, text.text_reject(t)).collect()
    assert [tuple(r) for r in got] == [("empty", "empty", "empty"), ("ok", "ok", None), ("control", "control", "control"), ("ok", "ok", None), ("unprintable", "unprintable", "unprintable"), ("ok", "ok", None)]
