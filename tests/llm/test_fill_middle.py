"""Fill-in-the-middle against brute force, its oracle and exact round trips."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from paperloom.llm import fill_middle
from tests.llm import cases, oracle


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def ordered(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_whole_documents_equal_the_oracle_and_come_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = fill_middle.digests(fill_middle.fill_in_middle(docs))
    assert found.join(docs, "doc_id").where(F.sha2("text", 256) != F.col("restored_sha256")).count() == 0
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    oracle.same_rows(found, fill_middle.ORACLE_SQL, documents=duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").df())


def test_edge_rows_equal_brute_force(spark):
    rows = cases.rows(null_id=True)
    odd = ["<P>", "a<S>b", "\U0001f600a\U0001f600 b", "a" * 500_000, "1" * 5000, "x1" * 64, "x1" * 32, "\r\n\n", "é ß é", "<P", "0"] * 6
    pairs = [(r[0], r[1]) for r in rows] + [(1000 + k, t) for k, t in enumerate(odd)] + [(1000, "<P>"), (1002, "another text of 1002")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "n", "form", "unit", "block", "rows")})
    assert ordered(fill_middle.fill_in_middle(docs).collect()) == ordered(brute(*p) for p in pairs)
    assert fill_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_cuts_at_and_beside_the_edges_of_blocks(spark):
    size = fill_middle.UNITS_A_BLOCK
    pairs = [(k, "".join("ab-"[(k + j) % 3] * (1 + j % 2) for j in range(size * (k % 4) + k % 5))) for k in range(400)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert ordered(fill_middle.fill_in_middle(docs).collect()) == ordered(brute(*p) for p in pairs)


def test_text_ids(spark):
    pairs = [("b", "one two"), (None, "three"), ("", "three"), ("007", "four five, six")]
    docs = spark.createDataFrame(pairs, "doc_id string, text string")
    assert ordered(fill_middle.fill_in_middle(docs).collect()) == ordered(brute(*p) for p in pairs)
