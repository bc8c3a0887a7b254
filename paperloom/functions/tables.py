"""Markdown blocks and fields as functions that SQL text can call, the blocks as a table function for LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperloom.functions.patterns import WS

_HEAD = rf"#{{3,4}}[{WS}]+(\d+)\.[{WS}]*"

#: SQL bodies of the table functions: name, columns, array of structs whose elements are the rows.
TABLES = (
    # Blocks headed `### n.` or `#### n.`, as markdown.numbered_blocks() has them; none for null.
    ("md_blocks", "idx INT, body STRING", rf"filter(zip_with(regexp_extract_all(md, r'{_HEAD}', 1), slice(split(md, r'{_HEAD}', -1), 2, 1000000000), (n, part) -> struct(int(n) AS idx, part AS body)), b -> NOT b.body RLIKE r'\A[{WS}]*\z')"),
    # Lines, numbered from 1; none for null.
    ("text_lines", "line_no INT, line STRING", "transform(split(md, '\\n', -1), (line, k) -> struct(k + 1 AS line_no, line AS line))"),
)

#: SQL bodies of the scalar functions: name, arguments, type, body.
SCALARS = (
    ("md_field", "block STRING, label STRING", "STRING", rf"nullif(trim(regexp_extract(block, concat('(?isu)\\*\\*', '\\Q', label, '\\E', '[\\s]*:?[\\s]*\\*\\*[\\s]*:?[\\s]*(.+?)(?=\\n[\\s]*\\*\\*|\\n[\\s]*\\n|\\n[\\s]*#|\\z)'), 1)), '')"),
    ("md_severity", "raw STRING", "STRING", "CASE WHEN contains(lower(raw), 'hoch') OR contains(lower(raw), 'high') THEN 'high' WHEN contains(lower(raw), 'niedrig') OR contains(lower(raw), 'low') THEN 'low' ELSE 'medium' END"),
)


def register(spark: SparkSession) -> None:
    """Makes md_blocks and text_lines (table functions), and md_field and md_severity known to the session's SQL."""
    for name, columns, rows in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(md STRING) RETURNS TABLE ({columns}) RETURN SELECT * FROM inline({rows})")
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
