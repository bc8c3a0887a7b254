"""Queries over model answers. Answers are written from `documents` by template; the oracle never parses them.

Each oracle computes the expected fields from the template's parameters: a quote that the document
holds for even ids, an invented one for odd ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import jsonx, markdown, text
from paperloom.operators import parsers

from .base import norm_sql, table

_CLEAN = "[*#\"'„“”»«`>_-]"


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, norm, quote, real (whether the document holds the quote)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("norm"))
    head = F.trim(F.substring("norm", 1, 40))
    real = (F.col("doc_id") % 2 == 0) & ~head.rlike(_CLEAN) & (F.length(head) >= 4)
    return docs.withColumn("real", real).withColumn("quote", F.when(real, head).otherwise(F.concat(F.lit("invented zz"), F.col("doc_id").cast("string"))))


QUOTED_SQL = f"""quoted AS (SELECT *, CASE WHEN real THEN head ELSE 'invented zz' || doc_id END AS quote FROM (
  SELECT doc_id, norm, head, doc_id % 2 = 0 AND NOT regexp_matches(head, '[*#"''„“”»«`>_-]') AND length(head) >= 4 AS real
  FROM (SELECT doc_id, norm, trim(substring(norm, 1, 40), ' ') AS head FROM (SELECT doc_id, {norm_sql("text")} AS norm FROM documents))))"""


def _template(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _grammar_answer() -> Column:
    return _template(
        "Intro.\n\n## Overall Assessment\n**Error Count:** ", (F.col("doc_id") % 7).cast("string"), " errors\n**Quality**: good\n**Summary:** \"text ", _id(),
        "\"\n\n## Error List\n### 1. Spelling (Severity: High)\n**Original:** ", F.col("quote"), "\n**Correction:** fixed ", _id(), "\n**Rule:**\nrule one\n\n### 2. Stil (Schwere: niedrig)\n**Original:** never ", _id(),
        " there\n**Korrektur:** x\n#### 3. Half\n**Original:** only this\n\n## Other\n",
    )


def parse_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _quoted(spark, sf_dir).select("doc_id", parsers.grammar(_grammar_answer(), F.col("norm")).alias("p"))
    first = F.get("p.errors", 0)
    return parsed.select(
        "doc_id", "p.error_count", "p.quality", "p.summary", F.size("p.errors").alias("n_errors"), first["type"].alias("type"), first["severity"].alias("severity"),
        first["original"].alias("original"), first["correction"].alias("correction"), first["rule"].alias("rule"), first["verified"].alias("verified"), parsers.filtered_count(F.col("p")).alias("filtered"),
    )


GRAMMAR_SQL = f"""WITH {QUOTED_SQL}
SELECT doc_id, doc_id % 7 AS error_count, 'good' AS quality, 'text ' || doc_id AS summary, real::INT AS n_errors,
       CASE WHEN real THEN 'Spelling' END AS type, CASE WHEN real THEN 'high' END AS severity, CASE WHEN real THEN quote END AS original, CASE WHEN real THEN 'fixed ' || doc_id END AS correction,
       CASE WHEN real THEN 'rule one' END AS rule, CASE WHEN real THEN true END AS verified, greatest(0, doc_id % 7 - real::INT) AS filtered FROM quoted"""


def _formulation_answer() -> Column:
    return _template(
        "## Dokumenttyp\n**Erkannt:** Brief\n**Tone:** formal ", _id(), "\n\n## Verbesserungsvorschläge\n### 1. Shorter\n**Kategorie:** Stil\n**Vorher:** „", F.col("quote"), "“\n**Nachher:** new ", _id(),
        "\n**Warum:** clearer\n\n### 2. Nothing\n**Before:** gone\n\n## Überarbeitete Gesamtversion\nAll of ", _id(), "\n\n",
    )


def parse_formulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _quoted(spark, sf_dir).select("doc_id", parsers.formulation(_formulation_answer(), F.col("norm")).alias("p"))
    first = F.get("p.suggestions", 0)
    return parsed.select("doc_id", "p.document_type", "p.tone", "p.impression", F.size("p.suggestions").alias("n"), first["title"].alias("title"), first["category"].alias("category"), first["before"].alias("before"), first["after"].alias("after"), first["why"].alias("why"), "p.revised")


FORMULATION_SQL = f"""WITH {QUOTED_SQL}
SELECT doc_id, 'Brief' AS document_type, 'formal ' || doc_id AS tone, '' AS impression, real::INT AS n, CASE WHEN real THEN 'Shorter' END AS title, CASE WHEN real THEN 'Stil' END AS category,
       CASE WHEN real THEN quote END AS before, CASE WHEN real THEN 'new ' || doc_id END AS after, CASE WHEN real THEN 'clearer' END AS why, 'All of ' || doc_id AS revised FROM quoted"""


def _summary_answer() -> Column:
    return _template(
        "## Document Type\n**Type:** invoice\n**Subject:** no ", _id(), "\n\n## Key Facts\n- **Sum:** ", (F.col("doc_id") * 3).cast("string"), " EUR\n-  **Due** soon\n\n## Kernaussagen\n- **Lead:** one ", _id(),
        "\n* two\n• three\n\n## Zusammenfassung\nShort ", _id(), "\n\n## Action Items\n- plain ", _id(), "\n- [ ] pay (Priority: High, Deadline: day ", _id(), ")\n- kein weiterer\n- [x] done\n\n## Observations\n- keine besonderen\n- odd\n",
        F.when(F.col("doc_id") % 3 == 0, F.lit("⚠ PHISHING-VERDACHT: link\n")).otherwise(""),
    )


def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "documents").select("doc_id", parsers.summary(_summary_answer()).alias("p"))
    facts = F.array_join(F.transform("p.key_facts", lambda f: F.concat(f["label"], F.lit("="), f["value"])), "|")
    return parsed.select("doc_id", "p.document_type", "p.title", facts.alias("facts"), F.array_join("p.key_points", "|").alias("points"), "p.summary", F.array_join("p.observations", "|").alias("observations"), "p.phishing")


SUMMARY_SQL = """SELECT doc_id, 'invoice' AS document_type, 'no ' || doc_id AS title, 'Sum=' || (doc_id * 3) || ' EUR|Due=soon' AS facts, 'one ' || doc_id || '|two|three' AS points,
 'Short ' || doc_id AS summary, 'odd' AS observations, CASE WHEN doc_id % 3 = 0 THEN 'link' END AS phishing FROM documents"""


def parse_action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsers.summary(_summary_answer())["action_items"]).alias("place", "item"))
    return parsed.select("doc_id", "place", "item.text", "item.priority", "item.deadline")


ACTION_SQL = """SELECT doc_id, 0 AS place, 'pay' AS text, 'high' AS priority, 'day ' || doc_id AS deadline FROM documents
UNION ALL SELECT doc_id, 1, 'plain ' || doc_id, NULL, NULL FROM documents"""


def strip_structured_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = _template("# A ", _id(), "\ntext\n\n", F.when(F.col("doc_id") % 2 == 0, F.lit("## Strukturierte  Daten\n```json\n{}\n```\n")).otherwise("rest \n"))
    return table(spark, sf_dir, "documents").select("doc_id", markdown.strip_structured(answer).alias("kept"))


STRIP_SQL = "SELECT doc_id, '# A ' || doc_id || chr(10) || 'text' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'rest' END AS kept FROM documents"


def _json_answer() -> Column:
    """Five forms by id: plain, fenced after an example, prose after an example, array, broken."""
    body = _template('{"id": ', _id(), ', "note": "a } brace { \\" in it"}')
    form = F.col("doc_id") % 5
    return (
        F.when(form == 0, body)
        .when(form == 1, _template("e.g. {\"x\": 1}\n```json\n{\"x\": 2}\n```\nthen\n```\n", body, "\n```"))
        .when(form == 2, _template("for example {\"x\": 1} so ", body, " done"))
        .when(form == 3, _template("[", _id(), "]"))
        .otherwise(_template('{"id": ', _id(), ", broken"))
    )


def json_extract_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.try_parse_json(jsonx.extract_object(_json_answer())).alias("v"))
    return found.select("doc_id", F.col("v").isNotNull().alias("found"), F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.note", "string").alias("note"))


JSON_SQL = """SELECT doc_id, doc_id % 5 < 3 AS found, CASE WHEN doc_id % 5 < 3 THEN doc_id END AS id, CASE WHEN doc_id % 5 < 3 THEN 'a } brace { " in it' END AS note FROM documents"""


def _letter_answer() -> Column:
    def phrase(said: Column | str, level: str) -> Column:
        return _template('{"phrase": "', said if isinstance(said, Column) else F.lit(said), f'", "decoded": "means", "severity": "{level}", "suggestion": {{"note2": "better"}}}}')

    grade = F.when(F.col("doc_id") % 3 == 0, _template('"overallGrade": {"grade": 4}')).otherwise(
        _template('"contentGrade": {"grade": ', (1 + F.col("doc_id") % 6).cast("string"), ', "confidence": "high", "reasoning": "r"}, "craftGrade": {"grade": 2, "confidence": "sure"}')
    )
    good = _template(
        "Prose.\n```json\n{\"sections\": 1}\n```\n```json\n{", grade, ', "sections": [{"name": "Intro", "present": false, "excerpt": "', F.col("quote"), '"}, 7, {"grade": 2.5}], "codedPhrases": [',
        phrase(F.col("quote"), "red"), ", ", phrase("not in any document at all", "red"), ", ", phrase(F.col("quote"), "blue"), '], "missingElements": [{"element": "Date"}, {}], "closingFormula": {"regret": {"excerpt": "x", "assessment": "positive"}, "thanks": {"assessment": "odd"}}, "summary": "s',
        _id(), "\"}\n```\n",
    )
    return F.when(F.col("doc_id") % 10 == 9, _template("no block ", _id())).otherwise(good)


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _quoted(spark, sf_dir).select("doc_id", "norm", jsonx.extract_letter(_letter_answer()).alias("block"))
    return blocks.select("doc_id", parsers.letter(F.col("block"), F.col("norm")).alias("p"))


def parse_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, other = F.get("p.sections", 0), F.get("p.sections", 1)
    return _letters(spark, sf_dir).select(
        "doc_id", "p.document_type", F.col("p.content_grade.grade").alias("content"), F.col("p.content_grade.confidence").alias("confidence"), F.col("p.craft_grade.grade").alias("craft"), F.col("p.craft_grade.confidence").alias("craft_confidence"),
        F.col("p.overall_grade.grade").alias("overall"), F.size("p.sections").alias("n_sections"), first["present"].alias("present"), first["verified"].alias("verified"), other["name"].alias("other_name"), other["grade"].alias("other_grade"),
        F.size("p.coded_phrases").alias("n_phrases"), F.size("p.missing").alias("n_missing"), F.col("p.closing.regret.assessment").alias("regret"), F.col("p.closing.thanks").isNull().alias("no_thanks"), "p.summary",
    )


LETTER_SQL = f"""WITH {QUOTED_SQL}, q AS (SELECT *, doc_id % 10 <> 9 AS good, doc_id % 3 = 0 AS old FROM quoted)
SELECT doc_id, CASE WHEN good THEN 'qualifiziertes' END AS document_type, CASE WHEN good THEN CASE WHEN old THEN 4 ELSE 1 + doc_id % 6 END END::INT AS content, CASE WHEN good THEN CASE WHEN old THEN 'medium' ELSE 'high' END END AS confidence,
       CASE WHEN good THEN CASE WHEN old THEN 3 ELSE 2 END END::INT AS craft, CASE WHEN good THEN CASE WHEN old THEN 'low' ELSE 'medium' END END AS craft_confidence, CASE WHEN good THEN CASE WHEN old THEN 4 ELSE 1 + doc_id % 6 END END::INT AS overall,
       CASE WHEN good THEN 2 END::INT AS n_sections, CASE WHEN good THEN false END AS present, CASE WHEN good AND norm <> '' THEN real END AS verified, CASE WHEN good THEN 'Unbekannt' END AS other_name, NULL::INT AS other_grade,
       CASE WHEN good THEN CASE WHEN norm = '' THEN 3 WHEN real THEN 2 ELSE 0 END END::INT AS n_phrases, CASE WHEN good THEN 1 END::INT AS n_missing, CASE WHEN good THEN 'positive' END AS regret, true AS no_thanks, CASE WHEN good THEN 's' || doc_id END AS summary
FROM q"""


def letter_red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _letters(spark, sf_dir).select("doc_id", F.posexplode(parsers.red_flags(F.col("p"))).alias("place", "flag"))
    return flags.select("doc_id", "place", "flag.phrase", "flag.decoded", "flag.suggestion.note2")


FLAGS_SQL = f"WITH {QUOTED_SQL} SELECT doc_id, 0 AS place, quote AS phrase, 'means' AS decoded, 'better' AS note2 FROM quoted WHERE real AND doc_id % 10 <> 9"


def first_impression(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("doc_id") % 3 == 0, F.lit("summary")).otherwise("poem")
    said = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.repeat(F.concat(F.lit("i"), _id(), F.lit(" ")), 80))
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit('"letter"')).otherwise("12")
    answer = _template('Sure:\n```json\n{"documentType": ', kind, ', "recommendedMode": "', mode, '", "firstImpression": "', said, '"}\n```')
    parsed = table(spark, sf_dir, "documents").select("doc_id", parsers.first_impression(jsonx.extract_object(answer)).alias("p"))
    return parsed.where("p IS NOT NULL").select("doc_id", "p.*")


IMPRESSION_SQL = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'letter' ELSE 'sonstiges' END AS document_type, CASE WHEN doc_id % 3 = 0 THEN 'summary' ELSE 'freeform' END AS recommended_mode,
 substring(repeat('i' || doc_id || ' ', 80), 1, 200) AS impression FROM documents WHERE doc_id % 4 <> 0"""


def verify_pass_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _template("first ", _id())
    form = F.col("doc_id") % 4
    second = F.when(form == 0, _template('{"ok": ', _id(), "}")).when(form == 1, F.lit(" \n")).when(form == 2, _template("no object ", _id()))
    rows = table(spark, sf_dir, "documents").select("doc_id", first.alias("a"), second.alias("b"), jsonx.extract_object(second).alias("found"))
    return rows.select("doc_id", parsers.choose_pass(F.col("a"), F.col("b"), F.col("found")).alias("chosen"))


CHOICE_SQL = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{"ok": ' || doc_id || '}' ELSE 'first ' || doc_id END AS chosen FROM documents"""


def markdown_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = _template("# Title ", _id(), "\n\n> said <b>\n- one **bold**\n2. two *it*\n\n```\n# code & ", _id(), "\n```\nplain `x` ", _id())
    return table(spark, sf_dir, "documents").select("doc_id", markdown.html(answer).alias("html"))


_NL = "|| chr(10) ||"
HTML_SQL = f"""SELECT doc_id, '<h1>Title ' || doc_id || '</h1>' {_NL} '<br>' {_NL} '<blockquote>said &lt;b&gt;</blockquote>' {_NL} '<ul><li>one <strong>bold</strong></li>' {_NL} '<li>two <em>it</em></li>' || chr(10) || '</ul><br>'
 {_NL} '<pre><code>' {_NL} '# code &amp; ' || doc_id {_NL} '</code></pre>' {_NL} '<p>plain <code>x</code> ' || doc_id || '</p>' AS html FROM documents"""

QUERIES = {
    "parse_grammar": (parse_grammar, GRAMMAR_SQL),
    "parse_formulation": (parse_formulation, FORMULATION_SQL),
    "parse_summary": (parse_summary, SUMMARY_SQL),
    "parse_action_items": (parse_action_items, ACTION_SQL),
    "strip_structured_section": (strip_structured_section, STRIP_SQL),
    "json_extract_object": (json_extract_object, JSON_SQL),
    "parse_letter": (parse_letter, LETTER_SQL),
    "letter_red_flags": (letter_red_flags, FLAGS_SQL),
    "first_impression": (first_impression, IMPRESSION_SQL),
    "verify_pass_choice": (verify_pass_choice, CHOICE_SQL),
    "markdown_to_html": (markdown_to_html, HTML_SQL),
}
