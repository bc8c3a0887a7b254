"""Answers of the five modes as typed structs. A document, where given, filters findings by evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import jsonx, text
from paperloom.functions.markdown import bullets, digits, field, first_group, numbered_blocks, priority, section, severity
from paperloom.functions.patterns import IMPRESSION_MAX, MODES, RED_FLAGS, WS


def _checked(findings: Column, normal: Column | None, *quotes: str) -> Column:
    """Adds verified to each finding and drops unverified ones. Without a document nothing is dropped and verified is null."""
    if normal is None:
        return F.transform(findings, lambda f: f.withField("verified", F.lit(None).cast("boolean")))

    def checked(document: Column) -> Column:
        def said(f: Column) -> Column:
            hit = F.lit(False)
            for quote in quotes:
                hit = hit | text.contains_quote(document, f[quote])
            return F.when(F.coalesce(F.length(document), F.lit(0)) > 0, hit)

        return F.filter(F.transform(findings, lambda f: f.withField("verified", said(f))), lambda f: F.coalesce(f["verified"], F.lit(True)))

    return text.let(normal, checked)


def grammar(md: Column, normal: Column | None = None) -> Column:
    """struct(error_count, quality, summary, errors); null without an overall section. normal: the normalised document."""
    whole = section(md, "Gesamtbewertung", "Gesamtquality", "Uebersicht", "Overall Assessment", "Overall")
    listed = F.coalesce(section(md, "Fehler-Liste", "Fehlerliste", "Error List", "Errors"), F.lit(""))

    def error(b: Column) -> Column:
        head = rf"(?i)^[{WS}]*([^\n(]+?)[{WS}]*\((?:Schwere|Severity):[{WS}]*([^)]+)\)"
        return F.struct(
            b["index"].alias("index"),
            F.coalesce(text.trim_ws(first_group(b["body"], head)), F.lit("Fehler")).alias("type"),
            severity(first_group(b["body"], head, 2)).alias("severity"),
            field(b["body"], "Original").alias("original"),
            field(b["body"], "Korrektur", "Correction").alias("correction"),
            field(b["body"], "Kontext", "Context", "Kontext-Satz", "Context Sentence").alias("context"),
            field(b["body"], "Regel", "Rule").alias("rule"),
        )

    errors = F.filter(F.transform(numbered_blocks(listed), error), lambda e: e["original"].isNotNull() & e["correction"].isNotNull())

    def parsed(overall: Column) -> Column:
        return F.when(
            F.length(overall) > 0,
            F.struct(
                digits(F.coalesce(field(overall, "Anzahl Fehler", "Fehleranzahl", "Error Count"), F.lit("0"))).alias("error_count"),
                F.coalesce(field(overall, "Qualitaet", "Qualität", "Quality", "Bewertung", "Note"), F.lit("Unbekannt")).alias("quality"),
                F.coalesce(field(overall, "Kurzfassung", "Zusammenfassung", "Summary"), F.lit("")).alias("summary"),
                _checked(errors, normal, "original", "context").alias("errors"),
            ),
        )

    return text.let(whole, parsed)


def filtered_count(parsed: Column) -> Column:
    """Findings that an answer claims but that its document doesn't bear out."""
    return F.greatest(F.lit(0), parsed["error_count"] - F.size(parsed["errors"]))


def formulation(md: Column, normal: Column | None = None) -> Column:
    """struct(document_type, tone, impression, suggestions, revised); null without a document type section."""
    head = section(md, "Dokumenttyp", "Document Type")
    listed = F.coalesce(section(md, "Verbesserungsvorschlaege", "Verbesserungsvorschläge", "Verbesserungen", "Vorschlaege", "Vorschläge", "Suggestions"), F.lit(""))

    def suggestion(b: Column) -> Column:
        title = text.trim_ws(first_group(b["body"], rf"^[{WS}]*([^\n]+)"))
        return F.struct(
            b["index"].alias("index"),
            F.coalesce(title, F.concat(F.lit("Vorschlag "), b["index"].cast("string"))).alias("title"),
            field(b["body"], "Kategorie", "Category").alias("category"),
            field(b["body"], "Vorher", "Before", "Original").alias("before"),
            field(b["body"], "Nachher", "After", "Verbessert").alias("after"),
            field(b["body"], "Warum", "Why", "Begruendung", "Begründung", "Reason").alias("why"),
        )

    found = F.filter(F.transform(numbered_blocks(listed), suggestion), lambda s: s["before"].isNotNull() & s["after"].isNotNull())
    s = f"[{WS}]*"
    revised = [rf"(?iu)##{s}(?:Ue|Ü)berarbeitete{s}Gesamtversion{s}([\s\S]*?)\z", rf"(?iu)##{s}Komplette{s}(?:Ue|Ü)berarbeitete{s}Version{s}([\s\S]*?)\z", rf"(?iu)##{s}Endversion{s}([\s\S]*?)\z", rf"(?iu)##{s}Revised{s}Full{s}Version{s}([\s\S]*?)\z"]
    return F.when(
        F.length(head) > 0,
        F.struct(
            F.coalesce(field(head, "Erkannt", "Typ", "Dokumenttyp", "Detected", "Type"), F.lit("Unbekannt")).alias("document_type"),
            F.coalesce(field(head, "Tonalitaets-Empfehlung", "Tonalitäts-Empfehlung", "Tonalitaet", "Tonalität", "Ton", "Tone Recommendation", "Tone"), F.lit("")).alias("tone"),
            F.coalesce(field(head, "Gesamteindruck", "Eindruck", "Overall Impression", "Impression"), F.lit("")).alias("impression"),
            _checked(found, normal, "before").alias("suggestions"),
            text.trim_ws(F.coalesce(*[first_group(md, p) for p in revised])).alias("revised"),
        ),
    )


def action_items(actions: Column) -> Column:
    """array<struct(text, priority, deadline)>: open checkboxes first, then plain bullets that don't say there are none."""
    boxes = F.regexp_extract_all(actions, F.lit(rf"-[{WS}]*\[[{WS}]*\][{WS}]*([^\n]+)"), F.lit(1))
    plain = F.regexp_extract_all(actions, F.lit(rf"(?m)^[{WS}]*-[{WS}]+(?!\[)([^\n]+)"), F.lit(1))
    plain = F.filter(F.transform(plain, text.trim_ws), lambda t: ~F.lower(t).startswith("kein"))
    both = F.filter(F.concat(F.transform(boxes, text.trim_ws), plain), lambda t: t != "")
    return F.transform(
        both,
        lambda t: F.struct(
            text.trim_ws(F.regexp_replace(t, r"\([^)]*\)", "")).alias("text"),
            priority(first_group(t, rf"(?i)(?:Prioritaet|Priority|Prio):[{WS}]*(\w+)")).alias("priority"),
            text.trim_ws(first_group(t, rf"(?i)(?:Frist|Deadline|Bis):[{WS}]*([^),]+)")).alias("deadline"),
        ),
    )


def summary(md: Column) -> Column:
    """struct(document_type, title, key_facts, key_points, summary, action_items, observations, phishing); null without a document type."""
    head = section(md, "Dokumenttyp", "Document Type")
    facts = F.coalesce(section(md, "Wichtige Fakten", "Key Facts", "Fakten"), F.lit(""))
    fact = rf"-[{WS}]*\*\*([^:*]+):?\*\*[{WS}]*([^\n]+)"
    key_facts = F.zip_with(F.regexp_extract_all(facts, F.lit(fact), F.lit(1)), F.regexp_extract_all(facts, F.lit(fact), F.lit(2)), lambda a, b: F.struct(text.trim_ws(a).alias("label"), text.trim_ws(b).alias("value")))
    points = bullets(F.coalesce(section(md, "Kernaussagen", "Key Points", "Hauptpunkte"), F.lit("")))
    notes = bullets(F.coalesce(section(md, "Auffaelligkeiten", "Auffälligkeiten", "Observations", "Hinweise"), F.lit("")))
    return F.when(
        F.length(head) > 0,
        F.struct(
            F.coalesce(field(head, "Typ", "Type", "Erkannt", "Detected"), F.lit("Unbekannt")).alias("document_type"),
            field(head, "Titel", "Title", "Betreff", "Subject").alias("title"),
            key_facts.alias("key_facts"),
            F.transform(points, lambda p: F.coalesce(text.trim_ws(first_group(p, rf"^\*\*[^:*]+:?\*\*[{WS}]*(.+)\z")), p)).alias("key_points"),
            F.coalesce(text.trim_ws(section(md, "Zusammenfassung", "Summary")), F.lit("")).alias("summary"),
            action_items(F.coalesce(section(md, "Handlungsbedarf", "Action Items", "Aktionen"), F.lit(""))).alias("action_items"),
            F.filter(notes, lambda n: ~F.contains(F.lower(n), F.lit("keine besonderen"))).alias("observations"),
            text.trim_ws(first_group(md, rf"(?i)(?:⚠[{WS}]*)?PHISHING[-{WS}]?(?:VERDACHT|WARNING):?[{WS}]*([^\n]+)")).alias("phishing"),
        ),
    )


_ASSESSMENTS = ("positive", "neutral", "negative", "missing_negative")
_NO_CRAFT_LABEL, _NO_CRAFT_REASON = "not rated separately", "The answer has no rating of its own for structure."


def _grade(parsed: Column, name: str) -> Column:
    raw = F.try_variant_get(parsed, f"$.{name}", "variant")
    said = jsonx.string(raw, "confidence")
    return F.when(
        jsonx.grade(raw).isNotNull(),
        F.struct(
            jsonx.grade(raw).alias("grade"),
            jsonx.string(raw, "label").alias("label"),
            F.when(said.isin("high", "medium", "low"), said).otherwise("medium").alias("confidence"),
            F.coalesce(jsonx.string(raw, "reasoning"), F.lit("")).alias("reasoning"),
        ),
    )


def letter(block: Column, normal: Column | None = None) -> Column:
    """The parsed reference letter from the JSON text of its block; null without a valid content or overall grade.

    Sections keep unverified excerpts and say so; coded phrases without evidence in the document go.
    """
    document = normal if normal is not None else F.lit(None).cast("string")
    return text.let(F.struct(F.try_parse_json(block).alias("parsed"), document.alias("normal")), lambda both: _letter(both["parsed"], both["normal"]))


def _letter(parsed: Column, normal: Column) -> Column:
    content = F.coalesce(_grade(parsed, "contentGrade"), _grade(parsed, "overallGrade"))
    missing_craft = F.struct(F.lit(3).alias("grade"), F.lit(_NO_CRAFT_LABEL).alias("label"), F.lit("low").alias("confidence"), F.lit(_NO_CRAFT_REASON).alias("reasoning"))
    has_document, norm = F.coalesce(F.length(normal), F.lit(0)) > 0, F.coalesce(normal, F.lit(""))

    def one_section(s: Column) -> Column:
        evidence, excerpt = jsonx.string(s, "evidence"), jsonx.string(s, "excerpt")
        return F.struct(
            F.coalesce(jsonx.string(s, "name"), F.lit("Unbekannt")).alias("name"),
            F.coalesce(jsonx.boolean(s, "present"), F.lit(True)).alias("present"),
            jsonx.grade(s).alias("grade"),
            excerpt.alias("excerpt"),
            evidence.alias("evidence"),
            jsonx.string(s, "assessment").alias("assessment"),
            F.when(has_document, text.contains_quote(norm, F.coalesce(F.nullif(evidence, F.lit("")), excerpt))).alias("verified"),
        )

    def phrase(p: Column) -> Column:
        said, evidence, level = F.coalesce(jsonx.string(p, "phrase"), F.lit("")), jsonx.string(p, "evidence"), jsonx.string(p, "severity")
        suggestion = F.try_variant_get(p, "$.suggestion", "variant")
        return F.struct(
            said.alias("phrase"),
            evidence.alias("evidence"),
            F.coalesce(jsonx.string(p, "decoded"), F.lit("")).alias("decoded"),
            F.when(level.isin("green", "yellow", "red"), level).otherwise("yellow").alias("severity"),
            jsonx.string(p, "category").alias("category"),
            F.when(jsonx.is_object(suggestion), F.struct(jsonx.string(suggestion, "note2").alias("note2"), jsonx.string(suggestion, "note3").alias("note3"), jsonx.string(suggestion, "howToNegotiate").alias("how_to"))).alias("suggestion"),
            F.when(has_document, text.contains_quote(norm, F.coalesce(evidence, said))).alias("verified"),
        )

    def element(m: Column) -> Column:
        return F.struct(*[F.coalesce(jsonx.string(m, n), F.lit("")).alias(n) for n in ("element", "importance", "implication")])

    closing = F.try_variant_get(parsed, "$.closingFormula", "variant")

    def part(name: str) -> Column:
        raw = F.try_variant_get(closing, f"$.{name}", "variant")
        excerpt, said = jsonx.string(raw, "excerpt"), jsonx.string(raw, "assessment")
        rated = F.when(said.isin(*_ASSESSMENTS), said)
        return F.when((F.coalesce(F.length(excerpt), F.lit(0)) > 0) | rated.isNotNull(), F.struct(excerpt.alias("excerpt"), rated.alias("assessment")))

    phrases = F.filter(F.transform(jsonx.objects(parsed, "codedPhrases"), phrase), lambda p: (p["phrase"] != "") & (p["decoded"] != "") & F.coalesce(p["verified"], F.lit(True)))
    return F.when(
        content.isNotNull(),
        F.struct(
            F.coalesce(jsonx.string(parsed, "documentType"), F.lit("qualifiziertes")).alias("document_type"),
            content.alias("content_grade"),
            F.coalesce(_grade(parsed, "craftGrade"), missing_craft).alias("craft_grade"),
            F.coalesce(_grade(parsed, "overallGrade"), content).alias("overall_grade"),
            F.transform(jsonx.objects(parsed, "sections"), one_section).alias("sections"),
            phrases.alias("coded_phrases"),
            F.filter(F.transform(jsonx.objects(parsed, "missingElements"), element), lambda m: m["element"] != "").alias("missing"),
            F.struct(*[part(n).alias(n) for n in ("regret", "wishes", "thanks", "reason")]).alias("closing"),
            F.coalesce(jsonx.string(parsed, "summary"), F.lit("")).alias("summary"),
            jsonx.boolean(parsed, "notGenuineZeugnis").alias("not_genuine"),
        ),
    )


def red_flags(parsed: Column, most: int = RED_FLAGS) -> Column:
    """The first red phrases in their order."""
    return F.slice(F.filter(parsed["coded_phrases"], lambda p: p["severity"] == "red"), 1, most)


def first_impression(block: Column) -> Column:
    """struct(document_type, recommended_mode, impression) from an answer's JSON text; null without an impression."""
    parsed = F.try_parse_json(block)
    mode = jsonx.string(parsed, "recommendedMode")
    said = F.substring(F.coalesce(jsonx.string(parsed, "firstImpression"), F.lit("")), 1, IMPRESSION_MAX)
    return F.when(
        said != "",
        F.struct(
            F.coalesce(jsonx.string(parsed, "documentType"), F.lit("sonstiges")).alias("document_type"),
            F.when(mode.isin(*MODES), mode).otherwise("freeform").alias("recommended_mode"),
            said.alias("impression"),
        ),
    )


def choose_pass(first: Column, second: Column, second_object: Column) -> Column:
    """The second answer if it isn't blank and holds a JSON object (second_object isn't null), else the first."""
    return F.when((F.coalesce(F.length(text.trim_ws(second)), F.lit(0)) > 0) & second_object.isNotNull(), second).otherwise(first)
