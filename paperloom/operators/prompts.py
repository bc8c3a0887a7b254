"""Prompts under a token budget: templates by mode and language, shortening, mode parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import classify, text
from paperloom.functions.patterns import CONTEXT_TOKENS, IMPRESSION_SAMPLE, RESPONSE_TOKENS, TEMPERATURES

#: System prompts by mode: German, then English. The letter mode is always German.
SYSTEM = {
    "grammar": ("Prüfe Rechtschreibung und Grammatik. Antworte mit ## Gesamtbewertung und ## Fehler-Liste, jeder Fehler als ### n.", "Check spelling and grammar. Answer with ## Overall Assessment and ## Error List, each error as ### n."),
    "formulation": ("Verbessere die Formulierungen. Antworte mit ## Dokumenttyp und ## Verbesserungen.", "Improve the wording. Answer with ## Document Type and ## Suggestions."),
    "arbeitszeugnis": ("Bewerte das Arbeitszeugnis und gib am Ende einen JSON-Block mit Noten und Abschnitten aus.", None),
    "summary": ("Fasse das Dokument zusammen: ## Dokumenttyp, ## Wichtige Fakten, ## Zusammenfassung, ## Handlungsbedarf.", "Summarise the document: ## Document Type, ## Key Facts, ## Summary, ## Action Items."),
    "freeform": ("Beantworte die Frage zum Dokument.", "Answer the question about the document."),
}
#: The short prompt that classifies a document by its beginning; {} is the language of the sentence.
IMPRESSION = "Classify the document. Answer with a JSON object of documentType, recommendedMode and firstImpression, a short sentence in {}."
IMPRESSION_TEMPERATURE, IMPRESSION_CONTEXT = 0.1, 2048
#: The second pass of letter mode: findings without a literal quote are struck out.
VERIFY = "Streiche aus der JSON-Analyse jeden Befund, dessen Zitat nicht wörtlich im Zeugnis steht. Erfinde nichts und ändere keine Note. Antworte nur mit dem bereinigten JSON-Block."
VERIFY_USER = "<document>\n{}\n</document>\n\n<analysis>\n{}\n</analysis>"
DEFAULT_QUESTION = "Worum geht es?"
#: Round the document in a user message.
BEFORE, AFTER = "<document>\n", "\n</document>"
DIRECTIVE = "\n\nWrite all prose in {}. Keep headings, bold labels and quotes from the document as they are."


def register_mode(name: str, german: str, english: str | None, temperature: float) -> None:
    """Adds a mode, or replaces one: its system prompts and temperature. Expressions built later know it."""
    SYSTEM[name] = (german, english)
    TEMPERATURES[name] = temperature


def with_language(system: Column, code: Column) -> Column:
    """German and English prompts stay; others are told the language to answer in."""
    head, tail = DIRECTIVE.split("{}")
    return F.when(code.isin("de", "en"), system).otherwise(F.concat(system, F.lit(head), classify.english_name(code), F.lit(tail)))


def system_prompt(mode: Column, code: Column) -> Column:
    out = F.lit(SYSTEM["freeform"][1])
    for name, (german, english) in SYSTEM.items():
        said = F.when(code == "de", german).otherwise(F.lit(english)) if english else F.lit(german)
        out = F.when(mode == name, said if not english else with_language(said, code)).otherwise(out)
    return out


def user_prompt(mode: Column, document: Column, question: Column) -> Column:
    asked = F.when(mode == "freeform", F.concat(F.lit("\n\n"), F.coalesce(question, F.lit(DEFAULT_QUESTION)))).otherwise("")
    return F.concat(F.lit(BEFORE), document, F.lit(AFTER), asked)


def temperature(mode: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m in TEMPERATURES for x in (m, TEMPERATURES[m])]), mode), F.lit(TEMPERATURES["freeform"]))


def prompt(mode: Column, document: Column, code: Column, question: Column) -> Column:
    """struct(system, user, temperature, context, truncated): the document is shortened if the whole exceeds the context."""
    system = system_prompt(mode, code)
    whole = user_prompt(mode, document, question)
    fixed = text.tokens(system) + text.tokens(whole)
    over = fixed + RESPONSE_TOKENS > CONTEXT_TOKENS
    fitted = text.fit(document, CONTEXT_TOKENS - RESPONSE_TOKENS - (fixed - text.tokens(document)))
    return F.struct(
        system.alias("system"),
        F.when(over, user_prompt(mode, fitted["text"], question)).otherwise(whole).alias("user"),
        temperature(mode).alias("temperature"),
        F.lit(CONTEXT_TOKENS).alias("context"),
        (over & fitted["truncated"]).alias("truncated"),
    )


def first_impression(document: Column, code: Column) -> Column:
    """struct(system, user, temperature, context) over the document's first characters."""
    head, tail = IMPRESSION.split("{}")
    return F.struct(
        F.concat(F.lit(head), classify.english_name(code), F.lit(tail)).alias("system"),
        F.concat(F.lit(BEFORE), F.substring(document, 1, IMPRESSION_SAMPLE), F.lit(AFTER)).alias("user"),
        F.lit(IMPRESSION_TEMPERATURE).alias("temperature"),
        F.lit(IMPRESSION_CONTEXT).alias("context"),
    )


def verification(document: Column, answer: Column) -> Column:
    """struct(system, user) of the second pass of letter mode: the document and the first answer."""
    head, middle, tail = VERIFY_USER.split("{}")
    return F.struct(F.lit(VERIFY).alias("system"), F.concat(F.lit(head), document, F.lit(middle), answer, F.lit(tail)).alias("user"))


def with_notice(answer: Column, truncated: Column, mode: Column) -> Column:
    """A stored answer says so if its document was shortened, except in letter mode, whose answer is parsed."""
    return F.when(truncated & (mode != "arbeitszeugnis"), F.concat(answer, F.lit(text.NOTICE))).otherwise(answer)
