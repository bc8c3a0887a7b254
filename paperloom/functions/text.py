"""Column functions over text: white space, lengths, printability, words, language, tokens, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import BREAK_RANGE, CHARS_PER_TOKEN, CONTROL, CONTROL_MAX, GARBLED_SAMPLE, GERMAN_WORDS, LANGUAGE_MIN_CHARS, LANGUAGE_RATIO, MARKER_CHARS, MIN_EVIDENCE, PRINTABLE, PRINTABLE_MIN, WS

#: Appended to texts that were shortened. Budgets count on its length.
MARKER = "\n\n[... document shortened here for analysis -- what follows did not fit into the context window of that model ...]"
assert len(MARKER) == MARKER_CHARS

#: Appended to stored answers whose document was shortened.
NOTICE = "\n\n---\n*Only the first part of the document was analysed; the rest exceeded the context window.*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def js_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def trim_ws(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def rtrim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+\\z", "")


def normalise(text: Column) -> Column:
    """Lower case, white space runs as one space, trimmed: the form in which quotes are compared."""
    return F.trim(F.regexp_replace(F.lower(text), f"[{WS}]+", " "))


def contains_quote(normalised: Column, quote: Column) -> Column:
    """Whether a quote of at least four characters occurs in a text that is normalised already."""
    return F.coalesce((js_length(quote) >= MIN_EVIDENCE) & (js_length(normalise(quote)) >= MIN_EVIDENCE) & F.contains(normalised, normalise(quote)), F.lit(False))


def count_of(text: Column, inside: str) -> Column:
    """Characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{inside}]+", ""))).cast("long")


def printable_chars(text: Column) -> Column:
    return count_of(text, PRINTABLE)


def control_chars(text: Column) -> Column:
    return count_of(text, CONTROL)


def print_verdict(chars: Column, printable: Column, control: Column) -> Column:
    """'empty', 'control' (tested first), 'unprintable' or 'ok'."""
    return (
        F.when(chars == 0, "empty")
        .when(control / chars > CONTROL_MAX, "control")
        .when(printable / chars < PRINTABLE_MIN, "unprintable")
        .otherwise("ok")
    )


def text_verdict(text: Column) -> Column:
    """print_verdict() of a text whose characters are counted once."""
    counts = lambda t: F.struct(js_length(t).alias("chars"), printable_chars(t).alias("printable"), control_chars(t).alias("control"))
    return let(text, lambda t: let(counts(t), lambda n: print_verdict(n["chars"], n["printable"], n["control"])))


def text_reject(text: Column) -> Column:
    """text_verdict(), null for 'ok'."""
    return let(text_verdict(text), lambda verdict: F.when(verdict != "ok", verdict))


def looks_garbled(text: Column, sample: int = GARBLED_SAMPLE) -> Column:
    """The same limits over the first characters; an empty text is not garbled."""
    head = F.substring(text, 1, sample)
    chars = js_length(head)
    return (chars > 0) & (print_verdict(chars, printable_chars(head), control_chars(head)) != "ok")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"[{WS}]+"), "")).cast("long")


def language(text: Column) -> Column:
    """'de' if more than 2 % of the words are German function words, else 'en'; null for short texts."""
    words = F.split(F.lower(text), f"[{WS}]+", -1)
    german = F.size(F.filter(words, lambda w: w.isin(*GERMAN_WORDS)))
    return F.when(js_length(text) > LANGUAGE_MIN_CHARS, F.when(german / F.greatest(F.size(words), F.lit(1)) > LANGUAGE_RATIO, "de").otherwise("en"))


def tokens(text: Column) -> Column:
    return F.ceil(js_length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def _last_index(text: Column, needle: str) -> Column:
    return F.when(F.contains(text, F.lit(needle)), F.length(text) - F.length(F.substring_index(text, needle, -1)) - len(needle)).otherwise(-1)


def shortened(text: Column, max_tokens: Column) -> Column:
    """Cut to the budget less the marker, back to the last paragraph or sentence if that is near, then marked."""
    most = F.greatest(F.lit(0), F.floor(max_tokens * F.lit(CHARS_PER_TOKEN)).cast("int") - MARKER_CHARS)
    cut = F.substring(text, F.lit(1), most)
    last = F.greatest(_last_index(cut, "\n\n"), _last_index(cut, ". "))
    return F.concat(F.when(last > most - BREAK_RANGE, F.substring(cut, F.lit(1), last + 1)).otherwise(cut), F.lit(MARKER))


def fit(text: Column, max_tokens: Column) -> Column:
    """struct(text, truncated): the text unchanged if it is within the budget."""
    over = tokens(text) > max_tokens
    return F.struct(F.when(over, shortened(text, max_tokens)).otherwise(text).alias("text"), over.alias("truncated"))
