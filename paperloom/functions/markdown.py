"""Column functions over Markdown answers: sections, fields, numbered blocks, bullets, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import WS
from .text import let, rtrim_ws, trim_ws


def _java(literal: str) -> str:
    """A literal as a Java pattern."""
    return rf"\Q{literal}\E"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one (an empty group stays empty)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def section(md: Column, *titles: str) -> Column:
    """What follows `## title`, up to the next `## ` at a line's start; of several titles, the first that occurs.

    A title matches anywhere after ##, whatever follows it; spaces in it match spaces and hyphens.
    """

    def pattern(title: str) -> str:
        spaced = rf"[{WS}-]+".join(_java(part) for part in title.split())
        return rf"(?imu)##[{WS}]*{spaced}([\s\S]*?)(?=^##[{WS}]|(?![\s\S]))"

    return F.coalesce(*[first_group(md, pattern(t)) for t in titles])


_QUOTES_AHEAD, _QUOTES_AFTER = "[\"'„»“”]", "[\"'»«“”]"


def field(block: Column, *labels: str) -> Column:
    """The value of `**label:** value`, of the first label with one that isn't empty; null if none.

    The colon may stand inside or outside the stars, or be missing. A value ends before the next
    bold label, blank line or heading; quotation marks round it are dropped.
    """

    def value(label: str) -> Column:
        end = rf"(?=\n[{WS}]*\*\*[A-ZÄÖÜa-zäöü0-9]|\n[{WS}]*\n|\n[{WS}]*#|\z)"
        # The group is never empty, so nothing found is empty.
        found = F.regexp_extract(block, rf"(?isu)\*\*{_java(label)}[{WS}]*:?[{WS}]*\*\*[{WS}]*:?[{WS}]*(.+?){end}", 1)
        return F.nullif(trim_ws(F.regexp_replace(trim_ws(found), f"^{_QUOTES_AHEAD}+|{_QUOTES_AFTER}+\\z", "")), F.lit(""))

    return F.coalesce(*[value(label) for label in labels])


def numbered_blocks(text: Column) -> Column:
    """array<struct(index, body)> of the blocks headed `### n.` or `#### n.`; blank ones are left out."""
    head = rf"#{{3,4}}[{WS}]+(\d+)\.[{WS}]*"
    numbers = F.regexp_extract_all(text, F.lit(head), F.lit(1))
    bodies = F.slice(F.split(text, head, -1), 2, 1_000_000_000)
    blocks = F.zip_with(numbers, bodies, lambda n, body: F.struct(n.cast("int").alias("index"), body.alias("body")))
    return F.filter(blocks, lambda b: trim_ws(b["body"]) != "")


def bullets(text: Column) -> Column:
    """Texts of the lines that start with -, * or •."""
    lines = F.regexp_extract_all(text, F.lit(rf"(?m)^[{WS}]*[-*•][{WS}]+(.+)$"), F.lit(1))
    return F.filter(F.transform(lines, trim_ws), lambda line: line != "")


def severity(raw: Column) -> Column:
    """high or low if the word occurs (in German or English), else medium."""
    said = F.lower(raw)
    return F.when(F.contains(said, F.lit("hoch")) | F.contains(said, F.lit("high")), "high").when(F.contains(said, F.lit("niedrig")) | F.contains(said, F.lit("low")), "low").otherwise("medium")


def priority(raw: Column) -> Column:
    """high, low or medium by the word's beginning, else null."""
    said = F.lower(raw)
    return (
        F.when(said.startswith("hoch") | said.startswith("high"), "high")
        .when(said.startswith("nied") | said.startswith("low"), "low")
        .when(said.startswith("mittel") | said.startswith("medium"), "medium")
    )


def digits(raw: Column) -> Column:
    """All digits of a text as one number, 0 without any."""
    return F.coalesce(F.regexp_replace(raw, r"\D", "").try_cast("bigint"), F.lit(0))


def strip_structured(md: Column) -> Column:
    """Without the trailing section of structured data."""
    return rtrim_ws(F.regexp_replace(md, rf"(?iu)##[{WS}]*Strukturierte[{WS}]*Daten[\s\S]*\z", ""))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _inline(text: Column) -> Column:
    text = F.regexp_replace(escape_html(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    text = F.regexp_replace(text, r"(^|[^*])\*([^*]+?)\*(?!\*)", "$1<em>$2</em>")
    return F.regexp_replace(text, r"`([^`]+?)`", "<code>$1</code>")


def html(md: Column) -> Column:
    """Markdown as HTML, line by line: fences, four heading levels, quotes, lists (all as ul), breaks, paragraphs.

    The text is split at its fence lines; every second part is code. So no state goes from line to line.
    """

    def rendered(x: Column) -> Column:
        tag = lambda name, pattern: F.concat(F.lit(f"<{name}>"), _inline(F.regexp_replace(x, pattern, "")), F.lit(f"</{name}>"))
        out = F.when(x.rlike(rf"^####[{WS}]+"), tag("h4", rf"^####[{WS}]+"))
        for level in (3, 2, 1):
            out = out.when(x.rlike(rf"^#{{{level}}}[{WS}]+"), tag(f"h{level}", rf"^#{{{level}}}[{WS}]+"))
        out = out.when(x.rlike(rf"^>[{WS}]"), tag("blockquote", rf"^>[{WS}]"))
        out = out.when(x.rlike(rf"^[{WS}]*[-*][{WS}]+"), tag("li", rf"^[{WS}]*[-*][{WS}]+"))
        out = out.when(x.rlike(rf"^[{WS}]*\d+\.[{WS}]+"), tag("li", rf"^[{WS}]*\d+\.[{WS}]+"))
        return out.when(trim_ws(x) == "", F.lit("<br>")).otherwise(F.concat(F.lit("<p>"), _inline(x), F.lit("</p>")))

    # (?d): lines end in line feeds only.
    parts = F.split(md, r"(?md)^```.*$", -1)

    def lines(part: Column, k: Column, more: Column) -> Column:
        """The lines of a part, without the empty ends that its fence lines leave."""
        first = F.when(k > 0, 2).otherwise(1)
        return let(F.split(part, "\n", -1), lambda split: F.slice(split, first, F.greatest(F.lit(0), F.size(split) - first + 1 - F.when(more, 1).otherwise(0))))

    def written(part: Column, k: Column, parts: Column) -> Column:
        more, code = k < F.size(parts) - 1, k % 2 == 1
        fence = F.when(code, F.lit("</code></pre>")).otherwise(F.lit("<pre><code>"))
        body = F.transform(lines(part, k, more), lambda x: F.when(code, escape_html(x)).otherwise(rendered(x)))
        return F.concat(body, F.when(more, F.array(fence)).otherwise(F.array().cast("array<string>")))

    def with_lists(out: Column) -> Column:
        """The lines as one text; a run of list items is told from its neighbour lines, and stands in ul tags with its line ends."""
        item = lambda i: F.coalesce(F.startswith(F.get(out, i), F.lit("<li>")), F.lit(False))

        def placed(x: Column, i: Column) -> Column:
            own, last = item(i), i == F.size(out) - 1
            ahead = F.when(own & ~item(i - 1), "<ul>").otherwise("")
            behind = F.when(own & ~item(i + 1), "</ul>").otherwise("")
            return F.concat(ahead, x, F.when(last, "").otherwise("\n"), behind)

        return F.array_join(F.transform(out, placed), "")

    rows = let(parts, lambda held: F.flatten(F.transform(held, lambda part, k: written(part, k, held))))
    return F.when(md.isNotNull(), let(rows, with_lists))


#: A page: round its title and its body. PAGE_END parts the pages of a file; no page holds it.
PAGE = ('<!DOCTYPE html><html><head><meta charset="utf-8"><title>', "</title></head><body>\n", "\n</body></html>")
PAGE_END = "\f"


def page(title: Column, md: Column) -> Column:
    """A whole HTML page of a Markdown text."""
    return F.concat(F.lit(PAGE[0]), escape_html(title), F.lit(PAGE[1]), F.replace(html(md), F.lit(PAGE_END), F.lit(" ")), F.lit(PAGE[2]))


def write_pages(rows: DataFrame, path: str) -> None:
    """Writes rows (title, md) as HTML pages, many to a file."""
    rows.select(page(F.col("title"), F.col("md")).alias("value")).write.option("lineSep", PAGE_END).text(path)
