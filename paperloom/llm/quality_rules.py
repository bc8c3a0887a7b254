"""Quality rules: a threshold table compiled into one projection, without user functions.

Counts come from built-in expressions over the text; the verdict is a conjunction of
integer comparisons made from RULES. Nothing is shuffled: each row is judged alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from an "
    "der die und den von zu das mit sich des auf für ist im dem nicht eine ein als "
    "de la le et les en un du une que pour est dans qui par au sur pas avec "
    "el y los se las del por con no su para al es lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds if low <= 100 * amount / per <= high, for texts of at least min_words words."""

    name: str
    amount: str
    per: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0

    def sql(self) -> str:
        tests = []
        if self.low is not None:
            tests.append(f"100 * {self.amount} >= {self.low} * {self.per}")
        if self.high is not None:
            tests.append(f"100 * {self.amount} <= {self.high} * {self.per}")
        test = " AND ".join(tests)
        return f"(n_words < {self.min_words} OR ({test}))" if self.min_words else f"({test})"


#: The threshold table, in per cent of the unit named in `per`.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols by word", "n_symbols", "n_words", high=10),
    Rule("stop words by word", "n_stop_words", "n_words", low=5, min_words=50),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
)

#: Fails texts that are too short or repeat five-word windows too much.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, although body's own lambdas use it for each element."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """Words that windows of WINDOW words at the sorted starts cover."""
    parts = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, part: total + part)


def _repeated(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def starts(ordered: Column) -> Column:
        twin = lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(_let(ordered, starts), _covered)).otherwise(F.lit(0).cast("long"))


def _judged(docs: DataFrame, carried: Column, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (row, counts, base_failed, failed_rules, kept); `row` is what is carried along, so names can't clash."""
    text = F.col("t")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    base = docs.select(carried.alias("row"), text_of(F.col(text_col)).alias("t")).select(
        "row",
        words_of(text).alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    known = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})
    window = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    counted = base.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(known))).cast("long").alias("n_stop_words"),
        F.when(F.size("words") > WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    ).withColumn("n_repeat_words", _repeated(F.col("windows")))
    failed = F.array_compact(F.array(*[F.when(~F.expr(r.sql()), F.lit(r.name)) for r in rules]))
    return counted.drop("windows").withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, failed_rules, kept.

    Null and empty texts have no words, so they fail the base rule. Repeated rows are judged
    alike and stay repeated; null ids pass through. Other columns are not read, so their
    names can't clash. An empty table gives an empty result. Windows are told apart by the
    64-bit hash of their five words.
    """
    judged = _judged(docs, F.col(id_col), text_col, rules)
    return judged.select(F.col("row").alias("doc_id"), *[c for c in judged.columns if c != "row"])


def good_rows(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Null and empty texts have no words and are rejected. Repeated rows are judged alike, each by itself;
    null ids, nulls in other columns and columns of any name pass through. An empty table stays empty.
    A very long text is held whole, with its words and the sorted places of its windows.
    """
    judged = _judged(docs, F.struct("*"), text_col, rules)
    # A filter would be pushed below the projections and take their expressions with it, arrays and
    # all, into every place that uses them. It isn't pushed below a row number, which is never negative.
    marked = judged.select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("stays"))
    return marked.where("stays").select("row.*")


def oracle_sql() -> str:
    words = f"list_filter(regexp_split_to_array(t, '[{SPACE}]+'), lambda w: w <> '')"
    lines = f"list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]'))"
    known = ", ".join(f"'{form}'" for w in sorted(set(STOP_WORDS)) for form in dict.fromkeys((w, w.capitalize())))
    return f"""
WITH split AS (SELECT doc_id, t, {words} AS words, {lines} AS lines
               FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
starts AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
           FROM (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram
                 FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5))),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM starts, range(0, 5) AS r(o) WHERE n >= 2 GROUP BY doc_id),
counted AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
                   len(list_filter(words, lambda w: w IN ({known})))::BIGINT AS n_stop_words
            FROM split LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
       ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND {" AND ".join(r.sql() for r in RULES)} AS kept
FROM counted"""
