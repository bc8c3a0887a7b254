"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are built-in expressions over the whole text. A small random forest is grown on the
statistics of labelled rows; every path from a root to a node is a conjunctive rule. A lasso
logistic regression over the rules drops most of them, and the rest is compiled into one column
expression that scores all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, words_of, written
from .quality_rules import STOP_WORDS, SYMBOLS

#: The forest and the weights are fitted on at most so many labelled rows, taken in seeded order.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 17
THRESHOLD = 0.3


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, one double per statistic). Shares of nothing are 0."""

    def count(pattern: str) -> Column:
        return F.length("t") - F.length(F.regexp_replace("t", pattern, ""))

    known = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    counted = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("t")).select(
        "doc_id",
        F.length("t").alias("chars"),
        words_of(F.col("t")).alias("words"),
        lines.alias("lines"),
        count(SYMBOLS).alias("symbols"),
        count("!").alias("bangs"),
        count(r"[A-ZÀ-ÖØ-Þ]").alias("capitals"),
        count(r"[0-9]").alias("digits"),
        count(r"[.,;:?]").alias("stops"),
    )
    sized = counted.select(
        "doc_id", "chars", "symbols", "bangs", "capitals", "digits", "stops",
        F.size("words").alias("n"), F.size("lines").alias("n_lines"),
        F.length(F.array_join("words", "")).alias("in_words"),
        F.size(F.array_distinct("words")).alias("distinct"),
        F.size(F.filter("words", lambda w: w.isin(known))).alias("function_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("same_lines"),
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return sized.select(
        "doc_id",
        F.log1p("n").alias("log_words"),
        share("in_words", "n").alias("word_length"),
        share("symbols", "n").alias("symbol_share"),
        share("bangs", "n").alias("bang_share"),
        share("capitals", "in_words").alias("capital_share"),
        share("digits", "in_words").alias("digit_share"),
        share("stops", "n").alias("punctuation_share"),
        share("distinct", "n").alias("distinct_share"),
        share("function_words", "n").alias("function_word_share"),
        share("same_lines", "n_lines").alias("same_line_share"),
        share("n", "n_lines").alias("words_by_line"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '<=' or '>', threshold) tests."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        return reduce(and_, (F.col(name) <= at if sign == "<=" else F.col(name) > at for name, sign, at in self.tests))


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """The rule of every node below a root, from a forest's toDebugString, without repeats."""
    found, path = {}, []
    for line in description.splitlines():
        if test := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(test[1]) - 4
            path = [*path[:depth], (names[int(test[2])], test[3], float(test[4]))]
            found[Rule(tuple(sorted(path)))] = None
    return list(found)


@dataclass(frozen=True)
class Ensemble:
    """score = 1 / (1 + exp(-(intercept + the weights of the rules that hold)))."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = reduce(add, [F.when(rule.column(), F.lit(w)).otherwise(0.0) for rule, w in self.weights], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def fit(training: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """training: rows (label 0.0 or 1.0, one column per name). With one class or none, a smoothed constant."""
    ones, rows = training.agg(F.sum("label"), F.count("*")).first()
    ones = ones or 0.0
    constant = Ensemble(float(_log_odds((ones + 1) / (rows + 2))), ())
    if ones in (0, rows):
        return constant
    vectors = VectorAssembler(inputCols=names, outputCol="statistics").transform(training)
    forest = RandomForestClassifier(labelCol="label", featuresCol="statistics", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=SEED).fit(vectors)
    rules = tree_rules(forest.toDebugString, names)
    if not rules:
        return constant
    held = training.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(held).select("label", "rules")
    model = LogisticRegression(labelCol="label", featuresCol="rules", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(held)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-6)
    return Ensemble(float(model.intercept), kept)


def _log_odds(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0; null labels and rows
    without a document are left out. Null and empty texts have all statistics 0 and are scored like
    others. Repeated rows are scored alike; a null doc_id is not held out and has no label. Other
    columns are not read. Without labels of both classes the score is a constant; an empty table gives an
    empty result. A very long text costs a few passes of its length and the memory of its words.
    """
    stats = written(statistics(docs, id_col, text_col), "statistics")
    names = stats.columns[1:]
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    marked = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")).where("label IN (0, 1)")
    draw = F.xxhash64("doc_id")
    training = stats.join(marked, F.col("doc_id") == F.col("label_id")).where(~held_out).select("label", *names, draw.alias("draw"))
    training = written(training.orderBy("draw", "label", *names).limit(max_training_rows).drop("draw"), "training")
    score = fit(training, names).column()
    return stats.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
