"""Text quality by a sparse ensemble of rules (Friedman and Popescu, 2008).

Shallow trees over statistics of the text propose rules: every path from a root
to a node is a conjunction of threshold tests. A logistic model with a lasso
penalty weighs all rules at once and leaves most of them out. What is left is
compiled into one Spark column: scoring is a sum of CASE expressions over the
statistics and never leaves the JVM.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import free_name, text_or_empty
from cairn.llm.fingerprints import words_of
from cairn.session import durable

#: At most so many labelled texts are learned from, those of lowest hashed doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY, STEPS = 0.001, 60
SEED = 11


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text; a null text counts as empty, all are finite."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("double").alias("n_words"),
        F.size(F.array_distinct("words")).cast("double").alias("n_distinct"),
        F.length(F.array_join("words", "")).cast("double").alias("n_chars"),
        F.size("lines").cast("double").alias("n_lines"),
        F.size(F.array_distinct("lines")).cast("double").alias("n_distinct_lines"),
        F.aggregate("words", F.lit(0), lambda a, w: F.greatest(a, F.length(w))).cast("double").alias("longest_word"),
        count(r"\p{Lu}").alias("n_upper"), count(r"\p{N}").alias("n_digits"),
        count(r"[#*$%&|<>@=_{}\[\]\\/~^]").alias("n_symbols"), count(r"[.,;:!?]").alias("n_marks"),
        count("!").alias("n_calls"), count(r"[.]").alias("n_stops"),
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1.0)) for c in ("n_words", "n_chars", "n_lines"))
    return rows.select(
        "doc_id", "n_words", "n_lines", "longest_word",
        (F.col("n_distinct") / words).alias("distinct_words"),
        (F.col("n_chars") / words).alias("word_length"),
        (F.col("n_words") / lines).alias("line_words"),
        (F.col("n_distinct_lines") / lines).alias("distinct_lines"),
        (F.col("n_upper") / chars).alias("upper"), (F.col("n_digits") / chars).alias("digits"),
        (F.col("n_symbols") / words).alias("symbols"), (F.col("n_marks") / words).alias("marks"),
        (F.col("n_calls") / words).alias("calls"), (F.col("n_stops") / words).alias("stops"),
    )


FEATURES = [
    "n_words", "n_lines", "longest_word", "distinct_words", "word_length", "line_words", "distinct_lines",
    "upper", "digits", "symbols", "marks", "calls", "stops",
]

#: One test: statistic, whether at most (else above), threshold.
Test = tuple[str, bool, float]


def paths(tree: str, names: list[str]) -> list[tuple[Test, ...]]:
    """Every root-to-node path of a tree as printed by Spark, as a conjunction of tests."""
    found, stack = [], []
    for line in tree.split("\n"):
        test = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if test:
            depth = len(test[1])
            stack = [x for x in stack if x[0] < depth]
            stack.append((depth, (names[int(test[3])], test[4] == "<=", float(test[5]))))
            found.append(tuple(x[1] for x in stack))
    return found


def tighten(rule: tuple[Test, ...]) -> tuple[Test, ...]:
    """The same rule with one test per statistic and direction, in order."""
    kept: dict[tuple[str, bool], float] = {}
    for name, below, value in rule:
        old = kept.get((name, below))
        kept[name, below] = value if old is None else (min if below else max)(old, value)
    return tuple(sorted((name, below, value) for (name, below), value in kept.items()))


def compiled(rule: tuple[Test, ...]) -> Column:
    """A rule as a condition."""
    held = F.lit(True)
    for name, below, value in rule:
        held = held & ((F.col(name) <= value) if below else (F.col(name) > value))
    return held


@dataclass
class Ensemble:
    """Rules with their weights, and the intercept."""

    rules: list[tuple[tuple[Test, ...], float]]
    base: float

    def score(self) -> Column:
        """Chance of label 1 as a column over the statistics."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(rows: DataFrame, penalty: float = PENALTY) -> Ensemble:
    """Learn from statistics with a label 0 or 1, a bounded sample such as ``sampled`` gives.

    All distinct rules of the forest take part; its trees and their depth bound
    how many there are. No rows, or rows of one label, give a model that scores
    the base rate.
    """
    rows = durable(rows.coalesce(4), "quality-sample").coalesce(4)
    ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    base = Ensemble([], math.log((ones + 0.5) / (n - ones + 0.5)))
    if ones == 0 or ones == n:
        return base
    rows = rows.withColumn("label", F.col("label").cast("double"))
    features = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, seed=SEED).fit(features)
    found = dict.fromkeys(tighten(p) for tree in forest.trees for p in paths(tree.toDebugString, FEATURES))
    rules = list(found)
    if not rules:
        return base
    fired = [f"rule_{i}" for i in range(len(rules))]
    rows = rows.select("label", *[compiled(r).cast("double").alias(c) for r, c in zip(rules, fired)])
    matrix = VectorAssembler(inputCols=fired, outputCol="features").transform(rows).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=STEPS).fit(matrix)
    weights = lasso.coefficients.toArray()
    return Ensemble([(r, float(w)) for r, w in zip(rules, weights) if w], float(lasso.intercept))


def sampled(stats: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled statistics, by lowest hashed doc_id.

    Labels are (doc_id, ``label``); of several labels of one doc_id the highest
    counts. The chosen labels (12 bytes each) are broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    chosen = durable(chosen, "chosen-labels")
    return stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id", "doc_id")


def scored(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id and score, learned from ``labels`` of a bounded sample.

    Null and empty texts score by their statistics, all zero. The statistics of
    every text are made once and written.
    """
    stats = durable(statistics(docs), "quality-statistics")
    model = fit(sampled(stats, labels, label, rows))
    return stats.select("doc_id", model.score().alias("score"))


def keep_good(docs: DataFrame, model: Ensemble, threshold: float) -> DataFrame:
    """The documents that score ``threshold`` or more, with all columns; of rows under one doc_id all must."""
    doc = free_name(docs, "_doc")
    low = statistics(docs).filter(model.score() < threshold).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(low, F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")
