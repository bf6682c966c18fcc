"""Quality classifier: tree paths as rules over statistics, weighted by a lasso logistic fit."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import quoted, shared_table
from viewforge.llm.rule_lists import Condition
from viewforge.llm.statistics import BLANKS, FIT_ROWS, bound, count_of, duplicate_lines, fit_sample, held_out, words_of

TREES, DEPTH, PENALTY, CUT = 24, 3, 0.002, 0.3
FEATURES = [
    "log_words", "chars_per_word", "symbols_per_word", "shouts_per_word", "capitals_per_char", "bars_per_word",
    "digits_per_char", "stops_per_word", "dup_lines_per_line", "distinct_words", "lines_per_100_words",
]


def quality_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", **kept: Column) -> DataFrame:
    """One row per document with the statistics that the rules look at; labels, language, source and id are none of them."""
    body = F.coalesce(quoted(text), F.lit(""))
    size = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))
    counted = docs.select(
        quoted(id).alias("doc_id"),
        *(c.alias(n) for n, c in kept.items()),
        held_out(quoted(id)).alias("held_out"),
        bound(words_of(body), size).alias("words"),
        (F.length(body) - count_of(body, BLANKS)).alias("chars"),
        count_of(body, "#*$%&|<>").alias("symbols"),
        count_of(body, "!").alias("shouts"),
        count_of(body, "|").alias("bars"),
        count_of(body, ".,").alias("stops"),
        count_of(body, "0123456789").alias("digits"),
        count_of(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ").alias("capitals"),
        (count_of(body, "\n") + 1).alias("lines"),
        duplicate_lines(body).alias("dup_lines"),
    )
    n, chars = F.greatest("words.n", F.lit(1)), F.greatest("chars", F.lit(1))
    return counted.select(
        "doc_id", *kept, "held_out",
        F.log1p("words.n").alias("log_words"),
        (F.col("chars") / n).alias("chars_per_word"),
        (F.col("symbols") / n).alias("symbols_per_word"),
        (F.col("shouts") / n).alias("shouts_per_word"),
        (F.col("capitals") / chars).alias("capitals_per_char"),
        (F.col("bars") / n).alias("bars_per_word"),
        (F.col("digits") / chars).alias("digits_per_char"),
        (F.col("stops") / n).alias("stops_per_word"),
        (F.col("dup_lines") / F.col("lines")).alias("dup_lines_per_line"),
        (F.col("words.distinct") / n).alias("distinct_words"),
        (F.col("lines") * 100 / n).alias("lines_per_100_words"),
    )


def tree_rules(text: str) -> list[tuple[Condition, ...]]:
    """The paths to all inner and leaf nodes of the trees that Spark prints."""
    rules, path = {}, []
    for line in text.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), Condition(FEATURES[int(m[2])], m[3] == ">", float(m[4]))))
            rules[tuple(sorted({c for _, c in path}, key=str))] = None
        elif "Tree " in line:
            path = []
    return list(rules)


class RuleEnsemble:
    """Weighted rules; ``score`` is the compiled column expression."""

    def __init__(self, weights: Sequence[tuple[tuple[Condition, ...], float]], intercept: float) -> None:
        self.weights, self.intercept = list(weights), intercept

    def score(self) -> Column:
        terms = (F.when(reduce(and_, (c.column() for c in rule)), w).otherwise(0.0) for rule, w in self.weights)
        return 1 / (1 + F.exp(-reduce(add, terms, F.lit(self.intercept))))

    @classmethod
    def fit(cls, sample: DataFrame) -> RuleEnsemble:
        """Fit to rows of ``label`` (0 or 1) and the statistics. With one class or no rows, the score is constant."""
        share = sample.agg(F.avg("label")).first()[0]
        if share is None or share in (0.0, 1.0):
            return cls([], {None: 0.0, 0.0: -4.0, 1.0: 4.0}[share])
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("label", "features", *FEATURES)
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="0.5", seed=1)
        rules = tree_rules(forest.fit(rows).toDebugString)
        if not rules:
            return cls([], 0.0)
        held = F.array(*(F.when(reduce(and_, (c.column() for c in rule)), 1.0).otherwise(0.0) for rule in rules))
        fitted = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60).fit(
            rows.select("label", array_to_vector(held).alias("features"))
        )
        weights = [(rule, float(w)) for rule, w in zip(rules, fitted.coefficients, strict=True) if w]
        return cls(weights, float(fitted.intercept))


def score_quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, **kept: Column
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (likelihood of label 1) and ``predicted`` (1 from 0.3 up) for every document.

    The ensemble is fitted to ``rows`` labelled rows at most, those with the smallest hash
    of their id, and never to held-out ones. ``kept`` adds columns of ``docs``. Null and
    empty texts are scored by their zero statistics; repeated rows are scored each; an
    empty table gives an empty result; without labels every score is 0.5.
    The statistics are stored once, since both fitting and scoring read them.
    """
    table = shared_table(quality_statistics(docs, id, text, **kept), "quality")
    sample = shared_table(fit_sample(table.drop(*kept), labels, label, rows).select("label", *FEATURES).coalesce(1), "labelled")
    score = RuleEnsemble.fit(sample).score()
    scored = table.select("doc_id", *kept, "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
