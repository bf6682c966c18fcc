"""Learned decision lists: ordered threshold conjunctions found by sequential covering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewforge.llm.frames import quoted, shared_table
from viewforge.llm.statistics import BLANKS, bound, count_of, duplicate_lines, fit_sample, held_out, repeated_words, words_of

MAX_CONDITIONS, MAX_RULES, THRESHOLDS = 3, 12, 32
#: A rule must be right on this share of the rows it covers, in the grow and the prune rows, and cover so many.
PRECISION, COVER = 0.8, 5
FEATURES = ["n_words", "chars_per_word", "symbols_per_word", "shouts_per_word", "capitals_per_char", "dup_lines_per_100_words", "repeats_per_word"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold


def covers(rule: Sequence[Condition], table: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(and_, (c.rows(table) for c in rule))


def _gain(bad: np.ndarray, covered: np.ndarray, chosen: np.ndarray) -> float:
    """What a condition adds in bits, times the wanted rows it keeps."""
    p0, n0 = (bad & covered).sum(), covered.sum()
    p, n = (bad & covered & chosen).sum(), (covered & chosen).sum()
    return p * (np.log2(p / n) - np.log2(p0 / n0)) if p else 0.0


def _grown(table, bad, features) -> list[Condition]:
    rule, covered = [], np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (bad & covered).sum() < covered.sum():
        best, top = None, 1e-9
        for name in features:
            values = np.unique(table[name][covered])
            if len(values) < 2:
                continue
            cuts = np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, THRESHOLDS)))
            for cut in cuts.tolist():
                for above in (True, False):
                    condition = Condition(name, above, cut)
                    if (gain := _gain(bad, covered, condition.rows(table))) > top:
                        best, top = condition, gain
        if best is None:
            break
        rule.append(best)
        covered &= best.rows(table)
    return rule


def _precision(rule, table, bad) -> tuple[float, int]:
    covered = covers(rule, table)
    n = int(covered.sum())
    return (float((bad & covered).sum()) / n if n else 0.0), n


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray, features: Sequence[str]) -> list[list[Condition]]:
    """Rules for the ``bad`` rows: grown on two thirds, cut back on the rest while that loses no precision, one after another."""
    third = np.arange(len(bad)) % 3 == 0
    grow = ({n: v[~third] for n, v in table.items()}, bad[~third])
    prune = ({n: v[third] for n, v in table.items()}, bad[third])
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES and grow[1].sum() >= COVER:
        rule = _grown(*grow, features)
        while len(rule) > 1 and _precision(rule[:-1], *prune)[0] >= _precision(rule, *prune)[0]:
            rule = rule[:-1]
        if not rule:
            break
        precision, n = _precision(rule, *grow)
        checked, m = _precision(rule, *prune)
        if n < COVER or precision < PRECISION or (m and checked < PRECISION):
            break
        rules.append(rule)
        grow, prune = (
            ({name: v[keep] for name, v in t.items()}, b[keep]) for t, b in (grow, prune) for keep in [~covers(rule, t)]
        )
    return rules


def verdict(rules: Sequence[Sequence[Condition]]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(and_, (c.column() for c in rule)), number).otherwise(out)
    return out


def text_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts and the ratios that rules are made of."""
    body = F.coalesce(quoted(text), F.lit(""))
    n_words = F.col("found.n_words")
    counted = docs.select(
        quoted(id).alias("doc_id"),
        held_out(quoted(id)).alias("held_out"),
        bound(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("found"),
        (F.length(body) - count_of(body, BLANKS)).cast("long").alias("word_chars"),
        count_of(body, "#*$%&|<>").alias("n_symbols"),
        duplicate_lines(body).alias("n_dup_lines"),
        count_of(body, "!").alias("n_shouts"),
        count_of(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ").alias("n_capitals"),
    )
    per_word = lambda c: F.col(c) / F.greatest(n_words, F.lit(1))
    return counted.select(
        "doc_id", "held_out", n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("found.n_repeat_words").alias("n_repeat_words"),
        per_word("word_chars").alias("chars_per_word"),
        per_word("n_symbols").alias("symbols_per_word"),
        per_word("n_shouts").alias("shouts_per_word"),
        (F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("capitals_per_char"),
        (per_word("n_dup_lines") * 100).alias("dup_lines_per_100_words"),
        per_word("found.n_repeat_words").alias("repeats_per_word"),
    )


def judge_by_rules(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Statistics of every document, ``base_failed``, ``rule`` (the learned rule that rejects it) and ``kept``.

    The list is learned from ``labels`` (0 is bad), ``FIT_ROWS`` labelled rows at most and
    never the held-out ones, and becomes one ordered conditional expression. Without
    usable labels there are no rules. Null texts are empty; repeated rows are judged
    each; an empty table gives an empty result; other columns are not looked at.
    The statistics are stored once, since both learning and judging read them.
    """
    table = shared_table(text_statistics(docs, id, text), "statistics")
    rows = fit_sample(table, labels, label).select("label", *FEATURES).collect()
    columns = {n: np.array([r[n] for r in rows], float) for n in FEATURES}
    rules = learn_list(columns, np.array([r["label"] == 0 for r in rows], bool), FEATURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = table.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
