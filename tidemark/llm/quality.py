"""Quality as a sparse ensemble of rules over text statistics, scored by Spark columns alone."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Labelled rows a fit uses at most, chosen by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH = 24, 4
#: Weight of the lasso penalty.
PENALTY = 1e-3
ACCEPT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about one text; null counts as empty, and every quotient is defined for it."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    split = F.split(F.trim(t), r"[ \n]+")
    words = F.greatest(F.size(split), F.lit(1))
    lines = F.split(t, "\n")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")) / n

    return {
        "log_chars": F.log(n + F.lit(0.0)),
        "word_length": F.length(t) / words,
        "distinct_words": F.size(F.array_distinct(split)) / words,
        "distinct_scaled": F.size(F.array_distinct(split)) / F.pow(words, F.lit(0.7)),
        "symbols": share(r"[\p{L}\p{N}\s.,;:'\"?()-]+"),
        "upper": share(r"[^\p{Lu}]+"),
        "digits": share(r"[^0-9]+"),
        "stops": share(r"[^.,]+"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": words / F.size(lines),
        "repeats": F.aggregate(
            F.zip_with(F.slice(split, 2, words), split, lambda a, b: F.lower(a) == F.lower(b)),
            F.lit(0),
            lambda s, same: s + F.coalesce(same, F.lit(False)).cast("int"),
        )
        / words,
    }


@dataclass
class Rules:
    """Conjunctions of ``(statistic, above, threshold)`` with their weights."""

    intercept: float
    weighted: list[tuple[float, tuple[tuple[str, bool, float], ...]]] = field(default_factory=list)

    def score(self) -> Column:
        """A probability, over columns named like the statistics."""
        z = F.lit(float(self.intercept))
        for weight, rule in self.weighted:
            z = z + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def condition(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    out = F.lit(True)
    for name, above, at in rule:
        out = out & (F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at))
    return out


def paths(debug: str, names: list[str]) -> list[tuple[tuple[str, bool, float], ...]]:
    """Every path of printed trees from the root to a node, simplified to one bound a side."""
    found, stack = {}, []
    step = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")
    for line in debug.splitlines():
        m = step.match(line)
        if not m:
            if "Tree" in line:
                stack = []
            continue
        indent = len(m[1])
        stack = [s for s in stack if s[0] < indent]
        stack.append((indent, names[int(m[2])], m[3] == ">", float(m[4])))
        bounds: dict[tuple[str, bool], float] = {}
        for _, name, above, at in stack:
            old = bounds.get((name, above))
            bounds[name, above] = at if old is None else max(old, at) if above else min(old, at)
        found[tuple(sorted((n, a, t) for (n, a), t in bounds.items()))] = None
    return list(found)


def fit(docs: DataFrame, labelled: DataFrame, label: str, scratch: Scratch, sample: int = SAMPLE, seed: int = 11) -> Rules:
    """Fit on at most ``sample`` rows of ``labelled (doc_id, <label>)``, chosen by a hash of the id.

    Trees give the rules, logistic regression with a lasso penalty their weights; rules of weight
    zero go. Labels other than 0 and 1 and null ids are ignored; a doc_id labelled twice counts by
    its smallest label. With one class or none there are no rules, only the smoothed share of ones.
    """
    chosen = (
        labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("__label"))
        .where("doc_id is not null and __label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("__label").alias("__label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(sample)
    )
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    data = scratch.settle(
        rows.select(F.col("__label").cast("double").alias("label"), *(c.cast("double").alias(n) for n, c in stats.items()))
    )
    ones, total = data.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0, total):
        share = (ones + 1) / (total + 2)
        return Rules(math.log(share / (1 - share)))
    data = data.coalesce(4)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, maxBins=64).fit(
        data.select("label", array_to_vector(F.array(*names)).alias("features"))
    )
    rules = paths(forest.toDebugString, names)
    table = scratch.settle(
        data.select("label", array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"))
    )
    linear = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(table.coalesce(4))
    weighted = [(float(w), r) for w, r in zip(linear.coefficients.toArray(), rules, strict=True) if w]
    return Rules(float(linear.intercept), weighted)


def score(docs: DataFrame, rules: Rules, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score: row by row, no shuffle, no Python.

    Null and empty texts get the score of an empty text. Repeated rows and null ids are scored
    like any other row; an existing column of that name is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != column]
    stats = {f"__{n}": c for n, c in statistics(F.col("text")).items()}
    renamed = Rules(
        rules.intercept, [(w, tuple((f"__{n}", a, t) for n, a, t in r)) for w, r in rules.weighted]
    )
    wide = docs.select(*kept, *(c.cast("double").alias(n) for n, c in stats.items()))
    return wide.withColumn(column, renamed.score()).drop(*stats)
