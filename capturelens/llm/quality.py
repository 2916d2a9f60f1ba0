"""Text quality as a sparse ensemble of rules.

Shallow trees over simple statistics of whole texts give conjunctive rules (the paths to their nodes);
a lasso logistic regression keeps a few of them; what stays is compiled into one column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

STATISTICS = (
    "words", "word_length", "distinct_words", "adjacent_repeats", "upper_words", "capital_words", "upper", "digits",
    "spaces", "commas_stops", "marks", "brackets", "symbols", "beyond_ascii", "longest_word", "line_words",
    "repeated_lines", "odd_ends",
)
#: Bytes of each class; the rest of ASCII (# $ % & * + / @ ^ _ ` ~ | \ = < >) are symbols.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t\n\r\x0b\x0c",
    "commas_stops": b",.;:", "marks": b"!?", "brackets": b"()[]{}\"'-",
    "symbols": b"#$%&*+/@^_`~|\\=<>",
}


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one whole text; zeros for null or a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = {name: float(counts[list(members)].sum()) / len(raw) for name, members in CLASSES.items()}
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = list(map(len, words))
    return [
        float(n), sum(lengths) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, share["upper"], share["digits"],
        share["spaces"], share["commas_stops"], share["marks"], share["brackets"], share["symbols"],
        float(counts[128:].sum()) / len(raw), float(max(lengths)), n / len(lines),
        1 - len(set(lines)) / len(lines), sum(not w[-1].isalnum() for w in words) / n,
    ]


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], np.float64)
        rows = rows.reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(rows[:, i]) for i in range(rows.shape[1])]], ["doc_id", *STATISTICS]
        )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every row's whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds on statistics: all of ``low < value <= high``."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low != float("-inf"):
                out = out & (F.col(name) > low)
            if high != float("inf"):
                out = out & (F.col(name) <= high)
        return out


def tree_rules(described: str, names: Sequence[str]) -> list[Rule]:
    """The path to every node but the root of one tree, from its printed form."""
    rules: list[Rule] = []
    path: list[tuple[int, str, str, float]] = []
    for line in described.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not found:
            continue
        indent = len(found[1])
        path = [p for p in path if p[0] < indent] + [(indent, names[int(found[2])], found[3], float(found[4]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, side, at in path:
            low, high = bounds.get(name, (float("-inf"), float("inf")))
            bounds[name] = (low, min(high, at)) if side == "<=" else (max(low, at), high)
        rules.append(Rule(tuple(sorted((n, *b) for n, b in bounds.items()))))
    return rules


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; compiled, the probability that the label is 1."""

    base: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def column(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(
    labelled: DataFrame, label: str = "label", trees: int = 24, depth: int = 3, penalty: float = 0.0008, seed: int = 7,
) -> RuleModel:
    """Rules and weights from rows of the statistics and a 0/1 label; null labels are left out.

    Without rows of both labels the model is their smoothed share.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("double").alias("label"), array_to_vector(F.array(*STATISTICS)).alias("features"), *STATISTICS
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, total = counts.get(1.0, 0), sum(counts.values())
    if len(counts) < 2:
        return RuleModel(float(np.log((ones + 1) / (total - ones + 1))))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, bootstrap=False, subsamplingRate=0.7, featureSubsetStrategy="onethird",
        minInstancesPerNode=5, maxBins=64, seed=seed,
    ).fit(rows)
    found = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString, STATISTICS)))
    cells = array_to_vector(F.array(*[r.column().cast("double") for r in found]))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=80, standardization=True).fit(
        rows.select("label", cells.alias("features"))
    )
    weights = fitted.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(found, weights) if w)
    return RuleModel(float(fitted.intercept), kept)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def scored(
    measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, threshold: float, **fit,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, digest`` of measured rows; ``digest`` only where they have it."""
    digest = F.col("digest") if "digest" in measured.columns else F.lit(None).cast("string")
    measured = written(measured.withColumn("digest", digest), "statistics")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    learnt = written(measured.join(marks.where(~held_out("doc_id")), "doc_id").where("label is not null"), "labelled")
    score = fit_rules(learnt, **fit).column()
    return measured.select(
        "doc_id", held_out("doc_id").alias("held_out"), score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"), "digest",
    )


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, **fit,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    The model learns from all labelled rows that are not held out. Only the text enters the score: null,
    empty and blank texts have all statistics 0 and one score. Repeated ids are scored row by row and
    learnt from once for each labelled row; a null id has no label. Statistics cover whole texts.
    """
    return scored(text_statistics(docs, id_col, text_col), labels, id_col, label_col, threshold, **fit).drop("digest")


def drop_rejected(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, **fit,
) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good, with all their columns.

    The decision is a function of the text: rows that share an id go or stay by their own texts, repeated rows
    go or stay together, null ids are rows like any other.
    """
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), text.alias("digest")).alias("key"), F.col(text_col).alias("text"))
    measured = text_statistics(keyed, "key", "text").select("doc_id.doc_id", "doc_id.digest", *STATISTICS)
    good = scored(measured, labels, id_col, label_col, threshold, **fit).where("predicted = 1")
    stays = good.select("doc_id", "digest").distinct().hint("merge")
    ours = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(stays, docs[id_col].eqNullSafe(stays["doc_id"]) & (ours == stays["digest"]), "left_semi")
