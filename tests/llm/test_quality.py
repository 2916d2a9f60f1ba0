"""Quality rules: held-out accuracy, compiled rules against their plain meaning, edge rows."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from capturelens.llm.quality import STATISTICS, Rule, drop_rejected, fit_rules, score_quality, statistics_of, tree_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    return got


def test_held_out_accuracy(scored):
    apart = [r for r in scored if r["held_out"] and r["quality"] is not None]
    assert len(apart) > 50
    assert sum(r["predicted"] == r["quality"] for r in apart) / len(apart) > 0.95


def test_scores_and_folds(scored):
    for r in scored:
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("quality", F.when(apart, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r["doc_id"]: r["score"] for r in score_quality(docs, x).collect()}
    one, two = score(labels), score(turned)
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_rules_are_paths():
    printed = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 3.5)
   If (feature 1 <= 0.25)
    Predict: 0.0
   Else (feature 1 > 0.25)
    Predict: 1.0
  Else (feature 0 > 3.5)
   Predict: 1.0
"""
    inf = float("inf")
    assert tree_rules(printed, ["x", "y"]) == [
        Rule((("x", -inf, 3.5),)), Rule((("x", -inf, 3.5), ("y", -inf, 0.25))),
        Rule((("x", -inf, 3.5), ("y", 0.25, inf))), Rule((("x", 3.5, inf),)),
    ]


def test_statistics_of_small_texts():
    got = dict(zip(STATISTICS, statistics_of("AB ab ab\ncd! é")))
    assert got["words"] == 5 and got["distinct_words"] == 0.8 and got["adjacent_repeats"] == 0.2
    assert got["upper_words"] == 0.2 and got["odd_ends"] == 0.2 and got["line_words"] == 2.5
    assert statistics_of(None) == statistics_of("") == statistics_of(" \n ") == [0.0] * len(STATISTICS)


def test_nulls_repeats_long_texts_and_no_labels(spark, documents):
    rows = [(1, None), (2, ""), (3, "word " * 100_000), (None, "some text"), (4, "same"), (4, "same"), (5, "same")]
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 0)], "doc_id bigint, quality int")
    got = score_quality(documents(rows), labels).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got}) == 1
    assert score_quality(documents([]), labels).count() == 0


def test_one_label_only(spark):
    stats = spark.createDataFrame([(1, *[0.0] * len(STATISTICS))], ["label", *STATISTICS])
    assert fit_rules(stats).rules == () and fit_rules(stats).base > 0


def test_rows_of_one_id_go_by_their_texts(spark, documents):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choices("abcdeilnrst", k=rng.randint(2, 8))) for _ in range(60)) + "." for _ in range(80)]
    bad = [" ".join("### !!" for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 80)) for i, _ in rows], "doc_id bigint, quality int")
    odd = [(0, bad[0]), (0, good[0]), (None, good[1]), (None, bad[1])]
    left = drop_rejected(documents(rows + odd), labels).collect()
    kept = [(r["doc_id"], r["text"]) for r in left]
    assert kept.count((0, good[0])) == 2 and (0, bad[0]) not in kept and (None, good[1]) in kept and (None, bad[1]) not in kept
