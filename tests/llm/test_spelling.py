"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from capturelens.llm.spelling import one_edit_apart, spelling_variants, variants, vocabulary


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, slips):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    forms, out = {}, []
    for w in counts:
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        best = others[0] if others and -others[0][0] >= 2 * counts[w] else None
        forms[w] = (best[1] if best else None, -best[0] if best else None, len(others))
    for w, (form, form_n, many) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, form, root, counts[w], many, form_n))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group", [20_000, 3])
def test_pairs_equal_brute_force(spark, group):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abéþ", k=rng.randint(5, 8))) for _ in range(400)}
                   | {"aaaaa" + "b" * i for i in range(12)} | {"x" * 3_000, "x" * 3_001, "x" * 1_500 + "y" + "x" * 1_499})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    got = [tuple(sorted(r)) for r in one_edit_apart(df, group).collect()]
    assert len(got) == len(set(got))
    assert sorted(got) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choices("abc", k=rng.randint(5, 6))): rng.choice([3, 6, 6, 12, 24, 100]) for _ in range(150)}
    counts |= {"chain": 3, "chaim": 6, "chaam": 12, "chbam": 24}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows(variants(df)) == brute(counts)


@pytest.mark.parametrize("slips", [True, False])
def test_documents(documents, slips):
    docs = [
        (1, "Kölner KÖLNER kölner koelner koelner koelner kolner Kolner kolner"), (2, None), (3, ""), (4, "123 --"), (None, "kolner koelner"),
        (5, "kölner " * 20_000), (5, "kölner"), (6, "z" * 100_000 + " " + "z" * 100_000), (7, "z" * 100_000 + "y " + "ŒuvreŒuvre uvre uvres uvres uvres"),
        *[(i, " ".join(random.Random(i).choices(["hello", "hallo", "hullo", "hell", "hellos", "Àbove", "àbove"], k=200))) for i in range(10, 40)],
    ]
    counts = brute_words(docs, slips)
    assert rows(vocabulary(documents(docs), slips=slips)) == sorted(counts.items())
    assert rows(spelling_variants(documents(docs), slips=slips)) == brute(counts)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    counts = brute_words(docs, True)
    assert rows(vocabulary(df, slips=True)) == sorted(counts.items())


def test_empty(spark, documents):
    assert rows(spelling_variants(documents([(1, None)]))) == []
    assert rows(variants(spark.createDataFrame([(None, 3), ("alone", 5)], "word string, n bigint"))) == [("alone", None, "alone", 5, 0, None)]
