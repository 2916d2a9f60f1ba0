"""Decontamination against a plain scan of all windows."""

from __future__ import annotations

import hashlib
import re

import pytest

from capturelens.llm.decontaminate import mark_contaminated, remove_contaminated

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i : i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    met |= found
        ids = sorted(str(m) for m in met if m is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [
    (1, LONG), (2, "Drei kurze Wörter"), (3, None), (4, ""), (5, "?! ..."), (10, LONG), (10, LONG), (7, "ÉCOLE Été x"),
    (None, "ganz ohne id hier"),
]
DOCS = [
    (1, LONG), (2, "a b " + LONG[9:60].upper() + " c"), (3, None), (4, ""), (5, " ..!"), (6, "zzz"),
    (7, "und drei-kurze\twörter, drei kurze wörter"), (8, "École Été X"), (8, "ÉCOLE Été X"), (9, "W0 w1 w2 w3 w4 w5 w6 w7 w8"),
    (10, LONG + " " + LONG), (10, LONG + " " + LONG), (10, "other text"), (None, LONG), (None, None), (11, "ganz ohne id hier"),
    (12, ("nothing of it " * 20_000) + LONG + (" more of it" * 20_000)), (13, "x" * 200_000),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in ITEMS], "item_id bigint, text string, length int, window string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bound", [400_000, 7])
def test_equals_brute_force(documents, items, bound):
    assert rows(mark_contaminated(documents(DOCS), items, broadcast_windows=bound)) == brute(DOCS, ITEMS)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    assert rows(mark_contaminated(docs, items)) == brute(*pairs)


def test_empty_tables(documents, items):
    assert rows(mark_contaminated(documents(DOCS[:0]), items)) == []
    assert not any(r["contaminated"] for r in mark_contaminated(documents(DOCS), items.limit(0)).collect())


def test_documents_go(documents, items):
    left = remove_contaminated(documents(DOCS), items)
    dirty = {(d, t) for (d, t), r in ((x, brute([x], ITEMS)[0]) for x in DOCS) if r[-1]}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted((x for x in DOCS if x not in dirty), key=repr)
    assert left.columns == documents(DOCS).columns


def test_spans_go(documents, items):
    left = remove_contaminated(documents(DOCS), items, spans=True).collect()
    assert len(left) == len(DOCS)
    texts = {r["doc_id"]: r["text"] for r in left if r["doc_id"] not in (8, 10, None)}
    assert texts[1] == "" and texts[3] is None and texts[5] == " ..!"
    assert texts[7] == "und" and texts[9] == DOCS[9][1]
    assert words(texts[12]) == words("nothing of it " * 20_000 + " more of it" * 20_000)
    assert texts[2].startswith("a b ") and texts[2].endswith(" c")


def test_python_free(spark, documents, items):
    plan = mark_contaminated(documents(DOCS), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
