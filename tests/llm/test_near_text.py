"""Near-duplicate texts against a brute-force comparison of all pairs."""

from __future__ import annotations

import random
import re

import pytest

from capturelens.llm import near_text
from capturelens.llm.near_text import near_groups

SF = "/root/testdata/sf0.001"


def shingle_set(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent=80):
    """{id: (set size, smallest reachable id)} by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def family(rng, size, length, share):
    """A text and copies of it with a share of the words exchanged."""
    base = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(length)]
    return [" ".join(base)] + [" ".join(edited(rng, base, share * rng.random())) for _ in range(size - 1)]


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = result(near_groups(docs, words=4))
    assert got == brute(rows, 4)


def test_families_of_any_size(documents):
    rng = random.Random(5)
    texts = []
    for size in (2, 3, 9, 40, 150):
        texts += family(rng, size, rng.randint(30, 200), 0.08)
    texts += [" ".join(rng.choices("abcdef", k=3)) for _ in range(20)] + family(rng, 1, 4000, 0)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_groups(documents(rows), words=4)
    assert result(got) == brute(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("share", [0.03, 0.06])
def test_large_nodes_are_cut_into_blocks(documents, monkeypatch, share):
    """One group far larger than a block: forest inside blocks, then the rest across them."""
    monkeypatch.setattr(near_text, "LEAF", 8)
    monkeypatch.setattr(near_text, "BLOCK", 16)
    rows = list(enumerate(family(random.Random(8), 120, 60, share)))
    assert result(near_groups(documents(rows), words=4)) == brute(rows, 4)


def test_star_of_copies_that_only_match_their_source(documents, monkeypatch):
    monkeypatch.setattr(near_text, "LEAF", 8)
    monkeypatch.setattr(near_text, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for i in range(40):
        own = list(base)
        own[5 + 2 * i] = f"x{i}"
        own[(45 + 2 * i) % 90] = f"y{i}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(near_groups(documents(rows), words=4)) == brute(rows, 4)


def test_nulls_empty_short_and_repeated_rows(documents):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " end"),
        (9, "É one two three"), (10, "é one two three"), (None, "one two"), (None, "alone here"), (5, "one  TWO"),
    ]
    got = sorted(near_groups(documents(rows), words=4).collect(), key=repr)
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4, 6, 7)] == [0, 0, 0, 1, 1, 49_997]
    assert {i: by_id[i]["component_id"] for i in range(1, 11)} == {
        1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    nulls = [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None]
    assert sorted(nulls, key=repr) == [(4, False), (None, True)]
    assert near_groups(documents([])).count() == 0


def test_one_row_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (3, "quite another text than the others"), (4, text + " end"), (None, "of no id at all"), (None, "of no id at all"), (None, text), (9, None), (9, None)]
    left = near_text.drop_near_copies(documents(rows), words=4)
    assert left.columns == documents(rows).columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    assert [g[0] for g in got] == [3, 9, None] and got[-1][1] == "of no id at all"


def test_even_repeats_and_small_equal_nodes(documents):
    """Every row twice: the nodes' marks must describe sets."""
    texts = family(random.Random(4), 12, 40, 0.04) + family(random.Random(6), 12, 40, 0.04)
    rows = list(enumerate(texts)) * 2
    assert result(near_groups(documents(rows), words=4)) == brute(dict(rows).items(), 4)


def test_nodes_of_one_group_are_not_joined_below_the_first_level(spark):
    """A large group of copies gives no rows but in the nodes that hold something else."""
    one = [(1, d, 0) for d in range(500)] + [(2, d, 0) for d in range(40)]
    torn = [(3, d, 0) for d in range(90)] + [(3, 990, 7)] + [(n, d, d % 2) for n in (4, 5) for d in (1, 2)]
    nodes = near_text.torn_nodes(spark.createDataFrame(one + torn, "node bigint, doc bigint, label bigint"))
    rows = {(r["node"], r["doc"], r["label"], r["most"], r["n"], r["n_open"]) for r in nodes.collect()}
    assert rows == {(3, d, 0, 0, 91, 1) for d in range(90)} | {(3, 990, 7, 0, 91, 1), (4, 1, 1, 1, 2, 1), (4, 2, 0, 1, 2, 1)}


def rows_by_node(spark, documents, monkeypatch, size, walk):
    """The groups of a family whose nodes branch, and the rows written by node on the way."""
    monkeypatch.setattr(near_text, "LEAF", 4)
    monkeypatch.setattr(near_text, "BLOCK", 8)
    monkeypatch.setattr(near_text, "WALKED", walk, raising=False)
    counts, plain = [], near_text.written

    def counted(df, name, *folder):
        out = plain(df, name, *folder)
        if name.endswith("nodes"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_text, "written", counted)
    rows = list(enumerate(family(random.Random(9), size, 60, 0.16)))
    got = result(near_groups(documents(rows), words=4))
    monkeypatch.setattr(near_text, "written", plain)
    assert got == brute(rows, 4)
    return sum(counts)


def test_rows_by_node_do_not_grow_with_the_levels(spark, documents, monkeypatch):
    """A membership is written at most three times, however many levels a family's nodes branch."""
    assert rows_by_node(spark, documents, monkeypatch, 320, 16_384) <= 3 * near_text.TREES * 320


def test_larger_nodes_are_dealt_anew_until_they_can_be_walked(spark, documents, monkeypatch):
    rows_by_node(spark, documents, monkeypatch, 120, 24)


@pytest.mark.parametrize("levels, times", [(96, 64), (3, 64), (96, 0)])
def test_a_walk_keeps_what_looks_alike(monkeypatch, levels, times):
    """Every pair of equal signatures and unequal labels meets; rows that never part end in a comparison of all."""
    monkeypatch.setattr(near_text, "WALKED_TIMES", times)
    rng = near_text.np.random.RandomState(2)
    signs = near_text.np.concatenate([rng.randint(0, 2, (300, near_text.COORDINATES)).astype("uint8")] * 2)
    signs = near_text.np.concatenate([signs, near_text.np.full((40, near_text.COORDINATES), 7, "uint8")])
    labels = near_text.np.arange(640)
    met = set()
    for _, rows in near_text.walked(near_text.np.uint64(5), signs, labels, near_text.second_share(0.8), 8, 16, levels):
        inside = set(rows.tolist())
        met |= {i for i in inside if i < 300 and i + 300 in inside}
        if {600, 639} <= inside:
            met.add(600)
    assert met == {*range(300), 600}
