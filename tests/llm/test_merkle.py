"""The manifest against a plain tree."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from capturelens.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)])
    return levels


def folded(levels, at, value, arity):
    met = ""
    for level in levels[:-1]:
        first = at // arity * arity
        run = level[first : first + arity]
        met += "".join(x for i, x in enumerate(run) if first + i != at)
        run[at - first] = value
        value, at = sha("".join(run)), at // arity
    return value, met


def brute(docs, tampered, arity):
    """docs: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d), d))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {g: (sorted(groups[g], key=lambda r: r[:3]), None) for g in names}
    trees = {g: (rows, levels_of([r[2] for r in rows], arity)) for g, (rows, _) in trees.items()}
    top = levels_of([trees[g][1][-1][0] for g in names], arity)
    out = []
    for place, g in enumerate(names):
        rows, levels = trees[g]
        for at, (*_, own, d) in enumerate(rows):
            given = leaf((*d[:3], None if d[3] is None else d[3] + 1, d[4])) if tampered(d[0]) else own
            sub, met = folded(levels, at, given, arity)
            whole, more = folded(top, place, sub, arity)
            out.append((d[0], own, levels[-1][0], top[-1][0], sha(met + more), whole, whole == top[-1][0]))
    return sorted(out, key=repr)


def docs_of(n, langs):
    return [(i % (n - 3), f"s{i % 3}" if i % 5 else None, langs[i % len(langs)], None if i % 4 == 0 else i, None if i % 11 == 0 else "tëxt" * (i % 7))
            for i in range(n)]


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("block", [4, 64])
def test_equals_plain_tree(spark, monkeypatch, arity, block):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    docs = [*docs_of(90, ["en", "de", None, "en", "", "én"]), (None, None, "xx", None, None), (None, "a", "en", 3, "long " * 50_000)]
    wide = [(*d, "idx", 1, "g", 2) for d in docs]
    df = spark.createDataFrame(wide, SCHEMA + ", leaf string, idx int, grp string, _one int").repartition(3)
    got = merkle.check_documents(df, F.col("doc_id") % 7 == 0, arity)
    want = brute(docs, lambda i: i is not None and i % 7 == 0, arity)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "s", "en", 2, "ab")], SCHEMA)
    (row,) = merkle.check_documents(one).collect()
    assert row["root"] == row["subroot"] == row["leaf"] == row["folded_root"] and row["proof_sha256"] == sha("") and row["verified"]
    assert merkle.check_documents(one.limit(0)).collect() == []


def test_states_are_those_of_sha256():
    digests = [sha(str(i)) for i in range(11)]
    for arity in (2, 3, 4, 7):
        parents, before = merkle.raised(merkle.from_hex(digests), arity)
        assert merkle.hex_texts(parents) == levels_of(digests, arity)[1]
        assert (before[::arity] == merkle.START).all()


def test_other_changes_fold_one_by_one(spark):
    docs = docs_of(20, ["en", "de"])
    rows = spark.createDataFrame(docs, SCHEMA).select("doc_id", "lang", merkle.row_digest(F.col("doc_id"), F.col("text")).alias("own"))
    made = merkle.build_manifest(rows, "lang", ["doc_id"], "own")
    changed = made.leaves.select("doc_id", "grp", "idx", F.sha2(F.lit("x"), 256).alias("digest"))
    got = merkle.fold_leaves(made, changed.union(changed)).collect()
    assert len(got) == 40 and len({r["folded_root"] for r in got}) == 20
    same = merkle.fold_leaves(made, made.leaves.select("grp", "idx", F.col("leaf").alias("digest"))).collect()
    assert {r["folded_root"] for r in same} == {r["root"] for r in same} and len({r["root"] for r in same}) == 1
    nowhere = changed.withColumn("idx", F.col("idx") + 1_000_000)
    assert merkle.fold_leaves(made, nowhere).collect() == []
