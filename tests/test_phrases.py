"""Listed items as rows and as text, for groups that fill many blocks and pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelens.functions import phrases as ph


def test_disagreements_of_a_large_group(split, monkeypatch):
    monkeypatch.setattr(ph, "PIECE", 7)
    rows = [(i * 7 % 1009, "hot" if i % 10 else None, i % 3 == 0) for i in range(1009)] + [(2000, "none", False), (None, "void", True)]
    checks = split.createDataFrame(rows, "doc_id bigint, source string, bad boolean")
    want = {s: sorted(i for i, x, bad in rows if x == s and bad and i is not None) for _, s, _ in rows}
    got = ph.disagreement_rows(checks, "source", F.col("bad"), F.col("doc_id")).collect()
    for source, ids in want.items():
        listed = sorted((r["place"], r["item"]) for r in got if r["source"] == source and r["place"] is not None)
        assert listed == [(n, str(i)) for n, i in enumerate(ids)]
    sums = {r["source"]: (r["disagree"], r["agree"]) for r in got if r["place"] is None}
    assert sums == {s: (sum(b for _, x, b in rows if x == s), sum(not b for _, x, b in rows if x == s)) for s in want}
    text = {r["source"]: r["phrase"] for r in ph.disagreement_phrase(checks, "source", F.col("bad"), F.col("doc_id")).collect()}
    assert text == {s: "; ".join(map(str, ids)) for s, ids in want.items()} | {"none": "no disagreement found"}


def test_stability_of_a_large_group(split, monkeypatch):
    monkeypatch.setattr(ph, "PIECE", 7)
    rows = [(1, i, 1, 2 if i % 2 else None) for i in range(600)] + [(2, 5, 1, None), (3, 6, 3, 3)]
    members = split.createDataFrame(rows, "nation int, id bigint, k bigint, n bigint")
    got = ph.stability_rows(members, "nation", "id", "k", "n").collect()
    assert sorted((r["place"], r["item"]) for r in got if r["nation"] == 1 and r["item"]) == [(j, f"{2 * j + 1}: 1 of 2 (50.0 %)") for j in range(300)]
    assert {r["nation"]: (r["members"], r["repeated"]) for r in got if r["place"] is None} == {1: (600, 300), 2: (1, 0), 3: (1, 1)}
    text = {r["nation"]: r["phrase"] for r in ph.stability_phrase(members, "nation", "id", "k", "n").collect()}
    assert text[2] == "single run" and text[3] == "6: 3 of 3 (100.0 %)"
    assert text[1] == "; ".join(f"{i}: 1 of 2 (50.0 %)" for i in range(1, 600, 2)) + "; others single run"
