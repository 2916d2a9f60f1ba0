"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from test_mixing import filled
from test_near_text import brute, family

from tokenizers import Tokenizer

import corpus_pipeline
from capturelens.llm.packing import SIZES
from capturelens.llm.wordpieces import public_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make_tables(spark, folder):
    """Clean texts, junk, copies, near copies, texts without words; most have a label."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9)))
    clean = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize() + "."
    junk = lambda n: " ".join((word().upper() + "!!") if n % 2 else f"{word()} ### |" for _ in range(n))
    texts = [(clean(rng.randint(30, 200)), 1) for _ in range(120)] + [(junk(rng.randint(30, 90)), 0) for _ in range(60)]
    texts += [(t, 1) for t, _ in texts[:10] for _ in range(3)]
    for base, _ in texts[20:26]:
        words = base.split()
        texts += [(" ".join(words[:i] + ["changed"] + words[i + 1 :]), 1) for i in (len(words) // 2, len(words) // 3)]
    texts += [(t, 1) for t in family(rng, 12, 150, 0.02)]
    texts += [(None, None), ("", None), ("two words", None)]
    rng.shuffle(texts)
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), len(t or "")) for i, (t, _) in enumerate(texts)]
    labels = [(i, q, 0) for i, (_, q) in enumerate(texts) if q is not None and i % 5]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The tables' texts and labels, and the rows that go into and come out of every stage."""
    folder = str(tmp_path_factory.mktemp("tables"))
    truth = make_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, folder)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert result.columns == COLUMNS
        result.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs.collect())
    final = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr)
    return truth, out, final


def test_quality_keeps_clean_and_drops_junk(steps):
    truth, out, _ = steps
    kept = {r["doc_id"] for r in out[1]}
    good = [i for i, (_, q) in truth.items() if q == 1]
    bad = [i for i, (_, q) in truth.items() if q == 0]
    assert all(i in kept for i in good) and not any(i in kept for i in bad)
    assert Counter(out[1]) <= Counter(out[0])


def test_exact_copies_leave_the_largest_id(steps):
    _, out, _ = steps
    largest = {}
    for r in out[1]:
        largest[r["text"] or ""] = max(r["doc_id"], largest.get(r["text"] or "", -1))
    assert {r["doc_id"] for r in out[2]} == set(largest.values()) and len(out[2]) == len(largest)


def test_near_copies_leave_the_smallest_id(steps):
    _, out, _ = steps
    groups = brute([(r["doc_id"], r["text"]) for r in out[2]], 5)
    assert {r["doc_id"] for r in out[3]} == {root for _, root in groups.values()}
    assert len(out[3]) < len(out[2])


def test_mix_meets_its_targets(steps):
    _, out, _ = steps
    words = lambda rows: {s: sum(len((r["text"] or "").split()) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    sizes = words(out[3])
    assert words(out[4]) == {s: int(t) for s, t in filled(sizes).items()}
    text = {r["doc_id"]: r["text"] for r in out[3]}
    assert all(r["text"] == text[r["doc_id"]] or " ".join(text[r["doc_id"]].split()).startswith(r["text"]) for r in out[4])


def test_packing_holds_every_row(steps):
    _, out, final = steps
    tokenizer = Tokenizer.from_file(public_path(corpus_pipeline.TOKENIZER))
    want, got, filled_ = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out[4]:
        want[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    for r in out[5]:
        got[r["doc_id"]] += r["length"]
        filled_[r["bin"], r["bin_size"]] += r["length"]
    assert got == want
    assert all(size == min(s for s in SIZES if s >= n) for (_, size), n in filled_.items())
    assert len(final) == len(out[5])


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
