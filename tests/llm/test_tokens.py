"""Token store and token counts against the tokenizers themselves."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from capturelens.llm import token_store
from capturelens.llm.token_counts import CACHE, count_tokens
from capturelens.llm.token_store import read_document, read_tokens, train_dictionary, write_tokens
from capturelens.llm.wordpieces import encoder, public_path
from capturelens.llm.work import file_store, new_folder

WORDS, BYTES, PIECES = map(public_path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
ODD = [
    "<|endoftext|> a<|startoftext|>b", "Don't WE'LL i'm", "x y\x1cz \x85 \xa0  q", "É é ß ſ İ Σς ΑΣ", "12a3!? #x# a_b a-b...",
    "日本語 テスト、です。", "é Å", "", " \n", "\x00 \x7f", "ÀÉ!!\n---", "word, Word. WORD", None,
]


def library(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_ids_are_the_library_s(path):
    assert [array("I", x).tolist() for x in library(path, ODD)] == [np.frombuffer(x, "<u4").tolist() for x in encoder(path).packed(ODD)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=12) | st.sampled_from(["don't", "Word,", "<|endoftext|>", "\x1f", "'S"])).map(" ".join))
def test_ids_of_any_text(text):
    assert np.frombuffer(next(encoder(WORDS).packed([text])), "<u4").tolist() == library(WORDS, [text])[0]


def expected(rows):
    out, start = {}, 0
    for (i, _), ids in zip(rows, library(WORDS, [t for _, t in rows])):
        ids = [*ids, 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def result(df):
    return {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()}


def test_store_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = new_folder(spark, "store")
    write_tokens(docs, folder, WORDS)
    assert result(read_tokens(spark, folder)) == expected(sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_store_in_many_shards_and_single_documents(spark, documents):
    rows = [(i * 3 - 9, t) for i, t in enumerate(ODD)] + [(10_000, "long text " * 60_000)]
    folder = new_folder(spark, "store")
    write_tokens(documents(rows), folder, WORDS, shard_bytes=200)
    assert result(read_tokens(spark, folder)) == expected(rows)
    shards, tasks = spark.read.parquet(f"{folder}/manifest").count(), read_tokens(spark, folder).select(F.spark_partition_id().alias("p"))
    assert shards > 1 and tasks.distinct().count() == shards
    ids = {r["doc_id"]: r["ids"] for r in read_tokens(spark, folder, with_ids=True).collect()}
    for r in spark.read.parquet(f"{folder}/manifest").collect():
        assert read_document(folder, r["file"], r["first_id"]).tolist() == ids[r["first_id"]]
        assert read_document(folder, r["file"], 10**6) is None


def test_store_of_null_and_repeated_ids_and_nothing(spark, documents):
    folder, empty = new_folder(spark, "store"), new_folder(spark, "store")
    write_tokens(documents([(2, "b c"), (None, "a"), (2, "b c"), (None, "a a")]), folder, WORDS)
    got = sorted(read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 2, 2] and [r["n_tokens"] for r in got][2:] == [3, 3]
    write_tokens(documents([]), empty, WORDS)
    assert read_tokens(spark, empty).count() == 0


def test_another_dictionary_is_noticed(spark, documents):
    folder = new_folder(spark, "store")
    write_tokens(documents([(1, "a b c")]), folder, WORDS)
    store, path = file_store(folder)
    name = next(x.path for x in store.get_file_info(__import__("pyarrow.fs").fs.FileSelector(path)) if x.path.endswith(".dictionary"))
    with store.open_output_stream(name) as out:
        out.write(b"something else")
    with pytest.raises(ValueError):
        token_store.ShardReader(folder, spark.read.parquet(f"{folder}/manifest").first()["file"])


def test_ids_must_fit():
    assert token_store.narrow(np.array([1, 65_535], "<u4").tobytes(), 2) == np.array([1, 65_535], "<u2").tobytes()
    with pytest.raises(ValueError):
        token_store.narrow(np.array([65_536], "<u4").tobytes(), 2)


def test_dictionaries_of_few_samples():
    assert len(train_dictionary([])) >= 8 and train_dictionary([b"12345678"]) == b"12345678"


@pytest.mark.parametrize("path", [WORDS, PIECES])
def test_counts_through_the_cache(spark, documents, path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "same"), (51, "same"), (None, "same"), (52, "longer text " * 3000)]
    cache = new_folder(spark, "cache")
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(n), len(n) > 2048)
                  for (i, t), n in zip(rows, library(path, [t for _, t in rows])))
    read = lambda df: sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())
    assert read(count_tokens(documents(rows), path, cache)) == want
    stored = spark.read.schema(CACHE).parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows}) == stored.select("digest").distinct().count()
    assert read(count_tokens(documents([*rows, (99, "new one")]), path, cache))[-1][0] == 99
    assert spark.read.schema(CACHE).parquet(cache).count() == len({t or "" for _, t in rows}) + 1


def test_another_tokenizer_has_counts_of_its_own(spark, documents):
    cache = new_folder(spark, "cache")
    table = documents([(1, "Some words here"), (2, None)])
    one, two = ([r["n_tokens"] for r in count_tokens(table, p, cache).orderBy("doc_id").collect()] for p in (WORDS, BYTES))
    assert spark.read.schema(CACHE).parquet(cache).count() == 4 and one[1] == two[1] == 0
    assert count_tokens(documents([]), WORDS).count() == 0
