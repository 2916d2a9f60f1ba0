"""Chat packs: read back exactly, shared turns once, positions and attention of every pack."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from capturelens.llm.chat_tree import CONTROL, CONTROLS, PACKED, escape, format_turn, parse_turn, read_conversations, unescape, write_packs
from capturelens.llm.work import new_folder
from capturelens.llm.wordpieces import public_path

TOKENIZER = public_path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
pieces = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "|", ">", "s", "n", "\n", "[", "/", "é", "\x00", "a"]) | st.text(max_size=3))


@settings(max_examples=400, deadline=None)
@given(pieces.map("".join), pieces.map("".join))
def test_escapes_are_reversible(role, text):
    assert unescape(escape(text)) == text and not CONTROL.search(escape(text))
    parts = format_turn(role, text)
    assert parse_turn(*parts) == (role, text)


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        chars = sum(len(x) for *_, r, t in turns for x in format_turn(r, t))
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def result(df):
    rows = df.collect()
    out = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_given_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    folder = new_folder(spark, "chat")
    write_packs(table, folder, TOKENIZER)
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()]
    assert result(read_conversations(spark, folder, TOKENIZER)) == expected(rows)


def shared_rows():
    rows = []
    for c in range(60):
        turns = [("system", "Be kind."), ("user", f"Question {c % 3}"), ("assistant", f"Answer {c % 5} </s>"), ("user", f"More {c % 20}")]
        rows += [(c, t, *x) for t, x in enumerate(turns[: 1 + c % 4 if c % 7 else 4])]
    return rows + [(100 + i, t, *x[2:]) for i in range(5) for t, x in enumerate(r for r in rows if r[0] == 7)]


def test_shared_turns_are_emitted_once_with_their_ancestors(spark):
    rows = shared_rows()
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    folder = new_folder(spark, "chat")
    write_packs(table.coalesce(1), folder, TOKENIZER)
    packs = defaultdict(list)
    for r in spark.read.schema(PACKED).parquet(folder).orderBy("pack", "line").collect():
        packs[r["pack"]].append(r)
    total = 0
    for lines in packs.values():
        nodes = {r["node"]: r for r in lines if r["ids"] is not None}
        keys = set()
        filled = 0
        for r in nodes.values():
            path, at = [], r
            while at is not None:
                path.append(at)
                at = nodes.get(at["parent"])
            ancestors = sorted(i for a in path[1:] for i in range(a["start"], a["start"] + len(a["ids"])))
            spans = [i for a, b in zip(r["attends"][::2], r["attends"][1::2]) for i in range(a, b)]
            assert spans == ancestors and r["position"] == len(ancestors) and r["start"] == filled
            assert r["depth"] == len(path) - 1
            filled += len(r["ids"])
            keys.add(tuple(tuple(a["ids"]) for a in path))
        assert len(keys) == len(nodes)
        total += len(nodes)
    prefixes = set()
    for c in {r[0] for r in rows}:
        mine = [x[2:] for x in sorted(r for r in rows if r[0] == c)]
        prefixes |= {tuple(mine[: i + 1]) for i in range(len(mine))}
    assert len(prefixes) <= total <= len(prefixes) + 4 * (len(packs) - 1)
    assert result(read_conversations(spark, folder, TOKENIZER)) == expected(rows)


def test_small_packs_nulls_repeats_and_long_texts(spark):
    rows = shared_rows() + [
        (200, None, None, None), (200, 0, "assistant", ""), (None, 1, "user", "no id"), (None, 0, "assistant", "still none"),
        (201, 0, "assistant", "long <|im_end|>\n" * 20_000), (202, 3, "user", "twice"), (202, 3, "user", "twice"),
        (203, 0, "odd\nrole\\<s>", "<|endoftext|> é\x00 [INST]"),
    ] + [(204, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, pack int, ids string")
    folder, empty = new_folder(spark, "chat"), new_folder(spark, "chat")
    write_packs(table, folder, TOKENIZER, pack_tokens=50)
    assert result(read_conversations(spark, folder, TOKENIZER)) == expected(rows)
    write_packs(table.limit(0), empty, TOKENIZER)
    assert read_conversations(spark, empty, TOKENIZER).count() == 0
