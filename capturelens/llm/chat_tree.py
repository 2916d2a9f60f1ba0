"""Chat formatting over a prefix tree.

Conversations stand in the order of their paths of turn digests, so those that share initial turns are
neighbours and the order is depth-first. Streaming over it, a task emits a turn once for all
conversations that share it: its token ids, the position ids they continue, and the intervals of the
pack that its ancestors fill, which is what its tokens attend to besides each other. A pack is one
training sequence and closed in itself; a tree that goes on in the next pack begins there with its path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import running_totals, same
from .wordpieces import tokenizer_of

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that mark turns or end texts in this template or other common ones; texts never hold them bare.
CONTROLS = (BEGIN, END, "<|endoftext|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
ESCAPED = re.compile(r"\\(\\|n|)")
PACK_TOKENS = 65_536
PACK_ROWS = 50_000
PACKED = (
    "pack bigint, line bigint, conv_id bigint, node int, parent int, depth int, start bigint, position bigint, ids array<int>, "
    "body_from int, body_to int, in_loss boolean, attends array<bigint>"
)
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    """No control string stays whole: backslashes are doubled, and one goes behind its first character."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text of a turn, the escaped text, and what stands behind it."""
    return BEGIN + escape(role).replace("\n", "\\n") + "\n", escape(text), END + "\n"


def parse_turn(before: str, body: str, behind: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not before.startswith(BEGIN) or not before.endswith("\n") or behind != END + "\n":
        raise ValueError("not a turn of this template")
    return unescape(before[len(BEGIN) : -1]), unescape(body)


def turn_digest(role: str, text: str) -> bytes:
    return hashlib.sha256(b"%d " % len(role.encode()) + role.encode() + text.encode()).digest()


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, role, text) to (conv_id, path): eight bytes for each turn and those before it."""
    open_id, path, last = None, bytearray(), b""
    begun = False
    for batch in batches:
        ids, out = [], []
        for conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if not begun or conv != open_id:
                if begun:
                    ids.append(open_id)
                    out.append(bytes(path))
                begun, open_id, path, last = True, conv, bytearray(), b""
            last = hashlib.blake2b(last + turn_digest(role, text), digest_size=8).digest()
            path += last
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["conv_id", "path"])
    if begun:
        yield pa.RecordBatch.from_arrays(
            [pa.array([open_id], pa.int64()), pa.array([bytes(path)], pa.binary())], ["conv_id", "path"])


@dataclass(frozen=True)
class Node:
    digest: bytes
    number: int
    start: int
    position: int
    tokens: int
    attends: tuple[int, ...]  # from, to, from, to ... of the ancestors in the pack

    def below(self) -> tuple[int, ...]:
        """What a child attends to: the same and this turn, joined where they touch."""
        end = self.start + self.tokens
        if self.attends and self.attends[-1] == self.start:
            return (*self.attends[:-1], end)
        return (*self.attends, self.start, end)


class Packer:
    """Emits turns and ends of conversations that arrive in depth-first order."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], part: int, loss_role: str, pack_tokens: int):
        self.encode, self.part, self.loss_role, self.pack_tokens = encode, part, loss_role, pack_tokens
        self.packs, self.rows = -1, []
        self.new_pack()

    def new_pack(self) -> None:
        self.packs += 1
        self.path: list[Node] = []
        self.lines = self.nodes = self.tokens = 0

    def emit(self, *row) -> None:
        self.rows.append((self.part << 32 | self.packs, self.lines, *row))
        self.lines += 1

    def begin(self) -> None:
        if self.tokens >= self.pack_tokens or self.lines >= PACK_ROWS:
            self.new_pack()
        self.depth, self.shared = 0, True

    def turn(self, role: str, text: str) -> None:
        digest = turn_digest(role, text)
        at, self.depth = self.depth, self.depth + 1
        self.shared = self.shared and at < len(self.path) and self.path[at].digest == digest
        if self.shared:
            return
        del self.path[at:]
        before, body, behind = self.encode(list(format_turn(role, text)))
        parent = self.path[-1] if self.path else None
        n = len(before) + len(body) + len(behind)
        node = Node(
            digest, self.nodes, self.tokens, parent.position + parent.tokens if parent else 0, n,
            parent.below() if parent else (),
        )
        self.emit(
            None, node.number, parent.number if parent else None, at, node.start, node.position, before + body + behind,
            len(before), len(before) + len(body), role == self.loss_role, list(node.attends),
        )
        self.path.append(node)
        self.nodes, self.tokens = self.nodes + 1, self.tokens + n

    def end(self, conv_id: int | None) -> None:
        last = self.path[self.depth - 1]
        self.emit(conv_id, last.number, None, self.depth - 1, None, None, None, None, None, None, None)

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PACKED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.list_(pa.int32()),
                 pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
        columns = [pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names)


def packer(tokenizer: str, loss_role: str, pack_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (rank, conv_id, role, text) to the rows of packs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = tokenizer_of(tokenizer)
        encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        out, rank, conv = Packer(encode, TaskContext.get().partitionId(), loss_role, pack_tokens), None, None
        for batch in batches:
            for own_rank, own_conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if own_rank != rank:
                    if rank is not None:
                        out.end(conv)
                    out.begin()
                    rank, conv = own_rank, own_conv
                out.turn(role, text)
                if len(out.rows) >= 500:
                    yield out.take()
        if rank is not None:
            out.end(conv)
            yield out.take()

    return pack


def write_packs(
    conversations: DataFrame, folder: str, tokenizer: str, loss_role: str = "assistant", pack_tokens: int = PACK_TOKENS,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> None:
    """Writes the packs of all conversations to a new folder.

    Turns of a conversation stand in the order of ``turn``, null first, then role and text, repeated
    rows included; null roles and texts are empty; rows with a null id are one conversation. Texts of
    ``loss_role`` are under the loss mask. Other columns are not looked at. A task keeps a digest and
    a few numbers for each turn of the conversation it is at, not its texts.
    """
    turns = conversations.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = ["turn", "role", "text"]
    grouped = turns.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "role", "text")
    ordered = grouped.mapInArrow(paths, "conv_id bigint, path binary").withColumn("one", F.lit(1))
    ranks = running_totals(ordered, [], ["path", "conv_id"], "one", "rank").select("conv_id", "rank")
    ranked = turns.join(ranks, same(turns, ranks, ["conv_id"])).select("rank", turns["conv_id"], *order)
    sorted_turns = ranked.repartitionByRange(F.col("rank")).sortWithinPartitions("rank", *order)
    rows = sorted_turns.select("rank", "conv_id", "role", "text").mapInArrow(packer(tokenizer, loss_role, pack_tokens), PACKED)
    rows.write.parquet(folder)


@dataclass
class Walk:
    """What the turns from the first to this one add up to."""

    turns: object
    loss: object
    loss_chars: int = 0
    chars: int = 0

    def after(self, role: str, text: str, in_loss: bool, chars: int) -> Walk:
        turns, loss = self.turns.copy(), self.loss.copy()
        turns.update(f"{role}\n{text}\n".encode())
        if in_loss:
            loss.update(text.encode())
        return Walk(turns, loss, self.loss_chars + len(text) * in_loss, self.chars + chars)


def reader(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs in order to one row for each conversation in them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer_of(tokenizer)
        walks: list[Walk] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["ids"] is None:
                    w = walks[row["depth"]]
                    out.append((row["conv_id"], row["depth"] + 1, w.turns.hexdigest(), w.loss_chars, w.loss.hexdigest(), w.chars))
                    continue
                cuts = [0, row["body_from"], row["body_to"], len(row["ids"])]
                parts = [model.decode(row["ids"][a:b], skip_special_tokens=False) for a, b in zip(cuts, cuts[1:])]
                role, text = parse_turn(*parts)
                del walks[row["depth"] :]
                base = walks[-1] if walks else Walk(hashlib.sha256(), hashlib.sha256())
                walks.append(base.after(role, text, row["in_loss"], sum(map(len, parts))))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in READ.split(", ")])

    return read


def read_conversations(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """One row for each conversation of the packs, decoded, parsed and unescaped."""
    packs = spark.read.schema(PACKED).parquet(folder)
    return packs.repartition("pack").sortWithinPartitions("pack", "line").mapInArrow(reader(tokenizer), READ)
