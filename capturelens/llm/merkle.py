"""A Merkle manifest of a dataset whose parents keep resumable hash states.

A leaf is the digest of a row, a parent the SHA-256 of its children's hex digests. A hex digest fills
exactly one block of SHA-256, so the state before each child's slot is a 32-byte value that can be stored:
folding a changed child resumes the state before its slot with the new digest and the siblings to its
right; what stands to its left is never hashed again. Groups have trees of their own, whose roots are the
leaves of the tree on top.

Trees are built in blocks of consecutive leaves, a task each, and the roots of blocks are the leaves of
the next pass. Nothing but a block's nodes is ever in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import running_totals, written

BLOCK_LEAVES = 4096


def first_primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def root_bits(n: int, power: int) -> int:
    """The first 32 bits of the fraction of the square (2) or cube (3) root of n."""
    scaled, low, high = n << (32 * power), 0, 1 << 40
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


START = np.array([root_bits(p, 2) for p in first_primes(8)], np.uint32)
ROUND = np.array([root_bits(p, 3) for p in first_primes(64)], np.uint32)
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one block (n, 16) each."""
    w = list(blocks.T.copy())
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        small = turned(x, 7) ^ turned(x, 18) ^ (x >> np.uint32(3))
        w.append(w[i - 16] + small + w[i - 7] + (turned(y, 17) ^ turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = states.T.copy()
    for i in range(64):
        one = h + (turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) + ((e & f) ^ (~e & g)) + ROUND[i] + w[i]
        two = (turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def absorbed(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hex text of one digest (n, 8) each."""
    raw = np.ascontiguousarray(digests.astype(">u4")).view(np.uint8).reshape(len(digests), 32)
    return compress(states, HEX[raw].reshape(len(digests), 64).view(">u4").astype(np.uint32))


def closed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 14:] = np.stack([blocks >> 23, (blocks << 9) & 0xFFFFFFFF], axis=1)
    return compress(states, last)


def from_hex(texts: Sequence[str]) -> np.ndarray:
    return from_bytes(bytes.fromhex("".join(texts)))


def to_bytes(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, 8)


def hex_texts(digests: np.ndarray) -> list[str]:
    text = to_bytes(digests).hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def height(nodes: int, arity: int) -> int:
    """Levels above so many leaves; none above one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // arity), levels + 1
    return levels


def block_depth(arity: int) -> int:
    depth = 1
    while arity ** (depth + 1) <= BLOCK_LEAVES:
        depth += 1
    return depth


def raised(nodes: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """Parents of consecutive nodes, and the state before each node's slot."""
    parents = -(-len(nodes) // arity)
    before = np.empty_like(nodes)
    states = np.tile(START, (parents, 1))
    held = np.zeros(parents, np.int64)
    for slot in range(arity):
        own = np.arange(slot, len(nodes), arity)
        if len(own):
            before[own] = states[: len(own)]
            states[: len(own)] = absorbed(states[: len(own)], nodes[own])
            held[: len(own)] += 1
    return closed(states, held), before


def building(arity: int):
    depth = block_depth(arity)

    def build(table: pa.Table) -> pa.Table:
        """The nodes of one block (grp, block, idx, digest) as one row. A first block that is not full is the only
        one of its group and ends at its root; all others have every level of a block."""
        nodes = from_hex(table.sort_by("idx").column("digest").to_pylist())
        levels, digests, states = [], [], []
        for _ in range(depth if table.column("block")[0].as_py() else height(len(nodes), arity)):
            digests.append(to_bytes(nodes))
            levels.append(len(nodes))
            nodes, before = raised(nodes, arity)
            states.append(to_bytes(before))
        return pa.table({
            "grp": table.column("grp").slice(0, 1), "block": table.column("block").slice(0, 1),
            "levels": pa.array([levels], pa.list_(pa.int32())), "digests": pa.array([b"".join(digests)], pa.binary()),
            "states": pa.array([b"".join(states)], pa.binary()), "root": pa.array(hex_texts(nodes)),
        })

    return build


BLOCK_SCHEMA = "grp string, block bigint, levels array<int>, digests binary, states binary, root string"
BLOCK_KEY = ("grp", "block")


def block_passes(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Blocks of every pass over nodes (grp, idx, digest); in the last one each group is one block."""
    width, passes = arity ** block_depth(arity), []
    while True:
        dealt = nodes.withColumn("block", F.expr(f"idx div {width}"))
        blocks = written(dealt.groupBy(*BLOCK_KEY).applyInArrow(building(arity), BLOCK_SCHEMA), "merkle-blocks")
        passes.append(blocks)
        if blocks.where("block > 0").isEmpty():
            return passes
        nodes = blocks.select("grp", F.col("block").alias("idx"), F.col("root").alias("digest"))


@dataclass
class Manifest:
    """Leaves (``grp, idx, leaf`` and their rows' columns), the blocks over them, and the blocks over the roots
    of the groups, whose ``names`` give each group its place."""

    arity: int
    leaves: DataFrame
    passes: list[DataFrame]
    names: DataFrame
    top: list[DataFrame]


def row_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of values, each as its number of bytes, a colon and its text; null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def build_manifest(rows: DataFrame, group_col: str, order: Sequence[str], leaf_col: str, arity: int = 2) -> Manifest:
    """The trees over rows with a leaf digest: leaves of a group in ascending ``order``, then by digest, groups in
    ascending order, null first. Rows equal in both are equal leaves, in any order. An empty table has no root."""
    named = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))).withColumn("_one", F.lit(1))
    placed = running_totals(named, ["grp"], [*order, leaf_col], "_one", "idx")
    leaves = written(placed.drop("_one").withColumnRenamed(leaf_col, "leaf"), "leaves")
    passes = block_passes(leaves.select("grp", "idx", F.col("leaf").alias("digest")), arity)
    roots = passes[-1].select(F.lit("").alias("all"), "grp", "root", F.lit(1).alias("_one"))
    names = written(running_totals(roots, ["all"], ["grp"], "_one", "idx").select("all", "grp", "idx", F.col("root").alias("digest")), "roots")
    top = block_passes(names.select(F.col("all").alias("grp"), "idx", "digest"), arity)
    return Manifest(arity, leaves, passes, names, top)


def sibling_levels(block: dict, slots: np.ndarray, arity: int):
    """For each level of a block and the leaves at these places: states before the slots, siblings (n, arity - 1, 8)
    from left to right, how many stand left and right."""
    digests, states = from_bytes(block["digests"]), from_bytes(block["states"])
    start = 0
    for count in block["levels"]:
        first = slots // arity * arity
        left = slots - first
        right = np.minimum(first + arity, count) - slots - 1
        siblings = np.zeros((len(slots), arity - 1, 8), np.uint32)
        for j in range(arity - 1):
            at = np.where(j < left, first + j, first + j + 1)
            has = j < left + right
            siblings[has, j] = digests[start + at[has]]
        yield states[start + slots], siblings, left, right
        start, slots = start + count, slots // arity


@dataclass
class Folding:
    """Digests on their way up, and the digest of all siblings met."""

    digests: np.ndarray
    proof: np.ndarray
    met: np.ndarray

    def level(self, states: np.ndarray, siblings: np.ndarray, left: np.ndarray, right: np.ndarray, there: np.ndarray) -> None:
        """One level up for the rows that have it."""
        states = absorbed(states, self.digests[there])
        proof = self.proof[there]
        for j in range(siblings.shape[1]):
            has = j < left + right
            if has.any():
                proof[has] = absorbed(proof[has], siblings[has, j])
            after = has & (j >= left)
            if after.any():
                states[after] = absorbed(states[after], siblings[after, j])
        self.digests[there] = closed(states, left + right + 1)
        self.proof[there] = proof
        self.met[there] += left + right


def inside_block(arity: int):
    width = arity ** block_depth(arity)

    def fold(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        """Rows (key columns, grp, block, idx, digest) folded to the root of their block."""
        held = ((blocks.column("levels")[0].as_py() or [1])[0]) if blocks.num_rows else 0
        rows = rows.filter(pa.array(rows.column("idx").to_numpy() % width < held))
        n = rows.num_rows
        way = Folding(from_hex(rows.column("digest").to_pylist()), np.tile(START, (n, 1)), np.zeros(n, np.int64))
        slots = rows.column("idx").to_numpy() % width
        for level in sibling_levels(blocks.to_pylist()[0], slots, arity) if n else ():
            way.level(*level, np.arange(n))
        raw = [pa.array([to_bytes(x) for x in part], pa.binary()) for part in (way.digests, way.proof)]
        out = rows.drop_columns(["digest"])
        for name, column in zip(("digest", "proof", "met"), (*raw, pa.array(way.met))):
            out = out.append_column(name, column)
        return out

    return fold


STEP = "struct<state: binary, siblings: binary, left: int>"


def child_steps(arity: int):
    """Blocks to (grp, idx, steps): the way of each child to its block's root."""
    width = arity ** block_depth(arity)

    def steps(batches):
        for batch in batches:
            for block in batch.to_pylist():
                n = block["levels"][0] if block["levels"] else 1
                ways: list[list[dict]] = [[] for _ in range(n)]
                for states, siblings, left, right in sibling_levels(block, np.arange(n), arity):
                    for i, way in enumerate(ways):
                        near = siblings[i, : left[i] + right[i]]
                        way.append({"state": to_bytes(states[i]), "siblings": to_bytes(near), "left": int(left[i])})
                first = block["block"] * width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block["grp"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array([block["block"]] * n, pa.int64()),
                     pa.array(ways, pa.list_(pa.struct([("state", pa.binary()), ("siblings", pa.binary()), ("left", pa.int32())])))],
                    ["grp", "idx", "block", "steps"],
                )

    return steps


def ways_up(passes: list[DataFrame], arity: int) -> DataFrame:
    """``grp, idx, steps, root``: the way of each node of the first of these passes to the root of its group."""
    up = passes[-1].select("grp", "root")
    ways = None
    for blocks in reversed(passes):
        own = blocks.mapInArrow(child_steps(arity), f"grp string, idx bigint, block bigint, steps array<{STEP}>")
        if ways is None:
            ways = own.join(up, "grp").select("grp", "idx", "steps", "root")
        else:
            above = ways.select("grp", F.col("idx").alias("block"), F.col("steps").alias("rest"), "root")
            ways = own.join(above, [*BLOCK_KEY]).select("grp", "idx", F.concat("steps", "rest").alias("steps"), "root")
    return ways


def above_block(arity: int):
    def fold(batches):
        """Rows with digest, proof, met and steps to the root: ``folded_root, proof_sha256`` in their place."""
        for batch in batches:
            n = batch.num_rows
            table = pa.Table.from_batches([batch])
            digests, proof = (from_bytes(b"".join(table.column(c).to_pylist())) for c in ("digest", "proof"))
            way = Folding(digests.copy(), proof.copy(), table.column("met").to_numpy().copy())
            steps = table.column("steps").to_pylist()
            for level in range(max(map(len, steps), default=0)):
                there = np.array([i for i in range(n) if level < len(steps[i])])
                here = [steps[i][level] for i in there]
                siblings = np.zeros((len(here), arity - 1, 8), np.uint32)
                many = np.array([len(s["siblings"]) // 32 for s in here])
                for j, s in enumerate(here):
                    siblings[j, : many[j]] = from_bytes(s["siblings"])
                left = np.array([s["left"] for s in here])
                way.level(from_bytes(b"".join(s["state"] for s in here)), siblings, left, many - left, there)
            out = table.drop_columns(["digest", "proof", "met", "steps"])
            out = out.append_column("folded_root", pa.array(hex_texts(way.digests), pa.string()))
            out = out.append_column("proof_sha256", pa.array(hex_texts(closed(way.proof, way.met)), pa.string()))
            yield from out.to_batches()

    return fold


def fold_leaves(manifest: Manifest, changed: DataFrame) -> DataFrame:
    """The rows ``changed`` (grp, idx, digest and other columns), each folded to the root on its own.

    Instead of ``digest`` come ``subroot, root`` as the manifest has them, ``folded_root``, what the root would
    be with that one leaf replaced, and ``proof_sha256`` over all siblings on the way. Repeated rows are folded
    one by one; rows whose place is not in the manifest are dropped.
    """
    arity, width = manifest.arity, manifest.arity ** block_depth(manifest.arity)
    others = [c for c in changed.columns if c != "digest"]
    rows = changed.select(*others, "digest").withColumn("block", F.expr(f"idx div {width}"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*others, "block"])
    blocks = manifest.passes[0]
    lower = rows.groupBy(*BLOCK_KEY).cogroup(blocks.select("grp", "block", "levels", "digests", "states").groupBy(*BLOCK_KEY))
    inside = lower.applyInArrow(inside_block(arity), f"{schema}, digest binary, proof binary, met bigint")

    top = ways_up(manifest.top, arity).select("idx", F.col("steps").alias("last"), F.col("root").alias("whole"))
    groups = manifest.names.join(top, "idx").select("grp", "last", "whole", F.col("digest").alias("subroot"))
    if len(manifest.passes) > 1:
        middle = ways_up(manifest.passes[1:], arity).select("grp", F.col("idx").alias("block"), "steps")
    else:
        middle = blocks.select("grp", "block", F.array().cast(f"array<{STEP}>").alias("steps"))
    ways = written(middle.join(groups, "grp").select(
        "grp", "block", F.concat("steps", "last").alias("steps"), "subroot", F.col("whole").alias("root")), "merkle-ways")
    joined = inside.join(ways, [*BLOCK_KEY]).select(*others, "block", "subroot", "root", "digest", "proof", "met", "steps")
    return joined.mapInArrow(above_block(arity), f"{schema}, subroot string, root string, folded_root string, proof_sha256 string")


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def check_documents(docs: DataFrame, tampered: Column | None = None, arity: int = 2) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of a documents table.

    Leaves are grouped by language, ascending by id (null first). Where ``tampered`` holds, the row is folded
    as if its ``n_chars`` were larger by one, all others as they are. Null values have a leaf text of their
    own, so null and empty differ; rows repeating an id stand side by side, ordered by their digest; an empty
    table gives no rows; other columns are not looked at. No text is cut.
    """
    fields = [F.col(c) for c in LEAF_FIELDS]
    more = row_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF_FIELDS])
    other = F.when(F.coalesce(tampered, F.lit(False)), more) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select("doc_id", "lang", row_digest(*fields).alias("digest"), other.alias("other"))
    manifest = build_manifest(rows, "lang", ["doc_id"], "digest", arity)
    changed = manifest.leaves.select("doc_id", "leaf", "grp", "idx", F.coalesce("other", "leaf").alias("digest"))
    return fold_leaves(manifest, changed).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
