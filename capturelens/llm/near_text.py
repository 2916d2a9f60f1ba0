"""Near-duplicate texts: a set-similarity join along randomly chosen paths.

Texts are sets of word shingles; equal sets are one vertex. Every vertex walks several independent
trees: a node deals its documents out by their minwise token at coordinates that the node chooses, on
average one divided by the similarity sought, so that similar documents keep meeting while others part.
Small nodes are compared exhaustively by signatures, large ones in blocks first. What the signatures
let through is confirmed on the full shingle sets. Large nodes whose documents are then not all linked
go on: a few documents outside the node's largest group meet all others, and where they are many the node
branches again, level by level, until its nodes are small, of one group, or have only a few such documents. A node
of a bounded number of documents is walked to its end in one task, on row numbers; only larger ones are dealt anew
for each level. Links leave a block as a spanning forest, so a group of copies gives as many rows as it has members.

With 16 trees a pair of exactly the similarity sought is missed by all of them with a chance of about
2e-6, and lost by its signature with one of about 1e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Forest, components, written

TREES = 16
COORDINATES = 128  # of a signature
LEAF = 64  # documents of a node that are compared exhaustively
BLOCK = 256  # documents of a block of a larger node
WALKED = 16_384  # documents of a node whose branches one task walks; with their signatures they take some 5 MB
WALKED_TIMES = 64  # rows of a walk for each document; beyond them the node's documents are all compared
LEVELS = 96  # of branching; no more, so that documents that never part are told apart by comparing them all
DEVIATIONS = 4.2  # by which a signature may underestimate
KEPT_WORDS = 500_000

_numbers = np.random.RandomState(20_240_501)
FACTORS = _numbers.randint(0, 2**31, COORDINATES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _numbers.randint(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32)
PLACES = _numbers.randint(0, 2**63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, one for each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Shingle sets of whole texts as sorted 64-bit values; A-Z is lower-cased, words end at ASCII space."""

    def __init__(self, words: int):
        self.k, self.hashes = words, WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if len(self.hashes) > KEPT_WORDS:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        k = min(self.k, n)  # fewer words: the whole sequence is the one shingle
        total = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            total += mixed(h[i : n - k + 1 + i] ^ PLACES[i % 64])* PLACES[(i + 7) % 64]
        return np.unique(mixed(total))


def minwise(values: np.ndarray) -> np.ndarray:
    """The least value of a set under each coordinate's order."""
    h = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        part = h[None, at : at + 4096] * FACTORS[:, None] + SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """One byte of each minwise token."""
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def sketcher(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sizes, digests, roots, signs = [], [], [], []
            for text in texts_of(batch, 1):
                values = shingle(text)
                least = minwise(values)
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                roots.append(least[:TREES].tobytes())
                signs.append(signature(least).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(roots, pa.binary()), pa.array(signs, pa.binary())],
                ["doc_id", "mark", "n", "digest", "roots", "sign"],
            )

    return sketch


def stacked(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def at_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, roots) to (node, doc): the first node of each tree."""
    for batch in batches:
        if batch.num_rows:
            tokens = stacked(batch.column(1), np.uint32).astype(np.uint64)
            nodes = mixed(tokens + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(33))[None, :])
            docs = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel().view(np.int64)), pa.array(docs)], ["node", "doc"])


def second_share(similarity: float) -> int:
    """How many of 2**20 nodes choose a second coordinate."""
    return int((1 / similarity - 1) * 2**20)


def child_nodes(node: np.ndarray, signs: np.ndarray, second: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their child nodes): each node chooses one coordinate, and now and then a second."""
    rows = np.arange(len(node))
    for place, chosen in ((1, rows), (2, rows[(mixed(node + PLACES[9]) >> np.uint64(44)) < np.uint64(second)])):
        own = mixed(node[chosen] * PLACES[10] + np.uint64(place))
        coordinate = (own % np.uint64(COORDINATES)).astype(np.int64)
        yield chosen, mixed(own ^ signs[chosen, coordinate].astype(np.uint64))


def branching(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, doc, sign, label) to the child nodes."""
    second = second_share(similarity)

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, doc = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            label = batch.column(3).to_numpy()
            chosen, children = zip(*child_nodes(node, stacked(batch.column(2), np.uint8), second))
            rows = np.concatenate(chosen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(children).view(np.int64)), pa.array(doc[rows]), pa.array(label[rows])],
                ["node", "doc", "label"],
            )

    return branch


def shared_nodes(members: DataFrame) -> DataFrame:
    """``node, doc, n`` of nodes with at least two documents; small nodes with the same documents count once."""
    marks = [F.sum(F.shiftright(F.xxhash64("doc", F.lit(i)), 24)).alias(f"x{i}") for i in range(2)]
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), *marks)
    sizes = sizes.where("n > 1").withColumn("own", F.when(F.col("n") > LEAF, F.col("node")))
    once = sizes.groupBy("n", "lo", "hi", "x0", "x1", "own").agg(F.min("node").alias("node")).select("node", "n")
    return members.join(once, "node")


def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block (the first column) of batches sorted by it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table.column(0).to_numpy()
        ends = np.flatnonzero(key[1:] != key[:-1]) + 1
        start = 0
        for end in ends:
            yield table.slice(start, end - start)
            start = end
        rest = table.slice(start)
    if rest is not None:
        yield rest


def alike(signs: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose estimated similarity reaches ``least``, the most similar first."""
    left, right, counts = [], [], []
    for i in range(len(signs) - 1):
        same = np.count_nonzero(signs[i + 1 :] == signs[i], axis=1)
        hits = np.flatnonzero(same >= least * COORDINATES)
        if len(hits):
            left.append(np.full(len(hits), i))
            right.append(hits + i + 1)
            counts.append(same[hits])
    if not left:
        return np.empty(0, int), np.empty(0, int)
    order = np.argsort(-np.concatenate(counts), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def least_estimate(similarity: float) -> float:
    """What a pair at the similarity sought shows at least, in a share of equal signature bytes."""
    p = similarity + (1 - similarity) / 256
    return p - DEVIATIONS * (p * (1 - p) / COORDINATES) ** 0.5


def candidates(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (block, doc, sign) to a forest of (block, a, b) over the pairs that look similar."""
    least = least_estimate(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for table in sorted_blocks(batches):
            block, docs = table.column(0)[0].as_py(), table.column(1).to_pylist()
            forest = Forest()
            for i, j in zip(*alike(stacked(table.column(2).combine_chunks(), np.uint8), least)):
                a, b = docs[i], docs[j]
                if forest.join(a, b):
                    out.append((block, min(a, b), max(a, b)))
            if len(out) > 50_000:
                yield edge_batch(out, ["block", "a", "b"])
                out = []
        if out:
            yield edge_batch(out, ["block", "a", "b"])

    return compare


def edge_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def open_batch(block: int, docs: np.ndarray, signs: np.ndarray, labels: np.ndarray, least: float) -> pa.RecordBatch | None:
    """The (block, doc) of one block that look like a document of another label."""
    i, j = alike(signs, least)
    apart = labels[i] != labels[j]
    open_docs = np.unique(np.concatenate([docs[i[apart]], docs[j[apart]]]))
    if len(open_docs):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(open_docs), block, np.int64)), pa.array(open_docs)], ["block", "doc"])


def unlinked(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (block, doc, sign, label) to the (block, doc) that look like a document of another label."""
    least = least_estimate(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_blocks(batches):
            labels, docs = table.column(3).to_numpy(), table.column(1).to_numpy()
            signs = stacked(table.column(2).combine_chunks(), np.uint8)
            if (found := open_batch(table.column(0)[0].as_py(), docs, signs, labels, least)) is not None:
                yield found

    return compare


def met_blocks(node: np.uint64, rows: np.ndarray, opened: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(block, rows) in which every opened row of a node meets every row of it."""
    parts = [np.array_split(r, -(-len(r) // block)) for r in (rows, opened)]
    for j, part in enumerate(parts[0]):
        for o, some in enumerate(parts[1]):
            own = mixed(np.array([node]) ^ mixed(np.array([1 + j * len(parts[1]) + o], np.uint64)))
            yield int(own.view(np.int64)[0]), np.union1d(part, some)


def walked(
    node: np.uint64, signs: np.ndarray, labels: np.ndarray, second: int, leaf: int, block: int, levels: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(block, rows) at the ends of a node's branches: small nodes, and nodes with few rows outside their largest
    group; nodes of one label have no links to find. Rows that do not part are all compared instead."""
    whole, seen, steps = np.arange(len(labels)), set(), 0
    ahead = [(node, whole, 1)]
    while ahead:
        node, rows, level = ahead.pop()
        names, counts = np.unique(labels[rows], return_counts=True)
        if len(names) == 1:
            continue
        opened = rows[labels[rows] != names[counts.argmax()]]
        if len(rows) <= leaf:
            if (key := rows.tobytes()) not in seen:
                seen.add(key)
                yield int(np.array([node]).view(np.int64)[0]), rows
        elif len(opened) <= block or level == levels:
            yield from met_blocks(node, rows, opened, block)
        elif (steps := steps + len(rows)) > WALKED_TIMES * len(whole):
            names, counts = np.unique(labels, return_counts=True)
            yield from met_blocks(node, whole, whole[labels != names[counts.argmax()]], block)
            return
        else:
            for chosen, children in child_nodes(np.full(len(rows), node), signs[rows], second):
                order = np.argsort(children, kind="stable")
                ends = np.flatnonzero(np.diff(children[order])) + 1
                for part in np.split(order, ends):
                    if len(part) > 1:
                        ahead.append((children[part[0]], rows[chosen[part]], level + 1))


def walking(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (node, doc, sign, label) of whole nodes to the (block, doc) that look like a document of another label
    at the ends of their branches."""
    least, limits = least_estimate(similarity), (second_share(similarity), LEAF, BLOCK, LEVELS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_blocks(batches):
            docs = table.column(1).to_numpy()
            order = np.argsort(docs)
            docs, labels = docs[order], table.column(3).to_numpy()[order]
            signs = stacked(table.column(2).combine_chunks(), np.uint8)[order]
            node = table.column(0).to_numpy().view(np.uint64)[0]
            for block, rows in walked(node, signs, labels, *limits):
                if (found := open_batch(block, docs[rows], signs[rows], labels[rows], least)) is not None:
                    yield found

    return walk


def confirming(words: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (block, doc, label, text) to a forest of links (a, b) that hold on the full sets."""
    least, percent = least_estimate(similarity), round(similarity * 100)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        out: list[tuple[int, int]] = []
        for table in sorted_blocks(batches):
            docs, labels = table.column(1).to_pylist(), table.column(2).to_pylist()
            sets = [shingle(t) for t in table.column(3).cast(pa.binary()).to_pylist()]
            signs = np.array([signature(minwise(s)) for s in sets])
            forest = Forest()
            for a, label in zip(docs, labels):
                forest.join(("doc", a), ("as", label))
            for i, j in zip(*alike(signs, least)):
                a, b = docs[i], docs[j]
                if forest.root(("doc", a)) == forest.root(("doc", b)):
                    continue
                x, y = sets[i], sets[j]
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    forest.join(("doc", a), ("doc", b))
                    out.append((min(a, b), max(a, b)))
            if len(out) > 50_000:
                yield edge_batch(out, ["a", "b"])
                out = []
        if out:
            yield edge_batch(out, ["a", "b"])

    return confirm


def by_block(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    return rows.repartition(*([tasks] if tasks else []), "block").sortWithinPartitions("block")


def confirmed(needs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links among the documents of each block of ``needs`` (block, doc, label)."""
    rows = needs.hint("merge").join(texts, "doc").select("block", "doc", "label", "text")
    return by_block(rows).mapInArrow(confirming(words, similarity), "a bigint, b bigint")


def small_blocks_once(needs: DataFrame) -> DataFrame:
    """Blocks with the same documents count once."""
    marks = [F.sum(F.shiftright(F.xxhash64("doc", F.lit(i)), 24)).alias(f"x{i}") for i in range(2)]
    sets = needs.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *marks)
    return needs.join(sets.groupBy("n", "x0", "x1").agg(F.min("block").alias("block")).select("block"), "block")


def open_counts(large: DataFrame) -> DataFrame:
    """``node, most, n, n_open`` of nodes with more than one label: the most frequent one and how many
    documents have another."""
    counts = large.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("node").agg(
        F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("n"),
        (F.sum("c") - F.max("c")).alias("n_open"),
    ).where("n_open > 0")


def torn_nodes(members: DataFrame) -> DataFrame:
    """``node, doc, label, most, n, n_open`` of nodes with more than one label, the others have no links to find; small
    nodes with the same documents count once."""
    marks = {f"x{i}": F.shiftright(F.xxhash64("doc", F.lit(i)), 24) for i in range(2)}
    each = members.groupBy("node", "label").agg(
        F.count(F.lit(1)).alias("c"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), *[F.sum(m).alias(x) for x, m in marks.items()])
    sizes = each.groupBy("node").agg(
        F.max_by("label", F.struct("c", "label")).alias("most"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("n_open"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(x).alias(x) for x in marks],
    ).where("n_open > 0").withColumn("own", F.when(F.col("n") > LEAF, F.col("node")))
    same = ["n", "n_open", "most", "lo", "hi", *marks, "own"]
    once = sizes.groupBy(*same).agg(F.min("node").alias("node")).select("node", "most", "n", "n_open")
    return members.join(once, "node")


def large_blocks(nodes: DataFrame) -> DataFrame:
    """``block, doc, label`` in which every document of a large node (node, doc, label, most, n, n_open) that has
    not the node's most frequent label meets every other document of the node."""
    rows = nodes.withColumns({"k": F.ceil(F.col("n") / BLOCK), "ko": F.ceil(F.col("n_open") / BLOCK)})
    own = F.pmod(F.xxhash64("doc", "node"), F.col("k"))
    own_open = F.pmod(F.xxhash64("doc", "node"), F.col("ko"))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    met = rows.select("node", "doc", "label", own.alias("j"), F.explode(every(F.col("ko"))).alias("o"))
    opened = rows.where("label <> most").select(
        "node", "doc", "label", F.explode(every(F.col("k"))).alias("j"), own_open.alias("o"),
    )
    return met.union(opened).distinct().select(F.xxhash64("node", "j", "o").alias("block"), "doc", "label")


def torn_blocks(rows: DataFrame) -> DataFrame:
    """``block, doc, label`` of the blocks with more than one label."""
    torn = rows.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return rows.join(torn.select("block"), "block", "left_semi").select("block", "doc", "label")


def unlinked_blocks(large: DataFrame, labels: DataFrame, signs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """What large nodes hold besides one group: documents outside a node's largest group meet all of it, in nodes
    with more of them than a block after branching again. ``block, doc, label`` of blocks to be compared, and ``node, doc,
    label`` of the nodes to be walked in one task each."""
    rows = large.join(labels, "doc").select("node", "doc", "label")
    wide = written(rows, "large-nodes")
    wide = written(wide.join(open_counts(wide), "node"), "nodes")
    few, small = F.col("n_open") <= BLOCK, F.col("n") <= WALKED
    ends, blocks = [wide.where(small)], [written(large_blocks(wide.where(few & ~small)), "blocks")]
    wide = wide.where(~few & ~small)
    for level in range(2, LEVELS + 1):
        if wide.isEmpty():
            break
        signed = wide.join(signs, "doc").select("node", "doc", "sign", "label")
        below = written(signed.mapInArrow(branching(similarity), "node bigint, doc bigint, label bigint"), "nodes")
        children = written(torn_nodes(below), "nodes")
        ends.append(children.where(small))
        last = F.lit(level == LEVELS)
        blocks.append(written(large_blocks(children.where(~small & (few | last))), "blocks"))
        wide = children.where(~small & ~few & ~last)
    return reduce(DataFrame.union, blocks), reduce(DataFrame.union, [e.select("node", "doc", "label") for e in ends])


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    ``component_id`` is the smallest id reachable over links of at least ``similarity`` (a multiple of
    0.01) between shingle sets of ``words`` words; ``kept`` marks that document itself. Shorter texts
    are one shingle, texts without words (null, empty, blank) are linked with nothing. Rows that repeat
    an id count as one document with the links of all of them; a row with a null id joins only the
    group of its own equal set, and is its own when no row of that set has an id. An empty table gives
    no rows, other columns are not looked at, and no text is cut.
    """
    return marked_groups(docs, id_col, text_col, words, similarity).drop("mark")


def text_mark(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def marked_groups(docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``near_groups`` with the ``mark`` of each row's text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(rows.select("*", text_mark(F.col("text")).alias("mark")).mapInArrow(
        sketcher(words), "doc_id bigint, mark binary, n bigint, digest binary, roots binary, sign binary"), "sketches")
    equal = sketches.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"))
    sets = written(
        sketches.join(equal.where("doc is not null"), "digest").where("doc_id = doc")
        .groupBy("doc", "digest").agg(F.first("roots").alias("roots"), F.first("sign").alias("sign")), "sets"
    )
    signs = sets.select("doc", "sign")

    nodes = written(shared_nodes(sets.select("doc", "roots").mapInArrow(at_roots, "node bigint, doc bigint")), "nodes")
    few = nodes.where(F.col("n") <= LEAF).select(F.col("node").alias("block"), "doc")
    large = nodes.where(F.col("n") > LEAF).select("node", "doc", "n")
    dealt = F.pmod(F.xxhash64("doc", "node"), F.ceil(F.col("n") / BLOCK))
    leaves = few.union(large.select(F.xxhash64("node", dealt).alias("block"), "doc"))

    alike_rows = by_block(leaves.join(signs, "doc").select("block", "doc", "sign"))
    pairs = written(alike_rows.mapInArrow(candidates(similarity), "block bigint, a bigint, b bigint"), "pairs")
    once = pairs.groupBy("a", "b").agg(F.min("block").alias("block"))
    needs = once.select("block", F.explode(F.array("a", "b")).alias("doc")).distinct()
    looked_at = needs.select("doc").union(large.select("doc")).distinct()
    texts = written(rows.withColumnRenamed("doc_id", "doc").join(looked_at.hint("merge"), "doc", "left_semi"), "texts")
    links = written(confirmed(needs.withColumn("label", F.col("doc")), texts, words, similarity), "links")
    roots = components(links)

    # blocks in which a pair that looked similar is not linked: other pairs of theirs may be
    labels = looked_at.join(roots, F.col("doc") == F.col("member"), "left").select(
        "doc", F.coalesce("root", "doc").alias("label"))
    labels = written(labels, "labels")
    ends = [labels.select(F.col("doc").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab"]
    failed = pairs.join(ends[0], "a").join(ends[1], "b").where("label_a <> label_b").select("block").distinct()
    mine = few.join(failed, "block", "left_semi").join(labels.join(needs.select("doc").distinct(), "doc", "left_semi"), "doc")
    blocks, walks = unlinked_blocks(large, labels, signs, similarity)
    again = torn_blocks(mine.select("block", "doc", "label")).union(blocks)
    tasks = 1 + 4 * walks.count() // WALKED  # given, as a walk takes longer than the bytes it reads tell
    looks = [
        by_block(r.join(signs, "doc").select("block", "doc", "sign", "label"), n).mapInArrow(how(similarity), "block bigint, doc bigint")
        for r, how, n in ((again, unlinked, None), (walks.withColumnRenamed("node", "block"), walking, tasks))
    ]
    rest = written(looks[0].union(looks[1]), "rest")
    if not rest.isEmpty():
        more = written(confirmed(small_blocks_once(rest).join(labels, "doc"), texts, words, similarity), "links")
        roots = components(links.union(more))

    own = sketches.select("doc_id", "mark", "n", "digest").join(equal, "digest", "left")
    out = own.join(roots, F.col("doc") == F.col("member"), "left")
    reached = F.when(F.col("n") > 0, F.coalesce("root", "doc")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), reached.alias("component_id"),
        F.col("doc_id").eqNullSafe(reached).alias("kept"), "mark",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group with all its columns (see ``near_groups``).

    Of rows that share the id that stays, the one with the smallest digest of its text; of rows with a null id
    that belong to no group of rows with one, one for each text. No rows of an empty table.
    """
    kept = marked_groups(docs, id_col, text_col, **how).where("kept").select("doc_id", "mark").distinct().hint("merge")
    ours = docs[id_col].eqNullSafe(kept["doc_id"]) & (text_mark(docs[text_col]) == kept["mark"])
    stays = docs.join(kept, ours, "left_semi")
    row, mark = F.struct(*[stays[c] for c in docs.columns]).alias("row"), text_mark(stays[text_col]).alias("mark")
    one = Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("mark"))).orderBy("mark")
    first = stays.select(row, stays[id_col].alias("id"), mark).withColumn("place", F.row_number().over(one)).where("place = 1")
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
