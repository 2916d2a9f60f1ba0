"""Near-duplicate vectors by product quantisation.

Vectors of one label are dealt into coarse inverted lists; a residual to the list's centre is coded by
one centroid number for each subspace. A vector looks into every list whose boundary to its own list is
within the link radius, so no link is missed, and compares the list's codes with tables of distances of
its own subvectors. A code is passed on when the distance, less the known error of the code, reaches
the radius; those are ranked again by the exact cosine in double precision.

Equal vectors are one row with a count; links leave a block as counts and a spanning forest, so groups
of copies never give all their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_text import sorted_blocks
from .work import components, hash_sample, same, written

SAMPLE = 20_000  # vectors that lists and codes are fitted on
LIST_ROWS = 1_000  # sought rows of a list
LISTS = 1_024
SUBSPACES = 8
CODES = 64
BLOCK = 2_048  # members of a list that one task compares at a time
SLACK = 1e-6


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """At most ``k`` centres of the rows."""
    start = np.unique(x, axis=0)
    rng = np.random.RandomState(seed)
    centres = start[rng.choice(len(start), min(k, len(start)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres and, for each subspace, the centroids of residuals."""

    centres: np.ndarray
    codebooks: tuple[np.ndarray, ...]

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, *[b.shape[1] for b in self.codebooks]]).tolist()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes and the distance of each row to what its code stands for."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.empty((len(x), len(self.codebooks)), np.uint8)
        error = np.zeros(len(x))
        for i, (book, lo, hi) in enumerate(zip(self.codebooks, self.cuts, self.cuts[1:])):
            codes[:, i] = nearest(rest[:, lo:hi], book)
            error += ((rest[:, lo:hi] - book[codes[:, i]]) ** 2).sum(1)
        return own, codes, np.sqrt(error)

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of the subvectors of ``x`` to the centroids, for residuals to one centre."""
        rest = x - self.centres[at]
        return np.stack([
            ((rest[:, None, lo:hi] - book[None]) ** 2).sum(2)
            if len(book) == CODES else
            np.pad(((rest[:, None, lo:hi] - book[None]) ** 2).sum(2), ((0, 0), (0, CODES - len(book))))
            for book, lo, hi in zip(self.codebooks, self.cuts, self.cuts[1:])
        ], axis=1)

    def probes(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that can hold a vector within the radius of each row: the plane half-way between the
        centres of such a list and of the row's own is no farther than the radius."""
        d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)[None, :], 0)
        own = d.argmin(1)
        apart = np.linalg.norm(self.centres[own][:, None, :] - self.centres[None, :, :], axis=2)
        reach = (d - d[np.arange(len(x)), own][:, None]) <= 2 * apart * (radius + SLACK) + SLACK
        return [np.flatnonzero(r) for r in reach]


def fit_quantiser(sample: np.ndarray, rows: int, list_rows: int = LIST_ROWS) -> Quantiser:
    """Lists for about ``list_rows`` rows each, and codes of their residuals."""
    lists = int(np.clip(rows // list_rows, 1, min(LISTS, max(1, len(sample) // 8))))
    centres = k_means(sample, lists)
    rest = sample - centres[nearest(sample, centres)]
    cuts = np.unique(np.linspace(0, sample.shape[1], SUBSPACES + 1).astype(int))
    return Quantiser(centres, tuple(k_means(rest[:, lo:hi], CODES) for lo, hi in zip(cuts, cuts[1:])))


def packing_rows(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(vec, label, list of numbers) to the numbers as bytes; null, empty, zero and not finite ones to null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column(2).to_pylist():
                if not values or None in values:
                    out.append(None)
                    continue
                x = np.array(values, kind)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vector"]
            )

    return pack


def numbers(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of vectors of one dimension, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def dealing(
    fitted: dict[int, Quantiser], radius: float, kind: str,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(class, vec, copies, size, vector) to the list a vector lies in, with its code, and those it looks into."""
    schema = pa.schema([
        ("class", pa.int64()), ("size", pa.int64()), ("list", pa.int64()), ("vec", pa.int64()), ("copies", pa.int64()),
        ("asks", pa.bool_()), ("vector", pa.binary()), ("codes", pa.binary()), ("error", pa.float64()),
    ])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes):
                part, q = batch.take(pa.array(np.flatnonzero(sizes == size))), fitted[int(size)]
                x = unit_rows(numbers(part.column(4), kind))
                own, codes, error = q.encode(x)
                probes = q.probes(x, radius)
                n = part.num_rows
                at = np.concatenate([np.arange(n), np.repeat(np.arange(n), [len(p) for p in probes])])
                rows = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(3), pa.array(np.concatenate([own, *probes])), rows.column(1), rows.column(2),
                    pa.array(np.arange(len(at)) >= n), rows.column(4),
                    pa.array([c.tobytes() for c in codes] + [None] * (len(at) - n), pa.binary()),
                    pa.array(np.concatenate([error, np.zeros(len(at) - n)])),
                ], schema=schema)

    return deal


def comparing(
    fitted: dict[int, Quantiser], cosine: float, kind: str,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted blocks of members and asking vectors to (a, b, n): links of a found here, and a forest of links."""
    radius = (2 - 2 * cosine) ** 0.5

    def links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Asking and member rows of links, for one list of one class."""
        size, at = table.column("size")[0].as_py(), table.column("list")[0].as_py()
        q, asks = fitted[size], table.column("asks").to_numpy()
        x = numbers(table.column("vector").combine_chunks(), kind)
        length = np.linalg.norm(x, axis=1)
        askers, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(askers) or not len(members):
            return
        codes = np.frombuffer(b"".join(table.column("codes").combine_chunks().take(pa.array(members)).to_pylist()), np.uint8)
        codes = codes.reshape(len(members), -1)
        bound = table.column("error").to_numpy()[members] + radius + SLACK
        for start in range(0, len(askers), 128):
            rows = askers[start : start + 128]
            tables = q.tables(x[rows] / length[rows, None], at)
            squared = sum(tables[:, s, :][:, codes[:, s]] for s in range(codes.shape[1]))
            i, j = np.nonzero(np.sqrt(np.maximum(squared, 0)) <= bound[None, :])
            a, b = rows[i], members[j]
            exact = np.einsum("ij,ij->i", x[a], x[b]) / (length[a] * length[b])
            yield a[exact >= cosine], b[exact >= cosine]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_blocks(batches):
            keys = block.column("class").to_numpy() * 1_000_003 + block.column("list").to_numpy()
            for key in np.unique(keys):  # more than one only where block numbers clash
                table = block.filter(pa.array(keys == key))
                ids, copies = table.column("vec").to_numpy(), table.column("copies").to_numpy()
                vertices, own = np.unique(ids, return_inverse=True)
                label = np.arange(len(vertices))
                counts: dict[int, int] = {}
                forest: list[tuple[int, int, int]] = []
                for a, b in links(table):
                    other = ids[a] != ids[b]
                    a, b = a[other], b[other]
                    for row in np.unique(a):
                        met = b[a == row]
                        counts[int(ids[row])] = counts.get(int(ids[row]), 0) + int(copies[met].sum())
                        joined = np.unique(label[np.append(own[met], own[row])])
                        if len(joined) > 1:
                            forest += [(int(vertices[joined[0]]), int(vertices[k]), 0) for k in joined[1:]]
                            label[np.isin(label, joined)] = joined[0]
                rows = [(v, v, n) for v, n in counts.items()] + forest
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "n"])

    return compare


def blocks_of(dealt: DataFrame, block_rows: int) -> DataFrame:
    """Adds ``block``: the members of a list in blocks, its asking vectors in parts, every part with every block."""
    keys = ["class", "list"]
    counts = dealt.groupBy(*keys).agg(
        F.ceil(F.sum(F.when(F.col("asks"), 0).otherwise(1)) / block_rows).alias("k"),
        F.ceil(F.sum(F.when(F.col("asks"), 1).otherwise(0)) / (4 * block_rows)).alias("ka"),
    ).where("k > 0 and ka > 0")
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    own = F.pmod(F.xxhash64("vec", "list"), F.when(F.col("asks"), F.col("ka")).otherwise(F.col("k")))
    rows = dealt.join(counts, keys).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.when(F.col("asks"), every(F.col("k"))).otherwise(every(F.col("ka")))))
    j = F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))
    o = F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    return rows.select(F.xxhash64(*keys, j, o).alias("block"), *dealt.columns)


def vector_groups(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", sample: int = SAMPLE, list_rows: int = LIST_ROWS, block_rows: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors are compared inside a label and a dimension. Links have a cosine of at least ``cosine``;
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable.
    Null, empty or zero vectors, those with null or not finite numbers, and null labels link with
    nothing. Rows with a null id are counted as links of equal vectors only; rows that repeat an id
    count as one vector with the links of all. Codes are fitted on ``sample`` distinct vectors chosen
    by hash; the index holds every vector and its bounds lose none. Other columns are not looked at.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    label = vectors.schema[label_col].dataType.simpleString()
    picked = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), vector_col)
    rows = written(picked.mapInArrow(packing_rows(kind), f"vec_id bigint, label {label}, vector binary"), "vectors")
    compared = rows.where("vector is not null and label is not null")
    distinct = compared.groupBy("label", "vector").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies"))
    distinct = written(distinct, "distinct")
    own = distinct.where("vec is not null").select(
        F.xxhash64("label", F.octet_length("vector")).alias("class"), "vec", "copies",
        F.expr(f"cast(octet_length(vector) div {kind[-1]} as bigint)").alias("size"), "vector",
    )
    largest = own.groupBy("size", "class").count().groupBy("size").agg(F.max("count").alias("n")).collect()
    taken = hash_sample(own.select("vec", "size", "vector"), sample, "vec", "vector").select("size", "vector").collect()
    fitted = {}
    for size, n in ((r["size"], r["n"]) for r in largest):
        mine = [np.frombuffer(r["vector"], kind) for r in taken if r["size"] == size] or [np.ones(size)]
        fitted[size] = fit_quantiser(unit_rows(np.array(mine, np.float64)), n, list_rows)
    radius = (2 - 2 * cosine) ** 0.5
    dealt = own.mapInArrow(
        dealing(fitted, radius, kind),
        "class bigint, size bigint, list bigint, vec bigint, copies bigint, asks boolean, vector binary, codes binary, error double",
    )
    blocks = blocks_of(dealt, block_rows).repartition("block").sortWithinPartitions("block")
    found = written(blocks.mapInArrow(comparing(fitted, cosine, kind), "a bigint, b bigint, n bigint"), "links")
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(found.where("a <> b"))

    of = rows.join(distinct, same(rows, distinct, ["label", "vector"]), "left").select(rows["vec_id"], "vec", "copies")
    of = of.join(counts, F.col("vec") == F.col("a"), "left").join(roots, F.col("vec") == F.col("member"), "left")
    reached = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.coalesce("root", "vec"))
    return of.select(
        "vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"),
        reached.alias("component_id"), F.col("vec_id").eqNullSafe(reached).alias("kept"),
    )
