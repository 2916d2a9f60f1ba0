"""Near-duplicate vectors against exact cosines of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from capturelens.llm.near_vectors import fit_quantiser, unit_rows, vector_groups

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, n bigint"


def brute(rows, cosine=0.98):
    """{row number: (links, component)} from exact double cosines."""
    out, root = {}, {}
    fine = [
        k for k, (i, v, x, *_) in enumerate(rows)
        if v and x is not None and None not in v and np.isfinite(np.array(v, "<f4")).all() and np.array(v, "<f4").any()
    ]
    units = {k: np.array(rows[k][1], "<f4").astype(float) for k in fine}

    def top(k):
        while root.get(k, k) != k:
            k = root[k]
        return k

    links = dict.fromkeys(range(len(rows)), 0)
    for n, a in enumerate(fine):
        for b in fine[n + 1 :]:
            x, y = units[a], units[b]
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a], links[b] = links[a] + 1, links[b] + 1
                p, q = sorted((top(a), top(b)), key=lambda k: rows[k][0])
                root[q] = p
    for k, row in enumerate(rows):
        out[row[0]] = (links[k], rows[top(k)][0])
    return out


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_given_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    assert result(vector_groups(table)) == brute(rows)


@pytest.mark.parametrize("list_rows,block_rows", [(10, 7), (1000, 2048)])
def test_groups_over_many_lists_and_blocks(spark, list_rows, block_rows):
    rng = np.random.RandomState(4)
    rows = []
    for size, noise in ((60, 0.02), (30, 0.03), (5, 0.01), (40, 0.5), (2, 0.0)):
        base = rng.normal(size=16)
        rows += [(base + noise * rng.normal(size=16)).astype("<f4").tolist() for _ in range(size)]
    rows += [list(rows[0])] * 25 + rng.normal(size=(40, 16)).astype("<f4").tolist()
    order = rng.permutation(len(rows))
    rows = [(int(i), rows[i], int(i) % 2, "x", 1) for i in order]
    got = vector_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), list_rows=list_rows, block_rows=block_rows)
    assert result(got) == brute(rows)


def test_nulls_and_odd_vectors(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, one, 0, "x", 1), (2, [2.0, 4.0, 6.0], 0, "x", 1), (3, one, 1, "x", 1), (4, one, None, "x", 1), (5, None, 0, "x", 1),
        (6, [], 0, "x", 1), (7, [0.0, 0.0, 0.0], 0, "x", 1), (8, [1.0, None, 3.0], 0, "x", 1), (9, [nan, 1.0, 1.0], 0, "x", 1),
        (10, [inf, 1.0, 1.0], 0, "x", 1), (11, [1.0, 2.0], 0, "x", 1), (12, one, 0, "x", 1),
    ]
    got = vector_groups(spark.createDataFrame(rows, SCHEMA))
    want = brute(rows)
    assert result(got) == want and want[1] == (2, 1) and want[4] == (0, 4)
    assert {r["vec_id"] for r in got.where("kept").collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    again = vector_groups(spark.createDataFrame([*rows, (None, one, 0, "x", 1), (None, [9.0], 3, "x", 1)], SCHEMA)).collect()
    assert [(r["n_links"], r["component_id"]) for r in again if r["vec_id"] == 1] == [(3, 1)]
    assert sorted(r["n_links"] for r in again if r["vec_id"] is None) == [0, 3]
    assert vector_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_lose_no_list_or_code():
    rng = np.random.RandomState(9)
    x = unit_rows(rng.normal(size=(600, 12)))
    near = unit_rows(x + rng.normal(size=x.shape) * 0.2 / np.sqrt(12) * 0.9)
    q = fit_quantiser(x, 20_000)
    own, codes, error = q.encode(near)
    for i, lists in enumerate(q.probes(x, 0.2)):
        if np.linalg.norm(x[i] - near[i]) <= 0.2:
            assert own[i] in lists
            table = q.tables(x[i : i + 1], own[i])[0]
            estimate = np.sqrt(sum(table[s, codes[i, s]] for s in range(codes.shape[1])))
            assert estimate - error[i] <= 0.2 + 1e-9
