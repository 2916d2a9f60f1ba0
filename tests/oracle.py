"""Runs a query in Spark and its oracle in DuckDB and compares names, counts and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(cell(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), cell(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def table(columns, rows):
    names = sorted(columns)
    at = [list(columns).index(n) for n in names]
    return names, sorted((tuple(cell(r[i]) for i in at) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_names, got = table(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    if not got:
        return "both empty"
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0][0]} vs {bad[0][1]}"
    return None


def main(argv: list[str]) -> int:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from capturelens.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(sf_dir), queries(), oracle_sql()
    picked = [q for q in qs if not argv or any(q.startswith(a) for a in argv)]
    failed = 0
    for name in picked:
        t0 = time.time()
        try:
            if name in sqls:
                note = compare(qs[name](spark, sf_dir), con, sqls[name])
            else:
                rows = qs[name](spark, sf_dir).collect()
                note = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += note is not None
        mark = "ok  " if note is None else "FAIL"
        print(f"{mark} {name} {time.time() - t0:.2f}s {'' if name in sqls else '(rows)'} {note or ''}", flush=True)
    print(f"{len(picked) - failed} of {len(picked)} pass")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
