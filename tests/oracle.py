"""Runs a registered query on Spark and its SQL twin on DuckDB and compares every value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, query, sf_dir, show=3):
    """Empty string when equal, else a description of the first differences."""
    df = query(spark, sf_dir)
    sn, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(query.oracle)
    dn, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sn != dn:
        return f"columns differ: spark {sn} duckdb {dn}"
    if len(sr) != len(dr):
        a, b = set(sr), set(dr)
        return f"rows {len(sr)} vs {len(dr)}; only spark {list(a - b)[:show]}; only duckdb {list(b - a)[:show]}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, columns {sn}: " + " | ".join(f"{a} <> {b}" for a, b in bad[:show])
    return ""


def main(sf="/root/testdata/sf0.001", only=None):
    import time

    from tickloom.plans.catalog import QUERIES
    from tickloom.session import local_session
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name, q in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            if q.oracle is None:
                n = q(spark, sf).count()
                msg = f"rows-only {n}"
            else:
                msg = compare(spark, con, q, sf)
                if not msg:
                    msg = "ok " + str(con.execute(f"select count(*) from ({q.oracle})").fetchall()[0][0])
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e).split("JVM stacktrace")[0][:700]
        print(f"{name:40s} {time.time() - t:6.2f}s {msg}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:] or None)
