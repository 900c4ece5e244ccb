"""Run registered queries next to their SQL twins: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return plain(value.item())
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


KINDS = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
         "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, build, sql: str) -> str:
    """Empty text when rows, names and values agree; otherwise what differs."""
    frame = build(spark, sf_dir)
    mine, my_names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs, their_names = rows_of([d[0] for d in result.description], result.fetchall())
    if my_names != their_names:
        return f"columns {my_names} != {their_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}: {[r for r in mine if r not in set(theirs)][:2]} | {[r for r in theirs if r not in set(mine)][:2]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"value {my_names}: {a} != {b}"
    odd = [f"{n}:{k}/{kinds[n]}" for n, k in frame.dtypes if KINDS.get(k, kinds[n]) != kinds[n]]
    return ("TYPES " + " ".join(odd)) if odd else ""


def main():
    from arborlake.session import session
    from arborlake.workload import QUERIES, SQL

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, build in QUERIES.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        begin = time.time()
        try:
            if name in SQL:
                note = compare(spark, con, sf_dir, build, SQL[name])
            else:
                frame = build(spark, sf_dir)
                note = f"(no twin) {frame.count()} rows {frame.columns}"
        except Exception as error:  # noqa: BLE001 - a report line per query
            note = f"ERROR {type(error).__name__}: {str(error)[:500]}"
        bad += bool(note) and not note.startswith("(no twin)")
        print(f"{name:28s} {time.time() - begin:6.2f}s {note or 'ok'}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
