"""Run every query beside its SQL twin and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, otherwise a short description of the difference."""
    cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    dcols, theirs = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != dcols:
        return f"columns {cols} != {dcols}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        a, b = bad[0]
        return f"{len(bad)} rows differ, first: " + str([(c, x, y) for c, x, y in zip(cols, a, b) if x != y][:4])
    return None if mine else "EMPTY"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tidewatch.runtime import session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = argv or list(queries())
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    todo, sqls = queries(), oracle_sql()
    for name in names:
        t0 = time.time()
        try:
            df = todo[name](spark, sf)
            if name in sqls:
                verdict = compare(df, con, sqls[name])
            else:
                n = df.count()
                verdict = None if n else "EMPTY"
        except Exception as e:  # report and go on with the next query
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        if verdict:
            bad += 1
        print(f"{'ok ' if not verdict else 'BAD'} {time.time() - t0:6.2f}s {name} {'' if name in sqls else '(rows only)'} {verdict or ''}", flush=True)
    print("bad:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
