"""Compare registered queries with their SQL: names, types, rows and values."""

from __future__ import annotations

import sys
import time

import duckdb

from strandline.fixtures import GIVEN

ALIKE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def duck(sf_dir):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def difference(spark, con, sf_dir, query, sql):
    """None if both agree, else what differs; and the number of rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(([r[c] for c in names] for r in df.collect()), key=repr)
    cur = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cur.description}
    if sorted(described) != names:
        return f"columns {names} against {sorted(described)}", len(ours)
    place = [list(described).index(c) for c in names]
    theirs = sorted(([r[i] for i in place] for r in cur.fetchall()), key=repr)
    types = {f.name: ALIKE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    odd = {c: (types[c], described[c]) for c in names if types[c] != described[c]}
    if odd:
        return f"types {odd}", len(ours)
    if ours != theirs:
        only = [r for r in ours if r not in theirs][:3], [r for r in theirs if r not in ours][:3]
        return f"{len(ours)} against {len(theirs)} rows; only here {only[0]}; only there {only[1]}", len(ours)
    return None, len(ours)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from strandline.session import get_spark

    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con, sqls = duck(sf_dir), e.oracle_sql()
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        start = time.time()
        try:
            bad, rows = difference(spark, con, sf_dir, query, sqls[name])
        except Exception as error:  # noqa: BLE001
            bad, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        print(f"{'ok ' if bad is None else 'BAD'} {name} {rows} rows {time.time() - start:.1f}s {bad or ''}", flush=True)
