"""Compare registered queries with their SQL on DuckDB.

As a script: ``python tests/oracle.py <sf_dir> [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else repr(value + 0.0))
    return (1, repr(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [_key(v) for v in r])


def differences(spark_df, con, sql):
    """Empty string when the query and the SQL agree exactly."""
    mine = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs = normalise([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} vs {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if [_key(v) for v in a] != [_key(v) for v in b]]
    return f"{len(bad)} of {len(mine[1])} rows differ, e.g. {bad[0]}" if bad else ""


def types(spark_df, con, sql):
    spark_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    duck = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    return {c: (t, duck.get(c)) for c, t in spark_types.items() if same.get(t) != duck.get(c)}


if __name__ == "__main__":
    from hearthmap.registry.spark_queries import QUERIES
    from hearthmap.registry.sql import ORACLE
    from hearthmap.session import local_session

    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf)
    good = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            if name in ORACLE:
                t1 = time.time()
                result = differences(df, con, ORACLE[name])
                mismatch = types(df, con, ORACLE[name])
                if mismatch:
                    result += f" TYPES {mismatch}"
            else:
                result, rows = "", df.collect()
                print(f"   {name}: {len(rows)} rows, e.g. {rows[:1]}"[:300])
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        good += not result
        print(f"{'ok ' if not result else 'BAD'} {name} {time.time() - start:.1f}s {result}", flush=True)
    print(good, "of", len(names))
