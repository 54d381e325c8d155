"""Run registered queries against their SQL twins: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.astype(object).itertuples(index=False, name=None):
        rows.append(tuple(None if pd.isna(v) else (float(v) + 0.0 if isinstance(v, float) else v) for v in row))
    return sorted(rows, key=repr)


def differences(spark, sf_dir: str, query, sql: str) -> list[str]:
    df = query(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    problems = []
    spark_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if spark_types != duck_types:
        problems.append(f"schema {set(spark_types.items()) ^ set(duck_types.items())}")
        return problems
    ours = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    a, b = canonical(ours), canonical(rel.df().convert_dtypes(convert_floating=False, convert_integer=True))
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    if not a:
        problems.append("no rows")
    return problems


def main() -> None:
    from tallyward.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        start = time.time()
        try:
            if name in sqls:
                found = differences(spark, sf_dir, queries[name], sqls[name])
                state = "ok" if not found else "DIFF " + "; ".join(found)
            else:
                state = f"rows {len(queries[name](spark, sf_dir).collect())}"
        except Exception as e:  # report and go on with the next query
            state = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"@ {name} {time.time() - start:.1f}s {state}", flush=True)


if __name__ == "__main__":
    main()
