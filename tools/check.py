"""Compare registered queries with their SQL in DuckDB: python tools/check.py FOLDER [name ...]"""

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from termindex.plans.oracle import SQL  # noqa: E402
from termindex.plans.registered import QUERIES  # noqa: E402
from termindex.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark, connection, folder, name):
    df = QUERIES[name](spark, folder)
    ours = rows_of(df.columns, [tuple(row) for row in df.toLocalIterator()])
    result = connection.execute(SQL[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    kinds = {d[0]: str(d[1]) for d in result.description}
    return df, sorted(columns) == sorted(df.columns), ours, theirs, kinds


if __name__ == "__main__":
    folder, *names = sys.argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            df, same_columns, ours, theirs, kinds = compare(spark, connection, folder, name)
            same = same_columns and ours == theirs
            print(f"{'ok  ' if same else 'DIFF'} {name:26s} {sum(ours.values()):8d} {sum(theirs.values()):8d} "
                  f"{time.time() - begin:6.2f} s", flush=True)
            ours_kinds = {n: t for n, t in df.dtypes}
            pairs = {n: (ours_kinds.get(n), kinds[n]) for n in kinds}
            known = {("bigint", "BIGINT"), ("int", "INTEGER"), ("string", "VARCHAR"), ("boolean", "BOOLEAN")}
            if any(p not in known for p in pairs.values()):
                print("     types:", {n: p for n, p in pairs.items() if p not in known})
            if not same:
                bad += 1
                print("     only ours  :", [str(x)[:300] for x in list((ours - theirs))[:3]])
                print("     only theirs:", [str(x)[:300] for x in list((theirs - ours))[:3]])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name} {str(error)[:900]}", flush=True)
    print("differences:", bad)
