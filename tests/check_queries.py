"""Compares registered queries with their SQL: check_queries.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftkit import queries as Q  # noqa: E402
from driftkit.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "driftkit-check", spark__master="local[8]", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = Q.oracle_sql()
    bad = 0
    for name, fn in Q.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = compare(name, spark, con, sf_dir, fn, sqls[name])
                note = f"{len(con.sql(sqls[name]).fetchall())} rows"
            else:
                problems, note = [], f"no SQL, {fn(spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{name}: {type(e).__name__} {str(e)[:1500]}"], "failed"
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
        for p in problems:
            print(p)
    print("bad:", bad)


if __name__ == "__main__":
    main()
