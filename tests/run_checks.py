"""Run registered queries against their SQL: python -m tests.run_checks [root] [name-part ...]"""

import os
import sys
import time

import __spark_entry__ as entry
from tests.oracle import compare, connect
from veilwork import new_session


def main(argv):
    root = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    plain = bool(os.environ.get("PLAIN_SESSION"))  # Spark's own defaults
    spark = new_session(
        master="local[8]",
        **({"spark.ui.showConsoleProgress": "false"} if plain else {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"}),
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = query(spark, root)
            if name in sql:
                problem = compare(df, con, sql[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.1f}s {name} {problem or ''}"[:2500], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
