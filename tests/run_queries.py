"""Run named queries (all by default) against DuckDB: run_queries.py [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tablework.session import build_session  # noqa: E402
from tests import oracle  # noqa: E402

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")

if __name__ == "__main__":
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(SF)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, SF)
            if name in sqls:
                problems = oracle.compare(df, con, sqls[name])
                note = f"{len(df.columns)} columns"
            else:
                rows, problems = df.count(), []
                note = f"{rows} rows (no SQL)"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for line in problems:
            print("     ", line[:2500])
        bad += [name] if problems else []
    print(f"{len(bad)} failing: {bad}")
