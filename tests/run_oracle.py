"""python tests/run_oracle.py [sf] [prefix ...]: run registered queries against their SQL."""

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
import oracle  # noqa: E402

from folioflow.session import build_session  # noqa: E402


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("RUN_ROWS"):
        spark.conf.set("spark.folioflow.runRows", os.environ["RUN_ROWS"])
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle.connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if picks and not any(name == p or name.startswith(p + "_") for p in picks):
            continue
        t = time.time()
        try:
            if name in sqls:
                err, n = oracle.check(spark, con, name, fn, sqls[name], sf_dir)
            else:
                err, n = None, len(fn(spark, sf_dir).collect())
        except Exception as e:  # report and go on
            err, n = "".join(traceback.format_exception_only(e))[:1500], 0
        bad += err is not None
        mark = "FAIL" if err else "ok" if name in sqls else "rows"
        print(f"{mark:5}{name:32}{n:8} rows {time.time() - t:6.1f}s {err or ''}", flush=True)
    print("bad:", bad)


main()
