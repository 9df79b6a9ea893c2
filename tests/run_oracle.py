"""Compare every registered query with its SQL twin: python tests/run_oracle.py [sf_dir] [names...]"""
import os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from oracle_harness import compare
from probelab.session import local_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = local_session()
qs, sql = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if only and name not in only:
        continue
    t = time.time()
    if name not in sql:
        n = fn(spark, sf).count()
        print(f"{name:24s} rows-only {n} rows {time.time()-t:.1f}s", flush=True)
        continue
    try:
        problems, n = compare(spark, name, fn, sql[name], sf)
    except Exception as e:  # noqa
        problems, n = [f"error {type(e).__name__}: {str(e)[:600]}"], -1
    bad += bool(problems)
    print(f"{name:24s} {'OK ' if not problems else 'BAD'} {n} rows {time.time()-t:.1f}s {problems}", flush=True)
print("mismatches:", bad)
