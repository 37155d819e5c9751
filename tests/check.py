"""Compare queries with their SQL twins: python tests/check.py SF_DIR [key ...|prefix*]"""
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E
from recset.session import build
from tests import harness as h

sf, pats = sys.argv[1], sys.argv[2:]
spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.structuredLogging.enabled": "false", "spark.driver.memory": "12g"})
spark.sparkContext.setLogLevel("ERROR")
con = h.connect(sf)
Q, S = E.queries(), E.oracle_sql()
keys = [k for k in Q if not pats or any(k == p or (p.endswith("*") and k.startswith(p[:-1])) for p in pats)]
bad = []
for k in keys:
    t0 = time.time()
    try:
        df = Q[k](spark, sf)
        cols, rows = h.spark_rows(df)
        t1 = time.time()
        if k not in S:
            print(f"rows  {k:28s} n={len(rows)} {t1-t0:.1f}s {rows[:1]}", flush=True)
            if not rows:
                bad.append(k)
            continue
        dcols, drows = h.duck_rows(con, S[k])
        t2 = time.time()
        ok = cols == dcols and rows == drows
        ty = h.kinds(df, con, S[k])
        print(f"{'ok   ' if ok else 'DIFF '} {k:28s} n={len(rows)}/{len(drows)} spark={t1-t0:.1f}s duck={t2-t1:.1f}s {ty or ''}", flush=True)
        if not ok or not rows:
            bad.append(k)
            if cols != dcols:
                print("   cols", cols, dcols)
            else:
                sa, sb = set(rows), set(drows)
                print("   spark only", sorted(sa - sb)[:3], "\n   duck only ", sorted(sb - sa)[:3], cols)
    except Exception as e:
        bad.append(k)
        print(f"ERROR {k}: {str(e)[:700]}", flush=True)
        if os.environ.get("TB"):
            traceback.print_exc()
print("BAD", bad, "of", len(keys))
