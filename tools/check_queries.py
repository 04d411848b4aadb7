"""Compare every registered query with its SQL on DuckDB: python tools/check_queries.py [sf] [name ...]"""
import sys, time, math, os
import duckdb
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from factrail.session import build_session
import importlib
entry = importlib.import_module("__spark_entry__")
sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
names = sys.argv[2:]
d = f"/root/testdata/sf{sf}"
spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
con = duckdb.connect()
for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
    con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "asDict"): return str(tuple(norm(x) for x in v))
    if isinstance(v, dict): return str(tuple(norm(x) for x in v.values()))
    if isinstance(v, (list, tuple)): return str(tuple(norm(x) for x in v))
    return str(v)
Q, O = entry.queries(), entry.oracle_sql()
bad = []
for n in Q:
    if names and not any(n == x or n.startswith(x) for x in names): continue
    t = time.time()
    try:
        df = Q[n](spark, d); cols = sorted(df.columns)
        rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    except Exception as e:
        print(f"FAIL {n}: spark {type(e).__name__}: {str(e)[:1500]}"); bad.append(n); continue
    ts = time.time() - t
    if n not in O:
        print(f"rows {n}: {len(rows)} rows {ts:.1f}s (no SQL)"); 
        if names: print(rows[:5])
        if not rows: bad.append(n)
        continue
    t = time.time()
    try:
        cur = con.execute(O[n]); oc = [x[0] for x in cur.description]; data = cur.fetchall(); types=[x[1] for x in cur.description]
    except Exception as e:
        print(f"FAIL {n}: duckdb {str(e)[:1500]}"); bad.append(n); continue
    td = time.time() - t
    if sorted(oc) != cols:
        print(f"FAIL {n}: columns {cols} vs {sorted(oc)}"); bad.append(n); continue
    idx = [oc.index(c) for c in cols]
    orows = sorted(tuple(norm(r[i]) for i in idx) for r in data)
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ty = {"bigint":"BIGINT","double":"DOUBLE","string":"VARCHAR","boolean":"BOOLEAN","int":"INTEGER"}
    tm = [(c, st[c], str(types[oc.index(c)])) for c in cols if ty.get(st[c], st[c]) != str(types[oc.index(c)])]
    if sorted(rows) != orows or not rows:
        print(f"FAIL {n}: rows {len(rows)} vs {len(orows)} types {tm}")
        a, b = set(rows) - set(orows), set(orows) - set(rows)
        print("  cols", cols); print("  spark only", sorted(a)[:4]); print("  sql only  ", sorted(b)[:4]); bad.append(n)
    else:
        print(f"ok   {n}: {len(rows)} rows spark {ts:.1f}s duckdb {td:.1f}s {tm or ''}")
print("BAD", bad)
