"""Compare registered queries with their SQL in DuckDB: ``python -m wiretally.verify DIR [name ...]``."""

import datetime
import decimal
import math
import sys
import time

import duckdb

from wiretally.fixtures import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        if math.isnan(v) or math.isinf(v):
            return str(v)
        return round(v, 6) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def compare(df, con, sql):
    names = sorted(df.columns)
    got = [tuple(_norm(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    idx = [cols.index(n) for n in names]
    want = [tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()]
    key = lambda row: tuple((x is None, str(type(x)), str(x)) for x in row)
    got.sort(key=key)
    want.sort(key=key)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; {names}; first {got[:1]} vs {want[:1]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{names}: {a} vs {b}"
    plain = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{n}: {plain[n]}/{kinds[n]}" for n in names if pairs.get(plain[n], kinds[n]) not in kinds[n]
           and not (plain[n] == "string" and kinds[n] in ("STRING",))]
    return f"types {odd}" if odd else f"ok {len(got)}" if got else "empty"


def main(argv):
    from wiretally.registry import ORACLES, QUERIES
    from wiretally.session import local_session
    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                res = compare(fn(spark, sf_dir), con, ORACLES[name])
            else:
                res = f"ok rows-only {len(fn(spark, sf_dir).collect())}"
        except Exception as e:  # report every query, then fail at the end
            lines = str(e).splitlines()
            res = f"ERROR {type(e).__name__}: " + " | ".join(
                [lines[0][:700] if lines else ""] + [x[:300] for x in lines[1:] if "Error" in x or "Caused" in x][:3])
        good = res.startswith("ok")
        bad += not good
        print(f"{'PASS' if good else 'FAIL'} {name} {time.time() - start:.1f}s {res}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
