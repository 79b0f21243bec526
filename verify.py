"""Compare every query with its SQL in DuckDB: python verify.py [sf_dir] [name ...]"""

import sys
import time
import traceback

import duckdb

from broadsheet.session import local_session
from checks.queries import ORACLES, QUERIES
from checks.views import TABLES


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = normal(df.collect(), df.columns)
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:28} {len(got):7} {spent:6.2f}s")
                continue
            res = con.execute(ORACLES[name])
            columns = [d[0] for d in res.description]
            want = normal(res.fetchall(), columns)
            ok = got == want and sorted(columns) == sorted(df.columns)
            print(f"{'ok   ' if ok else 'DIFF '} {name:28} {len(got):7} {len(want):7} {spent:6.2f}s", flush=True)
            if not ok:
                bad += 1
                extra, lost = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
                print("   ", sorted(df.columns), sorted(columns))
                print("    only spark:", str(extra)[:900])
                print("    only sql:  ", str(lost)[:900])
        except Exception:
            bad += 1
            print(f"FAIL  {name}", flush=True)
            print(traceback.format_exc()[-1500:])
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
