"""Run registered queries beside their check SQL and compare the rows."""

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return f"{type(value).__name__}:{value}"


def compare(df, con, sql):
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    cursor = con.execute(sql)
    theirs_cols = [d[0] for d in cursor.description]
    if sorted(theirs_cols) != cols:
        return f"columns {cols} vs {sorted(theirs_cols)}"
    mine = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    place = [theirs_cols.index(c) for c in cols]
    theirs = sorted(tuple(_cell(r[i]) for i in place) for r in cursor.fetchall())
    if mine == theirs:
        return None
    only = [r for r in mine if r not in set(theirs)][:2]
    other = [r for r in theirs if r not in set(mine)][:2]
    return f"rows {len(mine)} vs {len(theirs)}\n  cols  {cols}\n  spark {only}\n  sql   {other}"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from presswire.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                result = compare(df, con, sqls[name]) or "ok"
            else:
                result = f"rows only {len(df.collect())}"
        except Exception as error:
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not (result == "ok" or result.startswith("rows only"))
        print(f"{name:34} {time.time() - start:6.1f}s {result}", flush=True)
    print("failures:", bad)
