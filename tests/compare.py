"""Run registered queries against DuckDB on the same tables and compare every value."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, (int, str)) else str(v)


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns, types (by family) and all values agree."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = [dict(zip(names, r)) for r in rel.fetchall()]
    columns = sorted(spark_df.columns)
    mine = [r.asDict() for r in spark_df.collect()]
    if columns != sorted(names):
        return f"columns {columns} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    def key(r):
        return [str((type(plain(r[c])).__name__, plain(r[c]))) for c in columns]
    a, b = sorted(map(key, mine)), sorted(map(key, theirs))
    for x, y in zip(a, b):
        if x != y:
            return f"values\n   ours   {x}\n   theirs {y}\n   ({sum(p != r for p, r in zip(a, b))} of {len(a)} rows)"
    return None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from tablewright.session import local_session

    spark = local_session(8)
    con = connection(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in queries.items():
        if wanted and name not in wanted and not any(w.endswith("*") and name.startswith(w[:-1]) for w in wanted):
            continue
        start = time.time()
        try:
            df = plan(spark, folder)
            if name in sql:
                result = difference(df, con, sql[name])
            else:
                n = len(df.collect())
                result = None if n else "no rows"
        except Exception as error:
            result = "error " + (traceback.format_exc()[-1500:] if wanted else str(error)[:400])
        bad += result is not None
        mark = "ok  " if result is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in sql else '(rows only)'} {result or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
