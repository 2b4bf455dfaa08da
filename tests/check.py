"""Run registered queries next to their SQL in DuckDB and compare rows.

`python tests/check.py [sf] [name ...]` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    for name, keys in (("bool", ("bool",)), ("list", ("array", "[]")), ("huge", ("hugeint",)), ("long", ("bigint",)), ("int", ("int",)),
                       ("float", ("double", "float", "decimal")), ("ts", ("timestamp", "date")),
                       ("str", ("string", "varchar"))):
        if any(k in d for k in keys):
            return name
    return d


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark_df, con, sql: str) -> str:
    got_names = spark_df.columns
    got = rows_of([tuple(r) for r in spark_df.collect()], got_names)
    rel = con.sql(sql)
    want_names = rel.columns
    want = rows_of(rel.fetchall(), want_names)
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    kinds = {n: (kind(t), kind(str(w))) for (n, t), w in zip(
        sorted(spark_df.dtypes), [str(rel.types[want_names.index(n)]) for n in sorted(want_names)])}
    bad = {n: k for n, k in kinds.items() if k[0] != k[1]}
    if bad:
        return f"types {bad}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first {got[:2]} vs {want[:2]}"
    close = all(same(a, b) for a, b in zip(got, want))
    if got != want and not close:
        diff = [(a, b) for a, b in zip(got, want) if not same(a, b)][:3]
        return f"{sum(not same(a, b) for a, b in zip(got, want))} values differ: {diff}"
    return "ok" if got == want else "ok (rounding)"


def same(a, b) -> bool:
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)))
               for x, y in zip(a, b))


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from ordinalis.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                                      for a in argv[1:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            verdict = compare(df, con, oracles[name]) if name in oracles else f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"ERROR {type(e).__name__}: {str(e)[:500]}"
        good = verdict.startswith("ok") or (name not in oracles and verdict.startswith("rows"))
        failed += not good
        print(f"{'  ' if good else '!!'} {name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
