"""Run registered queries next to their SQL and report differences.

``python -m checks.compare [--sf DIR] [name-prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()
DUCK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("kinfold-checks")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())


def _key(row: tuple) -> tuple:
    return tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


def run(spark: SparkSession, con, sf: str, name: str, allow_empty: bool = False) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    took = time.time() - started
    note = f"{took:6.2f}s rows={len(got)}"
    if name not in ORACLES:
        return len(got) > 0, note + " (no SQL)"
    relation = con.sql(ORACLES[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    if sorted(types) != columns:
        return False, note + f" columns {columns} <> {sorted(types)}"
    want = [tuple(r[list(relation.columns).index(c)] for c in columns) for r in relation.fetchall()]
    bad = [
        (f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
        if DUCK_TYPES.get(f.dataType.simpleString()) != types[f.name]]
    a, b = sorted(map(_key, got)), sorted(map(_key, want))
    ok = a == b and not bad and (bool(got) or allow_empty)
    exact = sorted(map(repr, got)) == sorted(map(repr, want))
    if ok and not exact:
        note += " (floats differ in the last digits)"
    if bad:
        note += f" types {bad}"
    if a != b:
        note += f" sql rows={len(want)}; only spark {[x for x in a if x not in set(b)][:3]}; only sql {[x for x in b if x not in set(a)][:3]}"
    return ok and exact, note


def main() -> None:
    import checks.queries  # noqa: F401
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    failures = []
    for name in sorted(QUERIES):
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, note = run(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            failures.append(name)
    print(f"{len(failures)} failures", failures)


if __name__ == "__main__":
    main()
