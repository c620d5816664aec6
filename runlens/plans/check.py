"""Compare registered queries with their SQL counterparts (development aid)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("runlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(frame, con, sql: str) -> str:
    """Empty when both results agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in result.description}
    off = [f"{n}: {t} / {types[n]}" for n, t in frame.dtypes if kinds.get(t, t) != types[n]]
    if off:
        return f"types {off}"
    if expected == got:
        return ""
    ours, theirs = set(got), set(expected)
    only_got, only_sql = [r for r in got if r not in theirs][:3], [r for r in expected if r not in ours][:3]
    return f"{len(got)} rows, SQL has {len(expected)}; only ours {only_got}; only SQL {only_sql}"


def main(argv) -> int:
    from runlens.plans.catalog import ORACLES, QUERIES
    from runlens.session import tune

    sf_dir, wanted = argv[0], argv[1:]
    spark, con, bad = tune(session()), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, query in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in ORACLES:
                note = compare(frame, con, ORACLES[name])
            else:
                note = f"(no SQL, {frame.count()} rows)"
        except Exception as error:  # noqa: BLE001 - report and go on
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        ok = note == "" or note.startswith("(no SQL")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - begin:.2f}s {note}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
