"""Run queries against DuckDB and compare all rows. Also a command: ``python tests/compare.py DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "to_pydatetime"):
        return str(value.to_pydatetime())
    return str(value)


def _kind(text: str) -> str:
    text = text.upper()
    for kind, words in {
        "int": ("INT", "LONG", "SHORT"), "real": ("DOUBLE", "FLOAT"), "text": ("VARCHAR", "STRING"),
        "time": ("TIMESTAMP",), "bool": ("BOOL",),
    }.items():
        if any(w in text for w in words) and "HUGEINT" not in text:
            return kind
    return text


def frame_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides agree in columns, types and rows; otherwise what differs."""
    result = con.execute(sql)
    theirs_cols = {d[0]: _kind(str(d[1])) for d in result.description}
    theirs = frame_rows([d[0] for d in result.description], result.fetchall())
    ours_cols = {f.name: _kind(f.dataType.typeName()) for f in spark_df.schema.fields}
    if ours_cols != theirs_cols:
        return f"columns {sorted(set(ours_cols.items()) ^ set(theirs_cols.items()))}"
    ours = frame_rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        only = sorted(set(ours) - set(theirs))[:2], sorted(set(theirs) - set(ours))[:2]
        return f"{len(bad)} of {len(ours)} rows differ in {sorted(theirs_cols)}: {only}"
    return None


def session():
    from tapewatch.session import build_session

    spark = build_session(
        "compare", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.sql.adaptive.coalescePartitions.enabled": os.environ.get("COALESCE", "true"),
            "spark.driver.host": "localhost",
            "tapewatch.groupRows": os.environ.get("GROUP_ROWS", "2000000"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, chosen = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    every, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in every.items():
        if chosen and not any(c in name for c in chosen):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = differences(run(spark, folder), con, sql[name])
                rows = ""
            else:
                rows, problem = f"{len(run(spark, folder).collect())} rows, no SQL", None
        except Exception as error:  # report and go on with the other queries
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.2f}s {rows} {problem or ''}", flush=True)
    print(f"{failed} failed")
