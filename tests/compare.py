"""Compare the registered queries with their SQL on another engine.

``python -m tests.compare [sf_dir] [names...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        return f"rows only ({len(ours)})"
    cursor = con.execute(text)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"ROWS {len(ours)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"VALUES {len(wrong)} of {len(ours)}, e.g. {wrong[0]}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {text}").fetchall()}
    same = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
    }
    odd = {c: (k, described[c]) for c, k in kinds.items() if same.get(k) != described[c]}
    return f"ok ({len(ours)})" + (f" types {odd}" if odd else "")


def main() -> None:
    from plumbline.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:36s} {time.time() - start:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
