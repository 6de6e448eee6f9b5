"""Run the queries and their SQL side by side: python checks/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def _types(table) -> dict[str, str]:
    return {
        f.name: str(f.type).replace("large_", "").replace("string_view", "string")
        for f in table.schema
    }


def compare(spark: SparkSession, con, query, sql: str, sf_dir: str) -> str:
    """'' if both sides agree in columns, types, rows and values; else why not."""
    got, want = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    t_got, t_want = _types(got), _types(want)
    if sorted(t_got) != sorted(t_want):
        return f"columns {sorted(t_got)} / {sorted(t_want)}"
    diff = {c: (t_got[c], t_want[c]) for c in t_got if t_got[c] != t_want[c]}
    a, b = _rows(got.to_pandas(types_mapper=pd.ArrowDtype)), _rows(
        want.to_pandas(types_mapper=pd.ArrowDtype)
    )
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}"
    return f"types {diff}" if diff else ""


def main() -> None:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLE:
                why = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
            else:
                why = "" if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            why = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(why)
        kind = "sql" if name in ORACLE else "rows"
        print(f"{'FAIL' if why else 'ok  '} {name} [{kind}] {time.time() - start:.1f}s {why}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
