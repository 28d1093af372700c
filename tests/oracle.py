"""Run queries and their SQL side by side: python tests/oracle.py [sf_dir] [name...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(cols)} and {sorted(df.columns)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {bad}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con, oracles = views(sf_dir), entry.oracle_sql()
    for name, q in entry.queries().items():
        if name in oracles and (len(sys.argv) < 3 or name in sys.argv[2:]):
            t = time.time()
            try:
                said = compare(spark, con, name, q, oracles[name], sf_dir)
            except Exception as e:  # noqa: BLE001  one broken query must not hide the others
                said = f"{type(e).__name__}: {str(e)[:600]}"
            print(name, "ok" if not said else said, f"{time.time() - t:.1f} s", flush=True)
