"""Run registered queries beside their SQL on DuckDB: python tests/compare.py SF_DIR [name ...]"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql.types import DecimalType, FractionalType, IntegralType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as text, columns by name and rows sorted; missing values look alike."""
    frame = frame[sorted(frame.columns)].astype(object).where(lambda f: f.notna(), None)
    return sorted(tuple("" if v is None else repr(_plain(v)) for v in row) for row in frame.itertuples(index=False))


def _plain(value):
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, pd.Timestamp):
        return str(value)
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def difference(spark, connection, sf: str, name: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    result = entry.queries()[name](spark, sf)
    # pandas turns whole numbers with missing ones into fractions, so kinds of numbers are Spark's own
    numbers = {f.name: "i" if isinstance(f.dataType, IntegralType) else "f" for f in result.schema if isinstance(f.dataType, (IntegralType, FractionalType)) and not isinstance(f.dataType, DecimalType)}
    ours = result.toPandas()
    theirs = connection.execute(entry.oracle_sql()[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    for left, right in zip(a, b):
        if left != right:
            return f"values {left} / {right}"
    kinds = [
        (c, str(ours[c].dtype), str(theirs[c].dtype))
        for c in ours.columns
        if numbers.get(c, ours[c].dtype.kind) != theirs[c].dtype.kind
    ]
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    from conftest import make_session

    sf = sys.argv[1]
    spark, connection, bad = make_session(), connect(sf), 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            found = difference(spark, connection, sf, name)
        except Exception as error:  # a broken query must not hide the others
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += found is not None
        print(f"{name:24s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)
    print(f"{bad} differences")
