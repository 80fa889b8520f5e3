"""Compare a query with its SQL on the same tables."""

import math
import os

import duckdb

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else str(value)


def differences(spark, folder, name):
    """None if rows and columns agree, else a few rows of either side."""
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    frame = __spark_entry__.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    ours = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    answer = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    if sorted(names) != columns:
        return columns, sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    if ours == theirs:
        return None
    return len(ours), len(theirs), [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
