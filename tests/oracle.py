"""Compare a query with its SQL, as the driver does: column names, rows, values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def differences(df, sql, sf_dir):
    """Names that differ, or rows found on one side only."""
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    order = sorted(names)
    flat = lambda rows: sorted(tuple(("nan" if isinstance(v, float) and math.isnan(v) else v) for v in (r[c] for c in order)) for r in rows)
    key = lambda rows: sorted(map(repr, flat(rows)))
    got, want = key(r.asDict() for r in df.collect()), key(want)
    return [("rows", len(got), len(want), [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2])] if got != want else []
