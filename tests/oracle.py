"""A query's rows against those of its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    plain = frame[columns].astype(object)
    return sorted(map(repr, plain.where(plain.notna(), None).values.tolist()))


def same_rows(spark, function, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql).df()
    got = function(spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    for c in columns:  # integers with nulls come as floats from one side
        if want[c].dtype.kind == "f" or got[c].dtype.kind == "f":
            want[c], got[c] = want[c].astype(float), got[c].astype(float)
    assert rows_of(got, columns) == rows_of(want, columns)
