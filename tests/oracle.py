"""Compares a query with its DuckDB equivalent."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(pdf):
    def value(x):
        if isinstance(x, (float, decimal.Decimal)):
            return "nan" if math.isnan(x) else round(float(x), 6)
        return int(x) if hasattr(x, "__int__") and not isinstance(x, (str, bool)) else x

    return sorted((tuple(value(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


def same(df, sql, sf_dir):
    have, want = df.toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)
