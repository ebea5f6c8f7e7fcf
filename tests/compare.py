"""Rows of Spark and DuckDB in one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(7) + 0.0
    out = df[sorted(df.columns)].astype(str).replace({"nan": "<NA>", "None": "<NA>", "NaN": "<NA>"}).replace(r"\.0$", "", regex=True)
    return sorted(map(tuple, out.itertuples(index=False)))
