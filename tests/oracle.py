"""Compare a Spark result with a DuckDB query: columns, types, rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp"
    return {"large_string": "string", "large_list": "list"}.get(str(t), str(t))


def _rows(table: pa.Table) -> pd.DataFrame:
    df = table.select(sorted(table.column_names)).to_pandas()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]").astype("int64")
    df = df.astype(object).where(df.notna(), None)
    text = df.map(lambda v: "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both agree, else what differs first."""
    mine: pa.Table = spark_df.toArrow()
    theirs: pa.Table = con.sql(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(mine.column_names)} != {sorted(theirs.column_names)}"
    for c in mine.column_names:
        a, b = _plain(mine.schema.field(c).type), _plain(theirs.schema.field(c).type)
        if a != b:
            return f"type of {c}: {a} != {b}"
    if mine.num_rows != theirs.num_rows:
        return f"rows {mine.num_rows} != {theirs.num_rows}"
    x, y = _rows(mine), _rows(theirs)
    bad = (x != y).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        cols = [c for c in x.columns if x.at[i, c] != y.at[i, c]]
        return f"{int(bad.sum())} rows differ, first in {cols}: {x.loc[i].to_dict()} != {y.loc[i].to_dict()}"
    return None
