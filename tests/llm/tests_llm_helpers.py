from __future__ import annotations


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}
