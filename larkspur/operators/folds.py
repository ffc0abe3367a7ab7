"""Ordered folds by key: debounce, token bucket, TTL cache.

What each row gives depends on all rows of its key before it, in order. Rows are dealt by key and sorted within partitions; each task streams its keys'
rows as arrays and holds one state. Debounce and TTL jump from one accepted row to the next by binary search, so a key with very many rows costs
little time in its task, and no memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: (state, times in microseconds) -> (state, columns): the state is None before a key's first row.
Fold = Callable[[object, np.ndarray], tuple[object, list[np.ndarray]]]


def ordered_fold(df: DataFrame, key: str, order: list[str], micros: str, fold: Fold, out: list[T.StructField]) -> DataFrame:
    """Rows of ``df`` with the columns ``out`` that ``fold`` gives for each key's rows in order, piece by piece."""
    names = [f.name for f in out]

    def run(parts):
        last, state = object(), None
        for pdf in parts:
            keys, times = pdf[key].to_numpy(), pdf[micros].to_numpy()
            same = keys[1:] == keys[:-1]
            starts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(pdf)] if len(pdf) else [0]
            found = []
            for a, b in zip(starts, starts[1:]):
                if keys[a] != last:
                    last, state = keys[a], None
                state, columns = fold(state, times[a:b])
                found.append(columns)
            made = {n: np.concatenate([c[i] for c in found]) if found else [] for i, n in enumerate(names)}
            yield pdf.assign(**{n: pd.Series(c, index=pdf.index) for n, c in made.items()})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, T.StructType([*df.schema, *out]))


def _renewed(gap: int) -> Fold:
    """The rows that come ``gap`` after the last such row at least, the first one included."""

    def fold(last, times):
        chosen = np.zeros(len(times), bool)
        at = 0 if last is None else int(np.searchsorted(times, last + gap, side="left"))
        while at < len(times):
            chosen[at] = True
            last = int(times[at])
            # one row may not renew itself, even if the gap is nothing
            at = max(at + 1, int(np.searchsorted(times, last + gap, side="left")))
        return last, [chosen]

    return fold


def debounce(events: DataFrame, key: str, micros: str, gap_seconds: float) -> DataFrame:
    """Add ``accepted``: the gap has passed since the key's last accepted event (dropped ones do not extend it)."""
    return ordered_fold(events, key, [micros, "event_id"], micros, _renewed(int(gap_seconds * 1_000_000)), [T.StructField("accepted", T.BooleanType())])


def token_bucket(events: DataFrame, key: str, micros: str, rate: float, burst: float) -> DataFrame:
    """Add ``allowed`` and ``tokens`` left: a full bucket at first, refilled at ``rate`` a second up to ``burst``."""

    def fold(state, times):
        tokens, last = state or (float(burst), None)
        allowed, left = [], []
        for now in times.tolist():
            if last is not None:
                tokens = min(burst, tokens + (now - last) / 1e6 * rate)
            ok = tokens >= 1
            tokens -= ok
            last = now
            allowed.append(ok)
            left.append(tokens)
        return (tokens, last), [np.array(allowed, bool), np.array(left, float)]

    return ordered_fold(events, key, [micros, "event_id"], micros, fold, [T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType())])


def ttl_cache(events: DataFrame, key: str, micros: str, ttl_seconds: float) -> DataFrame:
    """Add ``hit``: the key's entry, written at its last miss, has not expired; a hit does not renew it."""
    missed = _renewed(int(ttl_seconds * 1_000_000))

    def fold(written, times):
        written, (misses,) = missed(written, times)
        return written, [~misses]

    return ordered_fold(events, key, [micros, "event_id"], micros, fold, [T.StructField("hit", T.BooleanType())])
