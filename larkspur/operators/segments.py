"""Tables that change by key, as folders of Parquet that are never changed: what changes is which of them count.

A change is a folder of its own; then its number in the log is taken by creating a file that must not exist, so of two writers one takes the next number, and
readers see whole changes only. (The folder has to be on a store where creating a file that exists fails, as HDFS, POSIX and object stores with conditional
puts do.) Neighbouring changes of like size are merged into one, so there are never many, and a row is rewritten about as often as the logarithm of the changes: a
merge stands for a span of numbers and hides what is within it. Folders that no living entry names go when they are older than GRACE.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.operators import store

#: Neighbouring changes that are merged, and how much larger than those behind it one may be to be merged with them.
FANOUT, RATIO = 8, 2
#: Seconds for which a folder stays that a merge has replaced: no reader may take longer.
GRACE = 3600


@dataclass(frozen=True)
class Span:
    """A living entry: the changes from ``low`` to ``high``, in one folder (none if nothing is left of them)."""

    low: int
    high: int
    entry: dict

    @property
    def folder(self) -> str | None:
        return self.entry["folder"]


class Log:
    """Numbered entries below one folder, each written once: changes ("put") and merges of a span of them ("span")."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._entries: dict[int, dict] = {}  # entries never change

    def entries(self) -> dict[int, dict]:
        """Every entry by number; those that are taken but not written yet are left out."""
        for n in (int(name) for name in store.names(self.spark, f"{self.folder}/log") if name.isdigit()):
            if n not in self._entries and (text := store.read_text(self.spark, f"{self.folder}/log/{n:09d}")):
                self._entries[n] = json.loads(text)
        return self._entries

    def version(self) -> int:
        return max(self.entries(), default=0)

    def commit(self, entry: dict) -> int:
        n = self.version() + 1
        while not store.create_once(self.spark, f"{self.folder}/log/{n:09d}", json.dumps(entry)):
            n += 1
        return n

    def live(self) -> list[Span]:
        """The entries that count, in order: of overlapping spans the one that clears, then the longest, then the first."""
        entries = self.entries()
        wide = [Span(e["low"], e["high"], e) for e in (entries[n] for n in sorted(entries)) if e["kind"] == "span"]
        taken: list[Span] = []
        for s in sorted(wide, key=lambda s: (s.folder is not None, s.low - s.high)):
            if all(s.high < t.low or t.high < s.low for t in taken):
                taken.append(s)
        puts = [Span(n, n, e) for n, e in entries.items() if e["kind"] == "put" and all(not t.low <= n <= t.high for t in taken)]
        return sorted([s for s in taken + puts if s.folder is not None], key=lambda s: s.low)

    def due(self) -> list[Span]:
        """The newest neighbours that should be merged: FANOUT or more, none of them much larger than all behind it. None if there are fewer."""
        run: list[Span] = []
        for s in reversed(self.live()):
            if run and s.entry["bytes"] > RATIO * sum(r.entry["bytes"] for r in run):
                break
            run.append(s)
        return run[::-1] if len(run) >= FANOUT else []

    def new_folder(self) -> str:
        return f"change-{uuid.uuid4().hex}"

    def size(self, name: str) -> int:
        return store.size(self.spark, f"{self.folder}/{name}")

    def vacuum(self, grace: float = GRACE) -> list[str]:
        """Remove the folders of no living entry that have not been touched for ``grace`` seconds; gives their names."""
        named = {s.folder for s in self.live()}
        old = [n for n in store.names(self.spark, self.folder) if n.startswith("change-") and n not in named and store.age(self.spark, f"{self.folder}/{n}") > grace]
        for n in old:
            store.remove(self.spark, f"{self.folder}/{n}")
        return old


class SegmentStore:
    """Tables (name -> schema) whose rows have the key columns; ``layout``: columns by which a table's files are laid out, a folder for each value of the first one;
    ``counts``: tables (name -> (table, columns)) of the numbers of rows that changes have brought, which take no account of those they hide.

    A change (``put``) brings rows of any of the tables and takes away the older rows of the keys it touches: a row is live if no later change touches its key.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], tables: dict[str, str], layout: dict[str, list[str]] | None = None, counts: dict[str, tuple[str, list[str]]] | None = None):
        self.spark, self.folder, self.keys, self.tables = spark, folder.rstrip("/"), list(keys), tables
        self.layout, self.counts = layout or {}, counts or {}
        self.log = Log(spark, folder)

    def version(self) -> int:
        return self.log.version()

    def _write(self, name: str, rows: dict[str, DataFrame]) -> None:
        for table, df in rows.items():
            writer = df.write
            if table in self.layout:
                # in several files where many rows have a value
                places = [*self.layout[table], *self.keys]
                writer = df.repartitionByRange(*places).sortWithinPartitions(*places).write.partitionBy(places[0])
            writer.parquet(f"{self.folder}/{name}/{table}")
            for counted, (of, by) in self.counts.items():
                if of == table:
                    self._read(name, table).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{self.folder}/{name}/{counted}")

    def counted(self, name: str) -> DataFrame:
        """One of the tables of counts."""
        of, by = self.counts[name]
        fields = {f.name: f for f in StructType.fromDDL(self.tables[of])}
        schema = StructType([*[fields[c] for c in by], *StructType.fromDDL("n long")])
        parts = [f"{self.folder}/{s.folder}/{name}" for s in self.log.live() if of in s.entry["tables"]]
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy(*by).agg(F.sum("n").alias("n"))

    def put(self, rows: dict[str, DataFrame], gone: DataFrame | None = None, **more) -> int:
        """Bring in rows, in the place of all older rows of their keys, and take away the rows of the keys in ``gone``. Gives the change's number; ``more`` stands in its entry."""
        name = self.log.new_folder()
        self._write(name, rows)
        keys = [self._read(name, table).select(self.keys) for table in rows] + ([gone.select(self.keys)] if gone is not None else [])
        reduce(DataFrame.unionByName, keys).distinct().write.parquet(f"{self.folder}/{name}/keys")
        n = self.log.commit({"kind": "put", "folder": name, "tables": list(rows), "bytes": self.log.size(name)} | more)
        if run := self.log.due():
            self.merge(run)
        return n

    def clear(self, **more) -> int:
        """Take away all rows."""
        return self.log.commit({"kind": "span", "low": 0, "high": self.version(), "folder": None} | more)

    def state(self) -> int:
        """The largest ``state`` that a change was given, -1 if there is none."""
        return max((e["state"] for e in self.log.entries().values() if "state" in e), default=-1)

    def merge(self, run: list[Span]) -> None:
        """Write the live rows of neighbouring changes as one that stands for all of them. Changes that others make meanwhile stay behind it."""
        name = self.log.new_folder()
        self._write(name, {t: self._rows(t, run) for t in self.tables})
        touched = reduce(DataFrame.unionByName, [self._keys(s) for s in run]).select(self.keys).distinct()
        touched.write.parquet(f"{self.folder}/{name}/keys")
        self.log.commit({"kind": "span", "low": run[0].low, "high": run[-1].high, "folder": name, "tables": list(self.tables), "bytes": self.log.size(name)})
        self.log.vacuum()

    def compact(self) -> None:
        """Merge all changes."""
        if run := self.log.live():
            self.merge(run)

    def changes(self, after: int) -> list[Span] | None:
        """The changes behind a number, in order; None if all was cleared since.

        A merge that the number lies within is one of them: its rows take the place of all rows of its keys, whatever part of it is known already.
        """
        entries = self.log.entries()
        cleared = any(e["kind"] == "span" and e["folder"] is None for n, e in entries.items() if n > after)
        return None if cleared else [s for s in self.log.live() if s.high > after]

    def rows_of(self, span: Span, name: str) -> DataFrame:
        """A table's rows of one change, whether they are live or not."""
        return self._read(span.folder, name) if name in span.entry["tables"] else self.spark.createDataFrame([], self.tables[name])

    def keys_of(self, span: Span) -> DataFrame:
        """The keys that a change touches."""
        return self._keys(span).select(self.keys)

    def _read(self, folder: str, table: str) -> DataFrame:
        return self.spark.read.schema(self.tables[table]).parquet(f"{self.folder}/{folder}/{table}")

    def _key_schema(self) -> StructType:
        fields = {f.name: f for t in self.tables.values() for f in StructType.fromDDL(t)}
        return StructType([fields[k] for k in self.keys])

    def _keys(self, span: Span) -> DataFrame:
        return self.spark.read.schema(self._key_schema()).parquet(f"{self.folder}/{span.folder}/keys").withColumn("__last", F.lit(span.high))

    def _rows(self, name: str, spans: list[Span]) -> DataFrame:
        parts = [self._read(s.folder, name).withColumn("__change", F.lit(s.high)) for s in spans if name in s.entry["tables"]]
        if not parts:
            return self.spark.createDataFrame([], self.tables[name])
        rows = reduce(DataFrame.unionByName, parts)
        first = min(s.high for s in spans if name in s.entry["tables"])
        later = [self._keys(s) for s in spans if s.high > first]
        if later:
            touched = reduce(DataFrame.unionByName, later).groupBy(*self.keys).agg(F.max("__last").alias("__last")).withColumnsRenamed({k: f"__{k}" for k in self.keys})
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
            rows = rows.join(touched, same & (F.col("__last") > F.col("__change")), "left_anti")
        return rows.drop("__change")

    def table(self, name: str) -> DataFrame:
        """The live rows."""
        return self._rows(name, self.log.live())
