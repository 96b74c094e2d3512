"""Linked tables: a parent and its children that change together (SNK-01, SNK-15, SNK-16, SRC-20).

All tables of a set are bucketed by the parent's key. A change writes the
touched buckets of every table into a new folder beside the old ones and then
creates one small numbered pointer file that names each bucket's folder. Readers
take the highest number, so they see the whole change or nothing of it; a change
that breaks off leaves folders that no pointer names. The folders hold plain
Parquet. Stored rows that stay in a touched bucket are copied from scan to file:
only keys and one bit per row are shuffled for them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sinks.positions import FILE, ROW, choose, located

BUCKET = "_bucket"
PART = "_part"  # a share of a bucket: one task writes one share or several
# Fixed value: changes after which the files they added to a bucket are put together again.
MANY_CHANGES = 8


class ConcurrentChange(RuntimeError):
    """Another writer changed the tables since they were read; nothing was changed."""


@dataclass(frozen=True)
class Snapshot:
    """What a pointer file says: its number, and schema and folder by bucket of each table."""

    number: int
    tables: Mapping[str, Mapping] = field(default_factory=dict)


class LinkedTables:
    """``links``: table -> its columns that hold the parent's key, the parent
    first. ``blooms``: table -> columns that get a Bloom filter in each file,
    for lookups by a second key. The number of buckets is fixed by the first change."""

    def __init__(self, spark: SparkSession, root: str, links: Mapping[str, Sequence[str]], buckets: int = 64,
                 blooms: Mapping[str, Sequence[str]] | None = None):
        self.spark, self.root, self.links, self.blooms = spark, root.rstrip("/"), dict(links), dict(blooms or {})
        self.parent = next(iter(self.links))
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.buckets = self.snapshot().tables.get(self.parent, {}).get("buckets", buckets)

    # --- pointers

    def _pointers(self) -> list[int]:
        folder = self._path(f"{self.root}/_pointers")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The state of the given or last change; number 0: nothing stored yet."""
        known = self._pointers()
        number = (known[-1] if known else 0) if number is None else number
        if not number:
            return Snapshot(0)
        stream = self._fs.open(self._path(f"{self.root}/_pointers/{number:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        return Snapshot(number, json.loads(text))

    def _publish(self, old: Snapshot, tables: Mapping[str, Mapping]) -> Snapshot:
        """Create the next pointer file: written beside under another name, then
        renamed, which fails if another writer took the number."""
        number = old.number + 1
        final, side = self._path(f"{self.root}/_pointers/{number:012d}.json"), self._path(f"{self.root}/_pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(side, False)
        try:
            out.write(bytearray(json.dumps(tables).encode("utf-8")))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(side, final):
            self._fs.delete(side, False)
            raise ConcurrentChange(f"change {number} of {self.root} was made by another writer")
        return Snapshot(number, tables)

    # --- reading

    def _load(self, table: str, snapshot: Snapshot, buckets: Sequence[int] | None = None) -> DataFrame | None:
        entry = snapshot.tables.get(table)
        if entry is None:
            return None
        folders = [f"{self.root}/{p}" for b, p in sorted(entry["folders"].items()) if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(entry["schema"])
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], entry["schema"])

    def read(self, table: str, snapshot: Snapshot | None = None) -> DataFrame | None:
        """All rows of a table; None if it was never written."""
        return self._load(table, snapshot or self.snapshot())

    def lookup(self, table: str, *key) -> DataFrame | None:
        """SRC-20: the rows of one parent key. The bucket is computed from the
        literal, one folder is read, and its files are sorted by the key, so
        their statistics leave one row group."""
        columns = self.links[table]
        snapshot = self.snapshot()
        if table not in snapshot.tables:
            return None
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], snapshot.tables[table]["schema"]).schema}
        literals = [F.lit(v).cast(kinds[c]) for c, v in zip(columns, key)]
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*literals), F.lit(self.buckets))).first()[0]
        rows = self._load(table, snapshot, [bucket])
        for c, v in zip(columns, literals):
            rows = rows.filter(F.col(c) == v)
        return rows

    def lookup_by(self, table: str, column: str, value) -> DataFrame | None:
        """SRC-20: rows by a second key; Bloom filters skip the files without it."""
        rows = self.read(table)
        return None if rows is None else rows.filter(F.col(column) == F.lit(value))

    # --- changes

    def remove(self, folder: str) -> None:
        """Delete a folder of intermediate rows of a writer."""
        self._fs.delete(self._path(folder), True)

    def _in_bucket(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int"))

    def _clustered(self, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Rows by bucket, each in so many shares that a shuffle's tasks get some of
        them each; and the number of shares. Small shares meet in a task."""
        shares = max(1, 2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        part = F.pmod(F.xxhash64(F.lit(PART), *self.links[name]), F.lit(shares)).cast("int")  # not the hash of the bucket
        return rows.withColumn(PART, part).repartition(BUCKET, PART), shares

    def _write(self, name: str, rows: DataFrame, place: str) -> None:
        writer = rows.sortWithinPartitions(BUCKET, *self.links[name]).write.mode("append").partitionBy(BUCKET).option("compression", "zstd")
        for c in self.blooms.get(name, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{place}")

    def _rebuild(self, old: Snapshot, touched: Sequence[int], folder: str, kept: Mapping[str, DataFrame], new: Mapping[str, DataFrame],
                 filled: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None) -> Snapshot:
        """Write the touched buckets of all tables beside, then switch once."""
        tables = {name: dict(entry) for name, entry in old.tables.items()}
        for name in [n for n in self.links if n in kept or n in new]:
            place, parts = f"{folder}/{name}", []
            if name in kept:
                rows = self._in_bucket(kept[name], self.links[name])
                together, shares = self._clustered(rows, name)
                few = len(kept[name].inputFiles()) <= (shares + MANY_CHANGES) * len(touched)
                parts.append(rows if few else together.drop(PART))
            if name in new:
                more, keys = (filled or {}).get(name, (None, ()))
                rows = new[name] if more is None else new[name].unionByName(more, allowMissingColumns=True)
                rows = self._clustered(self._in_bucket(rows, self.links[name]), name)[0]
                if more is not None:
                    rest = [c for c in rows.columns if c not in (BUCKET, PART, *keys)]
                    rows = rows.groupBy(BUCKET, PART, *keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])
                parts.append(rows.drop(PART))
            fields = (parts[0].unionByName(parts[1]) if parts[1:] else parts[0]).schema
            for rows in parts:
                self._write(name, rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]), place)
            made = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{place}"))}
            folders = {b: p for b, p in tables.get(name, {}).get("folders", {}).items() if int(b) not in touched}
            folders |= {str(b): f"{place}/{BUCKET}={b}" for b in touched if f"{BUCKET}={b}" in made}
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != BUCKET)
            tables[name] = {"buckets": self.buckets, "schema": schema, "folders": folders}
        self._fs.delete(self._path(f"{self.root}/{folder}/bits"), True)
        return self._publish(old, tables)

    def _touched(self, keys: DataFrame, columns: Sequence[str]) -> list[int]:
        return [r[0] for r in self._in_bucket(keys.select(*columns), columns).select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers

    def _without(self, old: Snapshot, touched: Sequence[int], keys: DataFrame, names: Sequence[str], folder: str) -> dict[str, DataFrame]:
        """The touched buckets of the tables without rows of the given parent keys.
        Null keys equal each other, as in the bucket hash. Keys and positions are
        joined; the rows themselves are then dropped by position."""
        kept = {}
        own = [f"_k{i}" for i in range(len(keys.columns))]
        gone = keys.toDF(*own).distinct()
        for name in names:
            rows = self._load(name, old, touched)
            if rows is not None and rows.inputFiles():
                same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(self.links[name], own)]
                on = same[0]
                for s in same[1:]:
                    on = on & s
                at = located(rows).select(*self.links[name], FILE, ROW).join(gone, on, "left_semi")
                kept[name] = choose(located(rows), at, f"{self.root}/{folder}/bits/{name}", keep=False)
        return kept

    def save(self, filled: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None, **tables: DataFrame) -> Snapshot:
        """SNK-01: replace whole parents. Stored rows whose parent key stands in
        the new parent rows go from every table, also where no new child comes
        for them; then the new rows come in. Running it again changes nothing.

        ``filled``: table -> (rows with further columns, unique key of the new rows,
        which holds the parent's): they meet the new rows of their key where these
        are written, so that the new rows are shuffled once."""
        old, columns, folder = self.snapshot(), self.links[self.parent], f"data/{uuid.uuid4().hex}"
        keys = tables[self.parent].select(*columns)
        touched = self._touched(keys, columns)
        for name, rows in tables.items():
            if name != self.parent:
                touched = sorted({*touched, *self._touched(rows, self.links[name])})
        return self._rebuild(old, touched, folder, self._without(old, touched, keys, list(self.links), folder), tables, filled)

    def delete(self, keys: DataFrame, cascade: Sequence[str] | None = None) -> Snapshot:
        """SNK-15: drop parents by key, and with them the rows of the ``cascade``
        tables (all children by default). The other tables stay as they are."""
        old, columns, folder = self.snapshot(), self.links[self.parent], f"data/{uuid.uuid4().hex}"
        names = [self.parent, *([n for n in self.links if n != self.parent] if cascade is None else cascade)]
        keys = keys.select(*columns)
        touched = self._touched(keys, columns)
        if not touched or not old.number:
            return old
        return self._rebuild(old, touched, folder, self._without(old, touched, keys, names, folder), {})

    def cleanup(self, due: Column, order: Sequence[Column], limit: int | None, cascade: Sequence[str] | None = None) -> int:
        """SNK-16: delete at most ``limit`` parents that are due, the first by
        ``order``, in one change; the number of deleted rows. Call again until it
        returns 0, or once with no limit: a call rewrites each bucket it touches,
        so many small calls over all buckets write the whole table each time."""
        parents = self.read(self.parent)
        if parents is None:
            return 0
        first = parents.filter(due)
        if limit is not None:
            first = first.orderBy(*order).limit(limit)
        first = first.select(*self.links[self.parent])
        n = first.count()
        if n:
            self.delete(first, cascade)
        return n

    def vacuum(self, keep: int = 1) -> int:
        """Remove what only older pointers than the last ``keep`` name, and what
        broken changes left; the number of removed folders. Readers of older
        states and running writers must be done."""
        known = self._pointers()
        kept = known[-keep:] if keep else []
        named = {p.split("/")[1] for n in kept for entry in self.snapshot(n).tables.values() for p in entry["folders"].values()}
        data, removed = self._path(f"{self.root}/data"), 0
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in named:
                removed += bool(self._fs.delete(s.getPath(), True))
        for n in known:
            if n not in kept:
                self._fs.delete(self._path(f"{self.root}/_pointers/{n:012d}.json"), False)
        return removed


def retention_cutoff(now: str, days: int) -> Column:
    """SCL-04: rows up to this time are past their retention of at least one day."""
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {max(1, int(days))} DAYS")
