"""Source files of folder trees and of captured change lists (SRC-03, SRC-13).

``source_tree`` is a Python data source: the driver lists the upper levels only,
the folders below them are dealt to tasks, and a pruned folder is never listed.
Filters on ``extension`` and ``language`` are applied while listing, a prefix of
``path`` also keeps folders that cannot hold such a path from being listed.

Links are not followed and folders that cannot be read count as empty. A missing
root, a missing subfolder and one outside of the root are errors.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from tidewatch.functions import text as T
from tidewatch.operators import paths as P

BATCH = 4096
COLUMNS = pa.schema([("path", pa.string()), ("language", pa.string()), ("extension", pa.string()), ("size_bytes", pa.int64())])

#: What a folder holds: names of its folders, and (name, size) of its files.
Children = tuple[list[str], list[tuple[str, int]]]


def local_children(folder: str) -> Children:
    folders, files = [], []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.name)
                    elif e.is_file(follow_symlinks=False):
                        files.append((e.name, e.stat(follow_symlinks=False).st_size))
                except OSError:  # gone since the folder was opened
                    continue
    except OSError:
        pass
    return folders, files


def remote_children(uri: str) -> Children:
    """The same by Arrow's file systems, for every other scheme."""
    system, path = fs.FileSystem.from_uri(uri)
    try:
        found = system.get_file_info(fs.FileSelector(path))
    except OSError:
        return [], []
    return [i.base_name for i in found if i.type == fs.FileType.Directory], [(i.base_name, i.size) for i in found if i.type == fs.FileType.File]


def _local(root: str) -> str | None:
    """The local form of a root, NULL for another file system."""
    if root.startswith("file:"):
        return "/" + root[len("file:"):].lstrip("/")
    return None if "://" in root else os.path.abspath(root)


@dataclass
class Folders(InputPartition):
    """Folders of one task; ``deep`` says whether what is below them belongs to it."""

    names: list[str]
    deep: bool


@dataclass
class Listing:
    """What is listed: a root, rules for folders and files, and how to open one."""

    root: str
    start: str
    pruned: frozenset[str]
    languages: dict[str, str]
    prefixes: tuple[str, ...] = ()

    def children(self, folder: str) -> Children:
        place = self.root if not folder else f"{self.root.rstrip('/')}/{folder}"
        return local_children(place) if _local(self.root) is not None else remote_children(place)

    def enters(self, folder: str) -> bool:
        """Whether a folder is listed: not pruned by name, and on the way to every prefix."""
        name = posixpath.basename(folder)
        if name in self.pruned or name.startswith(".git"):
            return False
        inside = folder + "/"
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)

    def below(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders to go on with and files, as paths from the root."""
        folders, files = self.children(folder)
        at = f"{folder}/" if folder else ""
        return [at + f for f in sorted(folders) if self.enters(at + f)], [(at + n, size) for n, size in files]

    def source(self, path: str, size: int) -> tuple[str, str, str, int] | None:
        """The row of a file, none for an extension that is not listed."""
        name = posixpath.basename(path)
        dot = name.rfind(".")
        extension = name[dot:].lower() if dot >= 0 else ""
        language = self.languages.get(extension)
        return None if language is None else (path, language, extension, size)


class TreeReader(DataSourceReader):
    def __init__(self, listing: Listing, depth: int, most: int):
        self.listing, self.depth, self.most = listing, depth, most

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Extension and language filters are done here; path prefixes prune
        folders and are still tested by Spark on the files."""
        for f in filters:
            column = getattr(f, "attribute", None)
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("extension",) and wanted is not None:
                self.listing.languages = {e: x for e, x in self.listing.languages.items() if e in wanted}
            elif column == ("language",) and wanted is not None:
                self.listing.languages = {e: x for e, x in self.listing.languages.items() if x in wanted}
            else:
                if column == ("path",) and isinstance(f, StringStartsWith):
                    self.listing.prefixes += (f.value,)
                yield f

    def partitions(self) -> list[Folders]:
        """The driver lists ``depth`` levels; what is below is dealt to at most
        ``most`` tasks, neighbours apart, so that one large branch is shared."""
        level, upper = [self.listing.start], []
        for _ in range(self.depth):
            upper += level
            level = [f for folder in level for f in self.listing.below(folder)[0]]
        tasks = min(len(level), self.most)
        return [Folders(upper, False)] * bool(upper) + [Folders(level[i::tasks], True) for i in range(tasks)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        stack, rows = list(partition.names), []
        while stack:
            folders, files = self.listing.below(stack.pop())
            if partition.deep:
                stack += folders
            for path, size in files:
                row = self.listing.source(path, size)
                if row is not None:
                    rows.append(row)
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), COLUMNS)], schema=COLUMNS)


class SourceTree(DataSource):
    """Options: ``path`` (root), ``subpath``, ``exclude`` (more folder names, by
    comma), ``extensions`` (by comma, in place of the known ones), ``depth``
    (levels that the driver lists), ``partitions`` (tasks at most)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, language string, extension string, size_bytes bigint"

    def reader(self, schema) -> TreeReader:
        o = self.options
        root, subpath = o["path"], posixpath.normpath(o.get("subpath") or ".").strip("/")
        start = "" if subpath == "." else subpath
        if start == ".." or start.startswith("../"):
            raise ValueError("the subfolder is outside of the root")
        local = _local(root)
        place = (local or root).rstrip("/") + (f"/{start}" if start else "")
        if not (os.path.isdir(place) if local is not None else _remote_folder(place)):
            raise ValueError(f"no such folder: {place}")
        if local is not None and os.path.commonpath([os.path.realpath(place), os.path.realpath(local)]) != os.path.realpath(local):
            raise ValueError("the subfolder is outside of the root")
        own = [e.strip().lower() for e in (o.get("extensions") or "").split(",") if e.strip()]
        languages = {e: P.EXTENSION_LANGUAGE.get(e, e[1:]) for e in own} if own else dict(P.EXTENSION_LANGUAGE)
        extra = [e.strip() for e in (o.get("exclude") or "").split(",") if e.strip()]
        listing = Listing(local or root, start, frozenset([*P.DISCOVERY_PRUNED, *extra]), languages)
        return TreeReader(listing, int(o.get("depth", 1)), int(o.get("partitions", 1024)))


def _remote_folder(uri: str) -> bool:
    system, path = fs.FileSystem.from_uri(uri)
    return system.get_file_info(path).type == fs.FileType.Directory


def discover(spark: SparkSession, root: str, subpath: str = "", exclude: Iterable[str] = (), **options: str) -> DataFrame:
    """SRC-03: the source files below a root, one row each. ``paths.limits`` tells
    whether they exceed a repository's bounds, :func:`checked` makes that an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").options(subpath=subpath, exclude=",".join(exclude), **options)
    return reader.load(root)


def checked(files: DataFrame) -> DataFrame:
    """SRC-03: the files by path, or an error where they exceed the bounds of a
    repository. The bounds are counted by an aggregation of their own."""
    total = P.limits(files.withColumnRenamed("size_bytes", "size")).head()
    if total["over_limit"]:
        raise ValueError(f"{total['files']} source files with {total['bytes']} bytes exceed {P.MAX_FILES} files or {P.MAX_TOTAL_BYTES} bytes")
    return files.orderBy("path")


def listed(files: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """SRC-03 over a captured listing (path, size) by the same rules: a file goes
    when any of its folders is pruned or its extension is not supported."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    names = F.array(*[F.lit(x) for x in [*P.DISCOVERY_PRUNED, *exclude]])
    pruned = F.arrays_overlap(folders, names) | F.exists(folders, lambda x: x.startswith(".git"))
    out = files.filter(~pruned).select("path", P.language("path").alias("language"), F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1).alias("extension"), F.col("size").alias("size_bytes"))
    return out.filter("language IS NOT NULL")


def staged(lines: DataFrame, value: str = "value") -> DataFrame:
    """SRC-13: rows (path, status, state) of name-status lines. A rename or copy
    counts by its new path; state is ``scan``, ``deleted`` or ``unsupported``.
    Lines without a tab are no entries."""
    fields = F.split(T.strip(value), "\t")
    out = lines.filter(F.size(fields) > 1).select(T.strip(F.element_at(fields, -1)).alias("path"), T.strip(fields[0]).alias("status"))
    # a name that only starts with its dot has no extension here
    known = P.language(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1)).isNotNull()
    return out.withColumn("state", F.when(F.col("status").startswith("D"), "deleted").when(known, "scan").otherwise("unsupported"))


def staged_content(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """SRC-13: the staged text of every entry to scan, NULL where the captured
    index (path, content) has none."""
    index = blobs.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("_at"), "content")
    todo = entries.filter("state = 'scan'").withColumn("_at", F.replace("path", F.lit("\\"), F.lit("/")))
    return todo.join(index, "_at", "left").drop("_at")
