"""Versioned tables: bucketed copy-on-write under a manifest.

A store holds one or more tables.  A table's rows are spread over buckets by
a hash of its key; a version is a manifest file that names the folder of every
bucket.  A commit rewrites only the buckets that its changes touch, writes
them to folders of its own and then makes the new manifest visible with one
rename that fails if another writer got there first.  Until then readers see
the old version, also if the writer dies; afterwards all tables of the commit
have changed together.  A reader that asked for a version keeps it: its
folders are never written again.

What the driver holds is a manifest: a path for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class VersionConflict(RuntimeError):
    """Another writer committed the version first."""


class ConstraintViolation(RuntimeError):
    """Changed rows repeat a key or lack a required value."""


class Table(NamedTuple):
    """A table to create: its rows, its key, and its rules."""
    rows: DataFrame
    key: list[str]
    buckets: int = 64
    unique: bool = False
    required: tuple[str, ...] = ()


class Change(NamedTuple):
    """Change rows, how they make new rows of old ones, and the columns on
    which they match (the table's key, unless they reach rows by others).
    ``repeats``: the rows bring keys of their own that the table may have
    already; both rows stay, and from this version on keys may repeat."""
    rows: DataFrame
    apply: Callable[[DataFrame, DataFrame], DataFrame]
    match: list[str] | None = None
    repeats: bool = False


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class SnapshotStore:
    """Tables under ``path``: ``manifests/<version>.json`` and ``data/``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- files -------------------------------------------------------------

    def _p(self, path: str):
        return self._hadoop.Path(path)

    def _names(self, path: str) -> list[str]:
        if not self._fs.exists(self._p(path)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._p(path))]

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._p(self._manifest_path(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, manifest: dict, version: int) -> None:
        """Make ``version`` visible: write beside, then one rename that never
        replaces a file."""
        tmp = self._p(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = self._hadoop.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else self._fs.getUri(),
                                                          self.spark._jsc.hadoopConfiguration())
        rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = rename.getEnumConstants()[0]  # NONE: do not overwrite
        try:
            context.rename(tmp, self._p(self._manifest_path(version)), options)
        except Exception as e:
            self._fs.delete(tmp, False)
            if "AlreadyExists" in str(e):
                raise VersionConflict(f"version {version} was committed by another writer") from None
            raise

    # -- reading -----------------------------------------------------------

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json"))

    def latest(self) -> int:
        return self.versions()[-1]

    def _rows(self, table: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.path}/{table['folders'][b]}" for b in buckets if b in table["folders"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version (default: the latest now); later commits do
        not change the frame."""
        table = self._load(self.latest() if version is None else version)["tables"][name]
        return self._rows(table, list(table["folders"]))

    def changed(self, name: str, old: int, new: int) -> DataFrame:
        """(change, row...): rows ``removed`` from and ``added`` to a table
        between two versions, repeated as often as they were.  Only buckets
        rewritten in between are read."""
        a, b = (self._load(v)["tables"][name] for v in (old, new))
        other = [k for k in sorted({*a["folders"], *b["folders"]}) if a["folders"].get(k) != b["folders"].get(k)]
        before, after = self._rows(a, other), self._rows(b, other)
        return (before.exceptAll(after).select(F.lit("removed").alias("change"), "*")
                .unionByName(after.exceptAll(before).select(F.lit("added").alias("change"), "*")))

    def rewritten(self, name: str, old: int, new: int) -> list[int]:
        """The buckets of a table that differ between two versions."""
        a, b = (self._load(v)["tables"][name]["folders"] for v in (old, new))
        return sorted(int(k) for k in {*a, *b} if a.get(k) != b.get(k))

    # -- writing -----------------------------------------------------------

    def _write(self, df: DataFrame, table: dict, name: str, transaction: str) -> dict[str, str]:
        """Rows to the transaction's folders, one for each bucket; the rules
        are checked on what was written.  Returns bucket -> folder."""
        at = f"data/{transaction}/{name}"
        schema = StructType.fromJson(table["schema"])
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        (rows.withColumn(BUCKET, _bucket(table["key"], table["buckets"])).repartition(BUCKET)
         .write.partitionBy(BUCKET).parquet(f"{self.path}/{at}"))
        folders = {n.split("=")[1]: f"{at}/{n}" for n in self._names(f"{self.path}/{at}") if n.startswith(f"{BUCKET}=")}
        if folders and (table["unique"] or table["required"]):
            written = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])
            # equal keys share a bucket, so the rewritten buckets show every repeated key
            if table["unique"] and (n := written.groupBy(*table["key"]).count().filter("count > 1").count()):
                raise ConstraintViolation(f"{name}: {n} keys {table['key']} are repeated")
            if table["required"]:
                null = written.filter(" OR ".join(f"`{c}` IS NULL" for c in table["required"])).count()
                if null:
                    raise ConstraintViolation(f"{name}: {null} rows lack one of {table['required']}")
        return folders

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, Table]) -> SnapshotStore:
        """A new store with the given tables as version 0."""
        store = cls(spark, path)
        store._fs.mkdirs(store._p(f"{store.path}/manifests"))
        transaction, out = uuid.uuid4().hex, {}
        for name, t in tables.items():
            schema = StructType.fromJson(t.rows.schema.jsonValue())
            for f in schema:
                f.nullable = True
            info = {"key": t.key, "buckets": t.buckets, "unique": t.unique, "required": list(t.required), "schema": schema.jsonValue()}
            info["folders"] = store._write(t.rows, info, name, transaction)
            out[name] = info
        store._switch({"tables": out}, 0)
        return store

    def _touched(self, table: dict, change: Change) -> list[str]:
        """The buckets with rows that the change can reach, found by its keys
        or, where it matches on other columns, by a semi-join of the table."""
        bucket = _bucket(table["key"], table["buckets"]).alias(BUCKET)
        match = table["key"] if change.match is None else change.match
        if set(table["key"]) <= set(match):
            hit = change.rows.select(bucket)
        else:
            hit = (self._rows(table, list(table["folders"])).select(*dict.fromkeys([*table["key"], *match]))
                   .join(change.rows.select(*match).distinct(), match, "left_semi").select(bucket))
        return sorted(str(r[0]) for r in hit.distinct().collect())

    def commit(self, changes: dict[str, Change], base: int | None = None, before_switch: Callable[[], None] | None = None) -> int:
        """Apply a change to each of the named tables and make the result the
        version after ``base`` (default: the latest); returns its number.

        Raises ``VersionConflict`` if that version exists already, and
        ``ConstraintViolation`` before anything is visible.  Folders of a
        commit that did not get through are left for ``remove_strays``.
        """
        base = self.latest() if base is None else base
        manifest = self._load(base)
        transaction = uuid.uuid4().hex
        for name, change in changes.items():
            table = manifest["tables"][name]
            touched = self._touched(table, change)
            if not touched:
                continue
            table["unique"] = table["unique"] and not change.repeats
            new = change.apply(self._rows(table, touched), change.rows)
            folders = self._write(new, table, name, transaction)
            strange = set(folders) - set(touched)
            if strange:
                raise ConstraintViolation(f"{name}: a change moved rows to other buckets: it may not change {table['key']}")
            table["folders"] = {b: f for b, f in table["folders"].items() if b not in touched} | folders
        if before_switch:
            before_switch()
        self._switch(manifest, base + 1)
        return base + 1

    # -- upkeep ------------------------------------------------------------

    def _folders(self, versions: list[int]) -> set[str]:
        return {f for v in versions for t in self._load(v)["tables"].values() for f in t["folders"].values()}

    def expire(self, keep: int = 2) -> list[int]:
        """Drop all but the last ``keep`` (at least one) versions and the
        folders that only they used; returns the dropped versions.  Readers
        of dropped versions must have finished."""
        every = self.versions()
        old, left = every[:-max(keep, 1)], every[-max(keep, 1):]
        unused = self._folders(old) - self._folders(left)
        for v in old:
            self._fs.delete(self._p(self._manifest_path(v)), False)
        for f in unused:
            self._fs.delete(self._p(f"{self.path}/{f}"), True)
        return old

    def remove_strays(self) -> list[str]:
        """Delete the folders of commits that never became a version; only
        while no writer is at work.  Returns their transactions."""
        used = {f.split("/")[1] for f in self._folders(self.versions())}
        strays = [n for n in self._names(f"{self.path}/data") if n not in used]
        for n in strays:
            self._fs.delete(self._p(f"{self.path}/data/{n}"), True)
        for n in self._names(f"{self.path}/manifests"):
            if n.endswith(".tmp"):
                self._fs.delete(self._p(f"{self.path}/manifests/{n}"), False)
        return strays
