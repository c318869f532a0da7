"""Tables that are replaced as one: versioned folders and a pointer that is switched in one step.

A version writes its files into a folder of its own and then renames one small file, the pointer, which names the
folder of every table (of every bucket, for tables cut into buckets) and the tables' schemas. A reader takes the
pointer once and sees one version of all tables, whatever is written meanwhile; a write that fails leaves
the pointer as it is. Buckets a version does not touch are taken over from the one before by name, not copied.

Folders that a version no longer names are removed one version later, so readers of the last one can finish.
There is one writer at a time, as with every periodic job here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "_current"
BUCKET = "bucket"


def file_system(spark: SparkSession, folder: str):
    """Hadoop's path class and the file system of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, folder: str) -> None:
    path, system = file_system(spark, folder)
    system.delete(path(folder), True)


@dataclass
class Snapshot:
    """What the pointer holds: schema and folders of each table, notes of the writer, folders to be removed next."""

    tables: dict[str, dict] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)
    retired: list[str] = field(default_factory=list)

    def folders(self) -> set[str]:
        return {f for table in self.tables.values() for f in table["folders"].values()}


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The version in force; None before the first one."""
    path, system = file_system(spark, root)
    pointer = path(f"{root}/{POINTER}")
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return Snapshot(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def read_table(
    spark: SparkSession, root: str, snapshot: Snapshot, name: str, buckets: Iterable[int] | None = None
) -> DataFrame:
    """A table of one version, all buckets or the given ones; only their files are listed, no schema is inferred."""
    table = snapshot.tables[name]
    schema = T.StructType.fromJson(table["schema"])
    wanted = table["folders"] if buckets is None else {str(b) for b in buckets} & set(table["folders"])
    folders = [f"{root}/{table['folders'][b]}" for b in sorted(wanted)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class Change:
    """A version in the making, on top of the one in force."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root
        self.base = current(spark, root) or Snapshot()
        self._folder = f"_versions/{uuid.uuid4().hex}"
        self._tables = dict(self.base.tables)

    def put(self, name: str, rows: DataFrame) -> None:
        """Replace a whole table."""
        folder = f"{self._folder}/{name}"
        rows.write.option("compression", "zstd").parquet(f"{self._root}/{folder}")
        self._tables[name] = {"schema": _nullable(rows.schema).jsonValue(), "folders": {"": folder}}

    def put_buckets(self, name: str, rows: DataFrame, touched: Iterable[int] | None = None) -> None:
        """Replace the ``touched`` buckets (None: all) by the rows, which carry their bucket in ``bucket``.

        A touched bucket without rows is empty from now on.
        """
        folder = f"{self._folder}/{name}"
        (
            rows.hint("rebalance", BUCKET)
            .write.option("compression", "zstd")
            .partitionBy(BUCKET)
            .parquet(f"{self._root}/{folder}")
        )
        path, system = file_system(self._spark, self._root)
        found = system.globStatus(path(f"{self._root}/{folder}/{BUCKET}=*")) or []
        written = {str(f.getPath().getName()).split("=")[1]: f"{folder}/{f.getPath().getName()}" for f in found}
        old = self._tables.get(name, {"folders": {}})["folders"]
        gone = set(old) if touched is None else {str(b) for b in touched}
        schema = _nullable(rows.drop(BUCKET).schema).jsonValue()
        self._tables[name] = {"schema": schema, "folders": {b: f for b, f in old.items() if b not in gone} | written}

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as this version has it so far."""
        return read_table(self._spark, self._root, Snapshot(self._tables), name, buckets)

    def publish(self, notes: Mapping | None = None) -> Snapshot:
        """Put the version in force, then remove what the version before had given up."""
        done = Snapshot(self._tables, dict(notes or {}))
        done.retired = sorted(self.base.folders() - done.folders())
        _switch(self._spark, self._root, json.dumps(done.__dict__))
        for folder in self.base.retired:
            drop_folder(self._spark, f"{self._root}/{folder}")
        return done

    def abandon(self) -> None:
        """Remove what was written so far."""
        drop_folder(self._spark, f"{self._root}/{self._folder}")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def _switch(spark: SparkSession, root: str, text: str) -> None:
    """Write the new pointer beside the old one and rename it over that."""
    jvm = spark._jvm
    path, system = file_system(spark, root)
    fresh, pointer = path(f"{root}/{POINTER}-{uuid.uuid4().hex}"), path(f"{root}/{POINTER}")
    stream = system.create(fresh, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(system.makeQualified(fresh), system.makeQualified(pointer), options)


def write_version(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], notes: Mapping | None = None) -> Snapshot:
    """Replace the given tables as one."""
    change = Change(spark, root)
    try:
        for name, rows in tables.items():
            change.put(name, rows)
        return change.publish(notes)
    except Exception:
        change.abandon()
        raise


def bucket_of(buckets: int, *keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
