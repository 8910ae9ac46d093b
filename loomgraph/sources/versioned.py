"""Folders whose contents change atomically.

Parts are immutable parquet folders with names of their own. A version is one small JSON file that names the parts it is
made of; it is written aside and renamed to the next number, which fails if another writer was there first. A reader opens
the highest version and sees the old state or the new one, whatever a writer was doing when it died; parts that no version
names are left over from such writers and are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class WriteConflict(Exception):
    """Another writer has made the next version."""


class VersionedFolder:
    """Numbered states of a folder, each a dictionary that JSON can hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def names(self, of: str) -> list[str]:
        """What lies in a folder below this one."""
        fs, place = self._at(of)
        return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def state(self, version: int | None = None) -> tuple[int, dict]:
        """Number and state of a version, the latest by default; 0 and nothing before the first."""
        known = self.versions()
        if version is None and not known:
            return 0, {}
        version = known[-1] if version is None else version
        fs, place = self._at(f"versions/{version:012d}.json")
        stream = fs.open(place)
        try:
            body = self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        finally:
            stream.close()
        return version, json.loads(bytes(body).decode("utf-8"))

    def commit(self, base: int, state: dict) -> int:
        """Make ``state`` the version after ``base``."""
        fs, aside = self._at(f"versions/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode("utf-8")))
        stream.close()
        _, place = self._at(f"versions/{base + 1:012d}.json")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(place), options)
        except Exception as failed:
            fs.delete(aside, False)
            if base + 1 in self.versions():
                raise WriteConflict(f"version {base + 1} exists") from failed
            raise
        return base + 1

    def stage(self, df: DataFrame, name: str, *partition_by: str) -> str:
        """Write a part; its name, to be put in a state."""
        part = f"parts/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{part}")
        return part

    def read(self, parts: list[str], schema: T.StructType) -> DataFrame:
        """The rows of some parts; none give an empty table."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def vacuum(self, keep: int = 1) -> None:
        """Remove versions but the last ``keep``, and parts that none of those names. Not while a writer is at work."""
        known = self.versions()
        named = json.dumps([self.state(v)[1] for v in known[-keep:]])
        for v in known[:-keep]:
            fs, place = self._at(f"versions/{v:012d}.json")
            fs.delete(place, False)
        for part in self.names("parts"):
            if part not in named:
                fs, place = self._at(f"parts/{part}")
                fs.delete(place, True)


class VersionedTable:
    """A table in hash buckets of its key columns: replacing the rows of some keys rewrites their buckets only."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.folder, self.keys, self.buckets = VersionedFolder(spark, path), keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        _, state = self.folder.state(version)
        if not state:
            raise ValueError("the table has no version yet")
        return self.folder.read(sorted(state["parts"].values()), T.StructType.fromJson(state["schema"]))

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """New version: ``rows`` in place of all rows with their keys; keys of ``gone`` lose their rows too."""
        base, state = self.folder.state()
        schema = T.StructType.fromJson(state["schema"]) if state else rows.schema
        rows = rows.select(*schema.names)
        keys = rows.select(*self.keys)
        keys = (keys if gone is None else keys.union(gone.select(*self.keys))).distinct()
        keyed = self.folder.read([self.folder.stage(keys.withColumn("__b", self.bucket()), "keys")], T.StructType([*keys.schema.fields, T.StructField("__b", T.IntegerType())]))
        touched = sorted(r["__b"] for r in keyed.select("__b").distinct().collect())  # as many as buckets at most
        if not touched:
            return base
        parts = dict(state.get("parts", {}))
        old = self.folder.read([parts[str(b)] for b in touched if str(b) in parts], schema)
        same = [old[k].eqNullSafe(keyed[k]) for k in self.keys]
        kept = old.join(keyed, same, "left_anti")
        part = self.folder.stage(kept.unionByName(rows).withColumn("__b", self.bucket()), "rows", "__b")
        there = self.folder.names(part)
        for b in touched:
            parts.pop(str(b), None)
            if f"__b={b}" in there:
                parts[str(b)] = f"{part}/__b={b}"
        return self.folder.commit(base, {"schema": schema.jsonValue(), "parts": parts})
