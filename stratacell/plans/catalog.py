"""Table definitions beside the data, one JSON file each, on any file system that Spark reads."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from .model import TableSchema


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        """Replaces a file as a whole: readers see the old one or the new one."""
        path, fs = self._path(name)
        fresh, _ = self._path(f"{name}.{uuid.uuid4().hex[:8]}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fs_of = self.spark._jvm.org.apache.hadoop.fs
        overwrite = self.spark.sparkContext._gateway.new_array(fs_of.Options.Rename, 1)
        overwrite[0] = fs_of.Options.Rename.OVERWRITE
        fs_of.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, path, overwrite)

    def _read(self, name: str) -> str | None:
        path, fs = self._path(name)
        if not fs.exists(path):
            return None
        jvm, stream = self.spark._jvm, fs.open(path)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def log_path(self, name: str) -> str:
        return f"{self.root}/{name}/{self.describe(name).folder}"

    def create(self, schema: TableSchema) -> None:
        if self.exists(schema.name):
            raise ValueError(f"table exists [{schema.name}]")
        self.save(schema)

    def save(self, schema: TableSchema) -> None:
        self._write(f"{schema.name}/schema.json", json.dumps(asdict(schema)))

    def exists(self, name: str) -> bool:
        return self._read(f"{name}/schema.json") is not None

    def describe(self, name: str) -> TableSchema:
        text = self._read(f"{name}/schema.json")
        if text is None:
            raise ValueError(f"no such table [{name}]")
        pairs = lambda v: tuple(tuple(x) if isinstance(x, list) else x for x in v)
        return TableSchema(**{k: pairs(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def drop(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def names(self) -> list[str]:
        path, fs = self._path()
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in found if self.exists(n))

    def add_column(self, name: str, column: str) -> TableSchema:
        schema = self.describe(name)
        out = replace(schema, columns=(*schema.columns, column))
        self.save(out)
        return out

    def tables(self) -> DataFrame:
        rows = [(s.name, s.owner, s.num_versions, s.comment) for s in map(self.describe, self.names())]
        return self.spark.createDataFrame(rows, "name string, owner string, version int, comment string")

    def columns(self, name: str) -> DataFrame:
        s = self.describe(name)
        kinds = dict(s.kinds)
        return self.spark.createDataFrame([(name, c, kinds.get(c, "normal")) for c in s.columns], "table_name string, column_name string, kind string")

    def users(self) -> list[str]:
        return json.loads(self._read("_users.json") or "[]")

    def set_users(self, users: list[str]) -> None:
        self._write("_users.json", json.dumps(sorted(set(users))))
