"""Tables that change together: folders of versions, and one manifest that says which are current.

A change writes new folders beside the old ones and then renames one manifest file into
place. Until then readers see the old state of every table, and after it the new state of
every table; a job that fails in between leaves folders that no manifest names, which
`vacuum` deletes. One writer at a time: a writer whose version was taken meanwhile gets an error.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NULL = "__HIVE_DEFAULT_PARTITION__"


class TableSet:
    """Named tables under a root folder; a table may be laid out by one column, its scope."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The current version, 0 before the first change."""
        return max([0, *(int(n[9:-5]) for n in self._names(self.root) if n.startswith("manifest-") and n.endswith(".json"))])

    def _stored(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}, "note": {}}
        rows = self.spark.read.text(f"{self.root}/manifest-{version:09d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def manifest(self, version: int | None = None) -> dict:
        """Table name -> its schema, scope column and parts (folders under the table, by scope value) at a version."""
        return self._stored(version)["tables"]

    def note(self, key: str, default=None):
        """What the changes so far noted under a key, such as the last batch of a stream."""
        return self._stored()["note"].get(key, default)

    def _read(self, name: str, t: dict, scope: list | None) -> DataFrame:
        kind = StructType.fromJson(t["schema"])
        wanted = None if scope is None else {None if v is None else str(v) for v in scope}
        parts = [p for v, p in t["parts"] if wanted is None or v in wanted]
        if not parts:
            return self.spark.createDataFrame([], kind)
        base = f"{self.root}/{name}"
        df = self.spark.read.schema(StructType([*kind.fields]).add("_v", "string")).option("basePath", base).parquet(*[f"{base}/{p}" for p in parts])
        return df.select(*kind.names)

    def read(self, name: str, version: int | None = None, scope: list | None = None) -> DataFrame:
        """A table at a version; with a scope, only the folders of those values are read."""
        return self._read(name, self.manifest(version)[name], scope)

    def change(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last `keep` manifests names, and older manifests; returns what went."""
        now, gone = self.version(), []
        live = {f"{name}/{p.split('/')[0]}" for v in range(max(1, now - keep + 1), now + 1) for name, t in self.manifest(v).items() for _, p in t["parts"]}
        for name in self._names(self.root):
            if name.startswith("manifest-") or name.startswith("."):
                if name.startswith(".") or int(name[9:-5]) <= now - keep:
                    gone.append(name)
            else:
                gone += [f"{name}/{v}" for v in self._names(f"{self.root}/{name}") if f"{name}/{v}" not in live]
        for g in gone:
            fs, p = self._fs(f"{self.root}/{g}")
            fs.delete(p, True)
        return sorted(gone)


class Change:
    """New contents of some tables, written at once and shown together by commit()."""

    def __init__(self, tables: TableSet):
        self.tables, self.base = tables, tables.version()
        was = tables._stored(self.base)
        self.new, self.note = was["tables"], was["note"]

    def _write(self, name: str, df: DataFrame, by: str | None) -> list[list]:
        folder = f"_v={self.base + 1}-{uuid.uuid4().hex[:8]}"
        path = f"{self.tables.root}/{name}/{folder}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        if not by:
            return [[None, folder]]
        found = [n.split("=", 1)[1] for n in self.tables._names(path) if n.startswith(f"{by}=")]
        return [[None if v == _NULL else unquote(v), f"{folder}/{by}={v}"] for v in found]

    def replace(self, name: str, df: DataFrame, by: str | None = None) -> Change:
        """The whole table is df from now on, laid out by a column."""
        self.new[name] = {"schema": json.loads(df.schema.json()), "by": by, "parts": self._write(name, df, by)}
        return self

    def replace_scope(self, name: str, df: DataFrame, scope: list) -> Change:
        """The rows whose scope column has one of the values are those of df from now on; values that df does not hold become empty. Rows of df outside the scope are an error."""
        t = self.new[name]
        by = t["by"]
        inside = F.col(by).isin([v for v in scope if v is not None]) | (F.col(by).isNull() if None in scope else F.lit(False))
        kind = StructType.fromJson(t["schema"])
        held = self._write(name, df.select(*kind.names).withColumn(by, F.when(F.coalesce(inside, F.lit(False)), F.col(by)).otherwise(F.raise_error(F.lit(f"a row of {name} is outside the scope")).cast(kind[by].dataType))), by)
        names = {None if v is None else str(v) for v in scope}
        self.new[name] = t | {"parts": [p for p in t["parts"] if p[0] not in names] + held}
        return self

    def drop_scope(self, name: str, scope: list) -> Change:
        """No rows of these values; nothing is written."""
        names = {None if v is None else str(v) for v in scope}
        self.new[name] = self.new[name] | {"parts": [p for p in self.new[name]["parts"] if p[0] not in names]}
        return self

    def read(self, name: str, scope: list | None = None) -> DataFrame:
        """A table as this change has it so far."""
        return self.tables._read(name, self.new[name], scope)

    def commit(self, **note) -> int:
        """Show the change, with notes beside it; returns its version."""
        v, t = self.base + 1, self.tables
        fs, draft = t._fs(f"{t.root}/.draft-{uuid.uuid4().hex}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"tables": self.new, "note": self.note | note}).encode()))
        out.close()
        target = t._fs(f"{t.root}/manifest-{v:09d}.json")[1]
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {v} was taken by another change")
        return v
