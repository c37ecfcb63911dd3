"""Stored tables that change by batches: hash buckets, a manifest, a change log.

Parquet files have no MERGE. A table here is dealt into buckets by a hash of its lookup
columns, and a change writes anew the buckets that its rows fall in, no others: rows of other
buckets are neither read nor written. Below a store's path stand

    data/<table>/v=<n>/bucket=<b>/   the rows of bucket b as version n left them
    log/v=<n>/                       what version n changed in the logged table: a row a change
    _manifest/<n>.json               which version of each bucket counts, and the batches seen

A version counts from the moment its manifest stands under its name; what a failed attempt
wrote is overwritten by the next one. A reader that holds an older manifest keeps its files
until ``vacuum``. The log of a version is made ready first and moved into place after the
manifest; a move that a failure left out is made up for by the next writer. One writer at a
time: a second one finds its version's manifest taken and fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """A table of a store: rows are known by ``identity`` (not null, unique) and dealt out by ``lookup``."""

    name: str
    schema: str
    identity: str
    lookup: tuple[str, ...]
    buckets: int = 64
    logged: bool = False

    def bucket(self) -> Column:
        """A row's bucket. Where a lookup column is null the identity decides, so that such rows don't fall together."""
        known = F.lit(True)
        for c in self.lookup:
            known = known & F.col(c).isNotNull()
        key = F.when(known, F.concat_ws("|", *(F.col(c).cast("string") for c in self.lookup))).otherwise(F.concat(F.lit("#"), F.col(self.identity).cast("string")))
        return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")


class Store:
    """The tables below a path, read and changed together."""

    def __init__(self, spark: SparkSession, path: str, tables: Iterable[Table]):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {t.name: t for t in tables}
        logged = [t for t in self.tables.values() if t.logged]
        if len(logged) > 1:
            raise ValueError("one table of a store can be logged")
        self._logged = logged[0] if logged else None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; an empty one before the first."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return {"version": -1, "buckets": {t: {} for t in self.tables}, "batches": {}}
        found = self._fs.open(self._path(f"{self.path}/_manifest/{version:010d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def _publish(self, manifest: dict) -> None:
        name = f"{self.path}/_manifest/{manifest['version']:010d}.json"
        half = self._path(f"{self.path}/_manifest/_{manifest['version']:010d}")
        out = self._fs.create(half, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(half, self._path(name)):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by another writer")

    # Reading

    def read(self, table: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets, as a version left it."""
        spec = self.tables[table]
        held = self.manifest(version)["buckets"].get(table, {})
        wanted = sorted(map(int, held)) if buckets is None else sorted({b for b in buckets if str(b) in held})
        paths = [f"{self.path}/data/{table}/v={held[str(b)]}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], spec.schema)
        return self.spark.read.schema(spec.schema).parquet(*paths)

    def near(self, table: str, rows: DataFrame) -> DataFrame:
        """The buckets of a table that ``rows`` (with its lookup columns and identity) fall in; no more are opened."""
        return self.read(table, self._touched(self.tables[table], rows))

    def _touched(self, spec: Table, rows: DataFrame) -> list[int]:
        """At most ``spec.buckets`` numbers."""
        return [r[0] for r in rows.select(spec.bucket().alias("b")).distinct().collect()]

    def log(self) -> DataFrame:
        """All changes: op (insert, update, delete), version, and the row after the change (before it, for a delete)."""
        return self.spark.read.schema(self._log_schema()).parquet(f"{self.path}/log")

    def log_stream(self, versions_per_trigger: int = 1) -> DataFrame:
        """The change log as a stream: each version's changes once, as it is published."""
        return self.spark.readStream.schema(self._log_schema()).option("maxFilesPerTrigger", versions_per_trigger).parquet(f"{self.path}/log")

    def _log_schema(self) -> StructType:
        if self._logged is None:
            raise ValueError("no table of this store is logged")
        return StructType.fromDDL(f"op string, {self._logged.schema}, v long")

    # Writing

    def staged(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written once below the store, for plans that use them more than once; the next version clears it."""
        path = f"{self.path}/_staged/v={self.manifest()['version'] + 1}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def seen(self, source: str, batch: int) -> bool:
        return self.manifest()["batches"].get(source, -1) >= batch

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], source: str | None = None, batch: int = 0) -> dict[str, list[int]]:
        """Write a version. ``changes`` gives for a table its rows to put (whole rows, by identity) and
        its rows to take away (identity and lookup columns). Returns the buckets written of each table.

        A batch of a source that a version already holds changes nothing. Both frames should be
        staged: they are read twice.
        """
        self.recover()
        if source is not None and self.seen(source, batch):
            return {t: [] for t in changes}
        old = self.manifest()
        version = old["version"] + 1
        new = {"version": version, "buckets": {t: dict(b) for t, b in old["buckets"].items()}, "batches": dict(old["batches"])}
        if source is not None:
            new["batches"][source] = batch
        written = {}
        for name, (put, take) in changes.items():
            written[name] = self._rewrite(self.tables[name], put, take, version, new["buckets"].setdefault(name, {}))
        self._publish(new)
        self.recover()
        self._fs.delete(self._path(f"{self.path}/_staged/v={version}"), True)
        return written

    def _rewrite(self, spec: Table, put: DataFrame | None, take: DataFrame | None, version: int, buckets: dict[str, int]) -> list[int]:
        columns = StructType.fromDDL(spec.schema).fieldNames()
        gone = [d.select(spec.identity, *(c for c in spec.lookup if c != spec.identity)) for d in (put, take) if d is not None]
        moved = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        touched = self._touched(spec, moved)
        current = self.read(spec.name, touched)
        rows = current.join(moved.select(spec.identity), spec.identity, "left_anti").select(*columns)
        if put is not None:
            rows = rows.unionByName(put.select(*columns))
        target = f"{self.path}/data/{spec.name}/v={version}"
        if touched:
            rows.withColumn("bucket", spec.bucket()).repartition(len(touched), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(target)
        if spec.logged:
            self._log(spec, current, put, take, version, columns)
        for b in touched:
            if self._fs.exists(self._path(f"{target}/bucket={b}")):
                buckets[str(b)] = version
            else:
                buckets.pop(str(b), None)
        return sorted(touched)

    def _log(self, spec: Table, current: DataFrame, put: DataFrame | None, take: DataFrame | None, version: int, columns: list[str]) -> None:
        parts = []
        if put is not None:
            held = current.select(spec.identity, F.lit(True).alias("__held"))
            op = F.when(F.col("__held"), "update").otherwise("insert").alias("op")
            parts.append(put.join(held, spec.identity, "left").select(op, *columns))
        if take is not None:
            parts.append(current.join(take.select(spec.identity), spec.identity, "left_semi").select(F.lit("delete").alias("op"), *columns))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rows.withColumn("v", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.path}/_pending/v={version}")

    def recover(self) -> None:
        """Publish the log of a version whose writer stopped after its manifest."""
        version = max(self.versions(), default=-1)
        ready, public = self._path(f"{self.path}/_pending/v={version}"), f"{self.path}/log"
        if version >= 0 and self._fs.exists(ready):
            self._fs.mkdirs(self._path(public))
            # File by file into one folder: a stream of the folder sees each as it comes.
            for status in self._fs.listStatus(ready):
                name = status.getPath().getName()
                if name.startswith("part-"):
                    self._fs.rename(status.getPath(), self._path(f"{public}/v{version:010d}-{name}"))
            self._fs.delete(ready, True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete buckets that none of the newest ``keep`` versions reads, and older manifests; how many folders went."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        gone = 0
        for name in self.tables:
            used = {(v, int(b)) for m in kept for b, v in m["buckets"].get(name, {}).items()}
            folder = self._path(f"{self.path}/data/{name}")
            for v in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                number = int(v.getPath().getName().removeprefix("v="))
                for b in self._fs.listStatus(v.getPath()):
                    part = b.getPath().getName()
                    if part.startswith("bucket=") and number <= versions[-1] and (number, int(part.removeprefix("bucket="))) not in used:
                        self._fs.delete(b.getPath(), True)
                        gone += 1
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_manifest/{v:010d}.json"), False)
        return gone
