"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards and never changed. Shards belong to tiers by size (each tier `fan_in`
times the one before); when a tier holds `fan_in` runs of similar size they are merged into new files of about the
target size, and so on upwards; a run that has reached the target size is left alone. Every change is a new manifest
version, written to a temporary file and renamed to its number without overwriting, so of two writers one wins and the
other starts over.

vacuum() removes the shards that only versions older than the last `keep_versions` name. The name of such a version
stays, as a stub without shards, so that a late writer who started from it still meets a conflict. A reader may hold a
version with pinned(); without that it can rely on the kept ones. A shard that no version ever named belongs to a
writer that hasn't committed yet, or never will, and goes only when it is older than `orphan_seconds`.

A merge reads its runs and writes them without a shuffle, as many tasks as target-sized files; no key decides
where a row goes, so a source or key with a third of all rows changes nothing. The driver holds file names, sizes and
row counts alone. A failed task or executor leaves files that no manifest names. Renaming without overwriting is atomic
on HDFS and local disks; an object store without it needs a store with conditional writes for the manifest folder.

Edge cases: rows are kept as they are, with nulls, empty and long texts, repeated rows and columns of any name; an
empty arrival commits a version without a new shard; an empty store reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapoint.llm.common import fresh, hadoop_path, read_text, write_once


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class VersionRemoved(ValueError):
    """The version's shards may be gone."""


@dataclass(frozen=True)
class Shard:
    """One run: a folder of Parquet files that were written together."""

    name: str
    bytes: int
    rows: int


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, first_tier_bytes: int = 4 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.first_tier_bytes = target_bytes, fan_in, first_tier_bytes

    # Manifests: plain JSON, one file a version.

    def _file(self, version: int) -> str:
        return f"{self.path}/_manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/_manifest")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName()[:-5].isdigit() and f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "shards": []}
        found = json.loads(read_text(self.spark, self._file(known[-1] if version is None else version)))
        if found.get("removed"):
            raise VersionRemoved(f"version {found['version']} was vacuumed")
        return found

    def _commit(self, base: dict, schema: T.StructType, shards: list[Shard], what: str) -> dict:
        new = {"version": base["version"] + 1, "parent": base["version"], "what": what, "schema": schema.jsonValue(), "shards": [vars(s) for s in shards]}
        if not write_once(self.spark, self._file(new["version"]), json.dumps(new)):
            raise CommitConflict(f"version {new['version']} exists")
        return new

    def _replace(self, version: int, text: str) -> None:
        """Writes a manifest anew; its name is there all the while."""
        fs, p = hadoop_path(self.spark, self._file(version))
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    # Pins: one file for each reader that holds a version.

    def _pins(self, pin_seconds: float) -> set[int]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/_pins")
        oldest = (time.time() - pin_seconds) * 1000
        return {int(f.getPath().getName().partition("-")[0]) for f in (fs.listStatus(folder) if fs.exists(folder) else []) if f.getModificationTime() >= oldest and not f.getPath().getName().startswith(".") and not f.getPath().getName().endswith(".tmp")}

    @contextmanager
    def pinned(self, version: int | None = None) -> Iterator[DataFrame]:
        """The rows of a version, whose files stay until the block ends."""
        held = self.manifest(version)["version"]
        path = f"{self.path}/_pins/{held:012d}-{uuid.uuid4().hex}"
        write_once(self.spark, path, "")
        try:
            yield self.read(held)  # raises if vacuum() was faster than the pin
        finally:
            fs, p = hadoop_path(self.spark, path)
            fs.delete(p, False)

    def _write(self, df: DataFrame) -> Shard | None:
        name = f"shard-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        size = sum(f.getLen() for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet"))
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").count()
        if rows:
            return Shard(name, size, rows)
        fs.delete(p, True)
        return None

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _read(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was committed yet")
        return self._read([Shard(**s) for s in m["shards"]], T.StructType.fromJson(m["schema"]))

    # Changes.

    def append(self, df: DataFrame, attempts: int = 5) -> dict:
        """One more shard. The write happens once; only the commit is tried again when another writer was first."""
        made = self._write(df)
        for attempt in range(attempts):
            base = self.manifest()
            schema = T.StructType.fromJson(base["schema"]) if base["schema"] else df.schema
            if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError("the arrival's columns differ from the store's")
            try:
                return self._commit(base, schema, [Shard(**s) for s in base["shards"]] + [made] * bool(made), "append")
            except CommitConflict:
                if attempt == attempts - 1:
                    raise
        raise AssertionError

    def tier(self, shard: Shard) -> int:
        return 0 if shard.bytes <= self.first_tier_bytes else 1 + int(math.log(shard.bytes / self.first_tier_bytes, self.fan_in))

    def _due(self, shards: list[Shard]) -> list[Shard]:
        """The runs of the lowest full tier, oldest first. Runs of the target size and beyond have grown up."""
        tiers: dict[int, list[Shard]] = {}
        for s in [s for s in shards if s.bytes < self.target_bytes]:
            tiers.setdefault(self.tier(s), []).append(s)
        for t in sorted(tiers):
            if len(tiers[t]) >= self.fan_in:
                return tiers[t]
        return []

    def compact(self) -> dict:
        """Merges full tiers until none is left; each merge is one commit."""
        base = self.manifest()
        while due := self._due([Shard(**s) for s in base["shards"]]):
            schema = T.StructType.fromJson(base["schema"])
            pieces = max(1, -(-sum(s.bytes for s in due) // self.target_bytes))
            merged = self._write(self._read(due, schema).coalesce(pieces))
            gone = {s.name for s in due}
            kept = [s for s in map(lambda x: Shard(**x), base["shards"]) if s.name not in gone]
            try:
                base = self._commit(base, schema, kept + [merged], f"merge {len(due)}")
            except CommitConflict:
                base = self.manifest()  # the merged runs may have changed: look again
        return base

    def vacuum(self, keep_versions: int = 1, orphan_seconds: float = 86_400.0, pin_seconds: float = 604_800.0) -> list[str]:
        """Removes the shards that only older versions than the last `keep_versions` name, pinned ones apart, and
        shards that no version names once they are older than `orphan_seconds`."""
        known = self.versions()
        manifests = {v: json.loads(read_text(self.spark, self._file(v))) for v in known}
        old = [v for v in known[:-keep_versions] if not manifests[v].get("removed")]
        pins = self._pins(pin_seconds)
        removed, kept = [], [v for v in known if v in pins or v not in old]
        for v in old:
            if v in pins:
                continue
            self._replace(v, json.dumps({"version": v, "removed": True}))
            removed.append(v)
        for v in [v for v in removed if v in self._pins(pin_seconds)]:  # a reader came meanwhile
            self._replace(v, json.dumps(manifests[v]))
            removed.remove(v)
            kept.append(v)
        names = lambda versions: {s["name"] for v in versions for s in manifests[v].get("shards", [])}
        held, ever = names(kept), names(known)
        fs, root = hadoop_path(self.spark, self.path)
        oldest = (time.time() - orphan_seconds) * 1000
        gone = []
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("shard-") and name not in held and (name in ever or f.getModificationTime() < oldest):
                fs.delete(f.getPath(), True)
                gone.append(name)
        return gone


def compacted(store: ShardStore, arrivals: list[DataFrame]) -> DataFrame:
    """All arrivals appended, compacting after each; the rows of the last version, each with the shard that holds it."""
    for df in arrivals:
        store.append(df)
        store.compact()
        store.vacuum()
    last = store.manifest()
    rows = store.read(last["version"])
    # Rows of an empty store come from no file, which would have a name.
    name = F.regexp_extract(F.col("_metadata.file_path"), "(shard-[0-9a-f]+)/", 1) if last["shards"] else F.lit("")
    return rows.select("*", name.alias(fresh(rows.columns, "shard")), F.lit(last["version"]).alias(fresh(rows.columns, "version")))
