"""A spatial table in versioned generations.

A generation is a Parquet folder partitioned by leaf. Inserts add delta folders, removals add tombstone folders, and
every change is a new manifest (JSON, written once under its number), so that readers keep what they opened and of two
writers one starts over. A rewrite (migration) reads everything visible and writes a new generation under another
layout; ids and answers stay. Inserts that have left many deltas end in a rewrite under the same layout, and vacuum()
removes folders that only old versions name."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapoint.operators import aggregate, bloom, layouts, query
from terrapoint.plans import adapt
from terrapoint.staging import hadoop_path, read_text, write_once
from terrapoint.types import BBox, SnapshotError, SpatialConfig, axes, layout_name

FORMAT = 1
LOG = "kind string, selectivity double, hit boolean, latency_ns long, ts long"


class ConcurrentChange(RuntimeError):
    """Another writer changed the table first."""


class SpatialIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = self._latest()
        self.noted: list[tuple] = []
        self._read: dict[str, object] = {}  # the generation's frame and leaf rows, by folder
        self.policy = adapt.Policy(self.state["layout"], self.config.migration_threshold, self.config.hysteresis_window)
        self.policy.frozen, self.policy.ticks = self.state["frozen"], self.state.get("ticks", 0)

    # Manifests.

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, dims: int, config: SpatialConfig | None = None) -> SpatialIndex:
        """A new table of df (id, x0.., payload) in the configured layout."""
        config = config or SpatialConfig()
        path = path.rstrip("/")
        schema = df.select("id", *axes(dims), *[c for c in df.columns if c not in {"id", *axes(dims)}]).schema
        state = {"format": FORMAT, "version": 0, "dims": dims, "layout": config.initial_layout, "config": asdict(config), "schema": schema.jsonValue(), "generation": None, "deltas": [], "tombstones": [], "next_id": 0, "frozen": False, "migrations": 0, "last_migration": None, "last_migration_at": None, "inserts": 0, "ticks": 0, "streams": {}}
        if not write_once(spark, f"{path}/_manifest/{0:012d}.json", json.dumps(state)):
            raise ConcurrentChange(f"{path} holds a table already")
        index = cls(spark, path)
        index._rewrite(df.select(*schema.names), config.initial_layout, migrations=0)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SpatialIndex:
        return cls(spark, path)

    def _versions(self) -> list[int]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/_manifest")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _latest(self) -> dict:
        versions = self._versions()
        if not versions:
            raise SnapshotError(f"{self.path} holds no table")
        try:
            state = json.loads(read_text(self.spark, f"{self.path}/_manifest/{versions[-1]:012d}.json"))
            if state["format"] != FORMAT:
                raise SnapshotError(f"format {state['format']} is unknown")
            axes(state["dims"])
            layout_name(state["layout"])
            SpatialConfig(**state["config"])
        except SnapshotError:
            raise
        except Exception as e:
            raise SnapshotError(f"the manifest can't be read: {e}") from e
        return state

    def _commit(self, **changes) -> None:
        state = self.state | changes
        state["version"] = self.state["version"] + 1
        if not write_once(self.spark, f"{self.path}/_manifest/{state['version']:012d}.json", json.dumps(state)):
            self.state = self._latest()
            raise ConcurrentChange(f"version {state['version']} exists; the table was opened anew")
        self.state = state

    @property
    def config(self) -> SpatialConfig:
        return SpatialConfig(**self.state["config"])

    @property
    def dims(self) -> int:
        return self.state["dims"]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    # Reading.

    def _folders(self, names: list[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _generation(self) -> DataFrame:
        """The rows of the present generation, with their leaf; its files are listed once."""
        name = self.state["generation"]
        if name not in self._read:
            with_leaf = T.StructType([*self.schema.fields, T.StructField("leaf", T.LongType())])
            self._read[name] = self.spark.read.schema(with_leaf).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return self._read[name]

    def leaf_rows(self) -> list[dict]:
        """The leaf table of the present generation, MOST_LEAVES rows at most, read once."""
        name = f"{self.state['generation']}-leaves"
        if name not in self._read:
            self._read[name] = [r.asDict() for r in self.leaves().collect()] if self.state["generation"] else []
        return self._read[name]

    def _met(self, box: BBox) -> list[dict]:
        return [r for r in self.leaf_rows() if all(r[f"lo{d}"] <= box.hi[d] and r[f"hi{d}"] >= box.lo[d] for d in range(self.dims))]

    def _visible(self, box: BBox | None = None) -> DataFrame:
        columns = self.schema.names
        parts = [self._folders(self.state["deltas"], self.schema)] if self.state["deltas"] else []
        if self.state["generation"]:
            base = self._generation()
            if box is not None:
                base = base.where(F.col("leaf").isin(sorted(r["leaf"] for r in self._met(box))))
            parts.append(base.select(*columns))
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)
        if self.state["tombstones"]:
            rows = query.remove(rows, self._folders(self.state["tombstones"], T.StructType([T.StructField("id", T.LongType())])))
        return rows

    def refresh(self) -> None:
        """Goes on from the newest version."""
        self.state = self._latest()

    def leaves(self) -> DataFrame:
        """The leaf table of the present generation."""
        return self.spark.read.parquet(f"{self.path}/{self.state['generation']}-leaves")

    def all_entries(self) -> DataFrame:
        return self._visible()

    def range_query(self, box: BBox) -> DataFrame:
        """Rows in the closed box, from the leaves that it meets. What is noted of the query is the share of rows in
        those leaves."""
        began = time.perf_counter_ns()
        total, met = sum(r["n"] for r in self.leaf_rows()), sum(r["n"] for r in self._met(box))
        found = query.range_query(self._visible(box), box)
        self.observe("range", met / total if total else 0.0, met > 0, time.perf_counter_ns() - began)
        return found

    def knn(self, point, k: int) -> DataFrame:
        began = time.perf_counter_ns()
        n = sum(r["n"] for r in self.leaf_rows())
        found = query.knn(self._visible(), point, k)
        self.observe("knn", min(k / n, 1.0) if n else 0.0, n > 0, time.perf_counter_ns() - began)
        return found

    def answer(self, found: DataFrame) -> list:
        """The rows of the query asked last, for results that fit the caller; its noted latency is then the whole of
        planning and running. Frames that are run elsewhere keep the time of their planning."""
        began = time.perf_counter_ns()
        rows = found.collect()
        if self.noted:
            kind, selectivity, hit, latency, ts = self.noted.pop()
            self.noted.append((kind, selectivity, hit, latency + time.perf_counter_ns() - began, ts))
        return rows

    def nearest(self, point) -> DataFrame:
        return self.knn(point, 1)

    def spatial_join(self, other: SpatialIndex) -> DataFrame:
        began = time.perf_counter_ns()
        found = query.spatial_join(self._visible(), other._visible(), self.dims)
        self.observe("join", 1.0, True, time.perf_counter_ns() - began)
        return found

    # Observations: what was asked, for the mix of queries.

    def observe(self, kind: str, selectivity: float, hit: bool, latency_ns: int = 0) -> None:
        """Notes one query; flush_observations() writes what was noted."""
        self.noted.append((kind, float(selectivity), bool(hit), int(latency_ns), time.time_ns()))

    def flush_observations(self) -> None:
        if self.noted:
            self.spark.createDataFrame(self.noted, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/_observations")
            self.noted.clear()

    def log(self) -> DataFrame:
        """kind, selectivity, hit, latency_ns, ts of every observation."""
        self.flush_observations()
        fs, folder = hadoop_path(self.spark, f"{self.path}/_observations")
        return self.spark.read.schema(LOG).parquet(f"{self.path}/_observations") if fs.exists(folder) else self.spark.createDataFrame([], LOG)

    def count(self) -> int:
        return self._visible().count()

    def is_empty(self) -> bool:
        return self._visible().isEmpty()

    # Writing.

    def insert(self, df: DataFrame, order: list[str] | None = None, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows, stream: tuple[str, int] | None = None) -> tuple[int, int]:
        """Adds rows (x0.. and payload); returns their ids as (first, past the last). finish gets the rows with their
        ids before they are written; stream (name, batch number) is committed with them."""
        names = [n for n in self.schema.names if n != "id"]
        first = self.state["next_id"]
        order = order or names
        rows = query.numbered(df.select(*dict.fromkeys([*names, *order])).withColumnsRenamed({"id": "order_id"}), ["order_id" if c == "id" else c for c in order], first)
        folder = f"delta-{uuid.uuid4().hex}"
        finish(rows).select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        added = self._folders([folder], self.schema).count()
        streams = self.state.get("streams", {}) | ({stream[0]: stream[1]} if stream else {})
        self._commit(deltas=[*self.state["deltas"], *([folder] if added else [])], next_id=first + added, inserts=self.state.get("inserts", 0) + added, streams=streams)
        if len(self.state["deltas"]) + len(self.state["tombstones"]) >= self.config.most_deltas:
            self.compact()
        return first, first + added

    def remove(self, ids: DataFrame) -> DataFrame:
        """Removes rows by id and returns them; unknown ids change nothing."""
        gone = query.removed(self._visible(), ids)
        folder = f"tombstone-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("long")).distinct().write.parquet(f"{self.path}/{folder}")
        self._commit(tombstones=[*self.state["tombstones"], folder])
        return gone

    def clear(self) -> None:
        """Empties the table and the observations; settings, the frozen flag and the count of migrations stay."""
        self._commit(generation=None, deltas=[], tombstones=[], next_id=0, inserts=0, ticks=0)
        self.policy.ticks = 0
        self.noted.clear()
        fs, folder = hadoop_path(self.spark, f"{self.path}/_observations")
        fs.delete(folder, True)

    def _rewrite(self, rows: DataFrame, layout: str, **changes) -> None:
        made = layouts.fit(layout, rows, self.dims, self.config.leaf_rows)
        assigned = made.assign(rows)
        name = f"generation-{uuid.uuid4().hex}"
        layouts.clustered(assigned, self.dims, aggregate.extent_box(rows, self.dims)[1]).write.partitionBy("leaf").parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(assigned.schema).parquet(f"{self.path}/{name}")
        layouts.leaf_table(written, self.dims).write.parquet(f"{self.path}/{name}-leaves")
        top = written.agg(F.max("id")).first()[0]
        self._commit(generation=name, deltas=[], tombstones=[], layout=layout, next_id=max(self.state["next_id"], 0 if top is None else top + 1), **changes)

    def compact(self) -> None:
        """A generation in place of the present one with its deltas and tombstones, under the same layout."""
        self._rewrite(self._visible(), self.state["layout"])

    def vacuum(self, keep_versions: int = 2, orphan_seconds: float = 86_400.0) -> list[str]:
        """Removes folders that only older versions than the last `keep_versions` name, and folders that no version
        names, left by writers that never committed, once they are older than `orphan_seconds`. Manifests stay."""
        versions = self._versions()
        named: list[set[str]] = []
        for v in versions:
            state = json.loads(read_text(self.spark, f"{self.path}/_manifest/{v:012d}.json"))
            generation = [state["generation"], f"{state['generation']}-leaves"] if state["generation"] else []
            named.append({*generation, *state["deltas"], *state["tombstones"]})
        kept, ever = set().union(*named[-keep_versions:]), set().union(*named)
        fs, root = hadoop_path(self.spark, self.path)
        oldest, gone = (time.time() - orphan_seconds) * 1000, []
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith(("generation-", "delta-", "tombstone-")) and name not in kept and (name in ever or f.getModificationTime() < oldest):
                fs.delete(f.getPath(), True)
                gone.append(name)
        return gone

    def force_layout(self, name: str) -> None:
        """Rewrites the table in another layout."""
        target = layout_name(name)
        self.policy.started()
        began = time.time()
        try:
            self._rewrite(self._visible(), target, migrations=self.state["migrations"] + 1, ticks=0)
            self._commit(last_migration=time.time() - began, last_migration_at=int(time.time() * 1000))
        finally:
            self.policy.completed(self.state["layout"])

    def freeze(self) -> None:
        self._commit(frozen=True)
        self.policy.frozen = True

    def unfreeze(self) -> None:
        self._commit(frozen=False)
        self.policy.frozen = False

    def adapt(self, log: DataFrame | None = None) -> tuple[str, float] | None:
        """One tick of the policy over the present shape and the observed queries; carries out what it recommends."""
        if self.state["frozen"]:
            return None
        found = self.policy.tick(adapt.data_shape(self._visible(), self.dims, self.log() if log is None else log, self.config.reservoir_size))
        if found:
            self.force_layout(found[0])
        else:
            self._commit(ticks=self.policy.ticks)
        return found

    # Facts.

    def shape(self) -> adapt.DataShape:
        return adapt.data_shape(self._visible(), self.dims, self.log(), self.config.reservoir_size)

    def stats(self) -> DataFrame:
        """One row: layout, points, dims, queries, inserts, mean and last latency, migrations, the last one's time (ms
        since 1970) and seconds, frozen, migrating, and the shape of the data."""
        state, shape = self.state, self.shape()
        asked = aggregate.latency(self.log()).first()
        facts = {
            "layout": state["layout"], "points": self.count(), "dims": self.dims, "queries": asked["queries"], "inserts": state.get("inserts", 0),
            "mean_latency_ns": asked["mean_ns"], "last_latency_ns": asked["last_ns"], "migrations": state["migrations"],
            "last_migration_at": state.get("last_migration_at"), "last_migration_s": state["last_migration"], "frozen": state["frozen"], "migrating": self.policy.migrating,
            "sampled": shape.point_count, "skewness": list(shape.skewness), "clustering": shape.clustering, "effective_dim": shape.effective_dim, "mean_selectivity": shape.mix.mean_selectivity,
        }
        schema = "layout string, points long, dims int, queries long, inserts long, mean_latency_ns long, last_latency_ns long, migrations int, last_migration_at long, last_migration_s double, frozen boolean, migrating boolean, sampled long, skewness array<double>, clustering double, effective_dim double, mean_selectivity double"
        return self.spark.createDataFrame([tuple(facts.values())], schema)

    def extent(self) -> DataFrame:
        return aggregate.extent(self._visible(), self.dims)

    def bloom(self) -> DataFrame:
        """Bloom words of the exact points."""
        return bloom.build(self._visible(), [F.col(a) + F.lit(0.0) for a in axes(self.dims)], self.config.bloom_bytes, self.config.bloom_hashes)
