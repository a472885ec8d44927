"""The registered spatial queries and their DuckDB counterparts.

Queries map the driver's tables to points: part (p_size, p_retailprice), customer (c_acctbal), lineitem (quantity,
price, discount, tax), events (epoch second, value), embeddings (first eight components), orders (price)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapoint.functions import geometry, keys
from terrapoint.operators import aggregate, bloom, layouts, query
from terrapoint.plans import adapt
from terrapoint.plans.index import SpatialIndex
from terrapoint.sources.points import load
from terrapoint.staging import scratch
from terrapoint.streaming.ingest import ingest, lines_stream, running_totals
from terrapoint.types import LAYOUT_NAMES, BBox, SpatialConfig, axes, layout_name

PART_BOX = BBox((10, 905), (30, 915))
PART_SQL = "(SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part)"
EVENT_SQL = "(SELECT event_id AS id, CAST(floor(epoch(ts)) AS DOUBLE) AS x0, value AS x1 FROM events)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return query.points(_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", [F.col("p_size"), F.col("p_retailprice")]).select("id", "x0", "x1")


def events(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "events").select("event_id", "value", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("s"))
    return query.points(t, "event_id", [F.col("s"), F.col("value")]).select("id", "x0", "x1")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "embeddings").select("vec_id", "embedding")
    return query.points(t, "vec_id", [F.get("embedding", F.lit(i)) for i in range(8)]).select("id", *axes(8))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return query.knn(query.range_query(parts(spark, d), PART_BOX), (20.0, 910.0), 20)


def _box_grid(spark: SparkSession) -> DataFrame:
    """60 boxes over the events: 6 by 10, of growing width, some of them overlapping."""
    n = spark.range(60)
    i, j = F.col("id") % 6, F.floor(F.col("id") / 6)
    start, day = 1_704_067_200.0, 86_400.0
    return n.select(F.col("id").alias("box_id"), (F.lit(start) + i * (5 * day)).alias("lo0"), (F.lit(start) + i * (5 * day) + (j + 1) * (day / 2)).alias("hi0"), (j * 45.0).cast("double").alias("lo1"), (j * 45.0 + 20.0 + i * 10.0).cast("double").alias("hi1"))


BOX_GRID_SQL = "(SELECT b AS box_id, 1704067200.0 + (b % 6) * 432000.0 AS lo0, 1704067200.0 + (b % 6) * 432000.0 + (b // 6 + 1) * 43200.0 AS hi0, (b // 6) * 45.0 AS lo1, (b // 6) * 45.0 + 20.0 + (b % 6) * 10.0 AS hi1 FROM range(60) t(b))"


def _log(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "events")
    kind = F.element_at(F.array(F.lit("range"), F.lit("knn"), F.lit("join")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.select(kind.alias("kind"), (F.col("value") / 1000).alias("selectivity"), (F.col("event_id") % 2 == 0).alias("hit"), F.col("event_id").alias("ts"), (F.col("event_id") % 977).alias("latency_ns"))


LOG_SQL = "(SELECT CASE event_id % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'knn' ELSE 'join' END AS kind, value / 1000 AS selectivity, event_id % 2 = 0 AS hit, event_id, event_id % 977 AS latency_ns FROM events)"


def range_1d(spark, d):
    p = query.points(_table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", [F.col("c_acctbal")])
    return query.range_query(p, BBox((0,), (1000,))).select("id", "x0")


def range_4d(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    p = query.points(_table(spark, d, "lineitem").select("l_orderkey", *names), "l_orderkey", [F.col(n) for n in names])
    return query.range_query(p, BBox((10, 10_000, 0.02, 0.01), (20, 20_000, 0.05, 0.04))).select("id", *axes(4))


_BUILT: dict[tuple[str, str, str], SpatialIndex] = {}


def _built(spark: SparkSession, d: str, name: str) -> SpatialIndex:
    """The parts as a table in a layout: written once a session, then only asked."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        _BUILT[key] = SpatialIndex.create(spark, scratch(spark, f"parts-{name}"), parts(spark, d), 2, SpatialConfig(initial_layout=name, leaf_rows=500))
    return _BUILT[key]


def _layout(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _built(spark, d, name).range_query(PART_BOX).select("id", "x0", "x1")


def _layout_stats(spark, d):
    """Leaves and the rows of the fullest one. Medians and tiles of tied coordinates have no closed form in SQL: for
    those layouts, whether the fullest leaf holds at most three times the mean (and -1 for the counts)."""
    p = parts(spark, d)
    out = None
    for name in sorted(layouts.LAYOUTS):
        assigned = layouts.fit(name, p, 2, 100).assign(p)
        table = layouts.leaf_table(assigned, 2)
        exact = name in ("grid", "quadtree")
        n, most = F.count(F.lit(1)), F.max("n")
        row = table.agg(F.sum("n").alias("points"), (n if exact else F.lit(-1).cast("long")).alias("leaves"), (most if exact else F.lit(-1).cast("long")).alias("most_rows"), (most <= F.lit(1000.0 if exact else 3.0) * F.sum("n") / n).alias("even"))
        row = row.select(F.lit(name).alias("layout"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _changed(spark, d, layout="kdtree"):
    """The parts without every seventh, and the suppliers inserted: (index, path)."""
    path = scratch(spark, f"changed-{layout}")
    index = SpatialIndex.create(spark, path, parts(spark, d), 2, SpatialConfig(initial_layout=layout, leaf_rows=500))
    new = _table(spark, d, "supplier").select(F.col("s_nationkey").cast("double").alias("x0"), F.col("s_acctbal").cast("double").alias("x1"), "s_suppkey")
    index.insert(new, ["s_suppkey"])
    index.remove(index.all_entries().where("id % 7 = 0").select("id"))
    return index, path


CHANGED_SQL = f"(SELECT * FROM (SELECT * FROM {PART_SQL} UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey) AS id, CAST(s_nationkey AS DOUBLE) AS x0, s_acctbal AS x1 FROM supplier) WHERE id % 7 <> 0)"


def index_entries(spark, d):
    return _changed(spark, d)[0].all_entries().select("id", "x0", "x1")


def index_range(spark, d):
    return _changed(spark, d, "rtree")[0].range_query(BBox((5, 900), (20, 3000))).select("id", "x0", "x1")


def index_removed(spark, d):
    index = _built(spark, d, "grid")
    return query.removed(index.all_entries(), index.range_query(PART_BOX).select("id")).select("id")


def index_migrated(spark, d):
    """All rows after a rewrite in every other layout, opened anew."""
    index, path = _changed(spark, d)
    for name in ("rtree", "quad", "grid"):
        index.force_layout(name)
    return SpatialIndex.open(spark, path).all_entries().select("id", "x0", "x1")


def index_stats(spark, d):
    index, _ = _changed(spark, d)
    index.force_layout("rtree")
    index.freeze()
    index.answer(index.knn((20.0, 910.0), 3))
    return index.stats().select("layout", "points", "dims", "queries", "inserts", "migrations", "frozen", "migrating", (F.col("mean_latency_ns") > 0).alias("timed"), F.col("last_migration_at").isNotNull().alias("migrated"))


def index_cleared(spark, d):
    index, path = _changed(spark, d)
    index.answer(index.range_query(PART_BOX))
    index.flush_observations()
    index.clear()
    again = SpatialIndex.open(spark, path)
    return spark.createDataFrame([(again.count(), again.is_empty(), again.log().count(), again.state["layout"])], "points long, empty boolean, queries long, layout string")


def index_adapted(spark, d):
    """A table whose policy may move at the second tick, over two openings."""
    path = scratch(spark, "adapted")
    SpatialIndex.create(spark, path, parts(spark, d), 2, SpatialConfig(initial_layout="grid", hysteresis_window=1, leaf_rows=500)).adapt()
    index = SpatialIndex.open(spark, path)
    index.adapt()
    return spark.createDataFrame([(index.state["layout"], index.state["migrations"], index.count())], "layout string, migrations long, points long")


def index_compacted(spark, d):
    """Rows inserted in three deltas; the third ends in a rewrite."""
    index = SpatialIndex.create(spark, scratch(spark, "compacted"), parts(spark, d).limit(0), 2, SpatialConfig(most_deltas=3, leaf_rows=500))
    for part in (0, 1, 2):
        index.insert(parts(spark, d).where(F.pmod("id", F.lit(3)) == part).select("x0", "x1"))
    index.vacuum(1)
    return index.all_entries().select("x0", "x1", F.lit(len(index.state["deltas"])).alias("deltas"))


def csv_source(spark, d):
    """Orders written as lines, with a label that holds a comma and blank ones, and read as points."""
    path = scratch(spark, "lines")
    label = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" o,"), F.col("o_orderkey").cast("string"))).otherwise("")
    lines = _table(spark, d, "orders").select(F.concat_ws(",", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), label).alias("value"))
    lines.unionByName(spark.createDataFrame([("x,y,label",), ("# note",), ("",), ("nan,1",), ("1",), ("1,zwei",)], "value string")).write.text(path)
    return load(spark, path).select("x0", "x1", F.when(F.col("label").startswith("o,"), F.col("label")).otherwise("default").alias("label"), (F.col("label") == F.concat(F.lit("pt"), F.col("id").cast("string"))).alias("numbered"))


def geojson_source(spark, d):
    path = scratch(spark, "shapes") + ".geojson"
    one = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.col("s_nationkey").cast("string"), F.lit(", "), F.col("s_suppkey").cast("string"), F.lit('.25, 9]}},{"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}'))
    _table(spark, d, "supplier").select(one.alias("value")).write.text(path)
    return load(spark, path).select("x0", "x1")


def parquet_source(spark, d):
    path = scratch(spark, "points") + ".parquet"
    parts(spark, d).write.parquet(path)
    return load(spark, path)


def stream_ingest(spark, d):
    """Events written as lines and streamed into a table, some files a batch; the stream is started twice."""
    folder, path = scratch(spark, "arrivals"), scratch(spark, "streamed")
    e = events(spark, d)
    e.repartition(6).select(F.concat_ws(",", F.col("x0").cast("long").cast("string"), F.col("x1").cast("string"), F.concat(F.lit("e"), F.col("id").cast("string"))).alias("value")).write.text(folder)
    index = SpatialIndex.create(spark, path, spark.createDataFrame([], "id long, x0 double, x1 double, label string"), 2, SpatialConfig(leaf_rows=5000))
    for _ in range(2):
        ingest(lines_stream(spark, folder, 2), index, f"{path}/_stream").awaitTermination()
    return SpatialIndex.open(spark, path).all_entries().select("x0", "x1", "label")


def cell_range(spark, d):
    lo0, hi0 = keys.cell_range(F.col("lo0"), F.col("hi0"), 86_400.0, 1_704_067_200.0)
    lo1, hi1 = keys.cell_range(F.col("lo1"), F.col("hi1"), 25.0)
    return _box_grid(spark).select("box_id", lo0.alias("first0"), hi0.alias("last0"), lo1.alias("first1"), hi1.alias("last1"))


def curve_order(spark, d):
    """Parts numbered along the space-filling curve over their extent's round numbers."""
    key = layouts.curve_key(2, BBox((0, 900), (64, 1000)))
    keyed = parts(spark, d).select(F.col("id").alias("part_id"), key.alias("key"))
    return query.numbered(keyed, ["key", "part_id"], 0).select(F.col("id").alias("place"), "part_id", "key")


def default_orders(spark, d):
    return spark.createDataFrame([(n, keys.default_order(n), keys.layout_order(n)) for n in range(1, 9)], "dims long, key_order long, layout_order long")


def layout_names(spark, d):
    return spark.createDataFrame([(n, layout_name(f" {n.upper()} ")) for n in LAYOUT_NAMES], "given string, layout string")


def _nations(spark, d, name: str, short: str) -> DataFrame:
    return query.points(_table(spark, d, name).select(f"{short}_{name[:4]}key", f"{short}_nationkey"), f"{short}_{name[:4]}key", [F.col(f"{short}_nationkey")]).select("id", "x0")


def batch_range(spark, d):
    return query.batch_range(events(spark, d), _box_grid(spark), 2, 43_200.0).select("box_id", "id")


def box_intersect_join(spark, d):
    boxes = _box_grid(spark)
    return query.box_intersect_join(boxes, boxes, 2, 43_200.0)


def knn_join(spark, d):
    p = parts(spark, d)
    asked = p.select(F.col("id").alias("query_id"), F.col("x0").alias("q0"), F.col("x1").alias("q1"))
    return query.knn_join(p, asked, 5, 2).select("query_id", "rank", "id", F.round("dist", 9).alias("dist"))


def geometry_columns(spark, d):
    p = parts(spark, d).select("id", *[(F.col(f"x{i}") - w).alias(f"a_lo{i}") for i, w in ((0, 3), (1, 2))], *[(F.col(f"x{i}") + w).alias(f"a_hi{i}") for i, w in ((0, 3), (1, 2))])
    p = p.withColumns({f"b_lo{i}": F.lit(v) for i, v in enumerate(PART_BOX.lo)} | {f"b_hi{i}": F.lit(v) for i, v in enumerate(PART_BOX.hi)})
    return p.select("id", geometry.intersects(2, "a_", "b_").alias("meets"), F.round(geometry.box_area(2, "a_"), 6).alias("area"), F.round(geometry.enlargement(2, "a_", "b_"), 6).alias("enlargement"), *geometry.merged(2, "a_", "b_"))


def moments_skewness(spark, d):
    m = aggregate.moments(events(spark, d), 2)
    return m.select("axis", F.round("mean", 3).alias("mean"), F.round(F.col("variance") / F.col("mean"), 4).alias("variance"), F.round("skewness", 5).alias("skewness"))


def percentiles(spark, d):
    return aggregate.nearest_rank(_table(spark, d, "events"), "value", [0, 25, 50, 75, 95, 99, 100])


def grid_density(spark, d):
    return aggregate.density(parts(spark, d), BBox((0, 900), (60, 1000)), 60, 20).select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "n")


def cell_occupancy(spark, d):
    return aggregate.occupancy(events(spark, d), [86_400.0, 10.0], [0.0, 0.0])


def grid_cell(spark, d):
    return parts(spark, d).select("id", keys.grid_cell(F.col("x0"), 7.0, -1.5).alias("cell0"), keys.grid_cell(F.col("x1"), 2.5, 950.0).alias("cell1"))


def quadrant(spark, d):
    return parts(spark, d).select("id", keys.quadrant([F.col("x0"), F.col("x1")], [F.lit(25.0), F.lit(910.0)]).cast("long").alias("quadrant"))


def _cells(order: int) -> list[Column]:
    return [keys.normalised(F.col("x0"), 0.0, 50.0, order), keys.normalised(F.col("x1"), 900.0, 1000.0, order)]


def sfc_key(spark, d):
    return parts(spark, d).select("id", keys.curve_key(_cells(8), 8).alias("key"))


def z_key(spark, d):
    return parts(spark, d).select("id", keys.z_key(_cells(8), 8).alias("key"))


def clustering_coef(spark, d):
    return spark.createDataFrame([(round(aggregate.clustering_coefficient(aggregate.sampled_points(parts(spark, d), 2)), 6),)], "clustering double")


def effective_dim(spark, d):
    return spark.createDataFrame([(round(aggregate.effective_dimension(aggregate.sampled_points(parts(spark, d), 2)), 6),)], "effective_dim double")


def _shape(spark, d):
    return adapt.data_shape(parts(spark, d), 2, _log(spark, d))


def cost_estimates(spark, d):
    return spark.createDataFrame([(k, round(v, 6)) for k, v in adapt.costs(_shape(spark, d)).items()], "layout string, cost double")


def cheapest_layout(spark, d):
    name, cost = adapt.cheapest(_shape(spark, d))
    return spark.createDataFrame([(name, round(cost, 6))], "layout string, cost double")


def policy_decision(spark, d):
    policy, shape, rows = adapt.Policy("grid", 0.77, 5), _shape(spark, d), []
    for tick in range(1, 9):
        found = policy.tick(shape)
        if found:
            rows.append((tick, found[0], round(found[1], 6)))
            policy.started()
            policy.completed(found[0])
    return spark.createDataFrame(rows, "tick long, layout string, ratio double")


def remove_antijoin(spark, d):
    o = query.points(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [F.col("o_totalprice")])
    return query.remove(o, o.where("id % 7 = 0").select("id")).select("id", "x0")


def removed_rows(spark, d):
    o = query.points(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [F.col("o_totalprice")])
    return query.removed(o, o.where("id % 7 = 0").select("id")).select("id", "x0")


def append_ids(spark, d):
    p = parts(spark, d)
    arrivals = _table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return query.append_ids(p, arrivals, ["s_suppkey"]).select("id", "s_suppkey")


def bloom_membership(spark, d):
    """Keys that were inserted are all found; of as many that were not, one in a hundred may be."""
    p = parts(spark, d)
    key = [F.col("x0") + F.lit(0.0), F.col("x1") + F.lit(0.0)]
    words = bloom.build(p, key)
    probes = p.select("x0", "x1", F.lit(True).alias("inserted")).unionByName(p.select("x0", (F.col("x1") + 5000).alias("x1"), F.lit(False).alias("inserted")))
    found = F.sum(F.col("maybe").cast("long"))
    return bloom.check(probes, key, words).groupBy("inserted").agg(F.count(F.lit(1)).alias("probes"), F.when(F.col("inserted"), found).otherwise(0).alias("found"), (found <= F.when(F.col("inserted"), F.count(F.lit(1))).otherwise(F.count(F.lit(1)) / 100)).alias("within"))


def stream_progress(spark, d):
    return running_totals(_table(spark, d, "events"), 1000)


def reservoir_sample(spark, d):
    return aggregate.reservoir(events(spark, d), 500)


def flat_result(spark, d):
    return query.flat(query.knn(parts(spark, d), (20.0, 910.0), 10), ["dist", "id"], ["dist", "id"]).select(F.explode("flat").alias("v")).select(F.round("v", 9).alias("v"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "range_1d": range_1d,
    "range_2d": lambda s, d: query.range_query(parts(s, d), PART_BOX),
    "range_degenerate": lambda s, d: query.range_query(parts(s, d), BBox.around((20.0, 910.0))),
    "range_boundary": lambda s, d: query.range_query(parts(s, d), BBox((1, 900), (1, 919.9))),
    "range_inverted": lambda s, d: query.range_query(parts(s, d), BBox((30, 915), (10, 905))),
    "range_4d": range_4d,
    "range_8d_f32": lambda s, d: query.range_query(vectors(s, d), BBox([0] * 4 + [-1] * 4, [1] * 8)),
    "contains_flag": lambda s, d: parts(s, d).select("id", geometry.contains(PART_BOX).alias("inside")),
    "geometry_columns": geometry_columns,
    "knn_2d": lambda s, d: query.knn(parts(s, d), (20.0, 910.0), 50),
    "nearest_2d": lambda s, d: query.nearest(parts(s, d), (25.3, 907.7)),
    "knn_8d": lambda s, d: query.knn(vectors(s, d), [0.1] * 8, 10).select("id", F.round("dist", 9).alias("dist")),
    "knn_k_gt_n": lambda s, d: query.knn(query.points(_table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", [F.col("s_acctbal")]).select("id", "x0"), (0.0,), 1_000_000),
    "spatial_self_join": lambda s, d: query.spatial_join(parts(s, d), parts(s, d), 2),
    "spatial_join": lambda s, d: query.spatial_join(_nations(s, d, "customer", "c"), _nations(s, d, "supplier", "s"), 1),
    "batch_range": batch_range,
    "box_intersect_join": box_intersect_join,
    "knn_join": knn_join,
    "extent": lambda s, d: aggregate.extent(events(s, d), 2),
    "moments_skewness": moments_skewness,
    "grid_density": grid_density,
    "cell_occupancy": cell_occupancy,
    "grid_cell": grid_cell,
    "quadrant": quadrant,
    "sfc_key": sfc_key,
    "z_key": z_key,
    **{f"layout_{short}_range": _layout(name) for short, name in (("grid", "grid"), ("kd", "kdtree"), ("quad", "quadtree"), ("str", "rtree"))},
    "layout_stats": _layout_stats,
    "clustering_coef": clustering_coef,
    "effective_dim": effective_dim,
    "cost_estimates": cost_estimates,
    "cheapest_layout": cheapest_layout,
    "policy_decision": policy_decision,
    "query_mix": lambda s, d: aggregate.query_mix(_log(s, d)).select(*[F.round(c, 9).alias(c) for c in ("range_fraction", "knn_fraction", "join_fraction", "mean_selectivity")]),
    "hit_rates": lambda s, d: aggregate.hit_rates(_log(s, d)).select(*[F.round(f"{k}_hit_rate", 9).alias(f"{k}_hit_rate") for k in ("range", "knn", "join")]),
    "latency_stats": lambda s, d: aggregate.latency(_log(s, d)),
    "percentile_nearest_rank": percentiles,
    "remove_antijoin": remove_antijoin,
    "removed_rows": removed_rows,
    "append_ids": append_ids,
    "bloom_membership": bloom_membership,
    "stream_progress": stream_progress,
    "reservoir_sample": reservoir_sample,
    "flat_result": flat_result,
    **{f.__name__: f for f in (index_entries, index_range, index_removed, index_migrated, index_stats, index_cleared, index_adapted, index_compacted, csv_source, geojson_source, parquet_source, stream_ingest, cell_range, curve_order, default_orders, layout_names)},
}

_IN = "x0 BETWEEN 10 AND 30 AND x1 BETWEEN 905 AND 915"
_DIST = "sqrt((x0 - {}) * (x0 - {}) + (x1 - {}) * (x1 - {}))"
_E8 = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(8))
_VEC = f"(SELECT vec_id AS id, {_E8} FROM embeddings)"
_KNN = f"SELECT id, x0, x1, {_DIST.format(20.0, 20.0, 910.0, 910.0)} AS dist FROM {PART_SQL}"
_CELL = "greatest(0, least(255, CAST(floor((x0 - 0.0) / 50.0 * 256.0) AS BIGINT))) AS a, greatest(0, least(255, CAST(floor((x1 - 900.0) / 100.0 * 256.0) AS BIGINT))) AS b"
#: The reservoir of the parts in the order of its hash, and the measures of the data's shape over it.
_SAMPLE = f"(SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(id AS VARCHAR), ':0')), id) - 1 AS i FROM {PART_SQL} QUALIFY i < 4096)"
_CLUSTERING = f"""WITH s AS (SELECT * FROM {_SAMPLE}), k AS (SELECT count(*) AS n, least(count(*), 256) AS asked, greatest(max(x0) - min(x0), 1e-12) * greatest(max(x1) - min(x1), 1e-12) AS v FROM s),
 c AS (SELECT s.*, k.n // k.asked AS step FROM s, k WHERE i % (k.n // k.asked) = 0 AND i // (k.n // k.asked) < k.asked),
 d AS (SELECT a.i, min(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1))) AS m FROM c a JOIN s b ON a.i <> b.i GROUP BY a.i) SELECT sqrt((SELECT v / n FROM k)) * 0.886226925452758 / avg(m) AS clustering FROM d"""
_SHAPE = f"(SELECT CAST(count(*) AS DOUBLE) AS n, any_value(g.clustering) AS c, any_value(l.sel) AS sel FROM {_SAMPLE}, ({_CLUSTERING}) g, (SELECT least(greatest(avg(selectivity), 0), 1) AS sel FROM {LOG_SQL}) l)"
_COSTS = f"""(SELECT layout, k, CASE k WHEN 0 THEN ln(n) * sel WHEN 1 THEN sqrt(n) * c * sel WHEN 2 THEN sqrt(sel) * sqrt(n) * c * c ELSE ln(n) * sel END AS cost
 FROM {_SHAPE}, (VALUES ('rtree', 0), ('kdtree', 1), ('grid', 2), ('quadtree', 3)) t(layout, k))"""
#: 100 rows a leaf: cells an axis of the grid, bits an axis of the quadrants.
_LEAVES = f"""SELECT layout, CAST(sum(n) AS BIGINT) AS points, count(*) AS leaves, max(n) AS most_rows, true AS even FROM (SELECT layout, a, b, count(*) AS n FROM (
 SELECT layout, least(greatest(CAST(floor((x0 - l0) / ((h0 - l0) / w)) AS BIGINT), 0), w - 1) AS a, least(greatest(CAST(floor((x1 - l1) / ((h1 - l1) / w)) AS BIGINT), 0), w - 1) AS b FROM {PART_SQL},
 (SELECT min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1, least(4096, (count(*) + 99) // 100) AS wanted FROM {PART_SQL}), LATERAL (SELECT 'grid' AS layout, CAST(floor(sqrt(wanted) + 1e-9) AS BIGINT) AS w UNION ALL SELECT 'quadtree', CAST(1 AS BIGINT) << CAST(floor(log2(wanted) / 2 + 1e-9) AS BIGINT))) GROUP BY ALL) GROUP BY layout"""
#: The two-dimensional curve bit by bit: cells c (id, a, b), `low` the number of their highest bit.
_CURVE = """WITH RECURSIVE c AS ({cells}), t AS (SELECT id, a, b, {low} AS i, CAST(0 AS BIGINT) AS key, CAST(0 AS BIGINT) AS state FROM c
 UNION ALL SELECT id, a, b, i - 1, key * 4 + child, CASE WHEN child = 1 THEN ((mixed >> 1) | (mixed << 1)) & 3 ELSE mixed END
 FROM (SELECT *, xor(state, xor(child, child >> 1)) & 3 AS mixed FROM (SELECT *, CASE WHEN state % 2 = 1 THEN ((e >> 1) | (e << 1)) & 3 ELSE e END AS child FROM (SELECT *, xor(((a >> i) & 1) + 2 * ((b >> i) & 1), state) AS e FROM t WHERE i >= 0))))
 SELECT id, key FROM t WHERE i = -1"""
_CURVE_CELLS = "SELECT id, greatest(0, least({top}, CAST(floor((x0 - 0.0) / {span} * {side}) AS BIGINT))) AS a, greatest(0, least({top}, CAST(floor((x1 - 900.0) / 100.0 * {side}) AS BIGINT))) AS b FROM " + PART_SQL
_RANGE = f"SELECT * FROM {PART_SQL} WHERE {_IN}"

ORACLES: dict[str, str] = {
    "flagship": f"SELECT * FROM ({_KNN}) WHERE {_IN} ORDER BY dist, id LIMIT 20",
    "range_1d": "SELECT c_custkey AS id, c_acctbal AS x0 FROM customer WHERE c_acctbal BETWEEN 0 AND 1000",
    "range_2d": _RANGE,
    "range_degenerate": f"SELECT * FROM {PART_SQL} WHERE x0 = 20 AND x1 = 910",
    "range_boundary": f"SELECT * FROM {PART_SQL} WHERE x0 = 1 AND x1 >= 900 AND x1 <= 919.9",
    "range_inverted": f"SELECT * FROM {PART_SQL} WHERE x0 >= 30 AND x0 <= 10 AND x1 >= 915 AND x1 <= 905",
    "range_4d": "SELECT l_orderkey AS id, l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 10000 AND 20000 AND l_discount BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.05 AS DOUBLE) AND l_tax BETWEEN CAST(0.01 AS DOUBLE) AND CAST(0.04 AS DOUBLE)",
    "range_8d_f32": f"SELECT * FROM {_VEC} WHERE " + " AND ".join(f"x{i} BETWEEN {0 if i < 4 else -1} AND 1" for i in range(8)),
    "contains_flag": f"SELECT id, {_IN} AS inside FROM {PART_SQL}",
    "geometry_columns": f"""SELECT id, (x0 + 3 >= 10 AND 30 >= x0 - 3 AND x1 + 2 >= 905 AND 915 >= x1 - 2) AS meets, round((x0 + 3 - (x0 - 3)) * (x1 + 2 - (x1 - 2)), 6) AS area,
 round((greatest(x0 + 3, 30) - least(x0 - 3, 10)) * (greatest(x1 + 2, 915) - least(x1 - 2, 905)) - (x0 + 3 - (x0 - 3)) * (x1 + 2 - (x1 - 2)), 6) AS enlargement,
 least(x0 - 3, 10) AS lo0, least(x1 - 2, 905) AS lo1, greatest(x0 + 3, 30) AS hi0, greatest(x1 + 2, 915) AS hi1 FROM {PART_SQL}""",
    "knn_2d": f"SELECT * FROM ({_KNN}) ORDER BY dist, id LIMIT 50",
    "nearest_2d": f"SELECT id, x0, x1, {_DIST.format('CAST(25.3 AS DOUBLE)', 'CAST(25.3 AS DOUBLE)', 'CAST(907.7 AS DOUBLE)', 'CAST(907.7 AS DOUBLE)')} AS dist FROM {PART_SQL} ORDER BY dist, id LIMIT 1",
    "knn_8d": "SELECT id, round(sqrt(" + " + ".join(f"(x{i} - CAST(0.1 AS DOUBLE)) * (x{i} - CAST(0.1 AS DOUBLE))" for i in range(8)) + f"), 9) AS dist FROM {_VEC} ORDER BY dist, id LIMIT 10",
    "knn_k_gt_n": "SELECT s_suppkey AS id, s_acctbal AS x0, sqrt(s_acctbal * s_acctbal) AS dist FROM supplier",
    "spatial_self_join": f"SELECT a.id AS id_a, b.id AS id_b FROM {PART_SQL} a JOIN {PART_SQL} b ON a.x0 = b.x0 AND a.x1 = b.x1",
    "spatial_join": f"SELECT c_custkey AS id_a, s_suppkey AS id_b FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "batch_range": f"SELECT box_id, id FROM {EVENT_SQL} e JOIN {BOX_GRID_SQL} b ON x0 BETWEEN lo0 AND hi0 AND x1 BETWEEN lo1 AND hi1",
    "box_intersect_join": f"SELECT a.box_id AS box_a, b.box_id AS box_b FROM {BOX_GRID_SQL} a JOIN {BOX_GRID_SQL} b ON a.hi0 >= b.lo0 AND b.hi0 >= a.lo0 AND a.hi1 >= b.lo1 AND b.hi1 >= a.lo1",
    "knn_join": f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(dist, 9) AS dist FROM (SELECT q.id AS query_id, p.id AS id, sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1)) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1)), p.id) AS rank FROM {PART_SQL} q, {PART_SQL} p) WHERE rank <= 5",
    "extent": f"SELECT count(*) AS n, min(x0) AS lo0, min(x1) AS lo1, max(x0) AS hi0, max(x1) AS hi1 FROM {EVENT_SQL}",
    "moments_skewness": " UNION ALL ".join(f"SELECT {i} AS axis, round(avg(x{i}), 3) AS mean, round(var_pop(x{i}) / avg(x{i}), 4) AS variance, round(avg(power((x{i} - m) / s, 3)), 5) AS skewness FROM {EVENT_SQL}, (SELECT avg(x{i}) AS m, stddev_pop(x{i}) AS s FROM {EVENT_SQL})" for i in range(2)),
    "grid_density": f"SELECT cx, cy, count(*) AS n FROM {PART_SQL}, range(60) a(cx), range(20) b(cy) WHERE x0 >= 0.0 + cx * 1.0 AND x0 <= 0.0 + (cx + 1) * 1.0 AND x1 >= 900.0 + cy * 5.0 AND x1 <= 900.0 + (cy + 1) * 5.0 GROUP BY cx, cy",
    "cell_occupancy": f"SELECT CAST(floor(x0 / 86400.0) AS BIGINT) AS cell0, CAST(floor(x1 / 10.0) AS BIGINT) AS cell1, count(*) AS n FROM {EVENT_SQL} GROUP BY 1, 2",
    "grid_cell": f"SELECT id, CAST(floor((x0 + 1.5) / 7.0) AS BIGINT) AS cell0, CAST(floor((x1 - 950.0) / 2.5) AS BIGINT) AS cell1 FROM {PART_SQL}",
    "quadrant": f"SELECT id, CAST(CASE WHEN x0 >= 25 THEN 1 ELSE 0 END + CASE WHEN x1 >= 910 THEN 2 ELSE 0 END AS BIGINT) AS quadrant FROM {PART_SQL}",
    "sfc_key": _CURVE.format(low=7, cells=_CURVE_CELLS.format(top=255, side="256.0", span="50.0")),
    "z_key": f"SELECT id, CAST(list_sum(list_transform(range(8), lambda i: ((a >> i) & 1) * power(4, i) + ((b >> i) & 1) * 2 * power(4, i))) AS BIGINT) AS key FROM (SELECT id, {_CELL} FROM {PART_SQL})",
    **{f"layout_{n}_range": _RANGE for n in ("grid", "kd", "quad", "str")},
    "layout_stats": f"{_LEAVES} UNION ALL SELECT layout, (SELECT count(*) FROM part), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), true FROM (VALUES ('rtree'), ('kdtree')) t(layout)",
    "clustering_coef": f"SELECT round(clustering, 6) AS clustering FROM ({_CLUSTERING})",
    "effective_dim": f"""WITH s AS (SELECT * FROM {_SAMPLE}), z AS (SELECT count(*) AS n, least(count(*), 200) AS asked FROM s), p AS (SELECT s.* FROM s, z WHERE i % (z.n // z.asked) = 0 AND i // (z.n // z.asked) < z.asked),
 d AS (SELECT sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS r FROM p a JOIN p b ON a.i < b.i), e AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM d WHERE r > 1e-15),
 k AS (SELECT max(CASE WHEN i = CAST(floor(n * 0.1) AS BIGINT) THEN r END) AS r1, max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN r END) AS r2 FROM e), c AS (SELECT r1, r2, (SELECT count(*) FROM e WHERE r <= r1) AS c1, (SELECT count(*) FROM e WHERE r <= r2) AS c2 FROM k) SELECT round(least(greatest((ln(c2) - ln(c1)) / (ln(r2) - ln(r1)), 0.5), 2.5), 6) AS effective_dim FROM c""",
    "cost_estimates": f"SELECT layout, round(cost, 6) AS cost FROM {_COSTS}",
    "cheapest_layout": f"SELECT layout, round(cost, 6) AS cost FROM {_COSTS} ORDER BY cost, k LIMIT 1",
    "policy_decision": f"SELECT CAST(6 AS BIGINT) AS tick, layout, round(cost / now, 6) AS ratio FROM (SELECT layout, cost, k, (SELECT cost FROM {_COSTS} WHERE layout = 'grid') AS now FROM {_COSTS} WHERE layout <> 'grid' ORDER BY cost, k LIMIT 1) WHERE cost / now < 0.77",
    "query_mix": f"SELECT round(avg(CASE WHEN kind = 'range' THEN 1.0 ELSE 0 END), 9) AS range_fraction, round(avg(CASE WHEN kind = 'knn' THEN 1.0 ELSE 0 END), 9) AS knn_fraction, round(avg(CASE WHEN kind = 'join' THEN 1.0 ELSE 0 END), 9) AS join_fraction, round(avg(selectivity), 9) AS mean_selectivity FROM {LOG_SQL}",
    "hit_rates": "SELECT " + ", ".join(f"round(avg(CASE WHEN kind = '{k}' THEN CAST(hit AS DOUBLE) END), 9) AS {k}_hit_rate" for k in ("range", "knn", "join")) + f" FROM {LOG_SQL}",
    "latency_stats": f"SELECT count(*) AS queries, CAST(floor(sum(latency_ns) / count(*)) AS BIGINT) AS mean_ns, CAST(arg_max(latency_ns, event_id) AS BIGINT) AS last_ns FROM {LOG_SQL}",
    "percentile_nearest_rank": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT CAST(p AS DOUBLE) AS percent, value FROM v, (VALUES (0), (25), (50), (75), (95), (99), (100)) t(p) WHERE i = least(n * p // 100, n - 1)",
    "remove_antijoin": "SELECT o_orderkey AS id, o_totalprice AS x0 FROM orders WHERE o_orderkey % 7 <> 0",
    "removed_rows": "SELECT o_orderkey AS id, o_totalprice AS x0 FROM orders WHERE o_orderkey % 7 = 0",
    "append_ids": "SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey FROM supplier",
    "bloom_membership": "SELECT inserted, (SELECT count(*) FROM part) AS probes, CASE WHEN inserted THEN (SELECT count(*) FROM part) ELSE 0 END AS found, true AS within FROM (VALUES (true), (false)) t(inserted)",
    "reservoir_sample": f"SELECT * FROM {EVENT_SQL} ORDER BY md5(concat(CAST(id AS VARCHAR), ':0')), id LIMIT 500",
    "index_entries": f"SELECT * FROM {CHANGED_SQL}",
    "index_range": f"SELECT * FROM {CHANGED_SQL} WHERE x0 BETWEEN 5 AND 20 AND x1 BETWEEN 900 AND 3000",
    "index_removed": f"SELECT id FROM {PART_SQL} WHERE {_IN}",
    "index_migrated": f"SELECT * FROM {CHANGED_SQL}",
    "index_stats": f"SELECT 'rtree' AS layout, (SELECT count(*) FROM {CHANGED_SQL}) AS points, CAST(2 AS INTEGER) AS dims, CAST(1 AS BIGINT) AS queries, (SELECT count(*) FROM supplier) AS inserts, CAST(1 AS INTEGER) AS migrations, true AS frozen, false AS migrating, true AS timed, true AS migrated",
    "index_cleared": "SELECT CAST(0 AS BIGINT) AS points, true AS empty, CAST(0 AS BIGINT) AS queries, 'kdtree' AS layout",
    "index_adapted": f"SELECT coalesce((SELECT layout FROM (SELECT layout, cost, k, (SELECT cost FROM {_COSTS.replace('l.sel', '0.01')} WHERE layout = 'grid') AS now FROM {_COSTS.replace('l.sel', '0.01')} WHERE layout <> 'grid' ORDER BY cost, k LIMIT 1) WHERE cost / now < 0.77), 'grid') AS layout, CAST(1 AS BIGINT) AS migrations, (SELECT count(*) FROM part) AS points",
    "index_compacted": f"SELECT x0, x1, CAST(0 AS INTEGER) AS deltas FROM {PART_SQL}",
    "csv_source": "SELECT CAST(o_custkey AS DOUBLE) AS x0, CAST(o_orderkey AS DOUBLE) AS x1, CASE WHEN o_orderkey % 3 = 0 THEN concat('o,', o_orderkey) ELSE 'default' END AS label, o_orderkey % 3 <> 0 AS numbered FROM orders",
    "geojson_source": "SELECT CAST(s_nationkey AS DOUBLE) AS x0, s_suppkey + CAST(0.25 AS DOUBLE) AS x1 FROM supplier",
    "parquet_source": f"SELECT * FROM {PART_SQL}",
    "stream_ingest": f"SELECT x0, x1, concat('e', id) AS label FROM {EVENT_SQL}",
    "cell_range": f"SELECT box_id, CAST(floor((lo0 - 1704067200.0) / 86400.0) AS BIGINT) AS first0, CAST(floor((hi0 - 1704067200.0) / 86400.0) AS BIGINT) AS last0, CAST(floor(lo1 / 25.0) AS BIGINT) AS first1, CAST(floor(hi1 / 25.0) AS BIGINT) AS last1 FROM {BOX_GRID_SQL}",
    "curve_order": "SELECT row_number() OVER (ORDER BY key, id) - 1 AS place, id AS part_id, key FROM (" + _CURVE.format(low=15, cells=_CURVE_CELLS.format(top=65535, side="65536.0", span="64.0")) + ")",
    "default_orders": "SELECT n AS dims, CASE WHEN 128 // n >= 32 THEN 32 ELSE least(128 // n, 16) END AS key_order, least(128 // n, 16, 63 // n) AS layout_order FROM range(1, 9) t(n)",
    "layout_names": "SELECT * FROM (VALUES ('rtree', 'rtree'), ('rt', 'rtree'), ('kdtree', 'kdtree'), ('kd', 'kdtree'), ('quadtree', 'quadtree'), ('quad', 'quadtree'), ('grid', 'grid')) t(given, layout)",
    "stream_progress": "SELECT g AS checkpoint, least(g * 1000, n) AS rows FROM (SELECT count(*) AS n FROM events), range(1, 1000000) t(g) WHERE g <= ceil(n / 1000.0)",
    "flat_result": f"SELECT round(unnest([dist, CAST(id AS DOUBLE)]), 9) AS v FROM (SELECT * FROM ({_KNN}) ORDER BY dist, id LIMIT 10)",
}
