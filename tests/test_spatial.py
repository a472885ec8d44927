"""Spatial operators against brute force, golden values and edge cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapoint.functions import geometry, keys
from terrapoint.operators import aggregate, bloom, layouts, query
from terrapoint.plans import adapt
from terrapoint.types import BBox, ConfigError, DimensionError, SpatialConfig, axes, layout_name


def frame(spark, points):
    dims = len(points[0]) if points else 2
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, " + ", ".join(f"{a} double" for a in axes(dims)))


def uniform(n, dims, seed=1):
    rng = random.Random(seed)
    return [[rng.uniform(0, 1000) for _ in range(dims)] for _ in range(n)]


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("dims", [1, 2, 3, 8])
def test_range_is_brute_force(spark, dims):
    points = uniform(400, dims)
    box = BBox([100] * dims, [800] * dims)
    assert ids(query.range_query(frame(spark, points), box)) == [i for i, p in enumerate(points) if box.contains(p)]


def test_edges_and_odd_boxes(spark):
    df = frame(spark, [[0, 0], [1, 1], [0, 1], [-0.0, 0.0], [2, 2]])
    assert ids(query.range_query(df, BBox((0, 0), (1, 1)))) == [0, 1, 2, 3]
    assert ids(query.range_query(df, BBox((1, 1), (0, 0)))) == []
    assert ids(query.range_query(df, BBox.around((0, 0)))) == [0, 3]
    assert BBox((0, 0), (1, 1)).intersects(BBox((1, 1), (2, 2)))
    assert BBox((0, 0), (1, 1)).enlargement(BBox((0, 0), (2, 1))) == 1
    with pytest.raises(DimensionError):
        axes(9)
    with pytest.raises(ConfigError):
        layout_name("b-tree")
    with pytest.raises(ConfigError):
        SpatialConfig(migration_threshold=2.0)


def test_non_finite_points_are_left_out(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, float("inf")), (3, None)], "k long, v double")
    assert ids(query.points(df, "k", [F.col("v")])) == [0]


def test_knn_order_ties_and_sizes(spark):
    df = frame(spark, [[1, 0], [0, 1], [3, 0], [-1, 0]])
    rows = query.knn(df, (0, 0), 10).collect()
    assert [(r["id"], r["dist"]) for r in rows] == [(0, 1.0), (1, 1.0), (3, 1.0), (2, 3.0)]
    assert query.knn(df, (0, 0), 0).count() == 0
    assert query.nearest(df, (2.9, 0)).first()["id"] == 2


def test_spatial_join_keeps_multiplicity(spark):
    df = frame(spark, [[0, 0]] * 3 + [[1, 2], [-0.0, 0.0]])
    assert query.spatial_join(df, df, 2).count() == 17


def test_spatial_join_deals_out_a_crowded_place(spark, monkeypatch):
    """One place with all rows, more than a block a side, null ids and one id many times: every pair once for each row,
    and more than one task makes them."""
    monkeypatch.setattr(query, "_BLOCK", 16)
    rows = [(i if i % 10 else None, 1.0) for i in range(200)] + [(7, 1.0)] * 20 + [(900, 2.0), (901, 3.0)]
    a = spark.createDataFrame(rows, "id long, x0 double")
    b = spark.createDataFrame([(i, 1.0) for i in range(90)] + [(-1, 2.0), (-2, 5.0)], "id long, x0 double")
    found = query.spatial_join(a, b, 1)
    tasks = found.groupBy(F.spark_partition_id()).count().count()
    want = sorted((str(i), j) for i, x in rows for j in range(90) if x == 1.0) + [("900", -1)]
    assert tasks > 1 and sorted((str(r["id_a"]), r["id_b"]) for r in found.collect()) == sorted(want)
    assert query.spatial_join(a, b.limit(0), 1).count() == 0


def test_batch_range_equals_nested_loop(spark):
    points, rng = uniform(300, 2, 3), random.Random(5)
    boxes = []
    for i in range(60):
        w = rng.choice([0.0, 1.0, 40.0, 900.0])
        x, y = rng.uniform(-50, 1000), rng.uniform(-50, 1000)
        boxes.append((i, x, y, x + w, y + w * rng.random()))
    boxes.append((99, 5.0, 5.0, 1.0, 1.0))
    b = spark.createDataFrame(boxes, "box_id long, lo0 double, lo1 double, hi0 double, hi1 double")
    got = {(r["box_id"], r["id"]) for r in query.batch_range(frame(spark, points), b, 2, 10.0).collect()}
    want = {(n, i) for n, a, c, d, e in boxes for i, (x, y) in enumerate(points) if a <= x <= d and c <= y <= e}
    assert got == want
    met = [(r["box_a"], r["box_b"]) for r in query.box_intersect_join(b, b, 2, 10.0).collect()]
    truth = {(p[0], q[0]) for p in boxes for q in boxes if p[0] != 99 and q[0] != 99 and p[3] >= q[1] and q[3] >= p[1] and p[4] >= q[2] and q[4] >= p[2]}
    assert len(met) == len(set(met)) and set(met) == truth


def test_knn_join_is_exact(spark):
    points = uniform(200, 2, 9) + [[5000.0, 5000.0], [500.0, 500.0], [500.0, 500.0]]
    asked = [(0, 500.0, 500.0), (1, -3000.0, 20.0), (2, 4000.0, 4100.0)]
    q = spark.createDataFrame(asked, "query_id long, q0 double, q1 double")
    got = {}
    for r in query.knn_join(frame(spark, points), q, 7, 2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for n, x, y in asked:
        want = sorted(range(len(points)), key=lambda i: (math.sqrt((points[i][0] - x) ** 2 + (points[i][1] - y) ** 2), i))[:7]
        assert [got[n][r] for r in range(1, 8)] == want


def test_knn_join_on_clusters_and_copies(spark):
    """One dense cluster, one far outlier and a place with many copies: exact, and the crowded ones stay cheap."""
    rng = random.Random(21)
    points = [[rng.gauss(0, 0.001), rng.gauss(0, 0.001)] for _ in range(600)] + [[1e6, 1e6]] + [[7.0, 7.0]] * 300 + uniform(100, 2, 8)
    asked = [(i, *points[i]) for i in range(0, 1000, 40)] + [(5000, 7.0, 7.5), (5001, 1e6, 0.0)]
    q = spark.createDataFrame(asked, "query_id long, q0 double, q1 double")
    got = {}
    for r in query.knn_join(frame(spark, points), q, 5, 2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for n, x, y in asked:
        want = sorted(range(len(points)), key=lambda i: (math.sqrt((points[i][0] - x) ** 2 + (points[i][1] - y) ** 2), i))[:5]
        assert [got[n][r] for r in range(1, 6)] == want


def test_knn_join_asks_once_for_a_place(spark, monkeypatch):
    """400 queries at two places: all have their answers, and two boxes are asked for."""
    points, boxes, plain = uniform(200, 2, 9), [], query.batch_range
    monkeypatch.setattr(query, "batch_range", lambda df, asked, *rest: boxes.append(asked.count()) or plain(df, asked, *rest))
    places = [(500.0, 500.0), (-0.0, 20.0)]
    q = spark.createDataFrame([(i, *(places[i % 2] if i != 1 else (0.0, 20.0))) for i in range(400)], "query_id long, q0 double, q1 double")
    got = {}
    for r in query.knn_join(frame(spark, points), q, 3, 2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    want = [sorted(range(200), key=lambda i: (math.dist(points[i], p), i))[:3] for p in places]
    assert got == {i: dict(enumerate(want[i % 2], 1)) for i in range(400)} and max(boxes) <= 2


def test_boxes_of_any_width(spark):
    points = uniform(50, 2, 6)
    inf = float("inf")
    boxes = [(0, -inf, -inf, inf, inf), (1, -1e300, 0.0, 1e300, 500.0), (2, 100.0, 100.0, 100.5, 100.5), (3, inf, inf, inf, inf), (4, 2000.0, -inf, inf, inf)]
    b = spark.createDataFrame(boxes, "box_id long, lo0 double, lo1 double, hi0 double, hi1 double")
    got = {(r["box_id"], r["id"]) for r in query.batch_range(frame(spark, points), b, 2, 1.0).collect()}
    assert got == {(n, i) for n, a, c, d, e in boxes for i, (x, y) in enumerate(points) if a <= x <= d and c <= y <= e}
    assert query.batch_range(frame(spark, points).limit(0), b, 2, 1.0).count() == 0


@pytest.mark.parametrize("name,columns", [("range_1d", ["c_acctbal"]), ("range_2d", ["p_size", "p_retailprice"]), ("flagship", ["p_size", "p_retailprice"]), ("range_4d", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])])
def test_box_bounds_reach_the_scan(spark, name, columns):
    from terrapoint.plans import registry

    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    for c in columns:
        assert f"GreaterThanOrEqual({c}," in pushed and f"LessThanOrEqual({c}," in pushed


def test_curve_sort_keeps_neighbours_together(spark):
    points = uniform(3000, 2, 2)
    df = frame(spark, points)
    rows = [(r["x0"], r["x1"]) for r in layouts.curve_sorted(df, 2, BBox((0, 0), (1000, 1000))).collect()]
    step = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) / len(p)
    assert sorted(rows) == sorted(map(tuple, points)) and step(rows) < 0.1 * step(points)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=1, max_size=60), st.floats(-100, 100), st.floats(0, 80))
def test_layouts_equal_brute_force(spark, points, corner, width):
    box = BBox((corner, corner), (corner + width, corner + width))
    df = frame(spark, points)
    want = [i for i, p in enumerate(points) if box.contains(p)]
    for name in layouts.LAYOUTS:
        assigned = layouts.fit(name, df, 2, 4).assign(df)
        assert ids(layouts.pruned_range(assigned, layouts.leaf_table(assigned, 2), box)) == want, name


def test_layout_leaves_are_balanced(spark):
    df = frame(spark, uniform(512, 2, 4))
    for name in ("kdtree", "rtree"):
        assigned = layouts.fit(name, df, 2, 32).assign(df)
        row = layouts.statistics(layouts.leaf_table(assigned, 2)).first()
        assert row["leaves"] == 16 and row["most_rows"] <= 40 and row["depth"] == 5
    with pytest.raises(ConfigError):
        layouts.fit("quad", frame(spark, uniform(10, 5)), 5, 2)


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_kd_leaves_are_balanced_where_coordinates_tie(spark, share):
    """The widest axis has two values: cuts fall between them or go to the other axis, and no side stays empty."""
    points = [[0.0 if i < share * 512 else 10_000.0, y] for i, (y, _) in enumerate(uniform(512, 2, 4))]
    df = frame(spark, points)
    row = layouts.statistics(layouts.leaf_table(layouts.fit("kdtree", df, 2, 32).assign(df), 2)).first()
    assert row["leaves"] == 16 and row["most_rows"] <= 40
    same = frame(spark, [[1.0, 2.0]] * 70)
    assert layouts.leaf_table(layouts.fit("kdtree", same, 2, 32).assign(same), 2).first()["n"] == 70


def test_curve_key_golden_and_bijective(spark):
    grid = spark.range(16 * 16).select((F.col("id") % 16).alias("a"), F.floor(F.col("id") / 16).alias("b"))
    key = {(r["a"], r["b"]): r["k"] for r in grid.select("a", "b", keys.curve_key([F.col("a"), F.col("b")], 4).alias("k")).collect()}
    assert sorted(key.values()) == list(range(256))
    small = spark.createDataFrame([(0, 0, 0), (3, 3, 13), (0, 3, 10), (3, 2, 15)], "a long, b long, want long")
    assert all(r["k"] == r["want"] for r in small.select("want", keys.curve_key([F.col("a"), F.col("b")], 2).alias("k")).collect())
    cube = spark.range(8**3).select((F.col("id") % 8).alias("a"), (F.floor(F.col("id") / 8) % 8).alias("b"), F.floor(F.col("id") / 64).alias("c"))
    assert cube.select(keys.curve_key([F.col(x) for x in "abc"], 3).alias("k")).distinct().count() == 512
    with pytest.raises(ConfigError):
        keys.curve_key([F.col("a")] * 8, 16)
    assert [keys.default_order(d) for d in (1, 4, 8)] == [32, 32, 16]


def test_grid_cells(spark):
    row = spark.range(1).select(keys.grid_cell(F.lit(2.5), 1).alias("a"), keys.grid_cell(F.lit(3.7), 1).alias("b"), keys.grid_cell(F.lit(-1.5), 1).alias("c"), keys.grid_cell(F.lit(-0.5), 1).alias("d"), keys.grid_cell(F.lit(9.0), 0).alias("e")).first()
    assert tuple(row) == (2, 3, -2, -1, 0)
    assert keys.default_cell_size(0.0, 10, 2) == 1.0


def lcg(seed):
    state = seed
    while True:
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        yield (state >> 11) / 2**53


def test_moments_and_constant_axis(spark):
    rows = {r["axis"]: r for r in aggregate.moments(frame(spark, [[1, 5], [2, 5], [10, 5]]), 2).collect()}
    assert rows[0]["skewness"] == pytest.approx(0.67455, abs=1e-5)
    assert rows[1]["skewness"] == 0 and rows[1]["variance"] == 0
    assert aggregate.extent_box(frame(spark, [[1, 1]]).where("id < 0"), 2) == (0, None)


def test_clustering_and_dimension():
    rng = np.random.default_rng(0)
    flat = rng.uniform(0, 1000, (400, 2))
    tight = np.vstack([c + rng.normal(0, 2, (40, 2)) for c in rng.uniform(0, 1000, (10, 2))])
    assert aggregate.clustering_coefficient(tight) > 2 * aggregate.clustering_coefficient(flat)
    line = np.column_stack([np.arange(300.0), np.arange(300.0)])
    assert aggregate.effective_dimension(line) < 1.3 < aggregate.effective_dimension(flat)
    assert aggregate.clustering_coefficient(np.zeros((1, 2))) == 1.0 and aggregate.clustering_coefficient(np.zeros((9, 2))) == 1.0
    assert aggregate.effective_dimension(np.zeros((3, 2))) == 2.0


def test_query_log_aggregates(spark):
    log = spark.createDataFrame([("range", 0.01, True)] * 60 + [("knn", 0.001, False)] * 40, "kind string, selectivity double, hit boolean")
    mix, hits = aggregate.query_mix(log).first(), aggregate.hit_rates(log).first()
    assert tuple(mix)[:3] == (0.6, 0.4, 0.0) and mix["mean_selectivity"] == pytest.approx(0.0064)
    assert tuple(hits) == (1.0, 0.0, 0.0)
    assert tuple(aggregate.query_mix(log.limit(0)).first()) == (1.0, 0.0, 0.0, 0.01)
    empty = spark.createDataFrame([], "ts long, latency_ns long")
    assert tuple(aggregate.latency(empty).first()) == (0, 0, 0)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    got = {r["percent"]: r["value"] for r in aggregate.nearest_rank(df, "v", [0, 50, 99, 100]).collect()}
    assert got == {0.0: 1.0, 50.0: 3.0, 99.0: 4.0, 100.0: 4.0}


def test_density_counts_shared_edges_twice(spark):
    df = frame(spark, [[0.5, 0.5], [1.0, 0.5], [2.0, 1.0]])
    got = {(r["cx"], r["cy"]): r["n"] for r in aggregate.density(df, BBox((0, 0), (2, 1)), 2, 1).collect()}
    assert got == {(0, 0): 2, (1, 0): 2}
    assert aggregate.raster(df, BBox((0, 0), (2, 1)), 2, 1) == "##"


def test_reservoir(spark):
    df = frame(spark, uniform(300, 2))
    assert ids(aggregate.reservoir(df, 50)) == ids(aggregate.reservoir(df.repartition(7), 50))
    assert ids(aggregate.reservoir(df, 50, seed=1)) != ids(aggregate.reservoir(df, 50))
    assert aggregate.replayed_reservoir(list(range(10)), 20) == list(range(10))
    assert len(set(aggregate.replayed_reservoir(list(range(1000)), 20))) == 20


def test_bloom_has_no_false_negative_and_few_positives(spark):
    key = [F.col("x0") + 0.0, F.col("x1") + 0.0]
    inside, outside = frame(spark, uniform(3000, 2, 1)), frame(spark, uniform(3000, 2, 2))
    words = bloom.build(inside, key, 8192, 7)
    assert bloom.check(inside, key, words, 8192, 7).where("not maybe").count() == 0
    assert bloom.check(outside, key, words, 8192, 7).where("maybe").count() <= 60
    assert bloom.check(frame(spark, [[-0.0, 0.0]]), key, bloom.build(frame(spark, [[0.0, -0.0]]), key)).first()["maybe"]
    with pytest.raises(ConfigError):
        bloom.build(inside, key, 4)


def test_costs_and_policy():
    shape = adapt.DataShape(2, 512, BBox((0, 0), (1, 1)), (0.0, 0.0), 3.7370946, 0.89, 0.0, adapt.QueryMix(mean_selectivity=0.323))
    got = adapt.costs(shape)
    assert {k: round(v, 1) for k, v in got.items()} == {"rtree": 2.0, "kdtree": 27.3, "grid": 179.6, "quadtree": 2.0}
    assert adapt.cheapest(shape)[0] == "rtree"
    policy = adapt.Policy("kdtree", 0.77, 5)
    assert [policy.tick(shape) for _ in range(5)] == [None] * 5
    layout, ratio = policy.tick(shape)
    assert layout == "rtree" and round(ratio, 3) == 0.074
    policy.started()
    assert policy.tick(shape) is None
    policy.completed("rtree")
    assert [policy.tick(shape) for _ in range(9)] == [None] * 9
    frozen = adapt.Policy("kdtree", 0.77, 0)
    frozen.frozen = True
    assert frozen.tick(shape) is None
    high = adapt.DataShape(5, 100, BBox([0] * 5, [1] * 5), (0.0,) * 5, 1.0, 5.0)
    assert adapt.cheapest(high)[0] != "quadtree"


def test_flat_and_ids(spark):
    df = frame(spark, [[0, 0], [3, 4]])
    assert query.flat(query.knn(df, (0, 0), 2), ["dist", "id"], ["dist", "id"]).first()["flat"] == [0.0, 0.0, 5.0, 1.0]
    more = spark.createDataFrame([(float(v),) for v in range(50, 0, -1)], "v double")
    got = query.append_ids(df, more, ["v"]).orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in got] == [(i + 2, float(i + 1)) for i in range(50)]
    assert query.append_ids(df, more.limit(0), ["v"]).count() == 0


def test_geometry_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 3.0, 2.0)], "a_lo0 double, a_lo1 double, a_hi0 double, a_hi1 double, b_lo0 double, b_lo1 double, b_hi0 double, b_hi1 double")
    row = df.select(geometry.intersects(2, "a_", "b_").alias("m"), geometry.enlargement(2, "a_", "b_").alias("e")).first()
    assert tuple(row) == (True, 5.0)
