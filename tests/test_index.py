"""The versioned table, sources, streaming and command line."""

import json
import random

import pytest

from terrapoint import cli
from terrapoint.plans.index import ConcurrentChange, SpatialIndex
from terrapoint.sources.points import load
from terrapoint.streaming.ingest import ingest, lines_stream, running_totals
from terrapoint.types import BBox, SnapshotError, SpatialConfig

SCHEMA = "id long, x0 double, x1 double, label string"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.uniform(0, 100), rng.uniform(0, 100), f"p{i}") for i in range(n)]


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_life_of_a_table(spark, tmp_path):
    data, box = rows(200), BBox((20, 20), (60, 70))
    path = str(tmp_path / "t")
    index = SpatialIndex.create(spark, path, spark.createDataFrame(data, SCHEMA), 2, SpatialConfig(initial_layout="grid", leaf_rows=20))
    want = [i for i, x, y, _ in data if box.contains((x, y))]
    assert index.state["layout"] == "grid" and ids(index.range_query(box)) == want
    first, last = index.insert(spark.createDataFrame([(30.0, 30.0, "new"), (999.0, 999.0, "far")], "x0 double, x1 double, label string"))
    assert (first, last) == (200, 202)
    assert ids(index.range_query(box)) == want + [200]
    index.remove(spark.createDataFrame([(want[0],), (123456,)], "id long"))
    assert ids(index.range_query(box)) == want[1:] + [200] and index.count() == 201
    before = ids(index.all_entries())
    for name in ("rtree", "kd", "quad", "grid"):
        index.force_layout(name)
        assert ids(index.all_entries()) == before and ids(index.range_query(box)) == want[1:] + [200]
    assert index.state["migrations"] == 4
    again = SpatialIndex.open(spark, path)
    assert [r["id"] for r in again.knn((30.0, 30.0), 1).collect()] == [200] and again.insert(spark.createDataFrame([(1.0, 1.0, "x")], "x0 double, x1 double, label string")) == (202, 203)
    with pytest.raises(ConcurrentChange):
        index.clear()
    index.freeze()
    assert index.adapt() is None and SpatialIndex.open(spark, path).state["frozen"]
    index.unfreeze()
    index.clear()
    assert index.log().count() == 0
    assert index.is_empty() and index.state["layout"] == "grid" and index.state["migrations"] == 4
    assert index.stats().first()["points"] == 0


def test_adapt_rewrites(spark, tmp_path):
    index = SpatialIndex.create(spark, str(tmp_path / "t"), spark.createDataFrame(rows(300), SCHEMA), 2, SpatialConfig(hysteresis_window=1))
    before = ids(index.all_entries())
    assert index.adapt() is None
    layout, ratio = index.adapt()
    assert ratio < 0.77 and index.state["layout"] == layout and ids(index.all_entries()) == before


def test_leaves_prune_the_scan(spark, tmp_path):
    index = SpatialIndex.create(spark, str(tmp_path / "t"), spark.createDataFrame(rows(400), SCHEMA), 2, SpatialConfig(initial_layout="rtree", leaf_rows=25))
    found = index.range_query(BBox((10, 10), (20, 20)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    leaves = [r["leaf"] for r in index._met(BBox((10, 10), (20, 20)))]
    assert 0 < len(leaves) < 8 and "PartitionFilters: [" in plan and "leaf" in plan[plan.index("PartitionFilters") :].splitlines()[0]
    assert "GreaterThanOrEqual(x0,10.0)" in plan


def test_latencies_stats_and_ticks(spark, tmp_path):
    path = str(tmp_path / "t")
    index = SpatialIndex.create(spark, path, spark.createDataFrame(rows(100), SCHEMA), 2, SpatialConfig(hysteresis_window=2))
    index.answer(index.knn((1.0, 1.0), 2))
    index.answer(index.range_query(BBox((0, 0), (50, 50))))
    stats = index.stats().first()
    assert stats["queries"] == 2 and stats["mean_latency_ns"] > 1_000_000 and stats["sampled"] == 100 and stats["inserts"] == 0 and stats["last_migration_at"] is None
    assert index.adapt() is None
    assert SpatialIndex.open(spark, path).adapt() is None
    again = SpatialIndex.open(spark, path)
    assert again.policy.ticks == 2 and again.adapt() is not None and again.stats().first()["last_migration_at"] > 0


def test_deltas_are_compacted_and_vacuumed(spark, tmp_path):
    path = tmp_path / "t"
    index = SpatialIndex.create(spark, str(path), spark.createDataFrame(rows(10), SCHEMA), 2, SpatialConfig(most_deltas=4))
    for n in range(5):
        index.insert(spark.createDataFrame([(float(n), 1.0, "d")], "x0 double, x1 double, label string"))
    index.remove(spark.createDataFrame([(3,)], "id long"))
    assert len(index.state["deltas"]) == 1 and ids(index.all_entries()) == [i for i in range(15) if i != 3]
    stray = path / "delta-stray"
    stray.mkdir()
    gone = index.vacuum(1)
    assert len(gone) == 6 and stray.exists() and ids(SpatialIndex.open(spark, str(path)).all_entries()) == [i for i in range(15) if i != 3]


def test_bad_manifests(spark, tmp_path):
    with pytest.raises(SnapshotError):
        SpatialIndex.open(spark, str(tmp_path / "none"))
    folder = tmp_path / "bad" / "_manifest"
    folder.mkdir(parents=True)
    (folder / f"{0:012d}.json").write_text("not json")
    with pytest.raises(SnapshotError):
        SpatialIndex.open(spark, str(tmp_path / "bad"))
    (folder / f"{1:012d}.json").write_text(json.dumps({"format": 1, "dims": 99, "layout": "grid", "config": {}}))
    with pytest.raises(SnapshotError):
        SpatialIndex.open(spark, str(tmp_path / "bad"))


def test_line_and_geojson_sources(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("x,y,label\n# note\n1,2,a, with comma\n\n 3 , 4 \n5,bad\n6\nnan,1\n1.5d,2\n7e1,-8.5,\n")
    got = [(r["id"], r["x0"], r["x1"], r["label"]) for r in load(spark, str(csv)).orderBy("id").collect()]
    assert got == [(0, 1.0, 2.0, "a, with comma"), (1, 3.0, 4.0, "pt1"), (2, 70.0, -8.5, "pt2")]
    geo = tmp_path / "b.geojson"
    features = [{"type": "Feature", "geometry": {"type": t, "coordinates": c}} for t, c in (("Point", [1, 2]), ("Point", [3.5, 4, 9]), ("LineString", [[0, 0], [1, 1]]))]
    geo.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = [(r["x0"], r["x1"], r["label"]) for r in load(spark, str(geo)).orderBy("id").collect()]
    assert got == [(1.0, 2.0, "pt0"), (3.5, 4.0, "pt1")]


def test_stream_is_added_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.txt").write_text("".join(f"{n},{i},s{n}_{i}\n" for i in range(5)))
    index = SpatialIndex.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA), 2)
    seen = []
    for _ in range(2):
        ingest(lines_stream(spark, str(folder)), index, str(tmp_path / "check"), lambda n, b: seen.append(n)).awaitTermination()
    assert index.count() == 15 and ids(index.all_entries()) == list(range(15)) and seen == [5, 10, 15]
    totals = [(r["checkpoint"], r["rows"]) for r in running_totals(spark.range(25), 10).orderBy("checkpoint").collect()]
    assert totals == [(1, 10), (2, 20), (3, 25)]


def test_a_batch_that_comes_again_is_known(spark, tmp_path, monkeypatch):
    """The driver dies after the rows were committed and before the stream knows of it."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(2):
        (folder / f"{n}.txt").write_text("".join(f"{n},{i}\n" for i in range(5)))
    index = SpatialIndex.create(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA), 2)
    insert = index.insert

    def dying(*args, **kwargs):
        insert(*args, **kwargs)
        raise RuntimeError("the driver dies")

    monkeypatch.setattr(index, "insert", dying)
    with pytest.raises(Exception):  # noqa: B017
        ingest(lines_stream(spark, str(folder)), index, str(tmp_path / "check")).awaitTermination()
    again = SpatialIndex.open(spark, str(tmp_path / "t"))
    assert again.count() == 5
    ingest(lines_stream(spark, str(folder)), again, str(tmp_path / "check")).awaitTermination()
    got = {(r["x0"], r["x1"]): r["label"] for r in again.all_entries().collect()}
    assert len(got) == 10 == again.count() and sorted(got.values()) == sorted(f"pt{i}" for i in range(10))


def test_stream_and_watch_verbs(spark, tmp_path, capsys, monkeypatch):
    import io

    run = lambda *a: cli.main(["--state", str(tmp_path / "state"), *a], spark)
    monkeypatch.setattr("sys.stdin", io.StringIO("".join(f"{i},{i}\n" for i in range(25))))
    run("stream", "--interval", "10")
    run("query", "range", "3", "3", "4", "4", "--capacity", "1")
    monkeypatch.setattr("time.sleep", lambda s: None)
    run("watch", "--ticks", "2")
    out = capsys.readouterr().out
    assert "25 points" in out and "pt3" in out and "pt4" not in out and "points: 25" in out and "queries/s: 0.00" in out


def test_command_line(spark, tmp_path, capsys):
    csv = tmp_path / "a.csv"
    csv.write_text("".join(f"{i},{i * 2},n{i}\n" for i in range(20)))
    run = lambda *a: cli.main(["--state", str(tmp_path / "state"), *a], spark)
    run("load", str(csv))
    run("load", str(csv))
    run("query", "range", "3", "0", "4", "100")
    run("query", "knn", "5.1", "10", "1")
    run("stats")
    run("visualise")
    run("bench", "--queries", "10", "--singles", "2")
    run("migrate", "rtree")
    out = capsys.readouterr().out
    assert "loaded 20 points" in out and "n3" in out and "0.1000\t5\tn5" in out and "points: 40" in out and "10 boxes" in out and "knn: p50" in out and "migrated to rtree" in out
