"""Command line: load, stream, query range, query knn, stats, watch, bench, visualise, migrate.

    python -m terrapoint.cli --state DIR load FILE
    python -m terrapoint.cli --state DIR query range X0 Y0 X1 Y1
"""

from __future__ import annotations

import argparse
import itertools
import sys
import time
import uuid

from pyspark.sql import SparkSession

from terrapoint.operators import aggregate, query
from terrapoint.plans.index import SpatialIndex
from terrapoint.sources.points import load
from terrapoint.staging import write_once
from terrapoint.streaming.ingest import ingest, lines_stream
from terrapoint.types import BBox, SnapshotError, SpatialConfig


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("terrapoint").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _open(spark: SparkSession, state: str) -> SpatialIndex | None:
    try:
        return SpatialIndex.open(spark, state)
    except SnapshotError:
        return None


def _need(spark: SparkSession, state: str) -> SpatialIndex:
    index = _open(spark, state)
    if index is None:
        sys.exit(f"{state} holds no table; load something first")
    return index


def _empty(spark: SparkSession, state: str, layout: str) -> SpatialIndex:
    rows = spark.createDataFrame([], "id long, x0 double, x1 double, label string")
    return SpatialIndex.create(spark, state, rows, 2, SpatialConfig(initial_layout=layout))


def print_stats(index: SpatialIndex) -> None:
    row, box = index.stats().first(), index.extent().first()
    for name in row.asDict():
        print(f"{name}: {row[name]}")
    print(f"extent: {box['lo0']} {box['lo1']} {box['hi0']} {box['hi1']}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="terrapoint", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--state", default="terrapoint_state", help="folder of the table")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("load")
    v.add_argument("file")
    v.add_argument("--layout", default="kdtree")
    v = verbs.add_parser("stream")
    v.add_argument("folder", nargs="?", default="-", help="a folder of line files; - reads standard input")
    v.add_argument("--interval", type=int, default=100, help="lines a batch from standard input")
    v = verbs.add_parser("query")
    kinds = v.add_subparsers(dest="kind", required=True)
    r = kinds.add_parser("range")
    r.add_argument("box", type=float, nargs=4)
    r.add_argument("--capacity", type=int)
    k = kinds.add_parser("knn")
    k.add_argument("point", type=float, nargs=2)
    k.add_argument("k", type=int)
    verbs.add_parser("stats")
    v = verbs.add_parser("watch")
    v.add_argument("--ticks", type=int, default=0, help="stop after so many; 0 goes on")
    v = verbs.add_parser("bench")
    v.add_argument("--queries", type=int, default=1000, help="boxes asked together")
    v.add_argument("--singles", type=int, default=20, help="queries asked one by one, for percentiles")
    for name in ("visualise", "visualize"):
        verbs.add_parser(name)
    v = verbs.add_parser("migrate")
    v.add_argument("layout")
    a = p.parse_args(argv)
    spark = spark or _session()

    if a.verb == "load":
        index = _open(spark, a.state) or _empty(spark, a.state, a.layout)
        first, last = index.insert(load(spark, a.file), ["id"])
        print(f"loaded {last - first} points")
    elif a.verb == "stream":
        index = _open(spark, a.state) or _empty(spark, a.state, "kdtree")
        told = lambda n, b: print(f"batch {b}: {n} points", flush=True)
        run = lambda folder, name: ingest(lines_stream(spark, folder), index, f"{a.state.rstrip('/')}/{name}", told).awaitTermination()
        if a.folder != "-":
            run(a.folder, "_stream")
        else:
            # Lines go to the table's own folder, which all executors see, some a file; every `files` of them are added.
            name, files = f"_stdin-{uuid.uuid4().hex}", 20
            lines = (x for x in sys.stdin if x.strip())
            for n in itertools.count():
                some = list(itertools.islice(lines, a.interval))
                if some:
                    write_once(spark, f"{a.state.rstrip('/')}/{name}/{n:012d}.txt", "".join(x if x.endswith("\n") else x + "\n" for x in some))
                if (not some and n) or (some and n % files == files - 1):
                    run(f"{a.state.rstrip('/')}/{name}", f"{name}-checkpoint")
                if not some:
                    break
    elif a.verb == "query" and a.kind == "range":
        index = _need(spark, a.state)
        rows = index.range_query(BBox(a.box[:2], a.box[2:])).orderBy("id")
        for r in index.answer(rows.limit(a.capacity)) if a.capacity is not None else rows.toLocalIterator():
            print(f"{r['id']}\t{r['x0']}\t{r['x1']}\t{r['label']}")
        index.flush_observations()
    elif a.verb == "query":
        index = _need(spark, a.state)
        for r in index.answer(index.knn(a.point, a.k)):
            print(f"{r['dist']:.4f}\t{r['id']}\t{r['label']}")
        index.flush_observations()
    elif a.verb == "stats":
        print_stats(_need(spark, a.state))
    elif a.verb == "watch":
        turn, before, at = 0, None, 0.0
        while True:
            index = _need(spark, a.state)
            print_stats(index)
            asked, now = index.log().count(), time.time()
            print(f"queries/s: {(asked - before) / (now - at):.2f}" if before is not None else "queries/s: -", flush=True)
            turn, before, at = turn + 1, asked, now
            if a.ticks and turn >= a.ticks:
                break
            time.sleep(1)
    elif a.verb == "bench":
        index = _need(spark, a.state)
        n, box = aggregate.extent_box(index.all_entries(), 2)
        if not n:
            sys.exit("the table is empty")
        w = [h - l or 1.0 for l, h in zip(box.lo, box.hi, strict=True)]
        boxes = spark.createDataFrame([(i, *[c - s * (0.1 + (i % 5) * 0.02) for c, s in zip(((box.lo[d] + box.hi[d]) / 2 for d in (0, 1)), w, strict=True)], *[c + s * (0.1 + (i % 5) * 0.02) for c, s in zip(((box.lo[d] + box.hi[d]) / 2 for d in (0, 1)), w, strict=True)]) for i in range(a.queries)], "box_id long, lo0 double, lo1 double, hi0 double, hi1 double")
        began = time.time()
        found = query.batch_range(index.all_entries(), boxes, 2, 0.2 * min(w)).count()
        took = time.time() - began
        print(f"{a.queries} boxes, {found} answers: {took:.2f} s, {a.queries / took:.0f} boxes/s")
        mid, singles = [(l + h) / 2 for l, h in zip(box.lo, box.hi, strict=True)], min(a.queries, a.singles)
        arms = {"range": lambda i: index.range_query(BBox([m - s * (0.1 + i % 5 * 0.02) for m, s in zip(mid, w, strict=True)], [m + s * (0.1 + i % 5 * 0.02) for m, s in zip(mid, w, strict=True)])), "knn": lambda i: index.knn([m + s * (i % 5 - 2) * 0.05 for m, s in zip(mid, w, strict=True)], 10)}
        for name, ask in arms.items():
            took = []
            for i in range(singles):
                began = time.perf_counter_ns()
                index.answer(ask(i))
                took.append(time.perf_counter_ns() - began)
            took.sort()
            print(f"{name}: " + ", ".join(f"p{p} {took[min(int(singles * p / 100), singles - 1)]} ns" for p in (50, 95, 99)))
        index.flush_observations()
    elif a.verb in ("visualise", "visualize"):
        index = _need(spark, a.state)
        n, box = aggregate.extent_box(index.all_entries(), 2)
        print(aggregate.raster(index.all_entries(), box) if n else "(empty)")
    elif a.verb == "migrate":
        index = _need(spark, a.state)
        index.force_layout(a.layout)
        print(f"migrated to {index.state['layout']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
