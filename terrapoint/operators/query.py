"""Range, nearest-neighbour and join operators over point DataFrames (id, x0.., any payload columns)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terrapoint.functions import geometry
from terrapoint.staging import staged
from terrapoint.types import BBox, ConfigError, axes

#: Cells of level n are 2^n base cells wide; a box goes to the level where it covers two cells an axis at most.
_LEVELS = 40
#: Ids of a block of spatial_join, and pairs that one of its tasks makes, both about; pairs that are in memory at once.
_BLOCK, _PAIRS, _CHUNK = 512, 64_000_000, 1 << 18
#: Places that one task of knn_join asks for, about.
_ASKED = 25_000


def points(df: DataFrame, id_column: str, coords: list[Column]) -> DataFrame:
    """id and x0.. (double) first, then the columns of df; rows with missing or non-finite coordinates are left out.
    Coordinates stay bare columns or widening casts, so that comparisons with them reach the scan; Spark itself takes
    -0.0 and 0.0 for one value in comparisons, keys and joins."""
    names = axes(len(coords))
    taken = {n.lower() for n in ["id", *names]}
    payload = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    out = df.select(F.col(id_column).cast("long").alias("id"), *[c.cast("double").alias(n) for c, n in zip(coords, names, strict=True)], *payload)
    return out.where(geometry.finite(len(names)))


def range_query(df: DataFrame, box: BBox) -> DataFrame:
    """Rows inside the closed box; the comparisons are pushed to the scan."""
    return df.where(geometry.contains(box))


def knn(df: DataFrame, point, k: int) -> DataFrame:
    """The k nearest rows with their distance, nearest first, ties to the smaller id. One pass with a bounded heap in
    each task."""
    if k < 0:
        raise ConfigError("k is negative")
    return df.withColumn("dist", geometry.distance(point)).orderBy("dist", "id").limit(k)


def nearest(df: DataFrame, point) -> DataFrame:
    return knn(df, point, 1)


def spatial_join(a: DataFrame, b: DataFrame, dims: int) -> DataFrame:
    """(id_a, id_b) of all pairs with equal coordinates; multiplicity is kept. Rows of a place are put in blocks of about
    `_BLOCK` ids, the blocks of equal places are joined, and the joined blocks are dealt out before they become pairs:
    a task holds one block a side, however many pairs a place has, and a crowded place is shared by all tasks. Blocks
    are by hash of the id, so that rows of one id share a block."""
    names = axes(dims)
    sizes = [df.groupBy(*names).agg(F.count(F.lit(1)).alias(f"n_{side}")) for side, df in (("a", a), ("b", b))]
    shared = staged(sizes[0].join(sizes[1], names), "join-places")
    pairs = shared.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0.0
    blocks = [_blocks(df, shared, names, side) for side, df in (("a", a), ("b", b))]
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / _PAIRS))
    dealt = blocks[0].join(blocks[1], names).repartition(tasks, *names, "block_a", "block_b")
    schema = StructType([StructField("id_a", a.schema["id"].dataType), StructField("id_b", b.schema["id"].dataType)])
    return dealt.select("ids_a", "ids_b").mapInArrow(_pairs, schema)


def _pairs(batches):
    """All pairs of the ids of each row's two lists, `_CHUNK` pairs or one row's at a time."""
    for batch in batches:
        (off_a, ids_a), (off_b, ids_b) = ((c.offsets.to_numpy().astype(np.int64), c.values) for c in batch.columns)
        len_b = np.diff(off_b)
        ends = np.cumsum(np.diff(off_a) * len_b)
        starts, row, made = np.concatenate([[0], ends]), 0, 0
        while row < len(ends):
            last = max(row + 1, int(np.searchsorted(ends, made + _CHUNK, side="right")))
            if last == row + 1:
                take_a = np.repeat(np.arange(off_a[row], off_a[last]), len_b[row])
                take_b = np.tile(np.arange(off_b[row], off_b[last]), off_a[last] - off_a[row])
            else:
                of = np.repeat(np.arange(row, last), np.diff(ends[row:last], prepend=made))
                take_a, take_b = np.divmod(np.arange(len(of)) - (starts[of] - made), len_b[of])
                take_a, take_b = take_a + off_a[of], take_b + off_b[of]
            yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(take_a)), ids_b.take(pa.array(take_b))], names=["id_a", "id_b"])
            row, made = last, int(ends[last - 1])


def _blocks(df: DataFrame, shared: DataFrame, names: list[str], side: str) -> DataFrame:
    """ids_<side> by place and block_<side>; few places have more than one block, so that their table is small."""
    crowded = shared.where(F.col(f"n_{side}") > _BLOCK).select(*names, F.ceil(F.col(f"n_{side}") / _BLOCK).alias("blocks_"))
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks_", F.lit(1).cast("long"))).alias(f"block_{side}")
    ids = F.transform(F.collect_list(F.struct("id")), lambda r: r["id"])  # collect_list() alone leaves null ids out
    return df.select("id", *names).join(crowded, names, "left").select("id", *names, block).groupBy(*names, f"block_{side}").agg(ids.alias(f"ids_{side}"))


def _level(dims: int, base: float, prefix: str = "") -> Column:
    """Smallest level whose cells are at least as wide as the box on every axis."""
    width = F.greatest(*[F.col(f"{prefix}hi{d}") - F.col(f"{prefix}lo{d}") for d in range(dims)], F.lit(base))
    return F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.ceil(F.log2(width / base)))).cast("int")


def _cell(x: Column, level: Column, base: float) -> Column:
    return F.floor(x / (F.lit(base) * F.pow(F.lit(2.0), level))).cast("long")


def _covered(boxes: DataFrame, dims: int, base: float, prefix: str = "") -> DataFrame:
    """boxes by each cell of their level they meet: two an axis at most, so 2^dims rows a box."""
    out = boxes.withColumn("level", _level(dims, base, prefix))
    for d in range(dims):
        lo, hi = (_cell(F.col(f"{prefix}{side}{d}"), F.col("level"), base) for side in ("lo", "hi"))
        out = out.withColumn(f"cell{d}", F.explode(F.sequence(lo, hi)))
    return out


def _located(df: DataFrame, dims: int, base: float, levels: list[int]) -> DataFrame:
    """df once for each level, with the point's cell there."""
    out = df.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    return out.withColumns({f"cell{d}": _cell(F.col(f"x{d}"), F.col("level"), base) for d in range(dims)})


def batch_range(df: DataFrame, boxes: DataFrame, dims: int, base: float) -> DataFrame:
    """(box_id, id) and the columns of df for every point in every box (box_id, lo0.., hi0..), without a nested loop:
    an equi-join on cells of the level that suits each box, then the exact test. base: width of the smallest cells,
    about the narrowest box. A point is copied once for each level that some box uses. Where a box is too wide for the
    levels, infinite ones included, boxes are looked up by their part within the extent of the points."""
    if base <= 0:
        raise ConfigError("the base cell has no width")
    right_way_up = boxes.where(" and ".join(f"lo{d} <= hi{d}" for d in range(dims)))
    width = F.greatest(*[F.col(f"hi{d}") - F.col(f"lo{d}") for d in range(dims)])
    used = right_way_up.select(_level(dims, base).alias("level"), (width > base * 2.0**_LEVELS).alias("wide")).distinct().collect()  # 2 * (_LEVELS + 1) at most
    levels = sorted({r["level"] for r in used}) or [0]
    if any(r["wide"] for r in used):
        ends = df.agg(*[f(a).alias(f"{s}{d}") for d, a in enumerate(axes(dims)) for s, f in (("lo", F.min), ("hi", F.max))]).first()
        if ends["lo0"] is None:
            ends = dict.fromkeys(ends.asDict(), 0.0)
        base = max(base, max(ends[f"hi{d}"] - ends[f"lo{d}"] for d in range(dims)) / 2.0 ** (_LEVELS - 1))
        given = right_way_up.select("box_id", *[F.col(f"{s}{d}").alias(f"given_{s}{d}") for d in range(dims) for s in ("lo", "hi")], *[F.greatest(F.col(f"lo{d}"), F.lit(float(ends[f"lo{d}"]))).alias(f"lo{d}") for d in range(dims)], *[F.least(F.col(f"hi{d}"), F.lit(float(ends[f"hi{d}"]))).alias(f"hi{d}") for d in range(dims)])
        right_way_up = given.where(" and ".join(f"lo{d} <= hi{d}" for d in range(dims)))
        levels = sorted(r["level"] for r in right_way_up.select(_level(dims, base).alias("level")).distinct().collect()) or [0]
    covered = _covered(right_way_up, dims, base)
    keys = ["level", *[f"cell{d}" for d in range(dims)]]
    met = _located(df, dims, base, levels).join(covered, keys).where(geometry.contains_columns(dims))
    return met.select("box_id", *[F.col(f"`{c}`") for c in df.columns])


def _crowd(df: DataFrame, boxes: DataFrame, dims: int, base: float) -> DataFrame:
    """box_id and many: the points of the cells that each box meets, from counts by cell; boxes that meet none are
    missing. Never less than the points in the box."""
    levels = sorted(r["level"] for r in boxes.select(_level(dims, base).alias("level")).distinct().collect()) or [0]
    keys = ["level", *[f"cell{d}" for d in range(dims)]]
    cells = _located(df, dims, base, levels).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _covered(boxes, dims, base).join(cells, keys).groupBy("box_id").agg(F.sum("n").alias("many"))


def box_intersect_join(a: DataFrame, b: DataFrame, dims: int, base: float) -> DataFrame:
    """(box_a, box_b) of all boxes that meet, touching included. Both sides go to the coarser level of each pair of
    levels in use, and a pair is reported in the one cell that holds the lower corner of its intersection."""
    ok = " and ".join(f"lo{d} <= hi{d}" for d in range(dims))
    sides = []
    for side, df in (("a", a.where(ok)), ("b", b.where(ok))):
        named = df.select(F.col("box_id").alias(f"box_{side}"), *[F.col(f"{s}{d}").alias(f"{side}_{s}{d}") for d in range(dims) for s in ("lo", "hi")])
        sides.append(named.withColumn("own", _level(dims, base, f"{side}_")))
    used = [sorted(r["own"] for r in s.select("own").distinct().collect()) for s in sides]
    every = sorted(set(used[0]) | set(used[1]))
    made = []
    for side, df in zip("ab", sides, strict=True):
        out = df.withColumn("level", F.explode(F.filter(F.array(*[F.lit(n) for n in every]), lambda n: n >= F.col("own"))))
        for d in range(dims):
            out = out.withColumn(f"cell{d}", F.explode(F.sequence(_cell(F.col(f"{side}_lo{d}"), F.col("level"), base), _cell(F.col(f"{side}_hi{d}"), F.col("level"), base))))
        made.append(out.withColumnRenamed("own", f"own_{side}"))
    keys = ["level", *[f"cell{d}" for d in range(dims)]]
    met = made[0].join(made[1], keys).where(F.col("level") == F.greatest("own_a", "own_b")).where(geometry.intersects(dims, "a_", "b_"))
    first = [F.col(f"cell{d}") == _cell(F.greatest(F.col(f"a_lo{d}"), F.col(f"b_lo{d}")), F.col("level"), base) for d in range(dims)]
    for same in first:
        met = met.where(same)
    return met.select("box_a", "box_b")


def knn_join(df: DataFrame, queries: DataFrame, k: int, dims: int, most_rounds: int = 120) -> DataFrame:
    """(query_id, rank, id, dist): the k nearest points of each query (query_id, q0..). Each round counts, from counts
    by cell, how many points lie about a query's radius: a crowded radius shrinks, all others are asked by batch_range;
    queries that found k are done, the others go on with twice the radius. So a query meets a few times k points,
    whatever the clusters, and of equal points the k smallest ids alone take part. Exact: the k-th distance found is
    never beyond the radius. Queries at one place are asked once, under the smallest query_id, and a task asks for
    `_ASKED` places, however small the files are that hold them."""
    if k < 1:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, dist double")
    names = axes(dims)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    slim = staged(df.select("id", *names).withColumn("place_", place).where(F.col("place_") <= k).drop("place_"), "knn-points")
    facts = slim.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{s}{d}") for d, a in enumerate(names) for s, f in (("lo", F.min), ("hi", F.max))]).first()
    if not facts["n"]:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, dist double")
    spans = [max(facts[f"hi{d}"] - facts[f"lo{d}"], 0.0) for d in range(dims)]
    used = [s for s in spans if s > 0]
    base = (math.prod(used) * k / facts["n"]) ** (1 / len(used)) if used else 1.0
    finest, cap = 2 * base / 2.0**20, 64 * k + 256
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), *[F.col(f"q{d}").cast("double").alias(f"q{d}") for d in range(dims)])
    # A query outside the extent starts with a radius that reaches it.
    outside = F.sqrt(sum((F.pow(F.greatest(F.lit(float(facts[f"lo{d}"])) - F.col(f"q{d}"), F.col(f"q{d}") - F.lit(float(facts[f"hi{d}"])), F.lit(0.0)), 2) for d in range(dims)), F.lit(0.0)))
    farthest = F.sqrt(sum((F.pow(F.greatest(F.abs(F.col(f"q{d}") - F.lit(float(facts[f"lo{d}"]))), F.abs(F.col(f"q{d}") - F.lit(float(facts[f"hi{d}"])))), 2) for d in range(dims)), F.lit(0.0)))
    spot = [f"q{d}" for d in range(dims)]
    given = staged(left, "knn-given")
    left = given.groupBy(*spot).agg(F.min("query_id").alias("query_id")).select("query_id", *spot)
    left = left.withColumns({"radius": outside * 1.0000001 + F.lit(base), "farthest": farthest * 1.0000001, "low": outside})
    left = staged(left, "knn-queries")
    columns = left.columns
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(left.count() / _ASKED))
    around = lambda rows: rows.select(F.col("query_id").alias("box_id"), *[(F.col(f"q{d}") + sign * F.col("radius")).alias(f"{s}{d}") for d in range(dims) for s, sign in (("lo", -1), ("hi", 1))])
    done = None
    for turn in range(most_rounds):
        crowd = _crowd(slim, around(left), dims, finest).withColumnRenamed("box_id", "query_id")
        now = left.join(crowd, "query_id", "left").withColumn("many", F.coalesce("many", F.lit(0)))
        ask = (F.col("many") <= cap) | (F.col("radius") <= 2.0000001 * F.col("low")) | (F.col("radius") <= finest)
        now = staged(now.withColumn("ask", ask), f"knn-crowd-{turn}")
        asked = now.where("ask").select(*columns).repartition(tasks, "query_id")
        near = batch_range(slim, around(asked), dims, finest).withColumnRenamed("box_id", "query_id").repartition(tasks, "query_id").join(asked, "query_id")
        near = near.withColumn("dist", geometry.distance(dims, "q")).where((F.col("dist") <= F.col("radius")) | (F.col("radius") >= F.col("farthest")))
        order = Window.partitionBy("query_id").orderBy("dist", "id")
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = staged(ranked.select("query_id", "rank", "id", "dist"), f"knn-found-{turn}")
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
        state = now.join(enough, "query_id", "left").withColumn("ready", F.col("ask") & ((F.coalesce("got", F.lit(0)) >= k) | (F.col("radius") >= F.col("farthest"))))
        state = staged(state, f"knn-state-{turn}")
        part = found.join(state.where("ready").select("query_id"), "query_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        smaller = F.col("radius") * F.greatest(F.lit(1 / 64), F.pow(F.lit(cap / 8.0) / F.col("many"), F.lit(1.0 / dims)))
        rest = state.where("not ready")
        left = rest.select(*[c for c in columns if c not in ("radius", "low")], F.when(F.col("ask"), F.col("radius") * 2).otherwise(F.greatest(smaller, 2 * F.col("low"))).alias("radius"), F.when(F.col("ask"), F.col("radius")).otherwise(F.col("low")).alias("low")).select(*columns)
        if left.isEmpty():
            first = given.groupBy(*[F.col(q).alias(f"at_{q}") for q in spot]).agg(F.min("query_id").alias("first_"))
            asked_as = given.join(first, [F.col(q).eqNullSafe(F.col(f"at_{q}")) for q in spot]).select("query_id", "first_")
            return asked_as.join(done.withColumnRenamed("query_id", "first_"), "first_").select("query_id", "rank", "id", "dist")
    raise RuntimeError("radii did not reach the points")


def append_ids(existing: DataFrame, arrivals: DataFrame, order: list[str]) -> DataFrame:
    """arrivals with ids that go on from the largest existing one, in the order of the columns given. Numbers come from
    a range partitioning and its row counts, not from one task."""
    top = existing.agg(F.max("id")).first()[0]
    return numbered(arrivals, order, 0 if top is None else top + 1)


def numbered(df: DataFrame, order: list[str], start: int) -> DataFrame:
    """df with id = start, start + 1, ... in the order of the columns given."""
    ranged = staged(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("row_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = {r["part_"]: r["n"] for r in ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, offsets = start, {}
    for p in sorted(sizes):
        offsets[p] = before
        before += sizes[p]
    if not offsets:
        return ranged.select(F.lit(0).cast("long").alias("id"), *df.columns)
    mapping = F.create_map(*[F.lit(v) for p, o in offsets.items() for v in (p, o)])
    return ranged.select((F.element_at(mapping, F.col("part_")) + F.col("row_")).cast("long").alias("id"), *df.columns)


def remove(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    """df without the ids of tombstones; unknown ids change nothing."""
    return df.join(tombstones.select("id").distinct(), "id", "left_anti")


def removed(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows that remove() takes away."""
    return df.join(tombstones.select("id").distinct(), "id", "left_semi")


def flat(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row: the columns of all rows in one flat array of doubles, in order. For small results handed to foreign
    callers; the result is one value, so callers limit df first."""
    packed = F.array(*[F.col(c).cast("double") for c in columns])
    return df.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order, packed.alias("v")))), lambda r: r["v"])).alias("flat"))
